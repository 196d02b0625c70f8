"""Format round trips and shape operators: what is written is read again and must be the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G, rings
from geoquarry.operators import shapes
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.geometry import ring_of
from geoquarry.plans.staging import Staging
from geoquarry.sources import formats, writers
from geoquarry.sources.tables import spread, table
from geoquarry.streaming import ingest


@query("sc1_sk2_geojson_round_trip", fixtures.with_("buildings") + "SELECT cast(building_id AS VARCHAR) AS id, west, south, east, north, usage FROM buildings")
def geojson(spark, sf_dir):
    b = fixtures.buildings(spark, sf_dir)
    at = Staging(spark, "geojson").path("buildings")
    writers.write_geojson_lines(b.select(writers.feature(F.col("building_id"), writers.polygon(ring_of()), F.struct("usage", "levels")).alias("feature")), at)
    back = formats.read_geojson_lines(spark, at)
    shape = F.from_json("geometry", "struct<type:string,coordinates:array<array<array<double>>>>")
    ring = F.transform(shape["coordinates"][0], lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return back.select("id", rings.bbox(ring).alias("box"), F.get_json_object("properties", "$.usage").alias("usage")).select("id", "box.*", "usage")


@query("sc23_sk3_csv_points", fixtures.with_("poi") + "SELECT cast(poi_id AS VARCHAR) AS poi_id, category, lon, lat FROM poi")
def csv_points(spark, sf_dir):
    at = Staging(spark, "csv").path("poi")
    fixtures.poi(spark, sf_dir).withColumnsRenamed({"lon": "Longitude", "lat": "Latitude"}).write.csv(at, header=True)
    return formats.read_csv_points(spark, at)


@query("sk4_sc24_kml_round_trip", fixtures.with_("stops") + "SELECT 'stop <' || stop_id || '> & co' AS name, lon, lat FROM stops")
def kml(spark, sf_dir):
    at = Staging(spark, "kml").path("stops")
    name = F.concat(F.lit("stop <"), F.col("stop_id").cast("string"), F.lit("> & co"))
    fixtures.stops(spark, sf_dir).select(writers.placemark(name, F.col("lon"), F.col("lat"))).write.text(at)
    return formats.read_kml_points(spark, at)


@query(
    "sf31_csv_fields",
    """SELECT doc_id, md5(CASE WHEN regexp_matches(coalesce(text, ''), '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END) AS field FROM documents""",
)
def csv_fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(writers.csv_field(F.col("text")).cast("binary")).alias("field"))


@query(
    "sc5_size_texts",
    "SELECT p_partkey AS id, cast(p_size * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS BIGINT) AS bytes FROM part",
)
def sizes(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.col("p_size").cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, " kb").otherwise("MB"))
    return table(spark, sf_dir, "part").select(k.alias("id"), formats.size_bytes(text).alias("bytes"))


def pairs(west="west", south="south", east="east", north="north"):
    p = lambda x, y: F.array(F.col(x), F.col(y))
    return F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))


def as_points(c):
    return F.transform(c, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


@query(
    "sf31_file_names",
    r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(n), '[\\/:*?"<>|]+', '-', 'g'), '\s+', '-', 'g'), ''), 'export') AS name FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '?a=1  b' WHEN 2 THEN ' ' END AS n FROM pages)""",
)
def file_names(spark, sf_dir):
    """Names of files for pages' addresses, some with white space, blank or missing."""
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit("?a=1  b"))).when(k == 2, " ")
    return table(spark, sf_dir, "pages").select("page_id", writers.file_name(name).alias("name"))


@query(
    "ge12_clipped_to_box",
    fixtures.with_("buildings")
    + """SELECT building_id, round((least(east, 37.6::DOUBLE) - greatest(west, 37.5503::DOUBLE)) * (least(north, 55.7::DOUBLE) - greatest(south, 55.6103::DOUBLE)), 12) AS planar
    FROM buildings WHERE east > 37.5503 AND west < 37.6 AND north > 55.6103 AND south < 55.7""",
)
def clip(spark, sf_dir):
    """Box test on columns first; only rings that meet the box are cut."""
    b = spread(fixtures.buildings(spark, sf_dir).where("east > 37.5503 AND west < 37.6 AND north > 55.6103 AND south < 55.7").select("building_id", "west", "south", "east", "north"), "building_id")
    edge = [F.lit(x) for x in (37.5503, 55.6103, 37.6, 55.7)]
    frame = F.array(*[G.point(edge[i], edge[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))])
    cut = G.clipped_to_ring(as_points(pairs()).cast(G.POSITIONS), frame)
    return b.select("building_id", F.round(rings.planar_area(cut), 12).alias("planar"))


@query(
    "ge10_ge11_ge23_shapes",
    fixtures.with_("buildings") + "SELECT building_id, 5 AS simple, 5 AS hull, building_id % 2 = 1 AS crosses FROM buildings",
)
def shape_measures(spark, sf_dir):
    """Boxes with the middle of each side added: simplification and hull give back the corners; odd ones are tied into a bow."""
    b = spread(fixtures.buildings(spark, sf_dir).select("building_id", "west", "south", "east", "north"), "building_id")
    corner = pairs()
    middle = lambda i: F.array((corner[i][0] + corner[i + 1][0]) / 2, (corner[i][1] + corner[i + 1][1]) / 2)
    dense = F.array(*[x for i in range(4) for x in (corner[i], middle(i))], corner[4])
    bow = F.when(F.col("building_id") % 2 == 1, F.array(*[corner[i] for i in (0, 2, 1, 3, 0)])).otherwise(corner)
    return b.select(
        "building_id",
        F.size(shapes.simplify(dense, F.lit(0.5))).alias("simple"),
        F.size(shapes.convex_hull(dense)).alias("hull"),
        G.crosses_itself(as_points(bow)).alias("crosses"),
    )


@query(
    "str1_windowed_counts",
    "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
)
def windowed(spark, sf_dir):
    """The streaming aggregation over a table; tests run it on a stream."""
    return ingest.windowed_counts(table(spark, sf_dir, "events"))
