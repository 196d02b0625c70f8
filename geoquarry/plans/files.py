"""Files and payloads: what is written is read back, and payloads of services are decoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G, rings, tiles
from geoquarry.operators import chunks
from geoquarry.operators.prefix import running_total
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.figures import FIGURE_SQL, _sql_line, ELL, ells, figures
from geoquarry.plans.geometry import ring_of
from geoquarry.plans.staging import Staging
from geoquarry.sources import formats, geometry_text as T, writers
from geoquarry.sources.tables import table

BOX = "37.52,55.61,37.6,55.7"


def building_features(spark, sf_dir):
    b = fixtures.buildings(spark, sf_dir)
    return b.withColumn("feature", writers.feature(F.col("building_id"), writers.polygon(ring_of()), F.struct("usage", "levels")))


def boxed(features):
    """Features (geometry text) with their boxes as columns."""
    b = G.bbox(T.from_geojson(F.col("geometry")))
    return features.withColumn("b", b).select("*", "b.*").drop("b")


@query("sc2_box_scan", fixtures.with_("buildings") + "SELECT cast(building_id AS VARCHAR) AS id FROM buildings WHERE west <= 37.6 AND east >= 37.52 AND south <= 55.7 AND north >= 55.61")
def box_scan(spark, sf_dir):
    """A box as a service's parameter, a scan of files, and what meets the box."""
    at = Staging(spark, "scan").path("buildings")
    writers.write_geojson_lines(building_features(spark, sf_dir), at)
    return formats.in_box(boxed(formats.read_geojson_lines(spark, at)), formats.parse_box(BOX)).select("id")


TILE_SQL = "cast(floor(({lon} + 180)/360*16384) AS BIGINT)", "cast(floor((1 - ln(tan(radians({lat})) + 1/cos(radians({lat})))/pi())/2*16384) AS BIGINT)"


@query(
    "sc3_footprint_partitions",
    fixtures.with_("buildings")
    + f""", t AS (SELECT *, {TILE_SQL[0].format(lon="west")} AS x, {TILE_SQL[1].format(lat="south")} AS y FROM buildings),
    z AS (SELECT {TILE_SQL[0].format(lon="37.52::DOUBLE")} AS x0, {TILE_SQL[0].format(lon="37.6::DOUBLE")} AS x1, {TILE_SQL[1].format(lat="55.7::DOUBLE")} AS y0, {TILE_SQL[1].format(lat="55.61::DOUBLE")} AS y1)
    SELECT cast(building_id AS VARCHAR) AS id FROM t, z WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND NOT ((x & 1) = 1 AND (y & 1) = 1) AND west <= 37.6 AND east >= 37.52 AND south <= 55.7 AND north >= 55.61""",
)
def footprint_partitions(spark, sf_dir):
    """Gzip line files by quadkey and their index; the files of a box's tiles are read, but those above the size limit."""
    staging = Staging(spark, "footprints")
    at, index = staging.path("parts"), staging.path("index")
    zoom = 14
    f = building_features(spark, sf_dir)
    key = tiles.quadkey(tiles.tile_x(F.col("west"), zoom), tiles.tile_y(F.col("south"), zoom), zoom)
    f = f.select("feature", key.alias("quadkey"))
    f.repartition("quadkey").write.partitionBy("quadkey").option("compression", "gzip").text(at)
    size = F.when(F.col("QuadKey").endswith("3"), "200MB").otherwise("1.5 MB")
    rows = f.select(F.col("quadkey").alias("QuadKey")).distinct()
    rows.select(F.lit("Town").alias("Location"), "QuadKey", F.concat(F.lit(at + "/quadkey="), F.col("QuadKey")).alias("Url"), size.alias("Size")).write.csv(index, header=True)
    box = formats.parse_box(BOX)
    got, _ = formats.read_quadkey_partitions(spark, index, box, zoom, max_files=4096)
    return formats.in_box(boxed(got), box).select("id") if got is not None else spark.createDataFrame([], "id string")


@query(
    "sc6_sc7_dem_samples",
    """WITH g AS (SELECT r, c, (r*7 + c*13) % 101 AS e FROM (SELECT unnest(generate_series(0, 59)) AS r), (SELECT unnest(generate_series(0, 49)) AS c) WHERE (r + c) % 17 <> 0)
    SELECT cast(r AS INT) AS row, cast(c AS INT) AS col, round(37.5::DOUBLE + 0.001::DOUBLE/2 + c*0.001::DOUBLE, 9) AS lon, round(55.6::DOUBLE + 0.001::DOUBLE/2 + (59 - r)*0.001::DOUBLE, 9) AS lat, cast(e AS DOUBLE) AS elevation FROM g WHERE r % 3 = 0 AND c % 3 = 0""",
)
def dem_samples(spark, sf_dir):
    """An ASCII grid of 60 by 50 cells with gaps, thinned to at most 400 samples."""
    at = Staging(spark, "dem").path("grid")
    cell = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda c: F.when((F.col("id") + c) % 17 == 0, F.lit(-9999)).otherwise((F.col("id") * 7 + c * 13) % 101).cast("string"))
    lines = spark.range(60).select("id", F.array_join(cell, " ").alias("line"))
    head = "ncols 50\nnrows 60\nxllcorner 37.5\nyllcorner 55.6\ncellsize 0.001\nNODATA_value -9999\n"
    grid = lines.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("body"))  # sixty lines
    grid.select(F.concat(F.lit(head), "body")).write.text(at)
    s = formats.sampled(formats.read_ascii_grid(spark, at), 400)
    return s.select("row", "col", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "elevation")


@query(
    "sc8_sc12_request_tiles",
    fixtures.with_("territories")
    + """, q AS (SELECT territory_id, 'quadrant' AS kind, i, CASE WHEN i % 2 = 0 THEN west ELSE (west+east)/2 END AS w, CASE WHEN i < 2 THEN south ELSE (south+north)/2 END AS s FROM territories, (SELECT unnest([0,1,2,3]) AS i)),
    t AS (SELECT territory_id, 'tile' AS kind, i, west + (east-west)/2*(i % 2) AS w, south + (north-south)/2*(i // 2) AS s FROM territories, (SELECT unnest([0,1,2,3]) AS i)),
    p AS (SELECT territory_id, 'sample' AS kind, r*5 + c AS i, west + (east-west)*c/4 AS w, south + (north-south)*r/4 AS s FROM territories, (SELECT unnest([0,1,2,3,4]) AS r), (SELECT unnest([0,1,2,3,4]) AS c))
    SELECT territory_id, kind, cast(i AS INT) AS i, round(w, 9) AS west, round(s, 9) AS south FROM q UNION ALL SELECT territory_id, kind, cast(i AS INT), round(w, 9), round(s, 9) FROM t UNION ALL SELECT territory_id, kind, cast(i AS INT), round(w, 9), round(s, 9) FROM p""",
)
def request_tiles(spark, sf_dir):
    """Boxes of requests: quadrants of a large box, tiles of 0.035 degrees (at most 12 on an axis), and a lattice of 5 by 5 samples."""
    t = fixtures.territories(spark, sf_dir)
    made = [(name, f()) for name, f in (("quadrant", quadrants), ("tile", lambda: split_tiles(0.035, 12)), ("sample", lambda: lattice(5)))]
    out = None
    for name, parts in made:
        p = t.select("territory_id", F.lit(name).alias("kind"), F.posexplode(parts).alias("i", "b")).select("territory_id", "kind", "i", F.round("b.west", 9).alias("west"), F.round("b.south", 9).alias("south"))
        out = p if out is None else out.unionByName(p)
    return out


def _box(w, s, e, n):
    return F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))


def quadrants():
    """Four quarters of a box: south-west, south-east, north-west, north-east."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    x, y = (w + e) / 2, (s + n) / 2
    return F.array(_box(w, s, x, y), _box(x, s, e, y), _box(w, y, x, n), _box(x, y, e, n))


def split_tiles(size: float, most: int):
    """Equal tiles of about ``size`` degrees row by row from the south-west; the outer edges are exact."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    count = lambda a, b: F.least(F.greatest(F.ceil(F.greatest(b - a, F.lit(0.0)) / size), F.lit(1)), F.lit(most)).cast("int")
    cols, rows = count(w, e), count(s, n)
    wide, high = (e - w) / cols, (n - s) / rows
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: _box(w + wide * c, s + high * r, F.when(c == cols - 1, e).otherwise(w + wide * (c + 1)), F.when(r == rows - 1, n).otherwise(s + high * (r + 1))))))


def lattice(side: int):
    """Points of a square lattice over a box, edges included."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    at = lambda a, b, i: a + (b - a) * i / (side - 1)
    span = F.sequence(F.lit(0), F.lit(side - 1))
    return F.flatten(F.transform(span, lambda r: F.transform(span, lambda c: _box(at(w, e, c), at(s, n, r), at(w, e, c), at(s, n, r)))))


@query(
    "sc9_nearest_cells",
    fixtures.with_("poi")
    + """, g AS (SELECT r, c, (r*7 + c*13) % 101 AS e FROM (SELECT unnest(generate_series(0, 199)) AS r), (SELECT unnest(generate_series(0, 199)) AS c)),
    p AS (SELECT poi_id, cast(greatest(0, least(199, floor((lon - 37.5::DOUBLE)/0.001::DOUBLE))) AS INT) AS c, cast(greatest(0, least(199, floor((55.8::DOUBLE - lat)/0.001::DOUBLE))) AS INT) AS r FROM poi),
    v AS (SELECT poi_id, cast(floor((e + 10000)*10 + 0.5) AS BIGINT) AS v FROM p JOIN g USING (r, c)) SELECT poi_id, (v >> 16) & 255 AS r, (v >> 8) & 255 AS g, v & 255 AS b FROM v""",
)
def nearest_cells(spark, sf_dir):
    """Each place with the elevation of the grid cell it lies in, as three bytes; places outside take the nearest edge cell."""
    g = spark.range(200 * 200).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col")).withColumn("e", ((F.col("row") * 7 + F.col("col") * 13) % 101).cast("double"))
    at = lambda v: F.greatest(F.lit(0), F.least(F.lit(199), F.floor(v))).cast("int")
    p = fixtures.poi(spark, sf_dir).select("poi_id", at((F.lit(55.8) - F.col("lat")) / F.lit(0.001)).alias("row"), at((F.col("lon") - F.lit(37.5)) / F.lit(0.001)).alias("col"))
    v = F.floor((F.col("e") + 10000) * 10 + 0.5)
    part = lambda n: F.shiftright(v, n).bitwiseAND(F.lit(255))
    return p.join(g, ["row", "col"]).select("poi_id", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


@query("sc13_gml_members", fixtures.with_("roads") + """SELECT CASE WHEN road_id % 2 = 0 THEN 'LineString' ELSE 'Point' END AS type, count(*) AS n, round(sum(lon1), 6) AS lon FROM roads GROUP BY 1""")
def gml_members(spark, sf_dir):
    """GML members with one position or two, a file each hundred."""
    at = Staging(spark, "gml").path("members")
    pos = lambda x, y: F.concat(F.lit("<gml:pos>"), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit("</gml:pos>"))
    r = fixtures.roads(spark, sf_dir)
    body = F.concat(F.lit("<gml:featureMember>"), pos("lon1", "lat1"), F.when(F.col("road_id") % 2 == 0, pos("lon2", "lat2")).otherwise(""), F.lit("</gml:featureMember>"))
    r.select(body).write.text(at)
    g = formats.read_gml(spark, at).select("g")
    return g.groupBy("g.type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("g.parts")[0][0][0]["lon"]), 6).alias("lon"))


@query(
    "sc14_esri_features",
    FIGURE_SQL + " SELECT id, CASE type WHEN 'Polygon' THEN 'MultiPolygon' ELSE type END AS type, round(list_sum(list_transform(flatten(flatten(parts)), lambda p: p.lon)), 6) AS lons FROM f WHERE type IN ('Point','LineString','MultiLineString','Polygon')",
)
def esri_features(spark, sf_dir):
    """Esri JSON of points, paths and rings back to geometries; several rings become several polygons."""
    at = Staging(spark, "esri").path("features")
    f = figures(spark, sf_dir).where("g.type IN ('Point', 'LineString', 'MultiLineString', 'Polygon')")
    pairs = F.to_json(F.transform(F.flatten("g.parts"), lambda line: F.transform(line, lambda p: F.array(p["lon"], p["lat"]))))
    p = F.flatten(F.flatten("g.parts"))[0]
    geometry = F.when(F.col("g.type") == "Point", F.to_json(F.struct(p["lon"].alias("x"), p["lat"].alias("y")))).when(F.col("g.type") == "Polygon", F.concat(F.lit('{"rings":'), pairs, F.lit("}"))).otherwise(F.concat(F.lit('{"paths":'), pairs, F.lit("}")))
    doc = F.concat(F.lit('{"features":[{"attributes":{"OBJECTID":'), F.col("id").cast("string"), F.lit('},"geometry":'), geometry, F.lit("}]}"))
    f.select(doc.alias("value")).write.text(at)
    rows = spark.read.text(at).select(F.explode(F.from_json("value", "struct<features:array<struct<attributes:string,geometry:string>>>")["features"]).alias("f"))
    g = rows.select(F.get_json_object("f.attributes", "$.OBJECTID").cast("long").alias("id"), T.from_esri(F.col("f.geometry")).alias("g"))
    lons = F.aggregate(G.positions(F.col("g")), F.lit(0.0), lambda s, p: s + p["lon"])
    return g.select("id", "g.type", F.round(lons, 6).alias("lons"))


@query(
    "sc15_catalogs",
    """SELECT s_suppkey AS id, 'http://x/' || s_suppkey || '/' || i AS url, CASE WHEN i = 0 THEN 'CSV' END AS format FROM supplier, (SELECT unnest([0, 1]) AS i) WHERE i < s_suppkey % 3
    UNION ALL SELECT s_suppkey, 'http://a/' || s_suppkey, 'image/tiff' FROM supplier WHERE s_suppkey % 2 = 0""",
)
def catalogs(spark, sf_dir):
    """Resources of catalogue records and assets of items, a row each; they carry no geometry."""
    k = F.col("s_suppkey").cast("string")
    resource = lambda i, more: F.concat(F.lit('{"url":"http://x/'), k, F.lit(f'/{i}"{more}}}'))
    two = F.when(F.col("s_suppkey") % 3 == 0, F.lit('{"name":"no url"}')).when(F.col("s_suppkey") % 3 == 1, resource(0, ',"format":"CSV"')).otherwise(F.concat_ws(",", resource(0, ',"format":"CSV"'), resource(1, "")))
    s = table(spark, sf_dir, "supplier")
    ckan = s.select(F.col("s_suppkey").alias("id"), F.explode(formats.catalog_resources(F.concat(F.lit('{"resources":['), two, F.lit("]}")))).alias("r")).select("id", "r.url", "r.format")
    asset = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"href":"http://a/'), k, F.lit('","type":"image/tiff"}'))).otherwise(F.lit('{"type":"none"}'))
    stac = s.select(F.col("s_suppkey").alias("id"), F.explode(formats.catalog_assets(F.concat(F.lit('{"assets":{"main":'), asset, F.lit("}}")))).alias("a")).select("id", F.col("a.href").alias("url"), F.col("a.type").alias("format"))
    return ckan.unionByName(stac)


@query("sc18_labelled_places", fixtures.with_("poi") + "SELECT poi_id, 'wikidata' AS category, category AS subtype FROM poi WHERE poi_id % 13 <> 0 ORDER BY poi_id LIMIT 500")
def labelled_places(spark, sf_dir):
    """The first five hundred places of a box that have coordinates, as points of interest."""
    p = fixtures.poi(spark, sf_dir).withColumn("lon", F.when(F.col("poi_id") % 13 != 0, F.col("lon")))
    return p.where("lon IS NOT NULL").orderBy("poi_id").limit(500).select("poi_id", F.lit("wikidata").alias("category"), F.col("category").alias("subtype"))


@query("sc19_first_elevations", fixtures.with_("terrain") + "SELECT terrain_id, elevation FROM terrain WHERE elevation IS NOT NULL")
def first_elevations(spark, sf_dir):
    """Of the elevation sources in order the first that has samples."""
    t = fixtures.terrain(spark, sf_dir).select("terrain_id", "elevation")
    return formats.first_with_rows([t.where("elevation > 1e12"), t.where("elevation IS NOT NULL"), t])


@query(
    "sk2_feature_collections",
    fixtures.with_("buildings") + "SELECT cast(building_id AS VARCHAR) AS id, usage, 'p1' AS project FROM buildings",
)
def feature_collections(spark, sf_dir):
    """FeatureCollections of at most a thousand features with the project's block, written and read again."""
    at = Staging(spark, "collections").path("documents")
    project = F.to_json(F.struct(F.lit("p1").alias("id"), F.lit("EPSG:4326").alias("crs")))
    docs = writers.collections(building_features(spark, sf_dir), F.floor(F.col("building_id") / 1000), project)
    docs.select("document").write.text(at)
    back = spark.read.text(at).select(F.explode(formats.features_of(F.col("value"))).alias("f"), F.get_json_object("value", "$.project.id").alias("project"))
    return back.select("f.id", F.get_json_object("f.properties", "$.usage").alias("usage"), "project")


@query("sk3_csv_columns", fixtures.with_("buildings") + "SELECT cast(building_id AS VARCHAR) AS id, 'building, \"' || usage || '\"' || chr(10) || 'x' AS name, height, west AS lon, south AS lat FROM buildings")
def csv_columns(spark, sf_dir):
    """A CSV export of the default columns, with quotes and line breaks in a name, read as points."""
    at = Staging(spark, "csv").path("entities")
    b = fixtures.buildings(spark, sf_dir)
    name = F.concat(F.lit('building, "'), F.col("usage"), F.lit('"\nx'))
    writers.write_csv(b.select(F.col("building_id").alias("id"), F.lit("building").alias("type"), name.alias("name"), "height", F.col("west").alias("longitude"), F.col("south").alias("latitude")), at)
    p = formats.read_csv_points(spark, at)
    first = next(c for c in p.columns if c.endswith("id"))
    return p.select(F.col(f"`{first}`").alias("id"), "name", F.col("height").cast("double").alias("height"), "lon", "lat")


@query(
    "sk4_sc24_kml_shapes",
    FIGURE_SQL + """ SELECT 'n<' || id || '>' AS name, type, CASE type WHEN 'Point' THEN 1 WHEN 'LineString' THEN len(parts[1][1]) ELSE len(parts[1][1]) + 1 END AS positions, round(parts[1][1][1].lat, 9) AS lat FROM f WHERE type IN ('Point', 'LineString', 'Polygon')""",
)
def kml_shapes(spark, sf_dir):
    """Points, lines and polygons with holes as placemarks with extended data, read again (a polygon's first ring, closed once more)."""
    at = Staging(spark, "kml").path("marks")
    f = figures(spark, sf_dir).where("g.type IN ('Point', 'LineString', 'Polygon')")
    name = F.concat(F.lit("n<"), F.col("id").cast("string"), F.lit(">"))
    f.select(writers.placemarks(name, F.lit("building"), F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("a<b"), F.lit("'c'")), T.to_kml(F.col("g")))).write.text(at)
    k = formats.read_kml(spark, at)
    return k.select("name", "g.type", F.size(G.positions(F.col("g"))).alias("positions"), F.round(G.positions(F.col("g"))[0]["lat"], 9).alias("lat"))


@query(
    "sk5_sc27_dxf_shapes",
    FIGURE_SQL + """ SELECT layer, type, count(*) AS n, round(sum(lat), 6) AS lat FROM (SELECT 'l' || id % 3 AS layer, type, unnest(CASE WHEN type = 'Polygon' THEN list_transform(parts[1], lambda r: r[1].lat) ELSE [parts[1][1][1].lat] END) AS lat FROM f WHERE type IN ('Point', 'LineString', 'Polygon')) GROUP BY 1, 2""",
)
def dxf_shapes(spark, sf_dir):
    """Points and polylines of DXF sections, a section a feature, read again; every ring is a polyline of its own."""
    at = Staging(spark, "dxf").path("sections")
    f = figures(spark, sf_dir).where("g.type IN ('Point', 'LineString', 'Polygon')")
    layer = F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))
    body = T.to_dxf(F.col("g"), layer, F.lit(7.5))
    section = F.concat(F.array(F.lit("0"), F.lit("SECTION"), F.lit("2"), F.lit("ENTITIES")), body, F.array(F.lit("0"), F.lit("ENDSEC")))
    f.select(F.array_join(section, "\n")).write.option("maxRecordsPerFile", 20_000).text(at)  # a file is read whole by one task
    d = formats.read_dxf(spark, at)
    return d.groupBy(F.get_json_object("properties", "$.layer").alias("layer"), "g.type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(G.positions(F.col("g"))[0]["lat"]), 6).alias("lat"))


@query("sk6_obj_prisms", fixtures.with_("buildings") + "SELECT building_id, 13 AS lines, 'f ' || string_agg(cast(n AS VARCHAR), ' ' ORDER BY n) AS roof FROM (SELECT building_id, unnest([5, 6, 7, 8]) + 8*building_id AS n FROM buildings) GROUP BY building_id")
def obj_prisms(spark, sf_dir):
    """Extruded footprints as OBJ lines: eight vertices, four walls and the roof, numbered on from those before."""
    b = fixtures.buildings(spark, sf_dir)
    corners = F.slice(ring_of(), 1, 4)
    o = b.select("building_id", writers.prism(corners, F.coalesce("height", F.lit(3.0)), F.col("building_id") * 8).alias("o"))
    return o.select("building_id", F.size("o").alias("lines"), F.get("o", F.size("o") - 1).alias("roof"))


@query(
    "sk6_running_vertices",
    fixtures.with_("buildings")
    + """, n AS (SELECT building_id, 2*(4 + building_id % 3) AS v FROM buildings), o AS (SELECT building_id, v // 2 AS k, coalesce(sum(v) OVER (ORDER BY building_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n)
    SELECT building_id, cast(3*k + 1 AS BIGINT) AS lines, 'f ' || array_to_string(list_transform(range(k, 2*k), lambda i: cast(first + 1 + i AS BIGINT)), ' ') AS roof FROM o""",
)
def running_vertices(spark, sf_dir):
    """Prisms of four to six corners, whose vertices are numbered on by the running sum of those of all prisms before."""
    b, m = fixtures.buildings(spark, sf_dir), (F.col("building_id") % 3).cast("int")
    ring = ring_of()
    side = lambda i: F.transform(F.slice(ring, i, 1), lambda p: G.point(p["lon"], (p["lat"] + F.col("north")) / 2))  # noqa: E731  one more corner on a side
    corners = F.concat(F.slice(ring, 1, 2), F.when(m > 0, side(2)).otherwise(F.array().cast(G.POSITIONS)), F.slice(ring, 3, 2).cast(G.POSITIONS), F.when(m > 1, side(1)).otherwise(F.array().cast(G.POSITIONS)))
    c = b.select("building_id", corners.alias("corners"), F.coalesce("height", F.lit(3.0)).alias("height"))
    placed = running_total(c, ("building_id",), F.size("corners") * 2, "offset", Staging(spark, "vertices"))
    o = placed.select("building_id", writers.prism(F.col("corners"), F.col("height"), F.col("offset")).alias("o"))
    return o.select("building_id", F.size("o").cast("long").alias("lines"), F.get("o", F.size("o") - 1).alias("roof"))


@query("sk7_gltf_nodes", FIGURE_SQL + " SELECT id, 'shape-' || id AS name, type FROM f")
def gltf_nodes(spark, sf_dir):
    """Nodes and meshes of a scene without buffers, read again."""
    f = figures(spark, sf_dir)
    node = T.gltf_node(F.concat(F.lit("shape-"), F.col("id").cast("string")), F.col("id"), T.to_geojson(F.col("g")), F.struct("size"))
    n = f.select("id", node.alias("n"))
    return n.select("id", F.get_json_object("n", "$.name").alias("name"), F.get_json_object(F.get_json_object("n", "$.geometry"), "$.type").alias("type"))


@query("ge30_geojson_geometries", FIGURE_SQL + " SELECT id, type, len(flatten(flatten(parts))) AS positions, true AS same FROM f")
def geojson_geometries(spark, sf_dir):
    """Geometries of all types to GeoJSON and back."""
    f = figures(spark, sf_dir).select("id", "g", T.to_geojson(F.col("g")).alias("t"))
    f = f.withColumn("h", T.from_geojson(F.col("t")))
    return f.select("id", "h.type", F.size(G.positions(F.col("h"))).alias("positions"), (F.col("g") == F.col("h")).alias("same"))


@query(
    "sc28_sk9_formats",
    "SELECT * FROM (VALUES ('csv', 'read', 'ready'), ('dem', 'read', 'unsupported'), ('dxf', 'read', 'ready'), ('geojson', 'read', 'ready'), ('geoparquet', 'read', 'unsupported'), ('geotiff', 'read', 'unsupported'), ('kml', 'read', 'ready'), ('raster-dem', 'read', 'unsupported'), ('csv', 'write', 'ready'), ('geoparquet', 'write', 'unsupported'), ('mbtiles', 'write', 'unsupported'), ('pmtiles', 'write', 'unsupported')) v(format, way, status)",
)
def format_states(spark, sf_dir):
    """Which formats are read and written, as the registries say; known ones without a reader or writer are unsupported."""

    def state(find, name):
        try:
            find(name)
        except NotImplementedError:
            return "unsupported"
        return "ready"

    rows = [(n, "read", state(formats.reader, n)) for n in ("csv", "dem", "dxf", "geojson", "geoparquet", "geotiff", "kml", "raster-dem")] + [(n, "write", state(writers.writer, n)) for n in ("csv", "geoparquet", "mbtiles", "pmtiles")]
    return spark.createDataFrame(rows, "format string, way string, status string")


@query(
    "sc29_dataset_layers",
    FIGURE_SQL + """ SELECT 'd' || id % 4 AS dataset, count(*) AS features, arg_min(type, id) AS geometry_type, min(list_min(list_transform(flatten(flatten(parts)), lambda p: p.lon))) AS west, max(list_max(list_transform(flatten(flatten(parts)), lambda p: p.lat))) AS north FROM f GROUP BY 1""",
)
def dataset_layers(spark, sf_dir):
    """A layer row of each imported dataset: features, type of the first geometry, bounds."""
    f = figures(spark, sf_dir)
    b = G.bbox(F.col("g"))
    return f.groupBy(F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("dataset")).agg(F.count(F.lit(1)).alias("features"), F.min_by("g.type", "id").alias("geometry_type"), F.min(b["west"]).alias("west"), F.max(b["north"]).alias("north"))


def put(spark, path: str, data: bytes) -> None:
    """A small file into the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data))
    out.close()


@query(
    "sc26_geopackage",
    f"""SELECT n_nationkey AS id, n_name AS name, 'Polygon' AS type, 7 AS positions, round(37.5::DOUBLE + cast(n_nationkey % 5 AS DOUBLE)*0.04::DOUBLE + 8*0.004::DOUBLE, 9) AS east FROM nation""",
)
def geopackage(spark, sf_dir):
    """A package of the nations' territories, as other programs write it, decoded on Spark."""
    import sqlite3
    import struct

    rows = ells(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory_id"), "n_name"), "territory_id").collect()  # 25 nations
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('areas', 'geom')")
    con.execute("CREATE TABLE areas (id INTEGER, name TEXT, geom BLOB)")
    for r in rows:
        ring = [(p["lon"], p["lat"]) for p in r["ring"]]
        blob = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
        con.execute("INSERT INTO areas VALUES (?, ?, ?)", (r["territory_id"], r["n_name"], blob))
    con.commit()
    at = Staging(spark, "package").path("areas.gpkg")
    put(spark, at, con.serialize())
    g = formats.read_geopackage(spark, at)
    return g.select(F.get_json_object("properties", "$.id").cast("int").alias("id"), F.get_json_object("properties", "$.name").alias("name"), "g.type", F.size(G.positions(F.col("g"))).alias("positions"), F.round(G.bbox(F.col("g"))["east"], 9).alias("east"))


@query(
    "sc25_shapefile",
    f"""SELECT n_nationkey AS id, n_name AS name, 'Polygon' AS type, 7 AS positions, round(55.6::DOUBLE + cast((n_nationkey - n_nationkey % 5)/5 AS DOUBLE)*0.04::DOUBLE + 9*0.004::DOUBLE, 9) AS north FROM nation""",
)
def shapefile(spark, sf_dir):
    """A zipped Shapefile of the nations' territories with its table, decoded on Spark."""
    import io
    import struct
    import zipfile

    rows = ells(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory_id"), "n_name"), "territory_id").collect()  # 25 nations
    shapes, records = b"", b""
    for i, r in enumerate(rows):
        ring = [(p["lon"], p["lat"]) for p in reversed(r["ring"])]
        body = struct.pack("<i4d2ii", 5, 0, 0, 0, 0, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        shapes += struct.pack(">2i", i + 1, len(body) // 2) + body
        records += b" " + str(r["territory_id"]).rjust(6).encode() + r["n_name"].ljust(25).encode()
    field = lambda name, kind, size: name.ljust(11, "\0").encode() + kind.encode() + b"\0" * 4 + bytes([size, 0]) + b"\0" * 14
    table_ = struct.pack("<B3BIHH20x", 3, 26, 1, 1, len(rows), 32 + 64 + 1, 32) + field("ID", "N", 6) + field("NAME", "C", 25) + b"\r" + records
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("areas.shp", b"\0" * 100 + shapes)
        z.writestr("areas.dbf", table_)
    at = Staging(spark, "shapes").path("areas.zip")
    put(spark, at, held.getvalue())
    g = formats.read_shapefiles(spark, at)
    return g.select(F.get_json_object("properties", "$.ID").cast("int").alias("id"), F.get_json_object("properties", "$.NAME").alias("name"), "g.type", F.size(G.positions(F.col("g"))).alias("positions"), F.round(G.bbox(F.col("g"))["north"], 9).alias("north"))


@query(
    "wn4_tp7_budget_chunks",
    """WITH RECURSIVE n AS (SELECT o_orderpriority AS layer, o_custkey % 50 AS cell, o_orderkey AS id, 200 + o_orderkey % 900 AS size, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 50 ORDER BY o_orderkey) AS rn FROM orders),
    r AS (SELECT layer, cell, rn, id, 0::BIGINT AS chunk, 1 AS held, size AS bytes FROM n WHERE rn = 1
      UNION ALL SELECT n.layer, n.cell, n.rn, n.id, CASE WHEN held >= 8 OR bytes + size > 4096 THEN chunk + 1 ELSE chunk END, CASE WHEN held >= 8 OR bytes + size > 4096 THEN 1 ELSE held + 1 END, CASE WHEN held >= 8 OR bytes + size > 4096 THEN size ELSE bytes + size END
      FROM r JOIN n ON n.layer = r.layer AND n.cell = r.cell AND n.rn = r.rn + 1)
    SELECT layer, cell, id, chunk FROM r""",
)
def budget_chunks(spark, sf_dir):
    """Features of each layer and cell in chunks of at most 8 features and 4096 bytes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("layer"), (F.col("o_custkey") % 50).alias("cell"), F.col("o_orderkey").alias("id"), (200 + F.col("o_orderkey") % 900).alias("size"))
    return chunks.by_budget(o, ("layer", "cell"), "id", "size", 8, 4096, Staging(spark, "chunks"))


@query(
    "wn4_one_large_group",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS id, 200 + o_orderkey % 900 AS size, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
    r AS (SELECT rn, id, 0::BIGINT AS chunk, 1 AS held, size AS bytes FROM n WHERE rn = 1
      UNION ALL SELECT n.rn, n.id, CASE WHEN held >= 100 OR bytes + size > 60000 THEN chunk + 1 ELSE chunk END, CASE WHEN held >= 100 OR bytes + size > 60000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 100 OR bytes + size > 60000 THEN size ELSE bytes + size END
      FROM r JOIN n ON n.rn = r.rn + 1)
    SELECT chunk, count(*) AS features, min(id) AS first_id, max(bytes) AS bytes FROM r GROUP BY 1""",
)
def one_large_group(spark, sf_dir):
    """All features as one group, cut in blocks of a thousand that know which chunk is open before them."""
    o = table(spark, sf_dir, "orders").select(F.lit("all").alias("layer"), F.col("o_orderkey").alias("id"), (200 + F.col("o_orderkey") % 900).alias("size"))
    c = chunks.by_budget(o, ("layer",), "id", "size", 100, 60000, Staging(spark, "chunks"), block=1000)
    return c.withColumn("size", 200 + F.col("id") % 900).groupBy("chunk").agg(F.count(F.lit(1)).alias("features"), F.min("id").alias("first_id"), F.sum("size").alias("bytes"))


@query(
    "sk12_chunk_manifest",
    fixtures.with_("buildings")
    + """SELECT cast(floor(building_id / 1000) AS BIGINT) AS sequence, count(*) AS features, min(west) AS west, max(north) AS north, count(*) || ':' || min(building_id) || ':' || max(building_id) AS content_hash FROM buildings GROUP BY 1""",
)
def chunk_manifest(spark, sf_dir):
    """Chunks written as documents, and their manifest: features, bounds and content hash."""
    at = Staging(spark, "chunks").path("documents")
    f = building_features(spark, sf_dir).withColumn("chunk", F.floor(F.col("building_id") / 1000))
    writers.collections(f, F.col("chunk"), F.lit("null")).write.partitionBy("chunk").parquet(at)
    m = f.groupBy(F.col("chunk").alias("sequence")).agg(F.count(F.lit(1)).alias("features"), F.min("west").alias("west"), F.max("north").alias("north"), F.min("building_id").alias("a"), F.max("building_id").alias("b"))
    stored = spark.read.parquet(at).select(F.col("chunk").cast("long").alias("sequence"), F.col("n").alias("features"))
    key = F.concat_ws(":", F.col("features").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return m.join(stored, ["sequence", "features"]).select("sequence", "features", "west", "north", key.alias("content_hash"))


@query(
    "tp3_tp5_covering_tiles",
    FIGURE_SQL
    + """, b AS (SELECT id, list_min(list_transform(flatten(flatten(parts)), lambda p: p.lon)) AS w, list_min(list_transform(flatten(flatten(parts)), lambda p: p.lat)) AS s, list_max(list_transform(flatten(flatten(parts)), lambda p: p.lon)) AS e, list_max(list_transform(flatten(flatten(parts)), lambda p: p.lat)) AS n FROM f),
    t AS (SELECT id, cast(floor((w + 180)/360*4096) AS BIGINT) AS x0, cast(floor((e + 180)/360*4096) AS BIGINT) AS x1, cast(floor((1 - ln(tan(radians(n)) + 1/cos(radians(n)))/pi())/2*4096) AS BIGINT) AS y0, cast(floor((1 - ln(tan(radians(s)) + 1/cos(radians(s)))/pi())/2*4096) AS BIGINT) AS y1 FROM b),
    x AS (SELECT id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t), k AS (SELECT id, x, unnest(range(y0, y1 + 1)) AS y FROM x)
    SELECT id, array_to_string(list_transform([11,10,9,8,7,6,5,4,3,2,1,0], lambda i: cast(((x >> i) & 1) + 2*((y >> i) & 1) AS VARCHAR)), '') AS quadkey, round((x/4096.0::DOUBLE*360 - 180) - (360/4096.0::DOUBLE)*0.1::DOUBLE, 9) AS padded_west FROM k""",
)
def covering_tiles(spark, sf_dir):
    """All tiles of a zoom that a feature's box touches, with their quadkeys and edges padded by a tenth."""
    b = G.bbox(F.col("g"))
    f = figures(spark, sf_dir).select("id", b.alias("b"))
    xs = F.sequence(tiles.tile_x(F.col("b.west"), 12), tiles.tile_x(F.col("b.east"), 12))
    ys = F.sequence(tiles.tile_y(F.col("b.north"), 12), tiles.tile_y(F.col("b.south"), 12))
    t = f.select("id", F.explode(xs).alias("x"), ys.alias("ys")).select("id", "x", F.explode("ys").alias("y"))
    west, east = tiles.tile_west(F.col("x"), 12), tiles.tile_west(F.col("x") + 1, 12)
    return t.select("id", tiles.quadkey(F.col("x"), F.col("y"), 12).alias("quadkey"), F.round(F.greatest(F.lit(-180.0), west - (east - west) * F.lit(0.1)), 9).alias("padded_west"))


@query(
    "ge6_surface_areas",
    """WITH b AS (SELECT p_partkey AS id, 0.002::DOUBLE AS d, cast(p_partkey % 30 AS DOUBLE) AS z FROM part),
    m AS (SELECT id, 6371000.0::DOUBLE*radians(d)*cos(radians(55.6::DOUBLE)) AS x, 6371000.0::DOUBLE*radians(d) AS y, z FROM b)
    SELECT id, round(CASE WHEN id % 4 = 0 THEN 0 ELSE sqrt(x*x*z*z + x*x*y*y)/2 END, 3) AS surface FROM m""",
)
def surface_areas(spark, sf_dir):
    """Area of a ring with heights: triangles from its first corner, in local metres; rings below four positions have none."""
    k = F.col("p_partkey")
    z = (k % 30).cast("double")
    p = lambda x, y, h: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"), h.alias("z"))
    ring = F.array(p(37.5, 55.6, F.lit(0.0)), p(37.502, 55.6, F.lit(0.0)), p(37.502, 55.602, z), p(37.5, 55.6, F.lit(0.0)))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(surface(F.when(k % 4 == 0, F.slice(ring, 1, 3)).otherwise(ring)), 3).alias("surface"))


def surface(ring):
    """Fan of triangles around the first position, in metres of a plane at its latitude with heights."""
    first = F.get(ring, F.lit(0))
    r = 6371000.0

    def local(q):
        return F.struct((F.radians(q["lon"] - first["lon"]) * r * F.cos(F.radians(first["lat"]))).alias("x"), (F.radians(q["lat"] - first["lat"]) * r).alias("y"), (F.coalesce(q["z"], F.lit(0.0)) - F.coalesce(first["z"], F.lit(0.0))).alias("z"))

    def triangle(i):
        a, b = local(F.get(ring, i)), local(F.get(ring, i + 1))
        x, y, z = a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
        return F.sqrt(x * x + y * y + z * z) / 2

    fan = F.when(F.size(ring) >= 4, F.sequence(F.lit(1), F.size(ring) - 3)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(fan, F.lit(0.0), lambda s, i: s + triangle(i))
