"""What is exported, imported and told apart: scopes, guards, payloads of several formats, stable texts and keys."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G, normalise as N, semantics as S
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.figures import FIGURE_SQL, figures
from geoquarry.plans.normalisers import TAGS, _maps, _sql_maps
from geoquarry.plans.summaries import by_ids
from geoquarry.sources import formats, geometry_text as T
from geoquarry.sources.tables import table

SCOPES = ("project", "visible-area", "selection", "active-layers")


def scoped(entities, scope: str, key: str, box=None, ids=()):
    """Entities of an export: all, those that meet the visible box, or the selected; active layers aren't told apart."""
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope!r}")
    if scope == "visible-area" and box is not None:
        return formats.in_box(entities, box)
    return by_ids(entities, key, ids) if scope == "selection" else entities


@query(
    "sk1_export_scopes",
    fixtures.with_("buildings")
    + """SELECT 'project' AS scope, count(*) AS n FROM buildings UNION ALL SELECT 'visible-area', count(*) FROM buildings WHERE west <= 37.6 AND east >= 37.52 AND south <= 55.7 AND north >= 55.601 UNION ALL SELECT 'selection', count(*) FROM buildings WHERE building_id IN (3, 5, 8) UNION ALL SELECT 'active-layers', count(*) FROM buildings""",
)
def export_scopes(spark, sf_dir):
    """How many entities each scope exports."""
    b = fixtures.buildings(spark, sf_dir)
    out = None
    for scope in SCOPES:
        n = scoped(b, scope, "building_id", (37.52, 55.601, 37.6, 55.7), (3, 5, 8)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def checked_bounds(west: float, south: float, east: float, north: float, most_km2: float = 50.0) -> float:
    """Square kilometres of an import's box; an error unless it is finite, in order and no larger than ``most_km2``."""
    if not all(map(math.isfinite, (west, south, east, north))) or west >= east or south >= north:
        raise ValueError("bounds must be finite, west of east and south of north")
    area = (east - west) * 111.32 * math.cos(math.radians((south + north) / 2)) * (north - south) * 111.32
    if area > most_km2:
        raise ValueError(f"{area:.1f} km2 are more than {most_km2:g}")
    return area


@query(
    "fp14_import_bounds",
    fixtures.with_("territories") + """, a AS (SELECT territory_id, (east - west)*111.32::DOUBLE*cos(radians((south + north)/2))*(north - south)*111.32::DOUBLE AS km2 FROM territories) SELECT territory_id, round(km2, 6) AS km2, km2 <= 11.19 AS accepted FROM a""",
)
def import_bounds(spark, sf_dir):
    """Area of each territory's box and whether an import of that size is allowed (here up to 11.19 km2)."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    km2 = (e - w) * F.lit(111.32) * F.cos(F.radians((s + n) / 2)) * (n - s) * F.lit(111.32)
    return fixtures.territories(spark, sf_dir).select("territory_id", F.round(km2, 6).alias("km2"), (km2 <= 11.19).alias("accepted"))


@query(
    "tp8_chunk_payloads",
    f"""WITH t AS (SELECT c_custkey AS id, {_sql_maps(TAGS)}[1 + cast(c_custkey % {len(TAGS)} AS INT)] AS g FROM customer)
    SELECT 'overpass' AS format, 'osm-way-' || id AS source_feature_id FROM t WHERE g IS NOT NULL AND id % 5 = 0 AND (coalesce(g['building'],'') <> '' OR coalesce(g['highway'],'') <> '' OR coalesce(g['natural'],'') <> '' OR coalesce(g['waterway'],'') <> '' OR coalesce(g['boundary'],'') <> '' OR coalesce(g['landuse'],'') <> '' OR g['leisure'] = 'garden')
    UNION ALL SELECT 'terrain', 'dem-' || id FROM t WHERE id % 5 = 1 UNION ALL SELECT 'geojson', coalesce('f-' || id) FROM t WHERE id % 5 = 2 UNION ALL SELECT 'source-features', 's-' || id FROM t WHERE id % 5 = 3""",
)
def chunk_payloads(spark, sf_dir):
    """Features of payloads in five formats, each by its own normaliser; catalogues give none."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.get(_maps(TAGS), (k % len(TAGS)).cast("int")).alias("tags"))
    named = lambda part, prefix, name: part.select(F.lit(name).alias("format"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("source_feature_id"))
    osm = c.where("id % 5 = 0").where(N.osm_domain(F.col("tags"), F.lit(False)).isNotNull())
    kinds = c.where("id % 5 = 2").where(N.geojson_kind(F.create_map(F.lit("category"), F.lit("building")), F.create_map(F.lit("x"), F.lit(1.0)), F.lit("Polygon")).isNotNull())
    out = named(osm, "osm-way-", "overpass").unionByName(named(c.where("id % 5 = 1"), "dem-", "terrain")).unionByName(named(kinds, "f-", "geojson"))
    return out.unionByName(named(c.where("id % 5 = 3"), "s-", "source-features")).unionByName(named(c.where("id % 5 = 4").where(F.lit(False)), "", "catalog"))


@query(
    "st2_first_representations",
    FIGURE_SQL
    + """, e AS (SELECT CASE WHEN id % 3 <> 0 THEN cast(id % 50 AS VARCHAR) ELSE '' END AS eid, type, array_to_string(list_transform(flatten(flatten(parts)), lambda p: p.lon || ' ' || p.lat), ',') AS shape, 0 AS rank, id FROM f UNION ALL SELECT CASE WHEN id % 3 <> 0 THEN cast(id % 50 AS VARCHAR) ELSE '' END, type, array_to_string(list_transform(flatten(flatten(parts)), lambda p: p.lon || ' ' || p.lat), ','), 1, id + 1000000 FROM f)
    SELECT min(rank*10000000 + id) AS first_id FROM e GROUP BY CASE WHEN eid <> '' THEN 'id:' || eid ELSE type || ':' || shape END""",
)
def first_representations(spark, sf_dir):
    """Of entities from two origins the first of each id, or of each type and geometry where the id is empty."""
    f = figures(spark, sf_dir)
    eid = F.when(F.col("id") % 3 != 0, (F.col("id") % 50).cast("string")).otherwise("")
    part = lambda rank, shift: f.select(eid.alias("eid"), "g", (F.lit(rank * 10000000 + shift) + F.col("id")).alias("at"))
    key = F.when(F.col("eid") != "", F.concat(F.lit("id:"), "eid")).otherwise(T.to_geojson(F.col("g")))
    return part(0, 0).unionByName(part(1, 1000000)).groupBy(key.alias("key")).agg(F.min("at").alias("first_id")).select("first_id")


@query("st3_chosen_sources", "SELECT s AS source FROM (SELECT unnest(['osm','overture','wikidata','gtfs']) AS s) WHERE s IN ('osm','wikidata','ckan','gtfs') AND s IN ('osm','gtfs','overture') AND s NOT IN ('gtfs')")
def chosen_sources(spark, sf_dir):
    """Preferred, available and selected sources together, without the excluded."""
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "source string")
    return names("osm", "overture", "wikidata", "gtfs").intersect(names("osm", "wikidata", "ckan", "gtfs")).intersect(names("osm", "gtfs", "overture")).exceptAll(names("gtfs"))


@query(
    "sf19_feature_ids",
    """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'own-' || c_custkey WHEN 1 THEN 'p' || c_custkey WHEN 2 THEN '@' || c_custkey WHEN 3 THEN cast(c_custkey AS VARCHAR) WHEN 4 THEN 'Q' || c_custkey ELSE 'file-' || c_custkey END AS id FROM customer""",
)
def feature_ids(spark, sf_dir):
    """A feature's own id, else one of four properties, else a name made from the file."""
    k = F.col("c_custkey")
    text = k.cast("string")
    at = lambda i, c: F.when(k % 6 == i, c)
    props = F.create_map(F.lit("id"), at(1, F.concat(F.lit("p"), text)), F.lit("@id"), at(2, F.concat(F.lit("@"), text)), F.lit("fid"), at(3, text), F.lit("wikidata"), at(4, F.concat(F.lit("Q"), text)))
    return table(spark, sf_dir, "customer").select(k.alias("k"), N.feature_id(at(0, F.concat(F.lit("own-"), text)), props, F.concat(F.lit("file-"), text)).alias("id"))


@query(
    "sf21_stable_texts",
    """WITH RECURSIVE t AS (SELECT c_custkey AS id, '{"domain":"' || (c_custkey % 7) || '","name":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"n \\"' || c_custkey || '"' END || ',"size":' || c_custkey || '}' AS t FROM customer),
    h AS (SELECT id, t, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS h FROM t)
    SELECT id, t AS text, h::BIGINT AS hash FROM h""",
)
def stable_texts(spark, sf_dir):
    """Values as JSON with sorted keys, and the hash of that text."""
    k = F.col("c_custkey")
    name = F.when(k % 3 != 0, F.concat(F.lit('n "'), k.cast("string")))
    t = table(spark, sf_dir, "customer").select(k.alias("id"), S.stable_json({"size": k, "name": name, "domain": (k % 7).cast("string")}).alias("text"))
    return t.select("id", "text", F.conv(S.fnv1a(F.col("text")), 36, 10).cast("long").alias("hash"))


@query(
    "sf22_geometry_identities",
    FIGURE_SQL + """ SELECT count(*) AS ids, count(*) AS features FROM (SELECT DISTINCT type, parts FROM f WHERE id % 2 = 0)""",
)
def geometry_identities(spark, sf_dir):
    """Features without an id of their own are named by hashes of their geometry: as many names as geometries, for which the short hash alone is too narrow."""
    f = figures(spark, sf_dir).where("id % 2 = 0").select(T.to_geojson(F.col("g")).alias("t")).distinct()
    named = f.select(F.concat(F.lit("canonical:building:osm:"), S.fnv1a(F.col("t")), F.lit("-"), F.sha2("t", 256)).alias("canonical_id"))
    return named.agg(F.count_distinct("canonical_id").alias("ids"), F.count(F.lit(1)).alias("features"))


@query("ge31_measure_wrappers", FIGURE_SQL + " SELECT id, type IN ('Polygon', 'MultiPolygon') AS has_area, type IN ('LineString', 'MultiLineString') AS has_length FROM f")
def measure_wrappers(spark, sf_dir):
    """Area is 0 for what is no polygon, length is 0 for what is no line."""
    g = F.col("g")
    return figures(spark, sf_dir).select("id", (G.area(g) > 0).alias("has_area"), (G.line_length(g) > 0).alias("has_length"))
