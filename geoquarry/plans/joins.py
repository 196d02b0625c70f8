"""Join-shaped queries: overlap, nearest, point in territory, fusion, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo
from geoquarry.operators import fusion, nearest, spatial, versions as versioning
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.staging import Staging
from geoquarry.sources.tables import table

GEOMETRY = ("osm", "microsoft-buildings", "overture", "local-buildings", "city-geojson")
FUNCTION = ("wikidata", "osm", "overture", "city-geojson", "local-buildings")
#: Boxes of the oracle side meet on their building, or on equal rows of the grid where parts share footprints.
PAIRS_SQL = (
    fixtures.with_("buildings", "candidates")
    + """, p AS (SELECT a.ordinal AS a, b.ordinal AS b, (least(a.east, b.east) - greatest(a.west, b.west)) * (least(a.north, b.north) - greatest(a.south, b.south))
        / least((a.east-a.west)*(a.north-a.south), (b.east-b.west)*(b.north-b.south)) AS ratio
      FROM candidates a JOIN candidates b ON a.building_id % 97 = b.building_id % 97 AND a.building_id % 8633 = b.building_id % 8633 AND a.ordinal < b.ordinal
      WHERE least(a.east, b.east) > greatest(a.west, b.west) AND least(a.north, b.north) > greatest(a.south, b.south)),
    pairs AS (SELECT * FROM p WHERE ratio >= 0.45)"""
)


@query("jn1_overlap_pairs", PAIRS_SQL + " SELECT a, b, round(ratio, 6) AS ratio FROM pairs")
def jn1(spark, sf_dir):
    met = spatial.overlapping(fixtures.candidates(spark, sf_dir), "ordinal", 0.45, Staging(spark, "overlaps"))
    return spatial.each_pair(met.withColumn("ratio", F.round("ratio", 6)))  # rounded before pairs are listed


def grouped(spark, sf_dir):
    staging = Staging(spark, "fusion")
    c = staging.cut(fixtures.candidates(spark, sf_dir), "candidates")
    return c, fusion.greedy_boxes(c, 0.45, staging)


@query("jn2_greedy_groups")
def jn2(spark, sf_dir):
    """Candidates and their group's founder; held against a replay of the loop in tests."""
    return grouped(spark, sf_dir)[1]


@query("tk3_pl4_fused_buildings")
def fused(spark, sf_dir):
    """One row a group: geometry by source priority, other attributes each by their own; held against a replay in tests."""
    c, groups = grouped(spark, sf_dir)
    m = c.join(groups, "ordinal")
    box = F.struct("source", "west", "south", "east", "north")
    f = m.withColumn("box", box).groupBy("founder").agg(
        F.count(F.lit(1)).alias("members"),
        fusion.pick("box", "source", GEOMETRY, "ordinal").alias("box"),
        fusion.pick("height", "source", GEOMETRY, "ordinal").alias("height"),
        fusion.pick("levels", "source", FUNCTION, "ordinal").alias("levels"),
        fusion.pick("usage", "source", FUNCTION, "ordinal").alias("usage"),
    )
    area = geo.box_area(*[F.col(f"box.{s}") for s in ("west", "south", "east", "north")])
    tall = F.coalesce("height", F.round(F.col("levels") * 3.2, 2))
    return f.select("founder", "members", F.col("box.source").alias("source"), "height", "levels", "usage", F.round(area, 2).alias("area"), F.round(area * tall, 2).alias("volume"))


@query("ag21_fusion_statistics")
def statistics(spark, sf_dir):
    groups = grouped(spark, sf_dir)[1]
    return groups.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("ordinal") == F.col("founder")).alias("fused")).withColumn("collapsed", F.greatest(F.col("input") - F.col("fused"), F.lit(0)))


@query(
    "jn7_points_in_territory",
    fixtures.with_("poi", "territories") + "SELECT territory_id, category, count(*) AS n FROM poi JOIN territories ON lon >= west AND lon < east AND lat >= south AND lat < north GROUP BY 1, 2",
)
def jn7(spark, sf_dir):
    met = spatial.points_in_boxes(fixtures.poi(spark, sf_dir), fixtures.territories(spark, sf_dir))
    return met.groupBy("territory_id", "category").agg(F.count(F.lit(1)).alias("n"))


H_SQL = "sin(radians(s.lat-p.lat)/2)*sin(radians(s.lat-p.lat)/2)+cos(radians(p.lat))*cos(radians(s.lat))*sin(radians(s.lon-p.lon)/2)*sin(radians(s.lon-p.lon)/2)"
NEAR_SQL = (
    fixtures.with_("poi", "stops")
    + f""", d AS (SELECT poi_id, stop_id, 2*6371000.0::DOUBLE*atan2(sqrt({H_SQL}), sqrt(1.0::DOUBLE-({H_SQL}))) AS m FROM poi p CROSS JOIN stops s),
    n AS (SELECT poi_id, min(m) AS m FROM d GROUP BY 1)"""
)


def to_stops(spark, sf_dir):
    t = fixtures.stops(spark, sf_dir).select("stop_id", F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
    found = nearest.nearest(fixtures.poi(spark, sf_dir), t, "poi_id", "stop_id", nearest.SPHERE, Staging(spark, "nearest"))
    return found.withColumnRenamed("far", "metres")


@query("jn8_nearest_stop", NEAR_SQL + " SELECT poi_id, round(m, 3) AS metres FROM n")
def jn8(spark, sf_dir):
    """Every point's metres to its nearest stop, null without any stop."""
    return to_stops(spark, sf_dir).select("poi_id", F.round("metres", 3).alias("metres"))


@query("jn10_snap", NEAR_SQL + " SELECT poi_id, m <= 600 AS snapped FROM n")
def jn10(spark, sf_dir):
    return to_stops(spark, sf_dir).select("poi_id", F.coalesce(F.col("metres") <= 600, F.lit(False)).alias("snapped"))


@query(
    "jn4_pl5_versions",
    """WITH v AS (SELECT l_orderkey % 500 AS id, l_linenumber AS run, max(l_quantity) AS a, min(l_partkey) AS g FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
    o AS (SELECT id, a, g FROM v WHERE run = 1), n AS (SELECT id, a, g FROM v WHERE run = 2)
    SELECT n.id, CASE WHEN o.id IS NULL THEN 1 WHEN o.a IS DISTINCT FROM n.a OR o.g IS DISTINCT FROM n.g THEN 2 ELSE 1 END AS version, o.id IS NULL AS is_new FROM n LEFT JOIN o ON o.id = n.id""",
)
def versions(spark, sf_dir):
    """Version rises only when the canonical text of the feature changes."""
    v = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy((F.col("l_orderkey") % 500).alias("id"), F.col("l_linenumber").alias("run")).agg(F.max("l_quantity").alias("a"), F.min("l_partkey").alias("g"))
    text = F.to_json(F.struct("a", "g"))
    old, new = v.where("run = 1").select("id", text.alias("was")), v.where("run = 2").select("id", text.alias("now"))
    changed = F.col("was").isNotNull() & (F.col("was") != F.col("now"))
    return new.join(old, "id", "left").select("id", F.when(changed, 2).otherwise(1).alias("version"), F.col("was").isNull().alias("is_new"))


#: Two snapshots of all rows: the later has rows that the earlier lacks, other ids for some and other states for some.
SNAPSHOT_SQL = """WITH f AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_returnflag AS domain, l_linestatus AS source,
      concat_ws(',', l_partkey, l_suppkey) AS geometry FROM lineitem),
    o AS (SELECT key AS id, domain, source, geometry, l_quantity AS state, 1 + l_linenumber AS version FROM f WHERE l_orderkey % 11 <> 0),
    n AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN concat('again-', key) ELSE key END AS id, domain, source, geometry, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END AS state FROM f),
    u AS (SELECT domain, source, geometry, any_value(id) AS id, any_value(version) AS version, any_value(state) AS state FROM o GROUP BY 1, 2, 3 HAVING count(*) = 1)
    SELECT coalesce(o.id, u.id, n.id) AS id, CASE WHEN coalesce(o.id, u.id) IS NULL THEN 1 WHEN coalesce(o.state, u.state) IS DISTINCT FROM n.state THEN coalesce(o.version, u.version) + 1 ELSE coalesce(o.version, u.version) END AS version,
      coalesce(o.id, u.id) IS NULL AS is_new, o.id IS NULL AND u.id IS NOT NULL AS moved_id
    FROM n LEFT JOIN o ON o.id = n.id LEFT JOIN u ON u.domain = n.domain AND u.source = n.source AND u.geometry = n.geometry"""


@query("jn4_previous_versions", SNAPSHOT_SQL)
def previous_versions(spark, sf_dir):
    """Every row under its whole key, against the snapshot before by id, else by its only equal in place."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    place = [F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("source"), F.concat_ws(",", "l_partkey", "l_suppkey").alias("geometry")]
    f = table(spark, sf_dir, "lineitem")
    before = f.where("l_orderkey % 11 <> 0").select(key.alias("id"), *place, F.col("l_quantity").alias("state"), (F.col("l_linenumber") + 1).alias("version"))
    again = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("again-"), key)).otherwise(key)
    now = f.select(again.alias("id"), *place, F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("state"))
    return versioning.against_previous(now, before)


REQUIRED = (("far", "error", True, 0.5, 0.5), ("access", "click", True, 0.2, 0.9), ("green", "view", False, None, 0.4), ("water", "flood", True, 0.1, None))
QUALITY_SQL = "q AS (SELECT event_type AS domain, count(*) AS n, CASE WHEN event_type = 'view' THEN NULL ELSE least(1, count(*)/2500.0::DOUBLE) END AS coverage, avg(value)/490 AS score FROM events GROUP BY 1)"


@query(
    "jn5_missing_requirements",
    f"""WITH {QUALITY_SQL}, r AS (SELECT * FROM (VALUES ('far','error',true,0.5::DOUBLE,0.5::DOUBLE), ('access','click',true,0.2,0.9), ('green','view',false,NULL,0.4), ('water','flood',true,0.1,NULL)) v(analysis, domain, required, min_coverage, min_quality))
    SELECT analysis, r.domain, required FROM r LEFT JOIN q ON q.domain = r.domain
    WHERE q.n IS NULL OR q.n = 0 OR (min_coverage IS NOT NULL AND (coverage IS NULL OR coverage < min_coverage)) OR (min_quality IS NOT NULL AND (score IS NULL OR score < min_quality))""",
)
def missing(spark, sf_dir):
    """A requirement is missing with no features, no quality row, or a score that is unknown or below its minimum."""
    q = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.count(F.lit(1)) / 2500).alias("coverage"), (F.avg("value") / 490).alias("score"))
    q = q.withColumn("coverage", F.when(F.col("domain") != "view", F.col("coverage")))
    r = spark.createDataFrame(list(REQUIRED), "analysis string, domain string, required boolean, min_coverage double, min_quality double")
    below = lambda v, m: F.col(m).isNotNull() & (F.col(v).isNull() | (F.col(v) < F.col(m)))
    return r.join(q, "domain", "left").where(F.col("n").isNull() | (F.col("n") == 0) | below("coverage", "min_coverage") | below("score", "min_quality")).select("analysis", "domain", "required")


@query(
    "jn13_metadata_last_wins",
    "SELECT user_id % 50 AS project, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
)
def metadata(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("project"), F.col("event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query(
    "jn10_snapped_points",
    NEAR_SQL + ", b AS (SELECT poi_id, arg_min(stop_id, m*1000000 + stop_id/1000000) AS stop_id, min(m) AS m FROM d GROUP BY 1) SELECT p.poi_id, CASE WHEN b.m <= 600 THEN s.lon ELSE p.lon END AS lon, CASE WHEN b.m <= 600 THEN s.lat ELSE p.lat END AS lat FROM poi p LEFT JOIN b USING (poi_id) LEFT JOIN stops s USING (stop_id)",
)
def snapped_points(spark, sf_dir):
    """Each point moved to its nearest stop if that is at most 600 m away, else left where it is."""
    p, s = fixtures.poi(spark, sf_dir), fixtures.stops(spark, sf_dir).select("stop_id", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    near = to_stops(spark, sf_dir).where("metres <= 600").join(s, "stop_id").select("poi_id", "to_lon", "to_lat")
    return p.join(near, "poi_id", "left").select("poi_id", F.coalesce("to_lon", "lon").alias("lon"), F.coalesce("to_lat", "lat").alias("lat"))
