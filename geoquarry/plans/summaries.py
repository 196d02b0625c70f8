"""Summaries over several sources, identities, and set operations by key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoquarry.functions import rings
from geoquarry.operators import spatial
from geoquarry.plans import fixtures
from geoquarry.plans.analysis import LENGTH_SQL
from geoquarry.plans.catalog import query
from geoquarry.plans.joins import QUALITY_SQL, REQUIRED
from geoquarry.sources.tables import table


@query(
    "ag22_first_and_largest_source",
    fixtures.with_("buildings", "candidates")
    + """, n AS (SELECT usage AS domain, source, source_rank, count(*) AS n FROM candidates GROUP BY 1, 2, 3)
    SELECT domain, arg_min(source, source_rank) AS first_source, arg_max(source, (n, -source_rank)) AS largest FROM n GROUP BY 1""",
)
def first_source(spark, sf_dir):
    """The first source by rank that has features, and the largest (ties: the first)."""
    n = fixtures.candidates(spark, sf_dir).groupBy(F.col("usage").alias("domain"), "source", "source_rank").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("domain").agg(F.min_by("source", "source_rank").alias("first_source"), F.max_by("source", F.struct("n", -F.col("source_rank"))).alias("largest"))


@query(
    "ag24_selection_statistics",
    fixtures.with_("buildings", "territories")
    + """SELECT territory_id, count(*) AS n, round(avg(b.west), 9) AS lon, round(avg(b.south), 9) AS lat FROM buildings b
    JOIN territories t ON b.west >= t.west AND b.west < t.east AND b.south >= t.south AND b.south < t.north GROUP BY 1""",
)
def selection(spark, sf_dir):
    """Buildings whose first vertex lies in each territory, and their mean first vertex."""
    b = fixtures.buildings(spark, sf_dir).select(F.col("west").alias("lon"), F.col("south").alias("lat"))
    met = spatial.points_in_boxes(b, fixtures.territories(spark, sf_dir))
    return met.groupBy("territory_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lon"), 9).alias("lon"), F.round(F.avg("lat"), 9).alias("lat"))


@query("ag28_legend_groups", fixtures.with_("roads") + f"SELECT road_type, count(*) AS n, round(sum({LENGTH_SQL}), 2) AS metres FROM roads GROUP BY 1")
def legend_groups(spark, sf_dir):
    r = fixtures.roads(spark, sf_dir)
    line = F.array(F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))
    return r.groupBy("road_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(rings.length(line)), 2).alias("metres"))


@query(
    "ag29_terrain_summary",
    fixtures.with_("terrain") + "SELECT count(elevation) AS known, count(*) AS total, min(elevation) AS low, max(elevation) AS high FROM terrain WHERE elevation IS NULL OR isfinite(elevation)",
)
def terrain_summary(spark, sf_dir):
    e = F.col("elevation")
    finite = F.when(~F.isnan(e) & (F.abs(e) != float("inf")), e)
    return fixtures.terrain(spark, sf_dir).agg(F.count(finite).alias("known"), F.count(F.lit(1)).alias("total"), F.min(finite).alias("low"), F.max(finite).alias("high"))


@query(
    "ag30_features_by_domain",
    fixtures.with_("buildings", "roads", "poi", "stops")
    + "SELECT 'buildings' AS domain, count(*) AS n FROM buildings UNION ALL SELECT 'roads', count(*) FROM roads UNION ALL SELECT 'poi', count(*) FROM poi UNION ALL SELECT 'transit', count(*) FROM stops",
)
def by_domain(spark, sf_dir):
    """Each table is counted before the union, so one row a table moves."""
    parts = {"buildings": fixtures.buildings, "roads": fixtures.roads, "poi": fixtures.poi, "transit": fixtures.stops}
    counted = [f(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("domain"), "n") for d, f in parts.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query(
    "ag31_coverage_assessment",
    f"""WITH {QUALITY_SQL}, r AS (SELECT * FROM (VALUES ('error', 0.5::DOUBLE, 0.5::DOUBLE), ('click', 0.2, 0.9), ('view', NULL, 0.4), ('flood', 0.1, NULL)) v(domain, min_coverage, min_quality))
    SELECT r.domain, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN coverage < min_coverage THEN 'partial' WHEN score < min_quality THEN 'below-threshold' ELSE 'covered' END AS state, coverage IS NULL AS unknown
    FROM r LEFT JOIN q ON q.domain = r.domain""",
)
def coverage(spark, sf_dir):
    """State of each required domain; an unknown coverage stays unknown and is not a failure by itself."""
    q = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.count(F.lit(1)) / 2500).alias("coverage"), (F.avg("value") / 490).alias("score"))
    q = q.withColumn("coverage", F.when(F.col("domain") != "view", F.col("coverage")))
    r = spark.createDataFrame([(d, c, s) for _, d, _, c, s in REQUIRED], "domain string, min_coverage double, min_quality double")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("coverage") < F.col("min_coverage"), "partial").when(F.col("score") < F.col("min_quality"), "below-threshold").otherwise("covered")
    return r.join(q, "domain", "left").select("domain", state.alias("state"), F.col("coverage").isNull().alias("unknown"))


@query(
    "wn6_reindexed_layers",
    "SELECT s_suppkey AS layer_id, cast(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS BIGINT) AS position FROM supplier",
)
def reindex(spark, sf_dir):
    """Positions from 0 in each project, by order and then id."""
    w = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("layer_id"), (F.row_number().over(w) - 1).cast("long").alias("position"))


def uri_part(c):
    """Percent-encoded text; a space is %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


@query(
    "sf22_canonical_ids",
    fixtures.with_("buildings", "candidates") + "SELECT ordinal, 'canonical:building:' || source || ':part%2F' || building_id || '%20a' AS canonical_id FROM candidates",
)
def canonical_ids(spark, sf_dir):
    raw = F.concat(F.lit("part/"), F.col("building_id").cast("string"), F.lit(" a"))
    return fixtures.candidates(spark, sf_dir).select("ordinal", F.concat_ws(":", F.lit("canonical"), F.lit("building"), uri_part(F.col("source")), uri_part(raw)).alias("canonical_id"))


@query(
    "sf23_overall_confidence",
    "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_discount > 0.02 OR l_tax > 0.02 THEN round(cast((CASE WHEN l_discount > 0.02 THEN cast(l_discount AS DOUBLE) ELSE 0 END + CASE WHEN l_tax > 0.02 THEN cast(l_tax AS DOUBLE) ELSE 0 END) / ((l_discount > 0.02)::INT + (l_tax > 0.02)::INT) AS DECIMAL(18,6)), 2)::DOUBLE END AS confidence FROM lineitem",
)
def overall_confidence(spark, sf_dir):
    """Mean of the parts that are known, to two places; null if none is."""
    part = lambda c: F.when(F.col(c) > 0.02, F.col(c).cast("double"))
    known = F.array_compact(F.array(part("l_discount"), part("l_tax")))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(mean.cast("decimal(18,6)"), 2).cast("double").alias("confidence"))


@query(
    "sf24_merged_tags",
    "SELECT user_id AS feature, event_type AS key, arg_min(value, (ts, event_id)) AS tag, arg_max(value, (ts, event_id)) AS name FROM events GROUP BY 1, 2",
)
def merged_tags(spark, sf_dir):
    """Of repeated keys the first tag and the last name hold."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("feature"), F.col("event_type").alias("key")).agg(F.min_by("value", at).alias("tag"), F.max_by("value", at).alias("name"))


@query("st7_distinct_issues", "SELECT event_type AS code, count(DISTINCT user_id) AS features FROM events GROUP BY 1")
def issues(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.col("user_id")).dropDuplicates(["code", "user_id"]).groupBy("code").agg(F.count("user_id").alias("features"))


@query("st9_unique_points", fixtures.with_("roads") + "SELECT count(*) AS points FROM (SELECT DISTINCT format('{:.10f}', lon1), format('{:.10f}', lat1) FROM roads)")
def unique_points(spark, sf_dir):
    """Points are the same when ten decimals of both coordinates are."""
    key = lambda c: F.format_string("%.10f", F.col(c))
    return fixtures.roads(spark, sf_dir).select(key("lon1").alias("x"), key("lat1").alias("y")).distinct().agg(F.count(F.lit(1)).alias("points"))


def by_ids(df, key, ids):
    """Rows with a selected id; an empty selection selects all.  ``ids`` is a short list that a user picked."""
    return df.where(F.col(key).isin(list(ids))) if ids else df


@query("fp5_selected_ids", fixtures.with_("poi") + "SELECT poi_id, category FROM poi WHERE poi_id IN (1, 5, 9, 77)")
def selected(spark, sf_dir):
    return by_ids(fixtures.poi(spark, sf_dir), "poi_id", (1, 5, 9, 77)).select("poi_id", "category")


@query(
    "fp17_box_predicates",
    fixtures.with_("buildings")
    + "SELECT building_id, west <= 37.6 AND east >= 37.55 AND south <= 55.7 AND north >= 55.65 AS meets, west >= 37.55 AND east <= 37.6 AND south >= 55.65 AND north <= 55.7 AS within FROM buildings",
)
def box_predicates(spark, sf_dir):
    meets = (F.col("west") <= 37.6) & (F.col("east") >= 37.55) & (F.col("south") <= 55.7) & (F.col("north") >= 55.65)
    within = (F.col("west") >= 37.55) & (F.col("east") <= 37.6) & (F.col("south") >= 55.65) & (F.col("north") <= 55.7)
    return fixtures.buildings(spark, sf_dir).select("building_id", meets.alias("meets"), within.alias("within"))
