"""Source policy, quality and query-context queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.sources.tables import table

# Weights of the score's parts, bonus and threshold.
WEIGHTS = {"coverage": 0.2, "reliability": 0.15, "freshness": 0.1, "geometry": 0.1, "attributes": 0.1}
AVAILABLE, RATE, COST, BONUS, THRESHOLD, MOST = 0.2, 0.1, 0.05, 0.03, 0.62, 3

#: Candidates from suppliers: eight domains, metrics unknown (null) for some.
CANDIDATES_SQL = """c AS (SELECT s_suppkey AS id, 'src' || lpad(cast(s_suppkey AS VARCHAR), 6, '0') AS source_id, s_nationkey % 8 AS domain, s_suppkey % 11 <> 0 AS available, s_suppkey % 13 <> 0 AS licensed,
  CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 17)/16.0::DOUBLE END AS coverage, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 19)/18.0::DOUBLE END AS reliability,
  CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey % 23)/22.0::DOUBLE END AS freshness, CASE WHEN s_suppkey % 7 = 0 THEN 1.4::DOUBLE END AS geometry, CASE WHEN s_suppkey % 4 = 0 THEN 0.75::DOUBLE END AS attributes,
  s_suppkey % 6 = 0 AS rate_limited, CASE WHEN s_suppkey % 9 = 0 THEN 0.2::DOUBLE END AS cost, s_suppkey % 10 = 1 AS preferred FROM supplier)"""
SCORE_SQL = """s AS (SELECT *, CASE WHEN NOT available OR NOT licensed THEN 0 ELSE least(1, 0.2::DOUBLE + 0.2::DOUBLE*coalesce(greatest(0, least(1, coverage)), 0.5) + 0.15::DOUBLE*coalesce(greatest(0, least(1, reliability)), 0.5)
  + 0.1::DOUBLE*coalesce(greatest(0, least(1, freshness)), 0.5) + 0.1::DOUBLE*coalesce(greatest(0, least(1, geometry)), 0.5) + 0.1::DOUBLE*coalesce(greatest(0, least(1, attributes)), 0.5)
  + CASE WHEN rate_limited THEN 0 ELSE 0.1::DOUBLE END + 0.05::DOUBLE*coalesce(greatest(0, 1 - least(1, cost)), 0.5) + CASE WHEN preferred THEN 0.03::DOUBLE ELSE 0 END) END AS score, NOT available OR NOT licensed AS rejected FROM c)"""


def candidates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    known = lambda m, v: F.when(k % m == 0, v)
    return s.select(
        k.alias("id"),
        F.concat(F.lit("src"), F.lpad(k.cast("string"), 6, "0")).alias("source_id"),
        (F.col("s_nationkey") % 8).alias("domain"),
        (k % 11 != 0).alias("available"),
        (k % 13 != 0).alias("licensed"),
        known(2, (k % 17) / 16.0).alias("coverage"),
        known(3, (k % 19) / 18.0).alias("reliability"),
        known(5, (k % 23) / 22.0).alias("freshness"),
        known(7, F.lit(1.4)).alias("geometry"),
        known(4, F.lit(0.75)).alias("attributes"),
        (k % 6 == 0).alias("rate_limited"),
        known(9, F.lit(0.2)).alias("cost"),
        (k % 10 == 1).alias("preferred"),
    )


def scored(c):
    """Weighted score; an unknown metric counts half its weight; a hard constraint rejects."""
    total = F.lit(AVAILABLE)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name))), F.lit(0.5))
    total = total + F.when(F.col("rate_limited"), 0.0).otherwise(RATE) + F.lit(COST) * F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("cost"))), F.lit(0.5))
    total = F.least(F.lit(1.0), total + F.when(F.col("preferred"), BONUS).otherwise(0.0))
    rejected = ~F.col("available") | ~F.col("licensed")
    return c.withColumn("rejected", rejected).withColumn("score", F.when(rejected, 0.0).otherwise(total))


@query("tk2_source_scores", f"WITH {CANDIDATES_SQL}, {SCORE_SQL} SELECT source_id, domain, round(score, 6) AS score, rejected FROM s")
def scores(spark, sf_dir):
    return scored(candidates(spark, sf_dir)).select("source_id", "domain", F.round("score", 6).alias("score"), "rejected")


@query(
    "tk1_source_selection",
    f"""WITH {CANDIDATES_SQL}, {SCORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(score, 9) DESC, source_id) AS rn, max(round(score, 9)) OVER (PARTITION BY domain) AS top FROM s WHERE NOT rejected)
    SELECT domain, source_id, rn AS place FROM r WHERE (score >= 0.62 AND rn <= 3) OR (rn = 1 AND top < 0.62)""",
)
def selection(spark, sf_dir):
    """Best three of a domain at or above the threshold; at least the best one. Top-k windows are pre-limited on the map side."""
    s = scored(candidates(spark, sf_dir)).where(~F.col("rejected"))
    order = W.partitionBy("domain").orderBy(F.desc(F.round("score", 9)), "source_id")
    r = s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)
    return r.where((F.col("score") >= THRESHOLD) | (F.col("place") == 1)).select("domain", "source_id", "place")


@query(
    "ag19_freshness_reliability",
    """SELECT event_type AS domain, count(*) AS n, round(avg(CASE WHEN event_type = 'view' THEN NULL WHEN greatest(0, epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(ts))/86400000.0::DOUBLE <= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS freshness,
      CASE WHEN count(*) = count(CASE WHEN user_id % 7 <> 100 THEN 1 END) THEN round(avg((user_id % 7)/7.0::DOUBLE), 6) END AS reliability FROM events GROUP BY 1""",
)
def freshness(spark, sf_dir):
    """Share of observations within the age limit; unknown as soon as one source has no limit (``view``)."""
    e = table(spark, sf_dir, "events")
    age = F.greatest(F.lit(0), F.unix_millis(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))) / 86400000.0
    fresh = F.when(F.col("event_type") != "view", F.when(age <= 15, 1.0).otherwise(0.0))
    n = F.count(F.lit(1))
    rel = (F.col("user_id") % 7) / 7.0
    return e.groupBy(F.col("event_type").alias("domain")).agg(n.alias("n"), F.when(F.count(fresh) == n, F.round(F.avg(fresh), 6)).alias("freshness"), F.when(F.count(rel) == n, F.round(F.avg(rel), 6)).alias("reliability"))


STATUS_SQL = """CASE WHEN n = 0 THEN 'empty' WHEN geometry = 0 THEN 'failed' WHEN geometry < 1 OR attributes < 1 THEN 'degraded' WHEN coverage IS NULL OR freshness IS NULL THEN 'partial' ELSE 'complete' END"""


@query(
    "ag18_domain_quality",
    fixtures.with_("buildings")
    + f""", q AS (SELECT building_id % 12 AS domain, count(*) AS n, avg(CASE WHEN east > west AND north > south THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS geometry,
      avg((CASE WHEN usage <> 'unknown' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN height IS NOT NULL OR levels IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)/2) AS attributes,
      CASE WHEN building_id % 12 < 6 THEN 0.8::DOUBLE END AS coverage, CASE WHEN building_id % 12 % 3 = 0 THEN 1.0::DOUBLE END AS freshness FROM buildings GROUP BY building_id % 12)
    SELECT domain, n, round(geometry, 6) AS geometry, round(attributes, 6) AS attributes, coverage, freshness,
      CASE WHEN coverage IS NOT NULL AND freshness IS NOT NULL THEN round((geometry + attributes + coverage + freshness)/4, 6) END AS overall, {STATUS_SQL} AS status FROM q""",
)
def domain_quality(spark, sf_dir):
    """Scores by domain; the overall score exists only if every component is known."""
    q = quality_rows(spark, sf_dir)
    return q.select("domain", "n", F.round("geometry", 6).alias("geometry"), F.round("attributes", 6).alias("attributes"), "coverage", "freshness", F.round((F.col("geometry") + F.col("attributes") + F.col("coverage") + F.col("freshness")) / 4, 6).alias("overall"), status().alias("status"))


def quality_rows(spark, sf_dir):
    b = fixtures.buildings(spark, sf_dir)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    q = b.groupBy((F.col("building_id") % 12).alias("domain")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(one((F.col("east") > F.col("west")) & (F.col("north") > F.col("south")))).alias("geometry"),
        F.avg((one(F.col("usage") != "unknown") + one(F.coalesce("height", "levels").isNotNull())) / 2).alias("attributes"),
    )
    return q.withColumns({"coverage": F.when(F.col("domain") < 6, 0.8), "freshness": F.when(F.col("domain") % 3 == 0, 1.0)})


def status():
    return F.when(F.col("n") == 0, "empty").when(F.col("geometry") == 0, "failed").when((F.col("geometry") < 1) | (F.col("attributes") < 1), "degraded").when(F.col("coverage").isNull() | F.col("freshness").isNull(), "partial").otherwise("complete")


@query(
    "ag20_quality_rollup",
    fixtures.with_("buildings")
    + f""", q AS (SELECT building_id % 12 AS domain, count(*) AS n, avg(CASE WHEN east > west AND north > south THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS geometry,
      avg((CASE WHEN usage <> 'unknown' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN height IS NOT NULL OR levels IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)/2) AS attributes,
      CASE WHEN building_id % 12 < 6 THEN 0.8::DOUBLE END AS coverage, CASE WHEN building_id % 12 % 3 = 0 THEN 1.0::DOUBLE END AS freshness FROM buildings GROUP BY building_id % 12),
    s AS (SELECT {STATUS_SQL} AS status FROM q)
    SELECT CASE WHEN count(*) = 0 OR bool_and(status = 'empty') THEN 'empty' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'degraded') THEN 'degraded' WHEN bool_or(status IN ('empty','partial')) THEN 'partial' ELSE 'complete' END AS overall_status, count(*) AS domains FROM s""",
)
def rollup(spark, sf_dir):
    s = quality_rows(spark, sf_dir).select(status().alias("status"))
    has = lambda *x: F.bool_or(F.col("status").isin(*x))
    n = F.count(F.lit(1))
    overall = F.when((n == 0) | F.bool_and(F.col("status") == "empty"), "empty").when(has("failed"), "failed").when(has("degraded"), "degraded").when(has("empty", "partial"), "partial").otherwise("complete")
    return s.agg(overall.alias("overall_status"), n.alias("domains"))


@query(
    "fp3_canonical_query",
    """WITH f AS (SELECT o_orderkey AS id, o_custkey % 20 AS project, o_orderdate AS saved, o_orderpriority AS domain, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 100)/100.0::DOUBLE END AS confidence, o_orderkey % 3 <> 0 AS preferred,
      37.5::DOUBLE + cast(o_custkey % 211 as double)*0.00095::DOUBLE AS lon, 55.6::DOUBLE + cast(o_custkey % 197 as double)*0.00101::DOUBLE AS lat FROM orders)
    SELECT id FROM f WHERE project = 7 AND domain IN ('1-URGENT','3-MEDIUM') AND coalesce(confidence, 0) >= 0.3 AND preferred AND lon BETWEEN 37.52 AND 37.66 AND lat BETWEEN 55.62 AND 55.75""",
)
def canonical_query(spark, sf_dir):
    """Unknown confidence counts as 0; the box is inclusive; all conditions are in one filter over the scan."""
    o = table(spark, sf_dir, "orders")
    f = o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 20).alias("project"),
        F.col("o_orderpriority").alias("domain"),
        F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("confidence"),
        (F.col("o_orderkey") % 3 != 0).alias("preferred"),
        (F.lit(37.5) + (F.col("o_custkey") % 211).cast("double") * 0.00095).alias("lon"),
        (F.lit(55.6) + (F.col("o_custkey") % 197).cast("double") * 0.00101).alias("lat"),
    )
    where = (F.col("project") == 7) & F.col("domain").isin("1-URGENT", "3-MEDIUM") & (F.coalesce("confidence", F.lit(0.0)) >= 0.3) & F.col("preferred")
    return f.where(where & F.col("lon").between(37.52, 37.66) & F.col("lat").between(55.62, 55.75)).select("id")


@query("fp1_column_query", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def column_query(spark, sf_dir):
    """Projection before the predicate: it sees only projected columns."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").where("p_size > 40")


@query("fp8_text_search", "SELECT event_id FROM events WHERE contains(lower(event_type || ' ' || coalesce(props, '')), 'click')")
def text_search(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.contains(F.lower(F.concat_ws(" ", "event_type", "props")), F.lit("click"))).select("event_id")


@query("fp2_bbox_filter", fixtures.with_("buildings") + "SELECT building_id FROM buildings WHERE west <= 37.6 AND east >= 37.55 AND south <= 55.7 AND north >= 55.62")
def bbox_filter(spark, sf_dir):
    return fixtures.buildings(spark, sf_dir).where("west <= 37.6D AND east >= 37.55D AND south <= 55.7D AND north >= 55.62D").select("building_id")


@query(
    "fp13_confidence_class",
    "SELECT event_id, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' WHEN c > 0 THEN 'low' ELSE 'unknown' END AS confidence FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (event_id % 11)/10.0::DOUBLE END AS c FROM events)",
)
def confidence_class(spark, sf_dir):
    from geoquarry.functions import semantics as S

    c = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 11) / 10.0)
    return table(spark, sf_dir, "events").select("event_id", S.confidence_class(c).alias("confidence"))


@query("st1_union_all", fixtures.with_("poi", "stops") + "SELECT 'poi' AS kind, poi_id AS id, lon, lat FROM poi UNION ALL SELECT 'stop', stop_id, lon, lat FROM stops")
def union_all(spark, sf_dir):
    p = fixtures.poi(spark, sf_dir).select(F.lit("poi").alias("kind"), F.col("poi_id").alias("id"), "lon", "lat")
    return p.unionByName(fixtures.stops(spark, sf_dir).select(F.lit("stop").alias("kind"), F.col("stop_id").alias("id"), "lon", "lat"))


@query(
    "st2_priority_union",
    """SELECT id, arg_min(origin, rank) AS origin FROM (SELECT c_custkey % 900 AS id, 'project' AS origin, 0 AS rank FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey % 900, 'layer', 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey % 900, 'fusion', 2 FROM customer) GROUP BY id""",
)
def priority_union(spark, sf_dir):
    """First representation by priority wins: a partial minimum, not a window."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    part = lambda cond, name, rank: c.where(cond).select((F.col("c_custkey") % 900).alias("id"), F.lit(name).alias("origin"), F.lit(rank).alias("rank"))
    u = part("c_custkey % 3 = 0", "project", 0).unionAll(part("c_custkey % 2 = 0", "layer", 1)).unionAll(part("true", "fusion", 2))
    return u.groupBy("id").agg(F.min_by("origin", "rank").alias("origin"))


@query("st3_except", "SELECT DISTINCT c_custkey % 500 AS id FROM customer WHERE c_custkey % 500 NOT IN (SELECT s_suppkey FROM supplier)")
def except_(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("id"))
    return a.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_anti").distinct()


@query("st5_first_by_key", "SELECT key, min(event_id) AS first_id FROM (SELECT event_type || ':' || (user_id % 40) AS key, event_id FROM events) GROUP BY key")
def first_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 40).cast("string")).alias("key"), "event_id")
    return e.groupBy("key").agg(F.min("event_id").alias("first_id"))


@query("st8_duplicate_coordinates", fixtures.with_("roads") + "SELECT road_id FROM (SELECT road_id, row_number() OVER (PARTITION BY lon1, lat1 ORDER BY road_id) AS rn FROM roads) WHERE rn > 1")
def duplicates(spark, sf_dir):
    """Repeated occurrences only: rows whose id isn't the smallest at its place."""
    r = fixtures.roads(spark, sf_dir).select("road_id", "lon1", "lat1")
    first = r.groupBy("lon1", "lat1").agg(F.min("road_id").alias("first"))
    return r.join(first, ["lon1", "lat1"]).where("road_id <> first").select("road_id")


@query("tk4_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("st3_intersect", "SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0 INTERSECT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0")
def intersect_(spark, sf_dir):
    """Distinct nations and segments that both sides have."""
    c = table(spark, sf_dir, "customer")
    side = lambda where: c.where(where).select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return side("c_acctbal > 0").intersect(side("c_acctbal < 0"))
