"""From candidates to stored snapshots and back: groups, conflicts, versions, run states, contexts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.operators import fusion, sessions, snapshots, upserts
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.joins import FUNCTION, GEOMETRY, QUALITY_SQL, fused, grouped
from geoquarry.plans.policy import CANDIDATES_SQL, SCORE_SQL, candidates as policy_candidates, scored
from geoquarry.plans.staging import Staging
from geoquarry.plans.summaries import uri_part
from geoquarry.plans.territory import AREA_SQL
from geoquarry.sources.tables import spread, table

#: Groups replayed candidate by candidate: each keeps the founders of its place in a list; places never overlap each other.
GROUPS_SQL = (
    fixtures.with_("buildings", "candidates").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT *, building_id % 8633 AS place, row_number() OVER (PARTITION BY building_id % 8633 ORDER BY ordinal) AS rn FROM candidates),
    r AS (SELECT place, rn, ordinal, ordinal AS founder, [{'o': ordinal, 'w': west, 's': south, 'e': east, 'n': north}] AS fs FROM n WHERE rn = 1
      UNION ALL SELECT place, rn, ordinal, CASE WHEN len(met) = 0 THEN ordinal ELSE met[1].o END, CASE WHEN len(met) = 0 THEN list_append(fs, {'o': ordinal, 'w': west, 's': south, 'e': east, 'n': north}) ELSE fs END
      FROM (SELECT n.*, r.fs, list_filter(r.fs, lambda f: least(f.e, n.east) > greatest(f.w, n.west) AND least(f.n, n.north) > greatest(f.s, n.south)
        AND (least(f.e, n.east) - greatest(f.w, n.west))*(least(f.n, n.north) - greatest(f.s, n.south))/least((f.e-f.w)*(f.n-f.s), (n.east-n.west)*(n.north-n.south)) >= 0.45) AS met FROM r JOIN n ON n.place = r.place AND n.rn = r.rn + 1)),
    g AS (SELECT ordinal, founder FROM r)"""
)


@query("jn2_groups_replayed", GROUPS_SQL + " SELECT ordinal, founder FROM g")
def groups_replayed(spark, sf_dir):
    """JN2 against a recursive replay: every candidate and the founder of its group."""
    return grouped(spark, sf_dir)[1].select("ordinal", "founder")


RANK_SQL = "CASE c.source WHEN 'osm' THEN 0 WHEN 'microsoft-buildings' THEN 1 WHEN 'overture' THEN 2 WHEN 'local-buildings' THEN 3 WHEN 'city-geojson' THEN 4 ELSE 5 END"


@query(
    "jn3_pl3_preferred_and_alternates",
    GROUPS_SQL
    + f""", p AS (SELECT founder, arg_min(c.ordinal, {RANK_SQL}*100000000 + c.ordinal) AS best, count(*) AS n FROM g JOIN candidates c USING (ordinal) GROUP BY founder)
    SELECT c.ordinal, 'canonical:building:' || c.source || ':' || c.ordinal AS canonical_id, c.ordinal = p.best AS preferred, CASE WHEN p.n > 1 THEN p.n END AS in_conflict, CASE WHEN p.n > 1 THEN b.source END AS geometry_from,
      c.ordinal = p.best AS carries_all FROM candidates c JOIN g USING (ordinal) JOIN p USING (founder) JOIN candidates b ON b.ordinal = p.best""",
)
def preferred_and_alternates(spark, sf_dir):
    """Every candidate as a canonical feature: the one whose geometry the group took is preferred, the others are kept as alternates of a conflict."""
    c, groups = grouped(spark, sf_dir)
    m = c.select("ordinal", "source").join(groups, "ordinal")
    best = m.groupBy("founder").agg(fusion.pick("ordinal", "source", GEOMETRY, "ordinal").alias("best"), fusion.pick("source", "source", GEOMETRY, "ordinal").alias("best_source"), F.count(F.lit(1)).alias("n"))
    mine = F.col("ordinal") == F.col("best")
    contested = F.col("n") > 1
    return m.join(best, "founder").select(
        "ordinal",
        F.concat_ws(":", F.lit("canonical"), F.lit("building"), uri_part(F.col("source")), uri_part(F.col("ordinal").cast("string"))).alias("canonical_id"),
        mine.alias("preferred"),
        F.when(contested, F.col("n")).alias("in_conflict"),
        F.when(contested, F.col("best_source")).alias("geometry_from"),
        mine.alias("carries_all"),
    )


@query(
    "pl3_conflicts",
    GROUPS_SQL + f""", p AS (SELECT founder, arg_min(c.ordinal, {RANK_SQL}*100000000 + c.ordinal) AS best, count(*) AS n, sum(c.ordinal) AS members FROM g JOIN candidates c USING (ordinal) GROUP BY founder) SELECT best AS preferred, n, members FROM p WHERE n > 1""",
)
def conflicts(spark, sf_dir):
    """One row for each group of several candidates: the preferred, how many, and the sum of their ids."""
    c, groups = grouped(spark, sf_dir)
    m = c.select("ordinal", "source").join(groups, "ordinal")
    best = m.groupBy("founder").agg(fusion.pick("ordinal", "source", GEOMETRY, "ordinal").alias("preferred"), F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("members"))
    return best.where("n > 1").drop("founder")


def _picked(column: str, sources: tuple[str, ...], where: str) -> str:
    """The value of the source that comes first in ``sources``, then of the smallest ordinal."""
    rank = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(sources))
    return f"arg_min({column}, (CASE c.source {rank} ELSE {len(sources)} END)*100000000 + c.ordinal) FILTER ({where} IS NOT NULL)"


FUSED_SQL = (
    GROUPS_SQL
    + f""", m AS (SELECT founder, count(*) AS members, {_picked("struct_pack(source := source, west := west, south := south, east := east, north := north)", GEOMETRY, "c.west")} AS b,
      {_picked("height", GEOMETRY, "height")} AS height, {_picked("levels", FUNCTION, "levels")} AS levels, {_picked("usage", FUNCTION, "usage")} AS usage FROM g JOIN candidates c USING (ordinal) GROUP BY founder),
    fused AS (SELECT founder, members, source, height, levels, usage, {AREA_SQL} AS area, round(levels*3.2::DOUBLE, 2) AS from_levels FROM (SELECT *, b.source AS source, b.west AS west, b.south AS south, b.east AS east, b.north AS north FROM m))"""
)


@query(
    "tk3_fused_attributes",
    FUSED_SQL + " SELECT founder, members, source, height, levels, usage, round(area, 2) AS area, round(area*coalesce(height, from_levels), 2) AS volume FROM fused",
)
def fused_attributes(spark, sf_dir):
    """TK3 with the replayed groups: one building a group, each attribute from the source that ranks first for it."""
    return fused(spark, sf_dir)


@query(
    "ag21_fusion_counts",
    FUSED_SQL
    + """ SELECT sum(members) AS input, count(*) AS fused, greatest(sum(members) - count(*), 0) AS collapsed,
      count(from_levels) + count(area*coalesce(height, from_levels)) + count(CASE WHEN coalesce(height, from_levels) = from_levels THEN 1 END) AS derived FROM fused""",
)
def fusion_counts(spark, sf_dir):
    """Input, fused and collapsed buildings, and their derived attributes: a height from levels, a volume, and a height that is the one from levels, each where known."""
    f = fused(spark, sf_dir).withColumn("from_levels", F.round(F.col("levels") * 3.2, 2))
    tall = F.coalesce("height", "from_levels")
    derived = F.count("from_levels") + F.count("volume") + F.count_if(tall == F.col("from_levels"))
    g = f.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("input"), F.count(F.lit(1)).alias("fused"), derived.alias("derived"))
    return g.select("input", "fused", F.greatest(F.col("input") - F.col("fused"), F.lit(0)).alias("collapsed"), "derived")


SESSION_SQL = """WITH RECURSIVE n AS (SELECT event_id, user_id AS session, concat_ws(':', event_type, user_id, event_id % 7) AS a, concat_ws(':', user_id, cast(round(value) AS BIGINT) % 9) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    r AS (SELECT session, rn, event_id, true AS stays, [a] AS sa, [b] AS sb FROM n WHERE rn = 1
      UNION ALL SELECT n.session, n.rn, n.event_id, NOT (list_contains(sa, a) OR list_contains(sb, b)), CASE WHEN list_contains(sa, a) OR list_contains(sb, b) THEN sa ELSE list_append(sa, a) END, CASE WHEN list_contains(sa, a) OR list_contains(sb, b) THEN sb ELSE list_append(sb, b) END
      FROM r JOIN n ON n.session = r.session AND n.rn = r.rn + 1)"""


@query("st6_session_dedup", SESSION_SQL + " SELECT event_id FROM r WHERE stays")
def session_dedup(spark, sf_dir):
    """Events of a session that repeat neither the identity nor the place of one that stays before them."""
    e = table(spark, sf_dir, "events")
    a = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string"))
    b = F.concat_ws(":", F.col("user_id").cast("string"), (F.round("value").cast("long") % 9).cast("string"))
    return sessions.first_by_either(e.select("event_id", a.alias("a"), b.alias("b")), "event_id", ("a", "b"), Staging(spark, "session"))


def snapshot_features(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("domain"), (F.col("o_orderkey") % 3 != 0).alias("preferred"))


@query(
    "pl6_sk10_snapshots",
    """SELECT p AS project, t AS territory, v AS version, cast(count(*) AS BIGINT) AS features, sum(o_orderkey) AS ids FROM orders, (VALUES ('p1', 'north', 2), ('p1', 'south', 1), ('p2', 'north', 1)) s(p, t, v)
    WHERE CASE WHEN p = 'p1' AND t = 'north' THEN o_orderkey % 2 = 0 WHEN t = 'south' THEN o_orderkey % 5 = 1 ELSE true END GROUP BY 1, 2, 3""",
)
def stored_snapshots(spark, sf_dir):
    """Snapshots stored by project and territory, read back as the newest of each; one of three projects was deleted again."""
    store = snapshots.Store(spark, Staging(spark, "hub").root, "snapshots")
    f = snapshot_features(spark, sf_dir)
    for project, territory, part in (("p1", "north", "id % 3 = 0"), ("p1", "north", "id % 2 = 0"), ("p1", "south", "id % 5 = 1"), ("p2", "north", "true"), ("p3", "north", "true")):
        snapshots.build_snapshot(store, f.where(part), {"project": project, "territory": territory}, project, territory)
    store.delete(project="p3")
    newest = snapshots.latest(store.read())
    return newest.groupBy("project", "territory", "version").agg(F.count(F.lit(1)).alias("features"), F.sum("id").alias("ids"))


RUN_STORE_SQL = """r AS (SELECT o_orderkey AS run, 'p' || (o_custkey % 3) AS project, 't' || (o_custkey % 7) AS territory, ['osm', 'overture', 'city'][1 + cast(o_orderkey % 3 AS INT)] AS source, ['building', 'road'][1 + cast(o_custkey % 2 AS INT)] AS domain,
      CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'running' END AS status,
      CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS updates, cast(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS created FROM orders)"""


def run_store(spark, sf_dir):
    """Runs that began (all), were completed (even ones) and failed at last (every fifth), each an upsert of its project; one project is compacted in between, one at last."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    runs = o.select(k.alias("run"), F.concat(F.lit("p"), (c % 3).cast("string")).alias("project"), F.concat(F.lit("t"), (c % 7).cast("string")).alias("territory"), pick(("osm", "overture", "city"), k % 3).alias("source"), pick(("building", "road"), c % 2).alias("domain"), day.alias("created"))
    store = upserts.Upserts(spark, Staging(spark, "runs").root, "runs", ("run",), "updates")
    for updates, (status, part) in enumerate((("running", "true"), ("completed", "run % 2 = 0"), ("failed", "run % 5 = 0")), 1):
        for p in ("p0", "p1", "p2"):
            now = runs.where((F.col("project") == p) & F.expr(part)).drop("project")
            store.upsert(now.select("*", F.lit(status).alias("status"), F.lit(updates).alias("updates")), p)
        if updates == 2:
            store.compact("p1")
    store.compact("p2")
    return store


@query("sk10_upserted_runs", f"WITH {RUN_STORE_SQL} SELECT run, project, territory, source, domain, status, updates, created FROM r")
def upserted_runs(spark, sf_dir):
    """Every run as its last upsert left it, whether its project is compacted or not."""
    return run_store(spark, sf_dir).scan()


@query(
    "sc30_repository_scans",
    f"""WITH {RUN_STORE_SQL} SELECT 'territory' AS scan, run, status, row_number() OVER (PARTITION BY territory, source ORDER BY created DESC, run DESC) AS place FROM r WHERE project = 'p1' AND source = 'osm' AND domain = 'road'
    UNION ALL SELECT 'run', run, status, 1 FROM r WHERE project = 'p2' AND run % 100 < 3""",
)
def repository_scans(spark, sf_dir):
    """One project's runs by territory, of one source and domain, newest first; another's by run."""
    store = run_store(spark, sf_dir)
    by_territory = upserts.newest_first(store.scan("p1"), ("territory", "source"), "created", "run", F.col("source") == "osm", F.col("domain") == "road")
    by_run = upserts.newest_first(store.scan("p2"), ("run",), "created", "run", F.col("run") % 100 < 3)
    return by_territory.select(F.lit("territory").alias("scan"), "run", "status", "place").unionByName(by_run.select(F.lit("run").alias("scan"), "run", "status", "place"))


@query(
    "sk10_raw_payloads",
    """SELECT doc_id, CASE WHEN strlen(text) >= 20000 THEN strlen(text) END AS payload_bytes, CASE WHEN strlen(text) >= 20000 THEN 'Raw payload is ' || strlen(text) || ' bytes; future ingestion should chunk this source response.' END AS storage_warning FROM documents""",
)
def raw_payloads(spark, sf_dir):
    """Documents as raw payloads; those of 20,000 bytes or more (5 MiB by default) carry a warning."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"))
    return upserts.raw_records(d, limit=20_000).drop("payload")


RUNS_SQL = """u AS (SELECT user_id AS run, list_distinct(list(event_type)) AS requested, list_distinct(list(event_type) FILTER (event_id % 5 <> 0 AND user_id % 9 <> 0)) AS completed, list_distinct(list(event_type) FILTER (event_id % 37 = 0)) AS errors,
      list_distinct(list(event_type) FILTER (event_id % 53 = 0)) AS warnings FROM events GROUP BY 1)"""


@query(
    "pl2_run_status",
    f"""WITH {RUNS_SQL}, m AS (SELECT *, list_filter(requested, lambda d: NOT list_contains(coalesce(completed, []), d)) AS missing FROM u)
    SELECT run, len(missing) AS missing, len(coalesce(errors, [])) AS errors, CASE WHEN len(coalesce(completed, [])) = 0 THEN 'failed' WHEN len(missing) > 0 OR len(coalesce(errors, [])) > 0 OR len(coalesce(warnings, [])) > 0 THEN 'partial' ELSE 'completed' END AS status FROM m""",
)
def run_status(spark, sf_dir):
    """ST10 and PL2: distinct errors of each run, and its state from them, its warnings and its missing domains."""
    e = table(spark, sf_dir, "events")
    some = lambda cond: F.collect_set(F.when(cond, F.col("event_type")))
    runs = e.groupBy(F.col("user_id").alias("run")).agg(
        F.collect_set("event_type").alias("requested"),
        some((F.col("event_id") % 5 != 0) & (F.col("user_id") % 9 != 0)).alias("completed"),
        some(F.col("event_id") % 37 == 0).alias("errors"),
        some(F.col("event_id") % 53 == 0).alias("warnings"),
    )
    return snapshots.run_status(runs).select("run", F.size("missing").cast("long").alias("missing"), F.size("errors").cast("long").alias("errors"), "status")


# Analyses, their required domains with the least quality, whether each is required, whether a degraded context will do, and of which domains one is enough.
ANALYSES = (
    ("floor-count", (("building", True, 0.5),), True, ()), ("roads", (("road", True, 0.5),), True, ()), ("greenery", (("green_area", True, 0.5),), True, ()), ("water", (("waterbody", True, 0.5),), True, ()),
    ("poi-transit", (("poi", False, 0.4), ("transport_stop", False, 0.4)), True, ("poi", "transport_stop")), ("terrain", (("terrain", True, 0.5),), True, ()),
    ("transit-accessibility", (("road", True, 0.5), ("transport_stop", True, 0.5)), False, ()), ("elevation-analysis", (("terrain", True, 0.6),), False, ()), ("functional-zoning", (("boundary", True, 0.6),), False, ()),
    ("noise", (("road", True, 0.6),), False, ()), ("social-infrastructure", (("poi", True, 0.6),), False, ()), ("suitability", (("building", True, 0.5), ("road", True, 0.5), ("waterbody", False, None), ("green_area", False, None)), False, ()),
)
#: Domains that the fixtures have in a territory (nation) and their quality there.
DOMAIN_SQL = """q AS (SELECT s_nationkey AS territory, ['building','road','waterbody','green_area','poi','transport_stop','terrain','boundary'][1 + cast(s_suppkey % 8 AS INT)] AS domain, count(*) AS n, CASE WHEN max(s_suppkey) % 3 <> 0 THEN round((max(s_suppkey) % 11)/10.0::DOUBLE, 3) END AS quality FROM supplier GROUP BY 1, 2)"""


def domains_of(spark, sf_dir):
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(x) for x in ("building", "road", "waterbody", "green_area", "poi", "transport_stop", "terrain", "boundary")])
    q = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("territory"), F.get(names, (k % 8).cast("int")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("m"))
    return q.select("territory", "domain", "n", F.when(F.col("m") % 3 != 0, F.round((F.col("m") % 11) / 10.0, 3)).alias("quality"))


REQUIREMENTS = [(a, d, r, m, g, d in any_) for a, rs, g, any_ in ANALYSES for d, r, m in rs]


@query(
    "pl7_pl8_contexts_and_gates",
    f"""WITH {DOMAIN_SQL}, r AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v).lower() if isinstance(v, bool) else repr(v) for v in row) + ")" for row in REQUIREMENTS)}) v(analysis, domain, required, least, degradable, any_of)),
    t AS (SELECT n_nationkey AS territory FROM nation), j AS (SELECT t.territory, r.*, coalesce(n, 0) AS n, quality, coalesce(n, 0) = 0 OR (least IS NOT NULL AND (quality IS NULL OR quality < least)) AS missing FROM t CROSS JOIN r LEFT JOIN q ON q.territory = t.territory AND q.domain = r.domain),
    w AS (SELECT territory, bool_and(quality IS NOT NULL AND quality >= 0.9) AS complete FROM q GROUP BY 1),
    c AS (SELECT j.territory, analysis, count(CASE WHEN missing AND required THEN 1 END) = 0 AS ready, NOT coalesce(any_value(complete), false) OR count(CASE WHEN missing THEN 1 END) > 0 AS degraded, count(CASE WHEN required AND n = 0 THEN 1 END) > 0 OR (bool_or(any_of) AND sum(CASE WHEN any_of THEN n ELSE 0 END) = 0) AS no_data,
      any_value(degradable) AS degradable, count(CASE WHEN missing THEN 1 END) AS missing, count(CASE WHEN least IS NOT NULL AND n > 0 AND quality IS NULL THEN 1 END) AS warnings FROM j LEFT JOIN w USING (territory) GROUP BY 1, 2)
    SELECT territory, analysis, ready, degraded, missing, warnings, CASE WHEN no_data THEN 'MISSING_REQUIRED_DATA' WHEN degraded AND NOT degradable THEN 'DEGRADED_NOT_SUPPORTED' WHEN degraded THEN 'degraded' ELSE 'ready' END AS state FROM c""",
)
def contexts_and_gates(spark, sf_dir):
    """For each territory and analysis: what is missing, whether the context is ready or degraded, and whether the analysis may run."""
    return gated(contexts(domains_of(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory"))))


def contexts(domains, territories):
    """territory, analysis and the state of its requirements; ``domains`` has territory, domain, n, quality."""
    spark = domains.sparkSession
    r = spark.createDataFrame(REQUIREMENTS, "analysis string, domain string, required boolean, least double, degradable boolean, any_of boolean")
    j = territories.crossJoin(F.broadcast(r)).join(domains, ["territory", "domain"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = F.col("least").isNotNull() & (F.col("quality").isNull() | (F.col("quality") < F.col("least")))
    j = j.withColumn("missing", (F.col("n") == 0) | low)
    whole = domains.groupBy("territory").agg(F.bool_and(F.coalesce(F.col("quality") >= 0.9, F.lit(False))).alias("complete"))
    c = j.groupBy("territory", "analysis").agg(
        (F.count_if(F.col("missing") & F.col("required")) == 0).alias("ready"),
        F.count_if("missing").alias("missing"),
        F.count_if(F.col("least").isNotNull() & (F.col("n") > 0) & F.col("quality").isNull()).alias("warnings"),
        ((F.count_if(F.col("required") & (F.col("n") == 0)) > 0) | (F.bool_or("any_of") & (F.sum(F.when(F.col("any_of"), F.col("n")).otherwise(0)) == 0))).alias("no_data"),
        F.first("degradable").alias("degradable"),
    )
    c = c.join(whole, "territory", "left")
    return c.withColumn("degraded", ~F.coalesce("complete", F.lit(False)) | (F.col("missing") > 0))


def gated(c):
    """An analysis runs if its required data are there, and in a degraded context only if it can."""
    state = F.when(F.col("no_data"), "MISSING_REQUIRED_DATA").when(F.col("degraded") & ~F.col("degradable"), "DEGRADED_NOT_SUPPORTED").when(F.col("degraded"), "degraded").otherwise("ready")
    return c.select("territory", "analysis", "ready", "degraded", "missing", "warnings", state.alias("state"))


@query(
    "ag32_quality_review",
    f"""WITH {QUALITY_SQL}, r AS (SELECT * FROM (VALUES ('error', true, 0.5::DOUBLE, 0.5::DOUBLE), ('click', true, 0.2, 0.9), ('view', false, NULL, 0.4), ('flood', false, 0.1, NULL)) v(domain, required, min_coverage, min_quality)),
    m AS (SELECT r.*, q.n IS NULL OR q.n = 0 OR (min_coverage IS NOT NULL AND (coverage IS NULL OR coverage < min_coverage)) OR (min_quality IS NOT NULL AND (score IS NULL OR score < min_quality)) AS missing FROM r LEFT JOIN q ON q.domain = r.domain)
    SELECT count(CASE WHEN missing THEN 1 END) AS missing, bool_and(NOT missing OR NOT required) AS sufficient, (SELECT count(*) FROM q) = 0 OR (SELECT bool_or(coverage IS NULL OR score IS NULL) FROM q) AS manual_review FROM m""",
)
def quality_review(spark, sf_dir):
    """What is missing, whether that is all optional, and whether someone must look because a domain's quality is unknown."""
    q = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.count(F.lit(1)) / 2500).alias("coverage"), (F.avg("value") / 490).alias("score"))
    q = q.withColumn("coverage", F.when(F.col("domain") != "view", F.col("coverage")))
    r = spark.createDataFrame([("error", True, 0.5, 0.5), ("click", True, 0.2, 0.9), ("view", False, None, 0.4), ("flood", False, 0.1, None)], "domain string, required boolean, min_coverage double, min_quality double")
    below = lambda v, m: F.col(m).isNotNull() & (F.col(v).isNull() | (F.col(v) < F.col(m)))
    missing = F.coalesce(F.col("n"), F.lit(0)) == 0
    m = r.join(q, "domain", "left").withColumn("missing", missing | below("coverage", "min_coverage") | below("score", "min_quality"))
    one = m.agg(F.count_if("missing").alias("missing"), F.bool_and(~F.col("missing") | ~F.col("required")).alias("sufficient"))
    known = q.agg((F.coalesce(F.bool_or(F.col("coverage").isNull() | F.col("score").isNull()), F.lit(True))).alias("manual_review"))
    return one.crossJoin(F.broadcast(known))


LATEST_SQL = """s AS (SELECT o_custkey % 20 AS project, o_orderstatus AS territory, max((o_orderdate, o_orderkey)) AS x FROM orders GROUP BY 1, 2)"""


@query(
    "jn6_pl11_territory_status",
    f"""WITH {LATEST_SQL}, r AS (SELECT o_custkey % 20 AS project, o_orderstatus AS territory, o_orderkey AS snapshot, round(o_totalprice % 1000/1000, 3)::DOUBLE AS quality FROM orders WHERE o_orderkey % 2 = 0),
    u AS (SELECT o_custkey % 20 AS project, o_orderstatus AS territory, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_run FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
    SELECT s.project, s.territory, s.x[2] AS snapshot, r.quality, u.last_run FROM s LEFT JOIN r ON r.project = s.project AND r.territory = s.territory AND r.snapshot = s.x[2] LEFT JOIN u ON u.project = s.project AND u.territory = s.territory""",
)
def territory_status(spark, sf_dir):
    """FP4, JN6 and PL11: the latest snapshot of each territory with its own quality report, if there is one, and the last run."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("project"), F.col("o_orderstatus").alias("territory"), F.col("o_orderkey").alias("snapshot"), "o_orderdate", "o_totalprice", "o_orderpriority")
    at = F.struct("o_orderdate", "snapshot")
    s = o.groupBy("project", "territory").agg(F.max(at).alias("x")).select("project", "territory", F.col("x.snapshot").alias("snapshot"))
    r = o.where("snapshot % 2 = 0").select("project", "territory", "snapshot", F.round(F.col("o_totalprice") % 1000 / 1000, 3).cast("double").alias("quality"))
    u = o.where("snapshot % 3 = 0").groupBy("project", "territory").agg(F.max_by("o_orderpriority", at).alias("last_run"))
    return s.join(r, ["project", "territory", "snapshot"], "left").join(u, ["project", "territory"], "left").select("project", "territory", "snapshot", "quality", "last_run")


@query(
    "fp3_query_of_latest",
    f"""WITH {LATEST_SQL}, f AS (SELECT l_orderkey AS snapshot, l_partkey AS id, l_linenumber % 3 AS domain, l_returnflag <> 'R' AS preferred, CASE WHEN l_partkey % 4 <> 0 THEN cast(l_discount AS DOUBLE)*10 END AS confidence FROM lineitem)
    SELECT s.project, s.territory, f.id, f.domain FROM s JOIN f ON f.snapshot = s.x[2] WHERE domain IN (0, 2) AND preferred AND coalesce(confidence, 0) >= 0.3""",
)
def query_of_latest(spark, sf_dir):
    """Features of the latest snapshot of every project and territory, by domain, confidence and preference."""
    o = table(spark, sf_dir, "orders")
    s = o.groupBy((F.col("o_custkey") % 20).alias("project"), F.col("o_orderstatus").alias("territory")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    s = s.select("project", "territory", F.col("x.o_orderkey").alias("snapshot"))
    li = table(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_orderkey").alias("snapshot"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 3).alias("domain"), (F.col("l_returnflag") != "R").alias("preferred"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_discount").cast("double") * 10).alias("confidence"))
    f = f.where(F.col("domain").isin(0, 2) & F.col("preferred") & (F.coalesce("confidence", F.lit(0.0)) >= 0.3))
    return s.join(f, "snapshot").select("project", "territory", "id", "domain")


@query(
    "fp3_whole_query",
    f"""WITH {LATEST_SQL}, f AS (SELECT l_orderkey AS snapshot, l_partkey AS id, l_linenumber % 3 AS domain, l_returnflag <> 'R' AS preferred, CASE WHEN l_partkey % 4 <> 0 THEN cast(l_discount AS DOUBLE)*10 END AS confidence,
      37.5::DOUBLE + cast(l_partkey % 97 AS DOUBLE)*0.002::DOUBLE AS west, 55.6::DOUBLE + cast(l_partkey % 89 AS DOUBLE)*0.002::DOUBLE AS south, cast(1 + l_partkey % 5 AS DOUBLE)*0.001::DOUBLE AS size FROM lineitem)
    SELECT s.project, s.territory, f.id, f.domain FROM s JOIN f ON f.snapshot = s.x[2]
    WHERE domain IN (0, 2) AND preferred AND coalesce(confidence, 0) >= 0.3 AND west + size >= 37.55 AND west <= 37.65 AND south + size >= 55.62 AND south <= 55.72""",
)
def whole_query(spark, sf_dir):
    """Latest snapshot, domain, confidence, preference and box in one query; the features' conditions are in their scan."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = o.select((F.col("o_custkey") % 20).alias("project"), F.col("o_orderstatus").alias("territory"), F.col("o_orderkey").alias("snapshot"), "o_orderdate")
    k = F.col("l_partkey")
    west, south, size = F.lit(37.5) + (k % 97).cast("double") * F.lit(0.002), F.lit(55.6) + (k % 89).cast("double") * F.lit(0.002), (1 + k % 5).cast("double") * F.lit(0.001)
    f = li.select(F.col("l_orderkey").alias("snapshot"), k.alias("id"), (F.col("l_linenumber") % 3).alias("domain"), (F.col("l_returnflag") != "R").alias("preferred"), F.when(k % 4 != 0, F.col("l_discount").cast("double") * 10).alias("confidence"), west.alias("west"), south.alias("south"), (west + size).alias("east"), (south + size).alias("north"))
    return snapshots.query_latest(s, f, ("o_orderdate",), (37.55, 55.62, 37.65, 55.72), (0, 2), 0.3, True).select("project", "territory", "id", "domain")


@query(
    "pl1_source_plans",
    f"""WITH {CANDIDATES_SQL}, {SCORE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(score, 9) DESC, source_id) AS rn FROM s WHERE NOT rejected),
    k AS (SELECT domain, source_id, id, preferred FROM r WHERE (score >= 0.62 AND rn <= 3) OR rn = 1)
    SELECT domain, source_id, cast(row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN preferred THEN 0 ELSE 1 END, id) AS INT) AS fetch_order FROM k""",
)
def source_plans(spark, sf_dir):
    """Sources that each domain's policy selects, in the order of fetching: the preferred first, then as registered."""
    from pyspark.sql import Window as W

    s = scored(policy_candidates(spark, sf_dir)).where(~F.col("rejected"))
    place = F.row_number().over(W.partitionBy("domain").orderBy(F.desc(F.round("score", 9)), "source_id"))
    k = s.withColumn("place", place).where((F.col("place") <= 3) & ((F.col("score") >= 0.62) | (F.col("place") == 1)))
    order = W.partitionBy("domain").orderBy(F.when(F.col("preferred"), 0).otherwise(1), "id")
    return k.select("domain", "source_id", F.row_number().over(order).alias("fetch_order"))


# Sources of each role by rank; 0 and up are primary, 100 and up secondary, 200 and up fallbacks.
RANKS = {
    "buildings": ("osm:100", "microsoft-buildings:101", "overture:102", "open-aerial-map:203"),
    "functions": ("osm:100", "wikidata:101", "city-geojson:102", "national-geospatial-portal:203"),
    "poi": ("osm:100", "wikidata:101", "overture:102", "national-geospatial-portal:203"),
    "transport": ("osm:100", "gtfs:101", "national-geospatial-portal:202"),
    "terrain": ("copernicus-dem:0", "nasa-srtm:101", "open-topography:102", "open-elevation:203", "aster-gdem:204", "mapbox-terrain:205"),
}
_RANKED = [(role, *x.rsplit(":", 1)) for role, xs in RANKS.items() for x in xs]


@query(
    "tk6_priority_plans",
    f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{s}', {n})" for r, s, n in _RANKED)}) v(role, source, rank)), a AS (SELECT unnest(['osm','gtfs','overture','wikidata','open-elevation','copernicus-dem','else']) AS source), r AS (SELECT unnest({list(RANKS)}) AS role)
    SELECT r.role, a.source, coalesce(p.rank, 10000) AS rank, cast(row_number() OVER (PARTITION BY r.role ORDER BY coalesce(p.rank, 10000), a.source) AS INT) AS place FROM r CROSS JOIN a LEFT JOIN p ON p.role = r.role AND p.source = a.source""",
)
def priority_plans(spark, sf_dir):
    """Available sources in each role's order of priority; unlisted ones last."""
    from pyspark.sql import Window as W

    p = spark.createDataFrame([(r, s, int(n)) for r, s, n in _RANKED], "role string, source string, rank int")
    a = spark.createDataFrame([(r, s) for r in RANKS for s in ("osm", "gtfs", "overture", "wikidata", "open-elevation", "copernicus-dem", "else")], "role string, source string")
    j = a.join(F.broadcast(p), ["role", "source"], "left").withColumn("rank", F.coalesce("rank", F.lit(10000)))
    return j.withColumn("place", F.row_number().over(W.partitionBy("role").orderBy("rank", "source")))


@query(
    "tk6_first_available",
    fixtures.with_("buildings", "candidates")
    + f""", p AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{s}', {n})" for r, s, n in _RANKED)}) v(role, source, rank)), r AS (SELECT unnest({list(RANKS)}) AS role),
    a AS (SELECT building_id, role, source, coalesce(rank, 10000) AS rank FROM candidates CROSS JOIN r LEFT JOIN p USING (role, source))
    SELECT building_id, role, count(*) AS available, arg_min(source, struct_pack(r := rank, s := source)) AS first, min(rank) AS rank FROM a GROUP BY 1, 2""",
)
def first_available(spark, sf_dir):
    """Of the sources that have a building, the one that each role takes first, and its priority (10000 if the role doesn't list it)."""
    c = spread(fixtures.candidates(spark, sf_dir).select("building_id", "source"), "building_id")  # groups below stay where they are
    best = []
    for role, sources in RANKS.items():
        rank = F.create_map(*[F.lit(x) for s in sources for x in (s.rsplit(":", 1)[0], int(s.rsplit(":", 1)[1]))])[F.col("source")]
        best.append(F.min(F.struct(F.coalesce(rank, F.lit(10000)).alias("rank"), F.col("source").alias("first"))).alias(role))
    b = c.groupBy("building_id").agg(F.count(F.lit(1)).alias("available"), *best)  # a group for each building, not for each of its roles
    roles = F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r)["first"].alias("first"), F.col(r)["rank"].alias("rank")) for r in RANKS]))
    return b.select("building_id", "available", roles).select("building_id", "role", "available", "first", "rank")


@query(
    "jn14_merged_layers",
    """WITH d AS (SELECT * FROM (VALUES ('buildings', 0), ('roads', 1), ('green', 2), ('water', 3), ('terrain', 4)) v(category, i)), e AS (SELECT s_nationkey AS project, ['buildings','water','notes','roads','sketch'][1 + cast(s_suppkey % 5 AS INT)] AS category, arg_max(s_name, s_suppkey) AS name, cast(max(s_suppkey) % 9 AS INT) AS ord FROM supplier GROUP BY 1, 2),
    p AS (SELECT DISTINCT project FROM e), u AS (SELECT p.project, d.category, coalesce(e.name, d.category) AS name, coalesce(e.ord, d.i) AS ord FROM p CROSS JOIN d LEFT JOIN e ON e.project = p.project AND e.category = d.category
      UNION ALL SELECT project, category, name, ord FROM e WHERE category NOT IN (SELECT category FROM d))
    SELECT project, category, name, cast(row_number() OVER (PARTITION BY project ORDER BY ord, category) - 1 AS INT) AS position FROM u""",
)
def merged_layers(spark, sf_dir):
    """Layer definitions keep what a project had set for them, its other layers stay, and all are numbered anew."""
    from pyspark.sql import Window as W

    names = F.array(*[F.lit(x) for x in ("buildings", "water", "notes", "roads", "sketch")])
    k = F.col("s_suppkey")
    e = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("project"), F.get(names, (k % 5).cast("int")).alias("category")).agg(F.max_by("s_name", k).alias("name"), (F.max(k) % 9).cast("int").alias("ord"))
    d = spark.createDataFrame([(c, i) for i, c in enumerate(("buildings", "roads", "green", "water", "terrain"))], "category string, i int")
    incoming = e.select("project").distinct().crossJoin(F.broadcast(d)).join(e, ["project", "category"], "left").select("project", "category", F.coalesce("name", "category").alias("name"), F.coalesce("ord", "i").alias("ord"))
    kept = e.join(F.broadcast(d), "category", "left_anti").select("project", "category", "name", "ord")
    return incoming.unionByName(kept).select("project", "category", "name", (F.row_number().over(W.partitionBy("project").orderBy("ord", "category")) - 1).alias("position"))


@query(
    "ag18_ag19_quality_reports",
    """WITH p AS (SELECT l_suppkey % 10 AS domain, l_orderkey AS id, 's' || (l_suppkey % 4) AS source, l_returnflag <> 'R' AS preferred, l_quantity > 3 AS valid, ((l_discount > 0.02)::INT + (l_tax > 0.01)::INT)/2.0::DOUBLE AS attributes, l_shipdate AS acquired FROM lineitem),
    m AS (SELECT domain, count(CASE WHEN preferred THEN 1 END) AS n, count(*) AS candidates, round(avg(CASE WHEN preferred THEN CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END END), 3) AS geometry, round(avg(CASE WHEN preferred THEN attributes END), 3) AS attributes,
      CASE WHEN domain < 6 THEN round(0.5 + domain/20.0::DOUBLE, 3) END AS coverage, CASE WHEN count(CASE WHEN preferred AND source = 's3' THEN 1 END) = 0 THEN round(avg(CASE WHEN preferred THEN CASE WHEN date_diff('day', acquired, DATE '2024-12-31') <= CASE source WHEN 's0' THEN 400 ELSE 2500 END THEN 1.0::DOUBLE ELSE 0 END END), 3) END AS freshness,
      list_sort(list_distinct(list(source) FILTER (preferred))) AS sources FROM p GROUP BY domain),
    r AS (SELECT *, CASE WHEN NOT list_contains(sources, 's3') AND len(sources) > 0 THEN round(list_sum(list_transform(sources, lambda s: CASE s WHEN 's0' THEN 0.9 WHEN 's1' THEN 0.7 ELSE 0.5 END::DOUBLE))/len(sources), 3) END AS reliability FROM m),
    o AS (SELECT *, CASE WHEN coverage IS NOT NULL AND freshness IS NOT NULL AND reliability IS NOT NULL AND geometry IS NOT NULL AND attributes IS NOT NULL THEN round((coverage + geometry + attributes + freshness + reliability)/5, 3) END AS overall,
      CASE WHEN n = 0 THEN 'empty' WHEN geometry = 0 THEN 'failed' WHEN geometry < 1 OR attributes < 1 THEN 'degraded' WHEN coverage IS NULL OR freshness IS NULL OR reliability IS NULL THEN 'partial' ELSE 'complete' END AS s FROM r)
    SELECT domain, n, candidates, geometry, attributes, coverage, freshness, reliability, overall, CASE WHEN candidates > n AND s IN ('complete','partial') THEN 'degraded' ELSE s END AS status,
      (candidates > n)::INT + (domain = 1)::INT + (domain = 3)::INT + (coverage IS NULL)::INT + (freshness IS NULL)::INT + (reliability IS NULL)::INT AS warnings FROM o""",
)
def quality_reports(spark, sf_dir):
    """All five scores of each domain from its preferred features, the overall one if all are known, status and warnings.

    Freshness needs an age limit, and reliability a declared value, for every source of the domain.
    """
    li = table(spark, sf_dir, "lineitem")
    source = F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    p = li.select(
        (F.col("l_suppkey") % 10).alias("domain"), source.alias("source"), (F.col("l_returnflag") != "R").alias("preferred"), (F.col("l_quantity") > 3).alias("valid"),
        ((one(F.col("l_discount") > 0.02) + one(F.col("l_tax") > 0.01)) / 2).alias("attributes"), F.date_diff(F.lit("2024-12-31").cast("date"), F.col("l_shipdate").cast("date")).alias("age"),
    )
    limits, declared = {"s0": 400, "s1": 2500, "s2": 2500}, {"s0": 0.9, "s1": 0.7, "s2": 0.5}
    return domain_reports(p, limits, declared, F.when(F.col("domain") < 6, F.round(F.lit(0.5) + F.col("domain") / 20.0, 3)))


def domain_reports(rows, limits: dict, declared: dict, coverage, road: int = 1, green: int = 3):
    """Quality by domain of rows (domain, source, preferred, valid, attributes, age in days)."""
    known = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("source")]
    mine = F.col("preferred")
    fresh = F.when(mine, F.when(F.col("age") <= known(limits), 1.0).when(known(limits).isNotNull(), 0.0))
    # sources are few: distinct ones are counted by a first grouping, so no set of rows is gathered
    of_source = rows.withColumn("trust", known(declared)).groupBy("domain", "source").agg(
        F.count_if(mine).alias("n"), F.count(F.lit(1)).alias("candidates"), F.sum(F.when(mine, F.when(F.col("valid"), 1.0).otherwise(0.0))).alias("valid"), F.sum(F.when(mine, F.col("attributes"))).alias("attributes"), F.sum(fresh).alias("fresh"), F.count(fresh).alias("aged"), F.first("trust").alias("trust")
    )
    used = F.col("n") > 0
    d = of_source.groupBy("domain").agg(
        F.sum("n").alias("n"), F.sum("candidates").alias("candidates"), F.sum("valid").alias("v"), F.sum("attributes").alias("a"), F.sum("fresh").alias("f"), F.sum("aged").alias("aged"),
        F.count_if(used).alias("sources"), F.count(F.when(used, F.col("trust"))).alias("trusted"), F.sum(F.when(used, F.col("trust"))).alias("t"),
    )
    n = F.nullif(F.col("n"), F.lit(0))
    d = d.select(
        "domain", "n", "candidates", F.round(F.col("v") / n, 3).alias("geometry"), F.round(F.col("a") / n, 3).alias("attributes"), coverage.alias("coverage"),
        F.when((F.col("aged") == F.col("n")) & (F.col("n") > 0), F.round(F.col("f") / n, 3)).alias("freshness"), F.when((F.col("trusted") == F.col("sources")) & (F.col("sources") > 0), F.round(F.col("t") / F.nullif(F.col("sources"), F.lit(0)), 3)).alias("reliability"),
    )
    five = [F.col(c) for c in ("coverage", "geometry", "attributes", "freshness", "reliability")]
    total = five[0]
    for c in five[1:]:
        total = total + c
    unknown = [F.col(c).isNull() for c in ("coverage", "freshness", "reliability")]
    plain = F.when(F.col("n") == 0, "empty").when(F.col("geometry") == 0, "failed").when((F.col("geometry") < 1) | (F.col("attributes") < 1), "degraded").when(unknown[0] | unknown[1] | unknown[2], "partial").otherwise("complete")
    contested = F.col("candidates") > F.col("n")
    warnings = contested.cast("int") + (F.col("domain") == road).cast("int") + (F.col("domain") == green).cast("int")
    for u in unknown:
        warnings = warnings + u.cast("int")
    return d.select("*", F.round(total / 5, 3).alias("overall"), F.when(contested & plain.isin("complete", "partial"), "degraded").otherwise(plain).alias("status"), warnings.alias("warnings"))


@query(
    "ag31_coverage_states",
    f"""WITH {DOMAIN_SQL}, f AS (SELECT *, CASE WHEN quality IS NOT NULL THEN round(1 - quality/2, 3) END AS freshness, CASE WHEN n % 2 = 1 THEN 0.9::DOUBLE WHEN n % 4 = 2 THEN 0.3::DOUBLE END AS coverage FROM q),
    r AS (SELECT n_nationkey AS territory, d AS domain, mc FROM nation, (VALUES ('building', 0.5::DOUBLE), ('road', NULL), ('green_area', NULL), ('imagery', NULL)) v(d, mc)),
    s AS (SELECT r.territory, r.domain, coalesce(n, 0) = 0 AS missing, coalesce(n, 0) > 0 AND (coverage IS NULL OR quality IS NULL) AS partial, coalesce(n, 0) > 0 AND coalesce(freshness < 0.55, false) AS outdated,
      coalesce(n, 0) > 0 AND ((mc IS NOT NULL AND (coverage IS NULL OR coverage < mc)) OR quality IS NULL OR quality < 0.5) AS below FROM r LEFT JOIN f ON f.territory = r.territory AND f.domain = r.domain)
    SELECT *, NOT missing AND NOT partial AND NOT outdated AND NOT below AS covered FROM s""",
)
def coverage_states(spark, sf_dir):
    """For each wanted domain of a territory: missing, partial, outdated, below a threshold, or covered.  An unknown score is below any threshold that is set."""
    d = domains_of(spark, sf_dir)
    d = d.withColumns({"freshness": F.round(1 - F.col("quality") / 2, 3), "coverage": F.when(F.col("n") % 2 == 1, 0.9).when(F.col("n") % 4 == 2, 0.3)})
    wanted = spark.createDataFrame([("building", 0.5), ("road", None), ("green_area", None), ("imagery", None)], "domain string, least_coverage double")
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory")).crossJoin(F.broadcast(wanted))
    there = F.coalesce("n", F.lit(0)) > 0
    short = F.col("least_coverage").isNotNull() & (F.col("coverage").isNull() | (F.col("coverage") < F.col("least_coverage")))
    s = r.join(d, ["territory", "domain"], "left").select(
        "territory",
        "domain",
        (~there).alias("missing"),
        (there & (F.col("coverage").isNull() | F.col("quality").isNull())).alias("partial"),
        (there & F.coalesce(F.col("freshness") < 0.55, F.lit(False))).alias("outdated"),
        (there & (short | F.col("quality").isNull() | (F.col("quality") < 0.5))).alias("below"),
    )
    return s.withColumn("covered", ~F.col("missing") & ~F.col("partial") & ~F.col("outdated") & ~F.col("below"))
