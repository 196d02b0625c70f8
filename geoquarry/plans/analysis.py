"""Analysis aggregates: distributions, networks, terrain, access, urban model and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo, semantics as S
from geoquarry.operators import spatial
from geoquarry.operators.prefix import running_total
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.staging import Staging
from geoquarry.plans.semantics import AGE_SQL, HEIGHT_SQL, with_area
from geoquarry.plans.territory import AREA_SQL

HAVERSINE_SQL = "2*6371000.0::DOUBLE*atan2(sqrt({h}), sqrt(1.0::DOUBLE-({h})))"
ROAD_H = "sin(radians(lat2-lat1)/2)*sin(radians(lat2-lat1)/2)+cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2-lon1)/2)*sin(radians(lon2-lon1)/2)"
LENGTH_SQL = HAVERSINE_SQL.format(h=ROAD_H)


def zero_filled(df, column: str, categories):
    """Count by category, with a zero for each category that has no row."""
    spark = df.sparkSession
    every = spark.createDataFrame([(c,) for c in categories], f"{column} string")
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def _values(xs):
    return ", ".join(f"('{x}')" for x in xs)


def _distribution(name, column, categories, expr_sql, expr):
    @query(name, fixtures.with_("buildings") + f""", b AS (SELECT {expr_sql} AS {column} FROM buildings)
      SELECT v.c AS {column}, count(b.{column}) AS n FROM (VALUES {_values(categories)}) v(c) LEFT JOIN b ON b.{column} = v.c GROUP BY v.c""")
    def run(spark, sf_dir):
        return zero_filled(fixtures.buildings(spark, sf_dir).select(expr().alias(column)), column, categories)

    return run


_distribution("ag6_floor_distribution", "height_class", S.HEIGHTS, HEIGHT_SQL, lambda: S.height_class(F.col("levels"), F.col("height")))
_distribution("ag7_age_distribution", "age_class", S.AGES, AGE_SQL, lambda: S.age_class(F.col("year")))
_distribution("ag8_function_distribution", "usage", S.FUNCTIONS, "usage", lambda: F.col("usage"))


def road_lengths(spark, sf_dir):
    r = fixtures.roads(spark, sf_dir)
    return r.withColumn("length", geo.haversine(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]))


@query(
    "ag9_roads",
    fixtures.with_("roads", "territories")
    + f""", r AS (SELECT road_type, {LENGTH_SQL} AS length FROM roads), t AS (SELECT sum({AREA_SQL}) AS area FROM territories)
    SELECT v.c AS road_type, round(coalesce(sum(r.length), 0), 1) AS length_m, round(coalesce(sum(r.length), 0) / (max(t.area) / 1000000), 4) AS density_m_km2
    FROM (VALUES {_values(S.ROAD_TYPES)}) v(c) LEFT JOIN r ON r.road_type = v.c CROSS JOIN t GROUP BY v.c""",
)
def roads(spark, sf_dir):
    """Length and density by class, all classes listed; the one-row territory area is a broadcast of fixed size."""
    area = with_area(fixtures.territories(spark, sf_dir)).agg(F.sum("area").alias("area"))
    lengths = road_lengths(spark, sf_dir).groupBy("road_type").agg(F.sum("length").alias("length"))
    every = spark.createDataFrame([(c,) for c in S.ROAD_TYPES], "road_type string")
    all_ = F.broadcast(every).join(lengths, "road_type", "left").crossJoin(F.broadcast(area))
    m = F.coalesce("length", F.lit(0.0))
    return all_.select("road_type", F.round(m, 1).alias("length_m"), F.round(m / (F.col("area") / 1000000), 4).alias("density_m_km2"))


@query(
    "ag2_ag5_buildings_by_territory",
    fixtures.with_("buildings", "territories")
    + f""", b AS (SELECT *, {AREA_SQL} AS area FROM buildings), t AS (SELECT *, {AREA_SQL} AS territory FROM territories),
    j AS (SELECT t.territory_id, t.territory, b.* FROM t LEFT JOIN b ON b.west >= t.west AND b.west < t.east AND b.south >= t.south AND b.south < t.north)
    SELECT territory_id, count(building_id) AS n_buildings, round(coalesce(sum(area), 0), 1) AS footprint_m2, round(coalesce(sum(area*coalesce(levels,1)), 0), 1) AS floor_area_m2,
      round(avg(levels), 6) AS avg_levels, max(levels) AS max_levels, round(CASE WHEN count(building_id) = 0 THEN 0 ELSE 100.0::DOUBLE*count(year)/count(building_id) END, 6) AS age_coverage,
      round(CASE WHEN count(building_id) = 0 THEN 0 ELSE 100.0::DOUBLE*count(CASE WHEN usage <> 'unknown' THEN 1 END)/count(building_id) END, 6) AS function_coverage,
      round(CASE WHEN count(building_id) = 0 THEN 0 ELSE 100.0::DOUBLE*count(coalesce(levels, height))/count(building_id) END, 6) AS floor_coverage,
      round(coalesce(sum(CASE WHEN usage = 'residential' THEN area*coalesce(levels,1) END), 0)*0.035, 2) AS population,
      round(100*coalesce(sum(area), 0)/max(territory), 6) AS gsi FROM j GROUP BY territory_id""",
)
def buildings_by_territory(spark, sf_dir):
    """Buildings meet territories on grid cells (no broadcast of a side whose size isn't known)."""
    b = with_area(fixtures.buildings(spark, sf_dir))
    t = with_area(fixtures.territories(spark, sf_dir)).withColumnRenamed("area", "territory")
    b = b.select(*[F.col(c) for c in ("building_id", "area", "levels", "height", "year", "usage")], F.col("west").alias("x"), F.col("south").alias("y"))
    j = spatial.points_in_boxes(b, t, "x", "y")
    n, floor = F.count("building_id"), F.col("area") * F.coalesce("levels", F.lit(1.0))
    share = lambda c: F.round(100.0 * c / n, 6)
    got = j.groupBy("territory_id").agg(
        n.alias("n_buildings"),
        F.round(F.sum("area"), 1).alias("footprint_m2"),
        F.round(F.sum(floor), 1).alias("floor_area_m2"),
        F.round(F.avg("levels"), 6).alias("avg_levels"),
        F.max("levels").alias("max_levels"),
        share(F.count("year")).alias("age_coverage"),
        share(F.count_if(F.col("usage") != "unknown")).alias("function_coverage"),
        share(F.count(F.coalesce("levels", "height"))).alias("floor_coverage"),
        F.round(F.coalesce(F.sum(F.when(F.col("usage") == "residential", floor)), F.lit(0.0)) * 0.035, 2).alias("population"),
        F.round(100 * F.sum("area") / F.max("territory"), 6).alias("gsi"),
    )
    zero = ["footprint_m2", "floor_area_m2", "age_coverage", "function_coverage", "floor_coverage", "population", "gsi"]
    return t.select("territory_id").join(got, "territory_id", "left").fillna(0.0, zero).fillna(0, ["n_buildings"])


@query(
    "ag12_terrain",
    fixtures.with_("terrain")
    + """SELECT CASE WHEN count(*) = 0 THEN 'not-available' ELSE 'ready' END AS status, min(elevation) AS min_elevation, max(elevation) AS max_elevation,
      round(avg(elevation), 6) AS avg_elevation, round(least(100, 100.0::DOUBLE*count(elevation)/greatest(count(*), 1)), 6) AS coverage FROM terrain""",
)
def terrain(spark, sf_dir):
    t = fixtures.terrain(spark, sf_dir).withColumn("elevation", F.when(~F.isnan("elevation"), F.col("elevation")))
    return t.agg(
        F.when(F.count(F.lit(1)) == 0, "not-available").otherwise("ready").alias("status"),
        F.min("elevation").alias("min_elevation"),
        F.max("elevation").alias("max_elevation"),
        F.round(F.avg("elevation"), 6).alias("avg_elevation"),
        F.round(F.least(F.lit(100.0), 100.0 * F.count("elevation") / F.greatest(F.count(F.lit(1)), F.lit(1))), 6).alias("coverage"),
    )


@query(
    "wn7_elevation_terciles",
    fixtures.with_("terrain")
    + """, r AS (SELECT min(elevation) AS lo, greatest(max(elevation)-min(elevation), 1) AS span FROM terrain)
    SELECT terrain_id, CASE WHEN elevation IS NULL THEN 'unknown' WHEN elevation <= lo + span/3 THEN 'low' WHEN elevation <= lo + span*2/3 THEN 'medium' ELSE 'high' END AS elevation_class FROM terrain CROSS JOIN r""",
)
def terciles(spark, sf_dir):
    """Thirds of the value range (not of ranks); the range is one row, not a window over everything."""
    t = fixtures.terrain(spark, sf_dir)
    r = t.agg(F.min("elevation").alias("lo"), F.greatest(F.max("elevation") - F.min("elevation"), F.lit(1.0)).alias("span"))
    e, lo, span = F.col("elevation"), F.col("lo"), F.col("span")
    kind = F.when(e.isNull(), "unknown").when(e <= lo + span / 3, "low").when(e <= lo + span * 2 / 3, "medium").otherwise("high")
    return t.crossJoin(F.broadcast(r)).select("terrain_id", kind.alias("elevation_class"))


@query(
    "ag13_accessibility",
    fixtures.with_("poi", "stops")
    + """, c AS (SELECT CASE WHEN regexp_matches(category, 'school|college|university|kindergarten|education') THEN 'schools' WHEN regexp_matches(category, 'hospital|clinic|doctor|health') THEN 'hospitals'
      WHEN regexp_matches(category, 'metro|subway|station') THEN 'metro' ELSE 'services' END AS g FROM poi), s AS (SELECT count(*) AS n FROM stops), p AS (SELECT count(*) AS n FROM poi)
    SELECT v.c AS access_group, count(c.g) AS n, CASE WHEN max(s.n) > 0 THEN 100 WHEN max(p.n) > 0 THEN 35 ELSE 0 END AS coverage
    FROM (VALUES ('metro'),('schools'),('hospitals'),('services')) v(c) LEFT JOIN c ON c.g = v.c CROSS JOIN s CROSS JOIN p GROUP BY v.c""",
)
def accessibility(spark, sf_dir):
    """Coverage is 100 with any stop, else 35 with any point of interest, else 0."""
    p = fixtures.poi(spark, sf_dir).select(S.poi_class(F.col("category")).alias("access_group"))
    one = fixtures.stops(spark, sf_dir).agg(F.count(F.lit(1)).alias("s")).crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("p"))))
    cover = F.when(F.col("s") > 0, 100).when(F.col("p") > 0, 35).otherwise(0)
    return zero_filled(p, "access_group", ("metro", "schools", "hospitals", "services")).crossJoin(F.broadcast(one)).select("access_group", "n", cover.alias("coverage"))


SCENARIOS = (("base", 0, 0, 0, 0), ("compact10", 8, -2, 2, 10), ("compact20", 16, -5, 3, 20), ("optimistic", 5, 12, 12, 8), ("height", 10, -3, 4, 28), ("transit", 4, 3, 24, 6))
MODEL_SQL = (
    fixtures.with_("buildings", "roads", "territories", "stops")
    + f""", b AS (SELECT count(*) AS n, sum({AREA_SQL}) AS fp, sum({AREA_SQL}*coalesce(levels,1)) AS fa, coalesce(avg(levels), 0) AS lv FROM buildings),
    r AS (SELECT sum({LENGTH_SQL}) AS len FROM roads), t AS (SELECT sum({AREA_SQL}) AS area FROM territories), s AS (SELECT count(*) AS n FROM stops),
    m0 AS (SELECT fa/area AS far, 100*fp/area AS gsi, b.n/(area/10000) AS density, lv, len/(area/10000) AS rd, s.n AS stops FROM b, r, t, s),
    m1 AS (SELECT *, greatest(0, least(100, rd/220*100)) AS noise, greatest(0, least(100, 100 - lv*5 - gsi*0.35::DOUBLE)) AS insolation, greatest(0, least(100, stops*12 + least(60, rd/45))) AS transport FROM m0),
    m AS (SELECT *, floor(greatest(0, least(100, (insolation + 0 + transport + (100 - noise))/4)) + 0.5) AS composite FROM m1)"""
)


def urban_model(spark, sf_dir, shares=None):
    """One row: FAR, GSI, densities, noise, insolation, transport and the composite score.

    ``shares`` is a row of green and water areas (green_m2, water_m2); without it both are 0.
    """
    b = with_area(fixtures.buildings(spark, sf_dir))
    one = b.agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("fp"), F.sum(F.col("area") * F.coalesce("levels", F.lit(1.0))).alias("fa"), F.coalesce(F.avg("levels"), F.lit(0.0)).alias("lv"))
    one = one.crossJoin(F.broadcast(road_lengths(spark, sf_dir).agg(F.sum("length").alias("len"))))
    one = one.crossJoin(F.broadcast(with_area(fixtures.territories(spark, sf_dir)).agg(F.sum("area").alias("area"))))
    one = one.crossJoin(F.broadcast(fixtures.stops(spark, sf_dir).agg(F.count(F.lit(1)).alias("stops"))))
    if shares is not None:
        one = one.crossJoin(F.broadcast(shares))
    part = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) / F.col("area") * 100) if shares is not None else F.lit(0.0)
    ha = F.col("area") / 10000
    m = one.select(part("green_m2").alias("green"), part("water_m2").alias("water"), (F.col("fa") / F.col("area")).alias("far"), (100 * F.col("fp") / F.col("area")).alias("gsi"), (F.col("n") / ha).alias("density"), "lv", (F.col("len") / ha).alias("rd"), "stops")
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    m = m.withColumns({"green": held(F.col("green")), "water": held(F.col("water")), "noise": held(F.col("rd") / 220 * 100), "insolation": held(100 - F.col("lv") * 5 - F.col("gsi") * 0.35), "transport": held(F.col("stops") * 12 + F.least(F.lit(60.0), F.col("rd") / 45))})
    return m.withColumn("composite", F.floor(held((F.col("insolation") + F.col("green") + F.col("transport") + (100 - F.col("noise"))) / 4) + 0.5).cast("double"))


@query("ag14_urban_model", MODEL_SQL + """ SELECT round(far, 6) AS far, round(gsi, 6) AS gsi, round(density, 6) AS density, round(rd, 4) AS road_density, round(noise, 4) AS noise,
      cast(floor(45 + noise*0.33::DOUBLE + 0.5) AS BIGINT) AS noise_db, round(insolation, 4) AS insolation, round(greatest(1.2::DOUBLE, least(6.8::DOUBLE, insolation/18)), 4) AS insolation_hours, round(transport, 4) AS transport, composite FROM m""")
def ag14(spark, sf_dir):
    r = lambda c, d: F.round(F.col(c), d)
    hours = F.greatest(F.lit(1.2), F.least(F.lit(6.8), F.col("insolation") / 18))
    return urban_model(spark, sf_dir).select(r("far", 6).alias("far"), r("gsi", 6).alias("gsi"), r("density", 6).alias("density"), r("rd", 4).alias("road_density"), r("noise", 4).alias("noise"), F.floor(45 + F.col("noise") * 0.33 + 0.5).alias("noise_db"), r("insolation", 4).alias("insolation"), F.round(hours, 4).alias("insolation_hours"), r("transport", 4).alias("transport"), "composite")


@query("ag15_scenarios", MODEL_SQL + f""" SELECT v.id AS scenario, round(far*(1 + fad/100.0::DOUBLE), 6) AS far, round(greatest(0, least(100, gsi + dd*0.35::DOUBLE)), 6) AS gsi,
      cast(floor(greatest(0, least(100, composite + gd*0.35::DOUBLE + td*0.3::DOUBLE - greatest(0, dd)*0.12::DOUBLE)) + 0.5) AS BIGINT) AS score
      FROM m CROSS JOIN (VALUES {", ".join(map(str, SCENARIOS))}) v(id, dd, gd, td, fad)""")
def ag15(spark, sf_dir):
    s = spark.createDataFrame(list(SCENARIOS), "scenario string, dd int, gd int, td int, fad int")
    m = urban_model(spark, sf_dir).crossJoin(F.broadcast(s))
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    score = held(F.col("composite") + F.col("gd") * 0.35 + F.col("td") * 0.3 - F.greatest(F.lit(0), F.col("dd")) * 0.12)
    return m.select("scenario", F.round(F.col("far") * (1 + F.col("fad") / 100), 6).alias("far"), F.round(held(F.col("gsi") + F.col("dd") * 0.35), 6).alias("gsi"), F.floor(score + 0.5).alias("score"))


@query(
    "ag17_population_theme",
    fixtures.with_("buildings")
    + f""", p AS (SELECT CASE WHEN usage = 'residential' THEN {AREA_SQL}*coalesce(levels,1)*0.035::DOUBLE ELSE 0 END AS residents FROM buildings)
    SELECT CASE WHEN residents <= 0 THEN 'none' WHEN residents < 25 THEN 'low' WHEN residents < 100 THEN 'medium' ELSE 'high' END AS population_class, count(*) AS n, round(sum(residents), 2) AS residents FROM p GROUP BY 1""",
)
def population_theme(spark, sf_dir):
    b = with_area(fixtures.buildings(spark, sf_dir))
    r = F.when(F.col("usage") == "residential", F.col("area") * F.coalesce("levels", F.lit(1.0)) * 0.035).otherwise(0.0)
    kind = F.when(F.col("residents") <= 0, "none").when(F.col("residents") < 25, "low").when(F.col("residents") < 100, "medium").otherwise("high")
    return b.select(r.alias("residents")).withColumn("population_class", kind).groupBy("population_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("residents"), 2).alias("residents"))


@query(
    "ag16_legends",
    fixtures.with_("buildings")
    + f""", b AS (SELECT {HEIGHT_SQL} AS h, {AGE_SQL} AS a, usage FROM buildings)
    SELECT 'floors' AS theme, h AS key, count(*) AS n FROM b GROUP BY h UNION ALL SELECT 'age', a, count(*) FROM b GROUP BY a UNION ALL SELECT 'function', usage, count(*) FROM b GROUP BY usage""",
)
def legends(spark, sf_dir):
    """Three themes in one scan and one shuffle: each row is unpivoted to its themes before counting."""
    b = fixtures.buildings(spark, sf_dir).select(S.height_class(F.col("levels"), F.col("height")).alias("h"), S.age_class(F.col("year")).alias("a"), "usage")
    return b.select(F.expr("stack(3, 'floors', h, 'age', a, 'function', usage) AS (theme, key)")).groupBy("theme", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag23_bounds",
    fixtures.with_("roads") + "SELECT min(least(lon1, lon2)) AS west, min(least(lat1, lat2)) AS south, max(greatest(lon1, lon2)) AS east, max(greatest(lat1, lat2)) AS north FROM roads",
)
def bounds(spark, sf_dir):
    r = fixtures.roads(spark, sf_dir)
    return r.agg(F.min(F.least("lon1", "lon2")).alias("west"), F.min(F.least("lat1", "lat2")).alias("south"), F.max(F.greatest("lon1", "lon2")).alias("east"), F.max(F.greatest("lat1", "lat2")).alias("north"))


@query(
    "ag27_population_bins",
    fixtures.with_("buildings")
    + f"""SELECT cast(floor((west - 37.5::DOUBLE)*1000/24) AS BIGINT) AS bx, cast(floor((south - 55.6::DOUBLE)*1000/24) AS BIGINT) AS by_, round(sum(CASE WHEN usage = 'residential' THEN {AREA_SQL}*coalesce(levels,1)*0.035::DOUBLE ELSE 0 END), 2) AS population FROM buildings GROUP BY 1, 2""",
)
def population_bins(spark, sf_dir):
    b = with_area(fixtures.buildings(spark, sf_dir))
    p = F.when(F.col("usage") == "residential", F.col("area") * F.coalesce("levels", F.lit(1.0)) * 0.035).otherwise(0.0)
    return b.groupBy(F.floor((F.col("west") - 37.5) * 1000 / 24).alias("bx"), F.floor((F.col("south") - 55.6) * 1000 / 24).alias("by_")).agg(F.round(F.sum(p), 2).alias("population"))


@query(
    "ag26_field_inventory",
    """SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY k""",
)
def field_inventory(spark, sf_dir):
    from geoquarry.sources.tables import table

    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag33_error_counts",
    "SELECT user_id % 10 AS source, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1",
)
def error_counts(spark, sf_dir):
    from geoquarry.sources.tables import table

    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.col("user_id") % 10).alias("source")).agg(F.count(F.lit(1)).alias("errors"))


@query(
    "ag34_metric_scores",
    MODEL_SQL
    + """, v AS (SELECT unnest(['far','gsi','density','floors','noise','insolation','transport','kpi']) AS metric, unnest([far/3*100, gsi, density, lv/20*100, noise, insolation, transport, composite]) AS raw FROM m)
    SELECT metric, round(greatest(0, least(100, raw)), 4) AS score FROM v""",
)
def metric_scores(spark, sf_dir):
    m = urban_model(spark, sf_dir)
    long = m.select(F.expr("stack(8, 'far', far/3*100, 'gsi', gsi, 'density', density, 'floors', lv/20*100, 'noise', noise, 'insolation', insolation, 'transport', transport, 'kpi', composite) AS (metric, raw)"))
    return long.select("metric", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw"))), 4).alias("score"))


@query(
    "wn1_latest_snapshot",
    """SELECT o_custkey % 20 AS project, o_orderstatus AS territory, o_orderkey AS snapshot, o_orderdate AS saved_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 20, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_snapshot(spark, sf_dir):
    """Newest row a key as a partial maximum of (date, id): no window, so a hot key is reduced before the shuffle."""
    from geoquarry.sources.tables import table

    o = table(spark, sf_dir, "orders")
    top = o.groupBy((F.col("o_custkey") % 20).alias("project"), F.col("o_orderstatus").alias("territory")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return top.select("project", "territory", F.col("x.o_orderkey").alias("snapshot"), F.col("x.o_orderdate").alias("saved_at"))


@query(
    "wn5_vertex_offsets",
    fixtures.with_("buildings")
    + """, n AS (SELECT building_id, 4 + building_id % 3 AS vertices FROM buildings)
    SELECT building_id, cast(coalesce(sum(2*vertices) OVER (ORDER BY building_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_vertex FROM n""",
)
def vertex_offsets(spark, sf_dir):
    """Running offset over all buildings in id order: totals of ranges first, then a window within each range."""
    n = fixtures.buildings(spark, sf_dir).select("building_id", (2 * (4 + F.col("building_id") % 3)).alias("v"))
    return running_total(n, ("building_id",), F.col("v"), "first_vertex", Staging(spark, "offsets")).select("building_id", "first_vertex")
