"""Themes, metrics and audits of a territory: what maps, legends and reports are made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo, rings, semantics as S
from geoquarry.operators import nearest, spatial
from geoquarry.plans import fixtures
from geoquarry.plans.analysis import HAVERSINE_SQL, LENGTH_SQL, MODEL_SQL, _values, road_lengths, urban_model, zero_filled
from geoquarry.plans.catalog import query
from geoquarry.plans.figures import SHEET, SHEET_SQL, SHEET_X, SHEET_Y, _sheet, pixels, sheet_point
from geoquarry.plans.geometry import ring_of
from geoquarry.plans.semantics import AGE_SQL, HEIGHT_SQL, with_area
from geoquarry.plans.territory import AREA_SQL
from geoquarry.sources.tables import table

SIDE = "sin(radians({b}-{a})/2)*sin(radians({b}-{a})/2)"
#: Perimeter of a box: two sides along the meridian, one along each parallel.
PERIMETER_SQL = "2*" + HAVERSINE_SQL.format(h=SIDE.format(a="south", b="north")) + "".join(" + " + HAVERSINE_SQL.format(h=f"cos(radians({lat}))*cos(radians({lat}))*" + SIDE.format(a="west", b="east")) for lat in ("south", "north"))


@query(
    "ag1_territories",
    fixtures.with_("territories", "roads", "poi", "stops")
    + f""", c AS (SELECT (SELECT count(*) FROM territories) AS b, (SELECT count(*) FROM poi) AS p, (SELECT count(*) FROM stops) AS s),
    x AS (SELECT min(lon1) AS west, min(lat1) AS south, max(lon1) AS east, max(lat1) AS north FROM roads),
    t AS (SELECT cast(territory_id AS VARCHAR) AS territory, west, south, east, north FROM territories UNION ALL SELECT 'bounds', west, south, east, north FROM x UNION ALL SELECT 'none', NULL, NULL, NULL, NULL)
    SELECT territory, round(coalesce({AREA_SQL}, 0), 0) AS area_m2, round(coalesce({PERIMETER_SQL}, 0), 2) AS perimeter_m, b AS boundaries, p AS poi, s AS stops FROM t CROSS JOIN c""",
)
def territories(spark, sf_dir):
    """Area and perimeter of every territory, of the project's bounds where none is active, and of nothing; with the project's counts."""
    one = F.count(F.lit(1))
    counts = fixtures.territories(spark, sf_dir).agg(one.alias("boundaries")).crossJoin(fixtures.poi(spark, sf_dir).agg(one.alias("poi"))).crossJoin(fixtures.stops(spark, sf_dir).agg(one.alias("stops")))
    box = ["west", "south", "east", "north"]
    of = fixtures.territories(spark, sf_dir).select(F.col("territory_id").cast("string").alias("territory"), *box)
    bounds = fixtures.roads(spark, sf_dir).agg(F.min("lon1").alias("west"), F.min("lat1").alias("south"), F.max("lon1").alias("east"), F.max("lat1").alias("north")).select(F.lit("bounds").alias("territory"), *box)
    none = spark.range(1).select(F.lit("none").alias("territory"), *[F.lit(None).cast("double").alias(c) for c in box])
    every = of.unionByName(bounds).unionByName(none).withColumn("ring", F.when(F.col("west").isNotNull(), ring_of()))
    measured = every.select("territory", F.round(F.coalesce(rings.mercator_area(F.col("ring")), F.lit(0.0)), 0).alias("area_m2"), F.round(F.coalesce(rings.length(F.col("ring")), F.lit(0.0)), 2).alias("perimeter_m"))
    return measured.crossJoin(F.broadcast(counts))


LANDSCAPES = ("park", "forest", "grass", "garden", "recreation", "unknown")
LANDSCAPE_SQL = "CASE WHEN kind IN ('park','recreation_ground','village_green') THEN 'park' WHEN kind IN ('forest','wood') THEN 'forest' WHEN kind IN ('grass','meadow','grassland') THEN 'grass' WHEN kind = 'garden' THEN 'garden' ELSE 'unknown' END"


def territory_area(spark, sf_dir):
    return with_area(fixtures.territories(spark, sf_dir)).agg(F.sum("area").alias("territory"))


@query(
    "ag10_vegetation",
    fixtures.with_("greens", "territories")
    + f""", g AS (SELECT {LANDSCAPE_SQL} AS landscape, {AREA_SQL} AS area FROM greens), t AS (SELECT sum({AREA_SQL}) AS a FROM territories)
    SELECT v.c AS landscape, round(coalesce(sum(area), 0), 0) AS area_m2, round(coalesce(sum(area), 0)/max(a)*100, 6) AS percent FROM (VALUES {_values(LANDSCAPES)}) v(c) LEFT JOIN g ON g.landscape = v.c CROSS JOIN t GROUP BY v.c""",
)
def vegetation(spark, sf_dir):
    """Green area by landscape, all listed, and its share of the territory (0 without an area)."""
    g = with_area(fixtures.greens(spark, sf_dir)).groupBy(S.landscape(F.col("kind")).alias("landscape")).agg(F.sum("area").alias("area"))
    every = spark.createDataFrame([(c,) for c in LANDSCAPES], "landscape string")
    all_ = F.broadcast(every).join(g, "landscape", "left").crossJoin(F.broadcast(territory_area(spark, sf_dir)))
    area = F.coalesce("area", F.lit(0.0))
    return all_.select("landscape", F.round(area, 0).alias("area_m2"), F.round(F.when(F.col("territory") > 0, area / F.col("territory") * 100).otherwise(0.0), 6).alias("percent"))


@query(
    "ag11_water",
    fixtures.with_("waters", "territories") + f", w AS (SELECT sum({AREA_SQL}) AS area FROM waters), t AS (SELECT sum({AREA_SQL}) AS a FROM territories) SELECT round(coalesce(area, 0), 0) AS area_m2, round(coalesce(area, 0)/a*100, 6) AS percent FROM w, t",
)
def water(spark, sf_dir):
    w = with_area(fixtures.waters(spark, sf_dir)).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area")).crossJoin(F.broadcast(territory_area(spark, sf_dir)))
    return w.select(F.round("area", 0).alias("area_m2"), F.round(F.when(F.col("territory") > 0, F.col("area") / F.col("territory") * 100).otherwise(0.0), 6).alias("percent"))


def shares(spark, sf_dir):
    one = lambda df, name: with_area(df).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias(name))
    return one(fixtures.greens(spark, sf_dir), "green_m2").crossJoin(F.broadcast(one(fixtures.waters(spark, sf_dir), "water_m2")))


GREEN_SQL = (
    MODEL_SQL.replace("WITH ", f"WITH {fixtures.SQL['greens']},\n{fixtures.SQL['waters']},\n", 1)
    + f""", gw AS (SELECT greatest(0, least(100, (SELECT sum({AREA_SQL}) FROM greens)/(SELECT sum({AREA_SQL}) FROM territories)*100)) AS green, greatest(0, least(100, (SELECT sum({AREA_SQL}) FROM waters)/(SELECT sum({AREA_SQL}) FROM territories)*100)) AS water),
    g AS (SELECT m.* EXCLUDE (composite), green, water, floor(greatest(0, least(100, (insolation + green + transport + (100 - noise))/4)) + 0.5) AS composite FROM m, gw)"""
)


@query("ag14_model_with_green", GREEN_SQL + " SELECT round(far, 6) AS far, round(gsi, 6) AS gsi, round(green, 6) AS green, round(water, 6) AS water, round(insolation, 4) AS insolation, round(transport, 4) AS transport, composite FROM g")
def model_with_green(spark, sf_dir):
    r = lambda c, d: F.round(F.col(c), d).alias(c)
    return urban_model(spark, sf_dir, shares(spark, sf_dir)).select(r("far", 6), r("gsi", 6), r("green", 6), r("water", 6), r("insolation", 4), r("transport", 4), "composite")


# Ranges of metrics by which a value becomes a score; the others score 100 if they are above 0.
RANGES = {"analysis.max-floors": 50.0, "analysis.green-share": 100.0, "analysis.water-share": 100.0}
MODEL_VALUES = {
    "far": ("far", "far/3*100"), "gsi": ("gsi/100", "gsi"), "bcr": ("gsi/100", "gsi"), "density": ("density*220", "density"), "floors": ("lv", "lv/20*100"), "noise": ("45 + noise*0.33D", "noise"), "insolation": ("insolation/18", "insolation"),
    "green": ("green", "green"), "transport": ("floor(transport + 0.5D)", "transport"), "isochrones": ("floor(transport + 0.5D)", "transport"), "charts": ("green + water", "green + water"),
}


def _spark_or_duck(text, duck):
    return text.replace("0.33D", "0.33::DOUBLE" if duck else "0.33D").replace("0.5D", "0.5::DOUBLE" if duck else "0.5D")


@query(
    "ag34_all_metrics",
    GREEN_SQL
    + f""", a AS (SELECT (SELECT count(*) FROM buildings) AS n, (SELECT max(levels) FROM buildings) AS top, (SELECT sum({LENGTH_SQL}) FROM roads) AS len, (SELECT sum({AREA_SQL}) FROM territories) AS area,
      (SELECT sum({AREA_SQL}) FROM greens) AS ga, (SELECT sum({AREA_SQL}) FROM waters) AS wa, (SELECT count(*) FROM customer) AS poi, (SELECT count(*) FROM supplier) AS st, (SELECT count(*) FROM events) AS te),
    v AS ({" UNION ALL ".join(f"SELECT 'model.{k}' AS source, ({_spark_or_duck(v, True)})::DOUBLE AS value, ({s})::DOUBLE AS raw FROM g" for k, (v, s) in MODEL_VALUES.items())}),
    w AS (SELECT unnest(['building-count','max-floors','road-length','road-density','green-area','green-share','water-area','water-share','poi-count','transit-count','terrain-samples']) AS k,
      unnest([n::DOUBLE, coalesce(top, 0), len, len/(area/1000000), ga, ga/area*100, wa, wa/area*100, poi::DOUBLE, st::DOUBLE, te::DOUBLE]) AS value FROM a)
    SELECT source, round(value, 3) AS value, round(greatest(0, least(100, raw)), 4) AS score FROM v
    UNION ALL SELECT 'analysis.' || k, round(value, 3), round(CASE k WHEN 'max-floors' THEN greatest(0, least(100, value/50*100)) WHEN 'green-share' THEN greatest(0, least(100, value)) WHEN 'water-share' THEN greatest(0, least(100, value)) ELSE CASE WHEN value > 0 THEN 100 ELSE 0 END END, 4) FROM w""",
)
def all_metrics(spark, sf_dir):
    """Value and score of all 22 metrics: those of the model have scores of their own, the others by range."""
    m = urban_model(spark, sf_dir, shares(spark, sf_dir))
    stack = ", ".join(f"'model.{k}', cast({_spark_or_duck(v, False)} AS double), cast({s} AS double)" for k, (v, s) in MODEL_VALUES.items())
    model = m.select(F.expr(f"stack({len(MODEL_VALUES)}, {stack}) AS (source, value, score)"))
    one = F.count(F.lit(1)).cast("double")
    a = fixtures.buildings(spark, sf_dir).agg(one.alias("n"), F.coalesce(F.max("levels"), F.lit(0.0)).alias("top"))
    for part in (
        road_lengths(spark, sf_dir).agg(F.sum("length").alias("len")), territory_area(spark, sf_dir), shares(spark, sf_dir),
        fixtures.poi(spark, sf_dir).agg(one.alias("poi")), fixtures.stops(spark, sf_dir).agg(one.alias("stops")), fixtures.terrain(spark, sf_dir).agg(one.alias("samples")),
    ):
        a = a.crossJoin(F.broadcast(part))
    values = {"building-count": "n", "max-floors": "top", "road-length": "len", "road-density": "len/(territory/1000000)", "green-area": "green_m2", "green-share": "green_m2/territory*100", "water-area": "water_m2", "water-share": "water_m2/territory*100", "poi-count": "poi", "transit-count": "stops", "terrain-samples": "samples"}
    stack = ", ".join(f"'analysis.{k}', cast({v} AS double)" for k, v in values.items())
    a = a.select(F.expr(f"stack({len(values)}, {stack}) AS (source, value)"))
    most = F.create_map(*[F.lit(x) for kv in RANGES.items() for x in kv])[F.col("source")]
    a = a.withColumn("score", F.when(most.isNotNull(), F.col("value") / most * 100).when(F.col("value") > 0, 100.0).otherwise(0.0))
    held = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score")))
    return model.unionByName(a).select("source", F.round("value", 3).alias("value"), F.round(held, 4).alias("score"))


# Colours of each theme's categories; the last serves all others.
PALETTES = {
    "floors": {"low": "#93C5FD", "mid": "#3B82F6", "high": "#1D4ED8", "very-high": "#1E3A8A", "unknown": "#9CA3AF"},
    "age": {"historic-pre-1917": "#92400E", "soviet-early": "#B45309", "soviet-mid": "#D97706", "soviet-late": "#F59E0B", "post-soviet": "#FBBF24", "contemporary": "#FCD34D", "unknown": "#9CA3AF"},
    "function": {"residential": "#60A5FA", "commercial": "#F59E0B", "industrial": "#6B7280", "public": "#A855F7", "education": "#22C55E", "healthcare": "#EF4444", "religious": "#8B5CF6", "sports": "#14B8A6", "mixed": "#A855F7", "unknown": "#9CA3AF"},
    "density": {"small-footprint": "#BBF7D0", "medium-footprint": "#FDE68A", "large-footprint": "#EF4444", "unknown": "#9CA3AF"},
    "roads": {"motorway": "#DC2626", "trunk": "#EA580C", "primary": "#F59E0B", "secondary": "#84CC16", "tertiary": "#22C55E", "residential": "#38BDF8", "service": "#64748B", "pedestrian": "#A855F7", "footway": "#C084FC", "cycleway": "#14B8A6", "other": "#94A3B8"},
    "population": {"none": "#CBD5E1", "low": "#FEF3C7", "medium": "#FDBA74", "high": "#DC2626"},
    "terrain": {"low": "#86EFAC", "medium": "#FACC15", "high": "#F97316", "unknown": "#94A3B8"},
    "vegetation": {"park": "#16A34A", "forest": "#15803D", "grass": "#4ADE80", "garden": "#22C55E", "recreation": "#65A30D", "unknown": "#22C55E"},
    "water": {"lake": "#38BDF8", "pond": "#7DD3FC", "reservoir": "#0EA5E9", "river": "#0284C7", "canal": "#0369A1", "water": "#38BDF8", "unknown": "#38BDF8"},
    "accessibility": {"transit": "#2563EB", "education": "#7C3AED", "healthcare": "#DC2626", "services": "#EA580C", "public": "#0891B2", "unknown": "#64748B"},
}
FILLED = {"floors": S.HEIGHTS, "age": S.AGES, "function": S.FUNCTIONS, "density": ("small-footprint", "medium-footprint", "large-footprint", "unknown"), "roads": S.ROAD_TYPES, "population": ("none", "low", "medium", "high"), "vegetation": LANDSCAPES}
DENSITY_SQL = "CASE WHEN area <= 0 THEN 'unknown' WHEN area < 250 THEN 'small-footprint' WHEN area < 1500 THEN 'medium-footprint' ELSE 'large-footprint' END"
POI_SQL = "CASE WHEN coalesce(category, '') = '' THEN 'unknown' WHEN contains(category, 'school') OR contains(category, 'education') THEN 'education' WHEN contains(category, 'hospital') OR contains(category, 'clinic') OR contains(category, 'health') THEN 'healthcare' WHEN contains(category, 'public') OR contains(category, 'civic') THEN 'public' ELSE 'services' END"


def poi_theme(category):
    """Class of a place on the accessibility map; unknown without a category, services by default."""
    c = lambda *words: F.greatest(*[category.contains(w) for w in words])
    return F.when(F.coalesce(category, F.lit("")) == "", "unknown").when(c("school", "education"), "education").when(c("hospital", "clinic", "health"), "healthcare").when(c("public", "civic"), "public").otherwise("services")


def colour(theme, key):
    """Colour of a category in its theme's palette; the theme's last colour for all others."""
    of = F.create_map(*[F.lit(x) for t, p in PALETTES.items() for k, c in p.items() for x in (f"{t}:{k}", c)])
    last = F.create_map(*[F.lit(x) for t, p in PALETTES.items() for x in (t, list(p.values())[-1])])
    return F.coalesce(of[F.concat_ws(":", theme, key)], last[theme])


@query("sf32_poi_themes", fixtures.with_("poi") + f" SELECT poi_id, {POI_SQL} AS theme FROM (SELECT poi_id, CASE WHEN poi_id % 5 = 0 THEN NULL ELSE category END AS category FROM poi)")
def poi_themes(spark, sf_dir):
    p = fixtures.poi(spark, sf_dir).withColumn("category", F.when(F.col("poi_id") % 5 != 0, F.col("category")))
    return p.select("poi_id", poi_theme(F.col("category")).alias("theme"))


def _colours_sql(theme, key):
    return "CASE " + " ".join(f"WHEN {theme} = '{t}' THEN CASE {key} " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in p.items()) + f" ELSE '{list(p.values())[-1]}' END" for t, p in PALETTES.items()) + " END"


@query(
    "ag16_all_legends",
    fixtures.with_("buildings", "roads", "terrain", "greens", "waters", "poi", "stops")
    + f""", b AS (SELECT *, {AREA_SQL} AS area FROM buildings), r AS (SELECT road_type, {LENGTH_SQL} AS length FROM roads), x AS (SELECT min(elevation) AS lo, greatest(max(elevation)-min(elevation), 1) AS span FROM terrain),
    k AS (SELECT 'floors' AS theme, {HEIGHT_SQL} AS key, 1.0::DOUBLE AS n FROM b UNION ALL SELECT 'age', {AGE_SQL}, 1 FROM b UNION ALL SELECT 'function', usage, 1 FROM b UNION ALL SELECT 'density', {DENSITY_SQL}, 1 FROM b
      UNION ALL SELECT 'population', CASE WHEN rs <= 0 THEN 'none' WHEN rs < 25 THEN 'low' WHEN rs < 100 THEN 'medium' ELSE 'high' END, 1 FROM (SELECT CASE WHEN usage = 'residential' THEN area*coalesce(levels,1)*0.035::DOUBLE ELSE 0 END AS rs FROM b)
      UNION ALL SELECT 'roads', road_type, CASE WHEN sum(length) OVER (PARTITION BY road_type) > 0 THEN 1 ELSE 0 END FROM r
      UNION ALL SELECT 'terrain', CASE WHEN elevation IS NULL THEN 'unknown' WHEN elevation <= lo + span/3 THEN 'low' WHEN elevation <= lo + span*2/3 THEN 'medium' ELSE 'high' END, 2 FROM terrain CROSS JOIN x
      UNION ALL SELECT 'vegetation', {LANDSCAPE_SQL}, {AREA_SQL} FROM greens UNION ALL SELECT 'water', coalesce(kind, 'unknown'), 1 FROM waters UNION ALL SELECT 'accessibility', {POI_SQL}, 1 FROM poi UNION ALL SELECT 'accessibility', 'transit', 1 FROM stops
      UNION ALL SELECT * FROM (VALUES {", ".join(f"('{t}', '{k}', 0)" for t, ks in FILLED.items() for k in ks)}))
    SELECT theme, key, round(sum(n), 0) AS n, {_colours_sql("theme", "key")} AS colour FROM k GROUP BY theme, key""",
)
def all_legends(spark, sf_dir):
    """Legends of all ten themes: counts by category (areas for green, doubled for terrain, roads only with a length), categories without objects where the theme lists them."""
    b = with_area(fixtures.buildings(spark, sf_dir))
    residents = F.when(F.col("usage") == "residential", F.col("area") * F.coalesce("levels", F.lit(1.0)) * 0.035).otherwise(0.0)
    people = F.when(residents <= 0, "none").when(residents < 25, "low").when(residents < 100, "medium").otherwise("high")
    b = b.select(S.height_class(F.col("levels"), F.col("height")).alias("h"), S.age_class(F.col("year")).alias("a"), "usage", S.footprint_class(F.col("area")).alias("d"), people.alias("p"))
    built = b.select(F.expr("stack(5, 'floors', h, 'age', a, 'function', usage, 'density', d, 'population', p) AS (theme, key)"))
    one = F.lit(1.0).alias("n")
    kinds = lambda df, theme, key, n=one: df.select(F.lit(theme).alias("theme"), key.alias("key"), n)
    roads = road_lengths(spark, sf_dir).groupBy("road_type").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("length").alias("length"))
    t = fixtures.terrain(spark, sf_dir)
    span = t.agg(F.min("elevation").alias("lo"), F.greatest(F.max("elevation") - F.min("elevation"), F.lit(1.0)).alias("span"))
    e, lo, s = F.col("elevation"), F.col("lo"), F.col("span")
    height = F.when(e.isNull(), "unknown").when(e <= lo + s / 3, "low").when(e <= lo + s * 2 / 3, "medium").otherwise("high")
    parts = [
        kinds(roads, "roads", F.col("road_type"), F.when(F.col("length") > 0, F.col("c")).otherwise(0.0).alias("n")),
        kinds(t.crossJoin(F.broadcast(span)), "terrain", height, F.lit(2.0).alias("n")),
        kinds(with_area(fixtures.greens(spark, sf_dir)), "vegetation", S.landscape(F.col("kind")), F.col("area").alias("n")),
        kinds(fixtures.waters(spark, sf_dir), "water", F.coalesce("kind", F.lit("unknown"))),
        kinds(fixtures.poi(spark, sf_dir), "accessibility", poi_theme(F.col("category"))),
        kinds(fixtures.stops(spark, sf_dir), "accessibility", F.lit("transit")),
        spark.createDataFrame([(theme, k, 0.0) for theme, ks in FILLED.items() for k in ks], "theme string, key string, n double"),
    ]
    every = built.withColumn("n", F.lit(1.0))
    for part in parts:
        every = every.unionByName(part)
    return every.groupBy("theme", "key").agg(F.round(F.sum("n"), 0).alias("n")).withColumn("colour", colour(F.col("theme"), F.col("key")))


@query(
    "sf29_theme_features",
    fixtures.with_("buildings") + f""" SELECT building_id, 'floors:' || k AS legend_group, CASE k WHEN 'low' THEN '#93C5FD' WHEN 'mid' THEN '#3B82F6' WHEN 'high' THEN '#1D4ED8' WHEN 'very-high' THEN '#1E3A8A' ELSE '#9CA3AF' END AS colour FROM (SELECT building_id, {HEIGHT_SQL} AS k FROM buildings)""",
)
def theme_features(spark, sf_dir):
    """PL13: each object with its legend group and colour in a theme."""
    k = S.height_class(F.col("levels"), F.col("height"))
    return fixtures.buildings(spark, sf_dir).select("building_id", F.concat(F.lit("floors:"), k).alias("legend_group"), colour(F.lit("floors"), k).alias("colour"))


PRESETS = ("population-grid", "transit-access", "terrain-height", "building-floors", "building-age", "functional-zoning", "axonometric-zoning", "sun-shadows")
AUDIT_SQL = """CASE WHEN preset = 'sun-shadows' OR known = 0 THEN 'unavailable' WHEN preset = 'transit-access' THEN 'modelled' WHEN preset = 'terrain-height' THEN 'measured' WHEN known >= 0.9*total THEN 'measured' ELSE 'partial' END"""


@query(
    "ag25_presentation_audit",
    fixtures.with_("buildings", "stops", "terrain")
    + f""", b AS (SELECT count(*) AS n, count(CASE WHEN levels > 0 THEN 1 END) AS lv, count(CASE WHEN year >= 1000 AND year <= 2027 THEN 1 END) AS yr, count(CASE WHEN usage <> 'unknown' THEN 1 END) AS us, count(CASE WHEN height > 0 OR levels > 0 THEN 1 END) AS hi,
        count(CASE WHEN building_id % 6 = 0 THEN 1 END) AS po FROM buildings), s AS (SELECT count(*) AS n FROM stops), t AS (SELECT count(*) AS n, count(elevation) AS k FROM terrain),
    a AS (SELECT 'population-grid' AS preset, po AS known, n AS total FROM b UNION ALL SELECT 'transit-access', n, n FROM s UNION ALL SELECT 'terrain-height', k, n FROM t UNION ALL SELECT 'building-floors', lv, n FROM b UNION ALL SELECT 'building-age', yr, n FROM b
      UNION ALL SELECT 'functional-zoning', us, n FROM b UNION ALL SELECT 'axonometric-zoning', hi, n FROM b UNION ALL SELECT 'sun-shadows', 0, n FROM b)
    SELECT preset, known, total, {AUDIT_SQL} AS status, CASE WHEN total > 0 THEN cast(floor(100.0::DOUBLE*known/total + 0.5) AS BIGINT) ELSE 0 END AS coverage, CASE {AUDIT_SQL} WHEN 'unavailable' THEN 'no-data' WHEN 'partial' THEN 'partial' ELSE 'ready' END AS readiness FROM a""",
)
def presentation_audit(spark, sf_dir):
    """Known and total objects of each map, its status and readiness; population counts only where a tag says it."""
    b = fixtures.buildings(spark, sf_dir).withColumn("population", population_of(tags_of(F.col("building_id"))))
    n = F.count(F.lit(1))
    b = b.agg(n.alias("n"), F.count_if(F.col("levels") > 0).alias("lv"), F.count_if(F.col("year").between(1000, 2027)).alias("yr"), F.count_if(F.col("usage") != "unknown").alias("us"), F.count_if((F.coalesce("height", F.lit(0.0)) > 0) | (F.coalesce("levels", F.lit(0.0)) > 0)).alias("hi"), F.count("population").alias("po"))
    s = fixtures.stops(spark, sf_dir).agg(n.alias("sn"))
    t = fixtures.terrain(spark, sf_dir).agg(n.alias("tn"), F.count("elevation").alias("tk"))
    one = b.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(t))
    a = one.select(F.expr("stack(8, 'population-grid', po, n, 'transit-access', sn, sn, 'terrain-height', tk, tn, 'building-floors', lv, n, 'building-age', yr, n, 'functional-zoning', us, n, 'axonometric-zoning', hi, n, 'sun-shadows', 0L, n) AS (preset, known, total)"))
    p = F.col("preset")
    status = F.when((p == "sun-shadows") | (F.col("known") == 0), "unavailable").when(p == "transit-access", "modelled").when((p == "terrain-height") | (F.col("known") >= 0.9 * F.col("total")), "measured").otherwise("partial")
    cover = F.when(F.col("total") > 0, F.floor(100.0 * F.col("known") / F.col("total") + 0.5)).otherwise(0)
    return a.select("preset", "known", "total", status.alias("status"), cover.alias("coverage"), F.when(status == "unavailable", "no-data").when(status == "partial", "partial").otherwise("ready").alias("readiness"))


def tags_of(k):
    """Tags of a building: some say its population, in several spellings."""
    text = F.when(k % 6 == 0, F.when(k % 12 == 0, F.concat((k % 90).cast("string"), F.lit(",5"))).otherwise((k % 90).cast("string"))).when(k % 6 == 1, "many").when(k % 6 == 2, "-3").when(k % 6 == 3, " ")
    return F.create_map(F.lit("residents"), text)


def population_of(tags):
    """Population as a tag states it, never inferred: the first of ``population`` and ``residents`` that is a number from 0 up."""
    one = lambda k: F.regexp_replace(F.trim(tags[k]), "^([^,]*),", "$1.").try_cast("double")
    known = lambda v: F.when((v >= 0) & (v < float("inf")), v)
    return F.coalesce(known(one("population")), known(one("residents")))


@query("sf27_building_population", "SELECT p_partkey AS building_id, CASE WHEN p_partkey % 12 = 0 THEN p_partkey % 90 + 0.5 WHEN p_partkey % 6 = 0 THEN p_partkey % 90 END::DOUBLE AS population FROM part")
def building_population(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("building_id"), population_of(tags_of(F.col("p_partkey"))).alias("population"))


@query(
    "sf26_render_styles",
    fixtures.with_("buildings", "roads")
    + """SELECT 'b' || building_id AS id, greatest(2, coalesce(height, levels*3.2::DOUBLE, 8)*1.5) AS height, NULL AS route, NULL AS style FROM buildings
    UNION ALL SELECT 'r' || road_id, NULL, CASE WHEN road_type IN ('footway','pedestrian') THEN 'pedestrian' WHEN road_type IN ('motorway','trunk','primary','secondary','tertiary') THEN 'public_transport' WHEN road_type = 'service' THEN 'service' WHEN road_id % 10 = 3 THEN 'parking' ELSE 'car' END,
      CASE WHEN road_type IN ('primary','secondary','tertiary') THEN 'major-road' WHEN road_type IN ('footway','pedestrian','cycleway') THEN 'pedestrian-road' WHEN road_type = 'service' THEN 'service-road' ELSE 'local-road' END FROM roads""",
)
def render_styles(spark, sf_dir):
    """Heights that buildings are drawn with, and the route class and style of roads."""
    b = fixtures.buildings(spark, sf_dir).select(F.concat(F.lit("b"), F.col("building_id").cast("string")).alias("id"), render_height(F.col("height"), F.col("levels"), 1.5).alias("height"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("style"))
    r = fixtures.roads(spark, sf_dir)
    kind = F.col("road_type")
    return b.unionByName(r.select(F.concat(F.lit("r"), F.col("road_id").cast("string")).alias("id"), F.lit(None).cast("double").alias("height"), route_class(kind, S.transport_category(kind), F.col("road_id") % 10 == 3).alias("route"), road_style(kind).alias("style")))


def render_height(height, levels, multiplier, default=8.0):
    return F.greatest(F.lit(2.0), F.coalesce(height, levels * F.lit(3.2), F.lit(default)) * multiplier)


def route_class(kind, transport, parking):
    rules = [(kind.isin("footway", "pedestrian") | (transport == "pedestrian"), "pedestrian"), (transport.isin("city", "regional"), "public_transport"), ((kind == "service") | (transport == "service"), "service"), (parking, "parking")]
    return S._cases(rules, "car")


def road_style(kind):
    return S._cases([(kind.isin("primary", "secondary", "tertiary"), "major-road"), (kind.isin("footway", "pedestrian", "cycleway"), "pedestrian-road"), (kind == "service", "service-road")], "local-road")


def poi_icon(category, subtype):
    return S._cases([(category == "parking", "parking"), ((category == "education") | (subtype == "school"), "school"), ((category == "healthcare") | (subtype == "hospital"), "hospital"), ((category == "park") | (subtype == "park"), "park")], "poi")


# Categories and subtypes of points that a three-dimensional map shows.
SHOWN_POI = ("parking", "bus_stop", "tram_stop", "station", "subway", "school", "education", "hospital", "healthcare", "public", "park")
_SUBTYPES = (None, "school", "hospital", "park", "parking")


def poi_important(category, subtype):
    return category.isin(*SHOWN_POI) | F.coalesce(subtype.isin(*SHOWN_POI), F.lit(False))


@query(
    "sf26_poi_icons",
    fixtures.with_("poi")
    + f""", p AS (SELECT poi_id, category, [{", ".join("NULL" if x is None else f"'{x}'" for x in _SUBTYPES)}][1 + cast(poi_id % 5 AS INT)] AS subtype FROM poi)
    SELECT poi_id, CASE WHEN category = 'parking' THEN 'parking' WHEN category = 'education' OR subtype = 'school' THEN 'school' WHEN category = 'healthcare' OR subtype = 'hospital' THEN 'hospital' WHEN category = 'park' OR subtype = 'park' THEN 'park' ELSE 'poi' END AS icon,
      list_contains({list(SHOWN_POI)}, category) OR coalesce(list_contains({list(SHOWN_POI)}, subtype), false) AS important FROM p""",
)
def poi_icons(spark, sf_dir):
    """Each point's icon, and whether a three-dimensional map shows it."""
    subtype = F.get(F.array(*[F.lit(x) for x in _SUBTYPES]), (F.col("poi_id") % 5).cast("int"))
    p = fixtures.poi(spark, sf_dir).select("poi_id", "category", subtype.alias("subtype"))
    return p.select("poi_id", poi_icon(F.col("category"), F.col("subtype")).alias("icon"), poi_important(F.col("category"), F.col("subtype")).alias("important"))


def value_colour(levels, year, palette: int):
    """Index into a palette of ``palette`` colours by the value itself, where no class is known: floors one by one, years by breaks; -1 for the unknown."""
    floors = F.when(levels > 0, F.least(F.lit(palette - 1), F.floor(levels + 0.5) - 1)).otherwise(-1)
    breaks = S._cases([(year < y, F.lit(i)) for i, y in enumerate((1800, 1920, 1960, 1990, 2020))], F.lit(5))  # fixed values
    return floors.cast("int"), F.when(year >= 1000, breaks).otherwise(-1).cast("int")


@query(
    "sf28_value_breaks",
    fixtures.with_("buildings")
    + """SELECT building_id, CASE WHEN levels > 0 THEN least(3, floor(levels + 0.5) - 1) ELSE -1 END::INT AS floors,
      CASE WHEN year IS NULL OR year < 1000 THEN -1 WHEN year < 1800 THEN 0 WHEN year < 1920 THEN 1 WHEN year < 1960 THEN 2 WHEN year < 1990 THEN 3 WHEN year < 2020 THEN 4 ELSE 5 END AS age FROM buildings""",
)
def value_breaks(spark, sf_dir):
    """Colours of buildings by their floors and years themselves, as where they have no class."""
    floors, age = value_colour(F.col("levels"), F.col("year"), 4)
    return fixtures.buildings(spark, sf_dir).select("building_id", floors.alias("floors"), age.alias("age"))


@query(
    "sf28_preset_colours",
    fixtures.with_("buildings")
    + f""", b AS (SELECT building_id, {HEIGHT_SQL} AS h, {AGE_SQL} AS a, usage, levels, year FROM buildings)
    SELECT building_id, CASE h WHEN 'low' THEN 0 WHEN 'mid' THEN 1 WHEN 'high' THEN 2 WHEN 'very-high' THEN 3 ELSE -1 END AS floors, CASE a WHEN 'historic-pre-1917' THEN 0 WHEN 'soviet-early' THEN 1 WHEN 'soviet-mid' THEN 2 WHEN 'soviet-late' THEN 3 WHEN 'post-soviet' THEN 4 WHEN 'contemporary' THEN 5 ELSE -1 END AS age,
      coalesce((list_position(['public','commercial','religious','industrial','education','residential','mixed'], usage) - 1) % 5, -1) AS function FROM b""",
)
def preset_colours(spark, sf_dir):
    """Index into each preset's palette, -1 for the colour of the unknown."""
    at = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), c).cast("int") - 1
    b = fixtures.buildings(spark, sf_dir)
    function = at(("public", "commercial", "religious", "industrial", "education", "residential", "mixed"), F.col("usage"))
    return b.select("building_id", at(S.HEIGHTS[:4], S.height_class(F.col("levels"), F.col("height"))).alias("floors"), at(S.AGES[:6], S.age_class(F.col("year"))).alias("age"), F.when(function >= 0, function % 5).otherwise(-1).cast("int").alias("function"))


# Layers of the analysis, other names for them, and the default.
LAYERS = ("floor-count", "building-age", "building-function", "built-density", "population-density", "roads", "greenery", "water", "poi-transit", "terrain", "sun-shadows", "noise")
ALIASES = {"far": "built-density", "gsi": "built-density", "density": "built-density", "green": "greenery", "transport": "poi-transit", "insolation": "sun-shadows"}


@query(
    "sf30_layer_names",
    """SELECT c_custkey AS id, CASE WHEN n IN ('far','gsi','density') THEN 'built-density' WHEN n = 'green' THEN 'greenery' WHEN n = 'transport' THEN 'poi-transit' WHEN n = 'insolation' THEN 'sun-shadows' WHEN n IN ('roads','water','terrain') THEN n ELSE 'built-density' END AS layer
    FROM (SELECT c_custkey, ['far','gsi','green','transport','insolation','roads','water','terrain','else','',NULL][1 + cast(c_custkey % 11 AS INT)] AS n FROM customer)""",
)
def layer_names(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("far", "gsi", "green", "transport", "insolation", "roads", "water", "terrain", "else", "", None)])
    n = F.get(names, (F.col("c_custkey") % 11).cast("int"))
    found = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[n], n)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(found.isin(*LAYERS), found).otherwise("built-density").alias("layer"))


NICE = (10, 20, 50, 100, 200, 500, 1000, 2000, 5000)


@query("tk7_nice_scales", f"SELECT r.road_id, arg_min(v.d, abs(v.d - r.m)*100000 + v.d) AS scale_m FROM (SELECT o_orderkey AS road_id, 3.0::DOUBLE*(o_orderkey % 1999) AS m FROM orders) r CROSS JOIN (SELECT unnest({list(NICE)}) AS d) v GROUP BY r.road_id")
def nice_scales(spark, sf_dir):
    """The listed length nearest to a wanted one, the shorter of two as near."""
    m = F.lit(3.0) * (F.col("o_orderkey") % 1999)
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(float(d)) - m).alias("off"), F.lit(d).alias("d")) for d in NICE]))["d"]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("road_id"), best.alias("scale_m"))


@query(
    "jn11_theme_lookup",
    fixtures.with_("roads") + """, t AS (SELECT road_id, 'roads:' || road_type AS grp FROM roads WHERE road_id % 4 <> 0) SELECT r.road_id, coalesce(t.grp, 'roads:' || r.road_type || ' *') AS legend_group FROM roads r LEFT JOIN t USING (road_id)""",
)
def theme_lookup(spark, sf_dir):
    """Features with the row of their theme by id; those without get their own category."""
    r = fixtures.roads(spark, sf_dir).select("road_id", "road_type")
    t = r.where("road_id % 4 <> 0").select("road_id", F.concat(F.lit("roads:"), F.col("road_type")).alias("grp"))
    return r.join(t, "road_id", "left").select("road_id", F.coalesce("grp", F.concat(F.lit("roads:"), F.col("road_type"), F.lit(" *"))).alias("legend_group"))


HEX = pixels(500)


@query(
    "jn12_hex_population",
    fixtures.with_("buildings")
    + f""", {SHEET_SQL}, c AS (SELECT {SHEET_X.format(lon="(west + east)/2")} AS x, {SHEET_Y.format(lat="(south + north)/2")} AS y, CASE WHEN building_id % 12 = 0 THEN building_id % 90 + 0.5 WHEN building_id % 6 = 0 THEN building_id % 90 END::DOUBLE AS p FROM buildings CROSS JOIN z),
    l AS (SELECT c AS col, r AS row_, 40 + c*{HEX!r}::DOUBLE*1.5 AS hx, 60 + r*sqrt(3)*{HEX!r}::DOUBLE + CASE WHEN c % 2 = 0 THEN 0 ELSE sqrt(3)*{HEX!r}::DOUBLE/2 END AS hy FROM (SELECT unnest(generate_series(-1, cast(ceil(1200/({HEX!r}*1.5)) AS INT))) AS c), (SELECT unnest(generate_series(-1, cast(ceil(800/(sqrt(3)*{HEX!r})) AS INT))) AS r))
    SELECT cast(col AS INT) AS col, cast(row_ AS INT) AS row, round(sum(p), 3) AS population FROM l JOIN c ON p IS NOT NULL AND sqrt((x - hx)*(x - hx) + (y - hy)*(y - hy)) < {HEX!r}::DOUBLE GROUP BY 1, 2 HAVING sum(p) > 0""",
)
def hex_population(spark, sf_dir):
    """Population within each circle of a hexagonal lattice on the sheet.

    A building looks up the lattice points around its own pixel, at most nine, so nothing is compared with the whole lattice.
    """
    b = fixtures.buildings(spark, sf_dir)
    x, y = sheet_point((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2)
    c = b.select(x.alias("x"), y.alias("y"), population_of(tags_of(F.col("building_id"))).alias("p")).where("p IS NOT NULL")
    wide, high = 1.5 * HEX, 3**0.5 * HEX
    columns, rows = -(-SHEET["width"] // wide), -(-SHEET["height"] // high)
    near = F.floor((F.col("x") - SHEET["x"]) / wide + 0.5).cast("int")
    c = c.withColumn("col", F.explode(F.sequence(near - 1, near + 1)))
    shift = F.when(F.col("col") % 2 == 0, 0.0).otherwise(high / 2)
    at = F.floor((F.col("y") - SHEET["y"] - shift) / high + 0.5).cast("int")
    c = c.withColumn("row", F.explode(F.sequence(at - 1, at + 1)))
    off = F.sqrt(F.pow(F.col("x") - (SHEET["x"] + F.col("col") * wide), 2) + F.pow(F.col("y") - (SHEET["y"] + F.col("row") * high + shift), 2))
    inside = F.col("col").between(-1, int(columns)) & F.col("row").between(-1, int(rows))
    return c.where((off < HEX) & inside).groupBy("col", "row").agg(F.round(F.sum("p"), 3).alias("population")).where("population > 0")


@query(
    "jn9_base_elevation",
    fixtures.with_("buildings", "terrain")
    + """, b AS (SELECT building_id, (3*west + 2*east)/5 AS x, (3*south + 2*north)/5 AS y, CASE WHEN building_id % 9 = 0 THEN cast(building_id % 50 AS DOUBLE) END AS own FROM buildings),
    n AS (SELECT building_id, arg_min(coalesce(elevation, 0), {'d': (lon-x)*(lon-x) + (lat-y)*(lat-y), 'i': terrain_id}) AS e FROM b CROSS JOIN terrain WHERE own IS NULL GROUP BY 1)
    SELECT b.building_id, coalesce(own, e, 0) AS elevation FROM b LEFT JOIN n USING (building_id)""",
)
def base_elevation(spark, sf_dir):
    """A building's own base elevation, else that of the sample nearest to its vertex mean in squared degrees (0 if unknown there or without samples)."""
    from geoquarry.plans.staging import Staging

    b = fixtures.buildings(spark, sf_dir)
    mean = rings.vertex_mean(ring_of())
    own = F.when(F.col("building_id") % 9 == 0, (F.col("building_id") % 50).cast("double"))
    b = b.select("building_id", mean["lon"].alias("lon"), mean["lat"].alias("lat"), own.alias("own"))
    t = fixtures.terrain(spark, sf_dir).select("terrain_id", F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"), F.coalesce("elevation", F.lit(0.0)).alias("elevation"))
    near = nearest.nearest(b.where("own IS NULL"), t, "building_id", "terrain_id", nearest.PLANE, Staging(spark, "elevation"))
    of = near.join(t.select("terrain_id", "elevation"), "terrain_id").select("building_id", "elevation")
    return b.select("building_id", "own").join(of, "building_id", "left").select("building_id", F.coalesce("own", "elevation", F.lit(0.0)).alias("elevation"))


@query(
    "ag24_selection_measures",
    fixtures.with_("territories", "poi", "roads")
    + """, t AS (SELECT *, abs(radians(east-west)*(2+2*sin(radians(south))) - radians(east-west)*(2+2*sin(radians(north))))*6371008.8::DOUBLE*6371008.8::DOUBLE/2/1000000 AS km2,
      (2*6371008.8::DOUBLE*2*asin(sqrt(sin(radians(north-south)/2)*sin(radians(north-south)/2))) + 6371008.8::DOUBLE*2*asin(sqrt(cos(radians(south))*cos(radians(south))*sin(radians(east-west)/2)*sin(radians(east-west)/2))) + 6371008.8::DOUBLE*2*asin(sqrt(cos(radians(north))*cos(radians(north))*sin(radians(east-west)/2)*sin(radians(east-west)/2))))/1000 AS km FROM territories)
    SELECT territory_id, round(km2, 6) AS area_km2, round(km, 6) AS perimeter_km, round((2*west + 2*east + west)/4, 7) AS centre_lon, (SELECT count(*) FROM poi WHERE lon > west AND lon < east AND lat > south AND lat < north) AS poi, (SELECT count(*) FROM roads WHERE lon1 > west AND lon1 < east AND lat1 > south AND lat1 < north) AS roads FROM t""",
)
def selection_measures(spark, sf_dir):
    """Spherical area and perimeter of a drawn area (radius 6 371 008.8 m), its centre, and objects by layer whose first vertex is inside."""
    t = fixtures.territories(spark, sf_dir)
    ring = ring_of()
    r = 6371008.8
    excess = F.aggregate(rings.edges(ring), F.lit(0.0), lambda s, e: s + F.radians(e["x2"] - e["x1"]) * (2 + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))))
    metres = rings.length(ring) * (r / geo.EARTH_RADIUS)
    centre = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lon"]) / F.greatest(F.size(ring) - 1, F.lit(1))
    out = t.select("territory_id", F.round(F.abs(excess * r * r / 2) / 1e6, 6).alias("area_km2"), F.round(metres / 1000, 6).alias("perimeter_km"), F.round(centre, 7).alias("centre_lon"))
    inside = lambda df, name, x="lon", y="lat": spatial.points_in_boxes(df, t, x, y).where((F.col(x) > F.col("west")) & (F.col(y) > F.col("south"))).groupBy("territory_id").agg(F.count(F.lit(1)).alias(name))
    out = out.join(inside(fixtures.poi(spark, sf_dir), "poi"), "territory_id", "left").join(inside(fixtures.roads(spark, sf_dir), "roads", "lon1", "lat1"), "territory_id", "left")
    return out.fillna(0, ["poi", "roads"])
