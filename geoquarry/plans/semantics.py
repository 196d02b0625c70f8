"""Classifier queries (per-row projections: one scan, no shuffle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo, semantics as S
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query
from geoquarry.plans.territory import AREA_SQL
from geoquarry.sources.tables import table

BOX = ("west", "south", "east", "north")


def with_area(b):
    return b.withColumn("area", geo.box_area(*[F.col(c) for c in BOX]))


HEIGHT_SQL = """CASE WHEN coalesce(levels, height/3) IS NULL THEN 'unknown' WHEN coalesce(levels, height/3) <= 3 THEN 'low'
  WHEN coalesce(levels, height/3) <= 8 THEN 'mid' WHEN coalesce(levels, height/3) <= 20 THEN 'high' ELSE 'very-high' END"""
AGE_SQL = """CASE WHEN year IS NULL THEN 'unknown' WHEN year < 1917 THEN 'historic-pre-1917' WHEN year <= 1945 THEN 'soviet-early'
  WHEN year <= 1970 THEN 'soviet-mid' WHEN year <= 1990 THEN 'soviet-late' WHEN year <= 2010 THEN 'post-soviet' ELSE 'contemporary' END"""


@query(
    "sf1_sf4_building_semantics",
    fixtures.with_("buildings")
    + f""", b AS (SELECT *, {AREA_SQL} AS area, {HEIGHT_SQL} AS height_class, {AGE_SQL} AS age_class FROM buildings)
    SELECT building_id, height_class, age_class,
      CASE WHEN area <= 0 THEN 'unknown' WHEN area < 250 THEN 'small-footprint' WHEN area < 1500 THEN 'medium-footprint' ELSE 'large-footprint' END AS footprint_class,
      CASE WHEN usage IN ('education','healthcare','public') THEN 'high' WHEN usage IN ('religious','sports') THEN 'medium'
           WHEN area >= 5000 THEN 'medium' WHEN usage = 'unknown' THEN 'unknown' ELSE 'low' END AS importance,
      CASE height_class WHEN 'low' THEN 'building-low' WHEN 'mid' THEN 'building-mid' WHEN 'unknown' THEN 'unknown' ELSE 'building-high' END AS colour_group,
      usage IN ('public','education','healthcare','religious','sports') AS is_public, usage = 'residential' AS is_residential,
      age_class = 'historic-pre-1917' AS is_historic FROM b""",
)
def building_semantics(spark, sf_dir):
    b = with_area(fixtures.buildings(spark, sf_dir))
    b = b.withColumn("height_class", S.height_class(F.col("levels"), F.col("height"))).withColumn("age_class", S.age_class(F.col("year")))
    return b.select(
        "building_id",
        "height_class",
        "age_class",
        S.footprint_class(F.col("area")).alias("footprint_class"),
        S.building_importance(F.col("usage"), F.col("area")).alias("importance"),
        S.building_colour(F.col("height_class")).alias("colour_group"),
        S.is_public(F.col("usage")).alias("is_public"),
        (F.col("usage") == "residential").alias("is_residential"),
        (F.col("age_class") == S.AGES[0]).alias("is_historic"),
    )


@query(
    "sf5_road_semantics",
    """SELECT o_orderkey AS road_id, k AS road_type, c AS category,
      CASE c WHEN 'regional' THEN 'critical' WHEN 'city' THEN 'high' WHEN 'local' THEN 'medium' WHEN 'pedestrian' THEN 'medium' WHEN 'cycle' THEN 'medium' WHEN 'service' THEN 'low' ELSE 'unknown' END AS importance
    FROM (SELECT o_orderkey, k, CASE WHEN k IN ('motorway','trunk') THEN 'regional' WHEN k IN ('primary','secondary','tertiary') THEN 'city' WHEN k = 'residential' THEN 'local'
        WHEN k = 'service' THEN 'service' WHEN k IN ('pedestrian','footway') THEN 'pedestrian' WHEN k = 'cycleway' THEN 'cycle' ELSE 'unknown' END AS c
      FROM (SELECT o_orderkey, CASE WHEN raw IN ('motorway','trunk','primary','secondary','tertiary','residential','service','pedestrian','footway','cycleway','other') THEN raw ELSE 'other' END AS k
        FROM (SELECT o_orderkey, ['motorway','trunk','primary','track','tertiary','residential','service','pedestrian','footway','cycleway',NULL][1 + cast(o_orderkey % 11 AS INT)] AS raw FROM orders)))""",
)
def road_semantics(spark, sf_dir):
    """SF5 and SF10: raw type to a listed type, then category and importance."""
    raw = F.array(*[F.lit(x) for x in ("motorway", "trunk", "primary", "track", "tertiary", "residential", "service", "pedestrian", "footway", "cycleway", None)])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("road_id"), S.road_type(F.get(raw, (F.col("o_orderkey") % 11).cast("int"))).alias("road_type"))
    o = o.withColumn("category", S.transport_category(F.col("road_type")))
    return o.withColumn("importance", S.road_importance(F.col("category")))


GREEN = ("park", "forest", "wood", "grass", "meadow", "garden", "recreation_ground", "orchard", None)


@query(
    "sf6_sf7_green_and_water",
    """WITH g AS (SELECT c_custkey AS id, ['park','forest','wood','grass','meadow','garden','recreation_ground','orchard',NULL][1 + cast(c_custkey % 9 AS INT)] AS kind, abs(c_acctbal) * 3 AS area FROM customer),
    l AS (SELECT *, CASE WHEN kind IN ('park','recreation_ground') THEN 'park' WHEN kind IN ('forest','wood') THEN 'forest' WHEN kind IN ('grass','meadow') THEN 'grass' WHEN kind = 'garden' THEN 'garden' ELSE 'unknown' END AS landscape FROM g)
    SELECT id, landscape, CASE WHEN kind IN ('forest','wood') THEN 'dense' WHEN kind IN ('park','garden') THEN 'medium' WHEN kind IS NOT NULL THEN 'sparse' ELSE 'unknown' END AS tree_density,
      CASE WHEN landscape IN ('park','forest') OR area >= 10000 THEN 'high' WHEN landscape = 'unknown' THEN 'unknown' ELSE 'medium' END AS green_importance,
      CASE WHEN area >= 20000 THEN 'high' WHEN kind IS NOT NULL THEN 'medium' ELSE 'unknown' END AS water_importance FROM l""",
)
def green_and_water(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in GREEN])
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(kinds, (F.col("c_custkey") % 9).cast("int")).alias("kind"), (F.abs("c_acctbal") * 3).alias("area"))
    g = g.withColumn("landscape", S.landscape(F.col("kind")))
    return g.select("id", "landscape", S.tree_density(F.col("kind")).alias("tree_density"), S.green_importance(F.col("landscape"), F.col("area")).alias("green_importance"), S.water_importance(F.col("kind"), F.col("area")).alias("water_importance"))


USAGES = ("Apartment block", "Retail Market", "warehouse 7", "School No 3", "clinic", "Old mosque", "stadium", "civic hall", "mixed", "жилой дом", "магазин", "barn", None)


@query(
    "sf9_usage_of_text",
    """SELECT p_partkey AS id, CASE WHEN regexp_matches(t, 'apart|жил|resid|house|detached|dorm|hostel') THEN 'residential'
      WHEN regexp_matches(t, 'shop|retail|market|office|commercial|торг|магаз|бизнес') THEN 'commercial' WHEN regexp_matches(t, 'industrial|warehouse|factory|manufact|склад|промыш') THEN 'industrial'
      WHEN regexp_matches(t, 'school|university|college|kindergarten|education|школ|вуз|детск') THEN 'education' WHEN regexp_matches(t, 'hospital|clinic|doctor|health|больниц|поликлин') THEN 'healthcare'
      WHEN regexp_matches(t, 'church|chapel|cathedral|mosque|synagogue|temple|церк|храм|мечет') THEN 'religious' WHEN regexp_matches(t, 'sport|stadium|fitness|спорт|стадион') THEN 'sports'
      WHEN regexp_matches(t, 'public|civic|government|админ|муницип') THEN 'public' WHEN t = 'mixed' THEN 'mixed' ELSE 'unknown' END AS usage
    FROM (SELECT p_partkey, lower(coalesce(['Apartment block','Retail Market','warehouse 7','School No 3','clinic','Old mosque','stadium','civic hall','mixed','жилой дом','магазин','barn',NULL][1 + cast(p_partkey % 13 AS INT)], '')) AS t FROM part)""",
)
def usage_of_text(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in USAGES])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.usage_of_text(F.get(words, (F.col("p_partkey") % 13).cast("int"))).alias("usage"))


@query(
    "sf11_source_confidence",
    fixtures.with_("buildings", "candidates")
    + """SELECT ordinal, source, CASE WHEN source IN ('microsoft-buildings','wikidata','local-buildings') THEN 'high' ELSE 'medium' END AS confidence,
      CASE WHEN source IN ('microsoft-buildings','wikidata','local-buildings') THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END AS score FROM candidates""",
)
def source_confidence(spark, sf_dir):
    c = fixtures.candidates(spark, sf_dir).select("ordinal", "source", S.source_confidence(F.col("source")).alias("confidence"))
    return c.withColumn("score", S.confidence_score(F.col("confidence")))


NUMBERS = ("12.5 m", "-3.2abc", "about 7", "1985-12", "..", "", "12,5", "3.4.5", None)


@query(
    "sf15_parse_number",
    """SELECT p_partkey AS id, try_cast(nullif(regexp_extract(regexp_replace(t, '[^0-9.\\-]', '', 'g'), '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE) AS number,
      try_cast(nullif(regexp_extract(t, '([0-9]{4})', 1), '') AS INT) AS year
    FROM (SELECT p_partkey, ['12.5 m','-3.2abc','about 7','1985-12','..','','12,5','3.4.5',NULL][1 + cast(p_partkey % 9 AS INT)] AS t FROM part)""",
)
def parse_number(spark, sf_dir):
    t = F.get(F.array(*[F.lit(x) for x in NUMBERS]), (F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.leading_number(t).alias("number"), S.year_of(t).alias("year"))


@query(
    "sf21_fnv1a",
    """WITH RECURSIVE x AS (SELECT p_partkey AS id, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS h FROM part)
    SELECT id, h::BIGINT AS hash FROM x""",
)
def fnv(spark, sf_dir):
    """The hash as a number; ``semantics.fnv1a`` gives its base-36 form."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.conv(S.fnv1a(F.col("p_name")), 36, 10).cast("long").alias("hash"))


@query(
    "sf25_three_d_measures",
    fixtures.with_("buildings")
    + f""", b AS (SELECT *, {AREA_SQL} AS area, round(levels * 3.2::DOUBLE, 2) AS from_levels FROM buildings)
    SELECT building_id, from_levels AS height_from_levels, coalesce(height, from_levels) AS relative_height, round(area * coalesce(height, from_levels), 2) AS volume,
      CASE WHEN height IS NOT NULL THEN 'absolute-height' WHEN from_levels IS NOT NULL THEN 'levels-derived' ELSE 'unknown' END AS extrusion_mode FROM b""",
)
def three_d(spark, sf_dir):
    b = with_area(fixtures.buildings(spark, sf_dir)).withColumn("height_from_levels", F.round(F.col("levels") * 3.2, 2))
    tall = F.coalesce("height", "height_from_levels")
    mode = F.when(F.col("height").isNotNull(), "absolute-height").when(F.col("height_from_levels").isNotNull(), "levels-derived").otherwise("unknown")
    return b.select("building_id", "height_from_levels", tall.alias("relative_height"), F.round(F.col("area") * tall, 2).alias("volume"), mode.alias("extrusion_mode"))
