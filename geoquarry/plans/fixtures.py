"""Spatial entities derived from the driver's tables.

Each entity is a projection (or one cross join with a handful of literal rows),
so column pruning and filters reach the parquet scan.  ``SQL`` holds the same
derivation as DuckDB common table expressions for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.sources.tables import table

D = "double"


def _grid(key, mod: int, base: float, step: float):
    return F.lit(base) + (key % mod).cast(D) * F.lit(step)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast(D)
    row = ((k % 8633 - k % 97) / F.lit(97)).cast(D)
    west, south = _grid(k, 97, 37.5, 0.002), F.lit(55.6) + row * F.lit(0.002)
    usage = F.coalesce(
        F.create_map(*[F.lit(x) for kv in {"STANDARD": "residential", "PROMO": "commercial", "ECONOMY": "industrial", "MEDIUM": "education", "SMALL": "public"}.items() for x in kv])[F.col("p_type")],
        F.lit("unknown"),
    )
    return p.select(
        k.alias("building_id"),
        west.alias("west"),
        south.alias("south"),
        (west + F.lit(0.0002) + size * F.lit(0.00001)).alias("east"),
        (south + F.lit(0.0002) + size * F.lit(0.00001)).alias("north"),
        F.when(k % 5 != 0, size * F.lit(1.5)).alias("height"),
        F.when(k % 3 != 0, (F.lit(1) + F.col("p_size") % 25).cast(D)).alias("levels"),
        F.when(k % 4 != 0, (F.lit(1880) + k % 145).cast("int")).alias("year"),
        usage.alias("usage"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buildings(spark, sf_dir)
    names = ["osm", "microsoft-buildings", "overture", "city-geojson", "local-buildings"]
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("source")) for i, n in enumerate(names)]))
    b = b.withColumn("s", k).where((F.col("building_id") + F.col("s.k")) % 3 != 0)
    shift = F.col("s.k") * F.lit(0.15) * (F.col("east") - F.col("west"))
    return b.select(
        "building_id",
        F.col("s.k").alias("source_rank"),
        F.col("s.source").alias("source"),
        (F.col("s.k") * 10000000 + F.col("building_id")).cast("bigint").alias("ordinal"),
        (F.col("west") + shift).alias("west"),
        "south",
        (F.col("east") + shift).alias("east"),
        "north",
        F.when((F.col("building_id") + F.col("s.k")) % 2 == 0, F.col("height")).alias("height"),
        "levels",
        "usage",
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lon, lat = _grid(c, 211, 37.5, 0.00095), _grid(c, 197, 55.6, 0.00101)
    kind = F.coalesce(
        F.create_map(*[F.lit(x) for kv in {"1-URGENT": "primary", "2-HIGH": "secondary", "3-MEDIUM": "residential", "4-NOT SPECIFIED": "service"}.items() for x in kv])[F.col("o_orderpriority")],
        F.lit("footway"),
    )
    return o.select(
        k.alias("road_id"),
        lon.alias("lon1"),
        lat.alias("lat1"),
        (lon + (F.lit(1) + k % 50).cast(D) * F.lit(0.0001)).alias("lon2"),
        (lat + (F.lit(1) + k % 37).cast(D) * F.lit(0.0001)).alias("lat2"),
        kind.alias("road_type"),
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind = F.coalesce(
        F.create_map(*[F.lit(x) for kv in {"HOUSEHOLD": "school", "MACHINERY": "clinic", "BUILDING": "station", "FURNITURE": "cafe"}.items() for x in kv])[F.col("c_mktsegment")],
        F.lit("public"),
    )
    return c.select(F.col("c_custkey").alias("poi_id"), _grid(F.col("c_custkey"), 211, 37.5, 0.00095).alias("lon"), _grid(F.col("c_custkey"), 197, 55.6, 0.00101).alias("lat"), kind.alias("category"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("stop_id"), _grid(F.col("s_suppkey"), 13, 37.5, 0.0151).alias("lon"), _grid(F.col("s_suppkey"), 11, 55.6, 0.0173).alias("lat"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(k.alias("terrain_id"), _grid(k, 101, 37.5, 0.00198).alias("lon"), _grid(k, 103, 55.6, 0.00194).alias("lat"), F.when(k % 11 != 0, F.col("value")).alias("elevation"))


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    west, south = _grid(k, 5, 37.5, 0.04), F.lit(55.6) + ((k - k % 5) / F.lit(5)).cast(D) * F.lit(0.04)
    return n.select(k.alias("territory_id"), west.alias("west"), south.alias("south"), (west + F.lit(0.04)).alias("east"), (south + F.lit(0.04)).alias("north"))


GREENS = ("park", "forest", "wood", "grass", "meadow", "garden", "recreation_ground", "orchard", None)
WATERS = ("lake", "river", "pond", "reservoir", None)


def _patches(rows, k, name: str, kinds) -> DataFrame:
    west, south = _grid(k, 211, 37.5, 0.00095), _grid(k, 197, 55.6, 0.00101)
    kind = F.get(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds)).cast("int"))
    return rows.select(k.alias(name), west.alias("west"), south.alias("south"), (west + (k % 7 + 1).cast(D) * F.lit(0.0003)).alias("east"), (south + (k % 5 + 1).cast(D) * F.lit(0.0002)).alias("north"), kind.alias("kind"))


def greens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(table(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), F.col("c_custkey"), "green_id", GREENS)


def waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(table(spark, sf_dir, "customer").where("c_custkey % 7 = 1"), F.col("c_custkey"), "water_id", WATERS)


def _patches_sql(name: str, kinds, where: str) -> str:
    values = ", ".join("NULL" if x is None else f"'{x}'" for x in kinds)
    west, south = "37.5::DOUBLE + cast(c_custkey % 211 as double)*0.00095::DOUBLE", "55.6::DOUBLE + cast(c_custkey % 197 as double)*0.00101::DOUBLE"
    return f"""{name}s AS (SELECT c_custkey AS {name}_id, {west} AS west, {south} AS south, {west} + cast(c_custkey % 7 + 1 as double)*0.0003::DOUBLE AS east,
      {south} + cast(c_custkey % 5 + 1 as double)*0.0002::DOUBLE AS north, [{values}][1 + cast(c_custkey % {len(kinds)} AS INT)] AS kind FROM customer WHERE {where})"""


SQL = {
    "greens": _patches_sql("green", GREENS, "c_custkey % 3 = 0"),
    "waters": _patches_sql("water", WATERS, "c_custkey % 7 = 1"),
    "buildings": """buildings AS (SELECT p_partkey AS building_id,
      37.5::DOUBLE + cast(p_partkey % 97 as double)*0.002::DOUBLE AS west,
      55.6::DOUBLE + cast((p_partkey % 8633 - p_partkey % 97)/97 as double)*0.002::DOUBLE AS south,
      37.5::DOUBLE + cast(p_partkey % 97 as double)*0.002::DOUBLE + 0.0002::DOUBLE + cast(p_size as double)*0.00001::DOUBLE AS east,
      55.6::DOUBLE + cast((p_partkey % 8633 - p_partkey % 97)/97 as double)*0.002::DOUBLE + 0.0002::DOUBLE + cast(p_size as double)*0.00001::DOUBLE AS north,
      CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(p_size as double)*1.5::DOUBLE END AS height,
      CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE cast(1 + p_size % 25 as double) END AS levels,
      CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE cast(1880 + p_partkey % 145 as int) END AS year,
      CASE p_type WHEN 'STANDARD' THEN 'residential' WHEN 'PROMO' THEN 'commercial' WHEN 'ECONOMY' THEN 'industrial'
                  WHEN 'MEDIUM' THEN 'education' WHEN 'SMALL' THEN 'public' ELSE 'unknown' END AS usage FROM part)""",
    "candidates": """candidates AS (SELECT b.building_id, k.k AS source_rank,
      CASE k.k WHEN 0 THEN 'osm' WHEN 1 THEN 'microsoft-buildings' WHEN 2 THEN 'overture' WHEN 3 THEN 'city-geojson' ELSE 'local-buildings' END AS source,
      cast(k.k*10000000 + b.building_id as bigint) AS ordinal,
      b.west + k.k*0.15::DOUBLE*(b.east-b.west) AS west, b.south AS south, b.east + k.k*0.15::DOUBLE*(b.east-b.west) AS east, b.north AS north,
      CASE WHEN (b.building_id + k.k) % 2 = 0 THEN b.height ELSE NULL END AS height, b.levels AS levels, b.usage AS usage
      FROM buildings b CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k
      WHERE (b.building_id + k.k) % 3 <> 0)""",
    "roads": """roads AS (SELECT o_orderkey AS road_id, 37.5::DOUBLE + cast(o_custkey % 211 as double)*0.00095::DOUBLE AS lon1,
      55.6::DOUBLE + cast(o_custkey % 197 as double)*0.00101::DOUBLE AS lat1,
      37.5::DOUBLE + cast(o_custkey % 211 as double)*0.00095::DOUBLE + cast(1 + o_orderkey % 50 as double)*0.0001::DOUBLE AS lon2,
      55.6::DOUBLE + cast(o_custkey % 197 as double)*0.00101::DOUBLE + cast(1 + o_orderkey % 37 as double)*0.0001::DOUBLE AS lat2,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'secondary' WHEN '3-MEDIUM' THEN 'residential'
        WHEN '4-NOT SPECIFIED' THEN 'service' ELSE 'footway' END AS road_type FROM orders)""",
    "poi": """poi AS (SELECT c_custkey AS poi_id, 37.5::DOUBLE + cast(c_custkey % 211 as double)*0.00095::DOUBLE AS lon,
      55.6::DOUBLE + cast(c_custkey % 197 as double)*0.00101::DOUBLE AS lat,
      CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'school' WHEN 'MACHINERY' THEN 'clinic' WHEN 'BUILDING' THEN 'station'
        WHEN 'FURNITURE' THEN 'cafe' ELSE 'public' END AS category FROM customer)""",
    "stops": """stops AS (SELECT s_suppkey AS stop_id, 37.5::DOUBLE + cast(s_suppkey % 13 as double)*0.0151::DOUBLE AS lon,
      55.6::DOUBLE + cast(s_suppkey % 11 as double)*0.0173::DOUBLE AS lat FROM supplier)""",
    "terrain": """terrain AS (SELECT event_id AS terrain_id, 37.5::DOUBLE + cast(event_id % 101 as double)*0.00198::DOUBLE AS lon,
      55.6::DOUBLE + cast(event_id % 103 as double)*0.00194::DOUBLE AS lat,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS elevation FROM events)""",
    "territories": """territories AS (SELECT n_nationkey AS territory_id, 37.5::DOUBLE + cast(n_nationkey % 5 as double)*0.04::DOUBLE AS west,
      55.6::DOUBLE + cast((n_nationkey - n_nationkey % 5)/5 as double)*0.04::DOUBLE AS south,
      37.5::DOUBLE + cast(n_nationkey % 5 as double)*0.04::DOUBLE + 0.04::DOUBLE AS east,
      55.6::DOUBLE + cast((n_nationkey - n_nationkey % 5)/5 as double)*0.04::DOUBLE + 0.04::DOUBLE AS north FROM nation)""",
}


def with_(*names: str) -> str:
    """``WITH`` clause of the named entities for the oracle side."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
