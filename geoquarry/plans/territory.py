"""Flagship: one row of planning metrics for the whole territory."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquarry.functions import geo
from geoquarry.plans import fixtures
from geoquarry.plans.catalog import query

AREA_SQL = "6371000.0::DOUBLE*6371000.0::DOUBLE*radians(east-west)*(ln(tan(pi()/4+radians(north)/2)) - ln(tan(pi()/4+radians(south)/2)))"


@query(
    "flagship_territory_metrics",
    fixtures.with_("buildings")
    + f"""
    , b AS (SELECT *, {AREA_SQL} AS area FROM buildings),
    t AS (SELECT 6371000.0::DOUBLE*6371000.0::DOUBLE*radians(max(east)-min(west))
        *(ln(tan(pi()/4+radians(max(north))/2)) - ln(tan(pi()/4+radians(min(south))/2))) AS territory FROM buildings)
    SELECT count(*) AS n_buildings, round(sum(area), 1) AS footprint_m2, round(sum(area*coalesce(levels,1)), 1) AS floor_area_m2,
      round(avg(levels), 6) AS avg_levels, max(levels) AS max_levels,
      round(sum(area*coalesce(levels,1))/max(territory), 6) AS far, round(100*sum(area)/max(territory), 6) AS gsi,
      round(sum(CASE WHEN usage='residential' THEN area*coalesce(levels,1) ELSE 0 END)*0.035, 2) AS population
    FROM b CROSS JOIN t""",
)
def flagship(spark, sf_dir):
    """Building count, footprint, floor area, levels, FAR, GSI and population (empty table: zero count, null measures)."""
    b = fixtures.buildings(spark, sf_dir)
    box = [F.col(c) for c in ("west", "south", "east", "north")]
    b = b.withColumn("area", geo.box_area(*box)).withColumn("floor", F.col("area") * F.coalesce("levels", F.lit(1.0)))
    one = b.agg(
        F.count(F.lit(1)).alias("n_buildings"),
        F.sum("area").alias("fp"),
        F.sum("floor").alias("fa"),
        F.avg("levels").alias("al"),
        F.max("levels").alias("max_levels"),
        F.sum(F.when(F.col("usage") == "residential", F.col("floor")).otherwise(0.0)).alias("res"),
        geo.box_area(F.min("west"), F.min("south"), F.max("east"), F.max("north")).alias("t"),
    )
    return one.select(
        "n_buildings",
        F.round("fp", 1).alias("footprint_m2"),
        F.round("fa", 1).alias("floor_area_m2"),
        F.round("al", 6).alias("avg_levels"),
        "max_levels",
        F.round(F.col("fa") / F.col("t"), 6).alias("far"),
        F.round(100 * F.col("fp") / F.col("t"), 6).alias("gsi"),
        F.round(F.col("res") * 0.035, 2).alias("population"),
    )
