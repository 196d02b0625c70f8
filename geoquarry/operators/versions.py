"""Versions of features against the snapshot before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PLACE = ("domain", "source", "geometry")


def against_previous(now: DataFrame, before: DataFrame) -> DataFrame:
    """id, version, is_new, moved_id: one row for each row of ``now``.

    Both have id, domain, source, geometry and state; ``before`` has version, and
    its ids are unique.  A feature continues the one of its id, else the only
    previous one of its domain, source and exact geometry, whose id it takes;
    several of these decide nothing.  The version rises when the state changes.
    """
    old = F.struct("id", "version", "state")
    by_id = before.select(F.col("id").alias("k"), old.alias("same"))
    alone = before.groupBy(*[F.coalesce(c, F.lit("")).alias(f"p_{c}") for c in PLACE]).agg(F.count(F.lit(1)).alias("n"), F.first(old).alias("placed")).where("n = 1").drop("n")
    on = [F.coalesce(F.col(c), F.lit("")) == F.col(f"p_{c}") for c in PLACE]
    met = now.join(by_id, now["id"] == F.col("k"), "left").join(alone, on, "left").withColumn("prior", F.coalesce("same", "placed"))
    known = F.col("prior").isNotNull()
    risen = (~F.col("prior.state").eqNullSafe(F.col("state"))).cast("int")
    return met.select(
        F.coalesce("prior.id", now["id"]).alias("id"),
        F.when(known, F.col("prior.version") + risen).otherwise(1).alias("version"),
        (~known).alias("is_new"),
        (known & F.col("same").isNull()).alias("moved_id"),
    )
