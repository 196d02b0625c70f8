"""Running totals over a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from geoquarry.plans.staging import Staging


def running_total(rows: DataFrame, order: tuple[str, ...], value: Column, name: str, staging: Staging, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in the order of the columns ``order`` (unique together).

    Rows are parted by ranges of the order and written; the totals of the ranges,
    one row each, are summed up before them, and within a range a window goes on.
    """
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn(name, value).repartitionByRange(count, *order).withColumn("range_no", F.spark_partition_id())
    ranged = staging.cut(ranged, "ranges")
    totals = ranged.groupBy("range_no").agg(F.sum(name).alias("total")).orderBy("range_no").collect()  # a row for each range
    before, bases = 0, []
    for r in totals:
        bases.append((r["range_no"], before))
        before += r["total"] or 0
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "range_no int, base long"))
    line = W.partitionBy("range_no").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(name).over(line), F.lit(0))
    return ranged.withColumn(name, within).join(base, "range_no").withColumn(name, F.col(name) + F.col("base")).drop("range_no", "base")
