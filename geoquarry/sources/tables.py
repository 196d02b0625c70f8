"""The driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt to several tasks a core, by ``keys``: a table packed into one small file is one task otherwise, however much work its rows are."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
