"""Stored snapshots, runs and reports: insert-only tables by project and territory.

A store is a folder of Parquet partitions.  Inserting what is there already is
an error of the writer, a snapshot's version must be above the last, and deleting a
project removes its partitions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Store:
    """One kind of record under ``root``."""

    def __init__(self, spark: SparkSession, root: str, kind: str):
        self.spark, self.root = spark, f"{root}/{kind}"

    def _path(self, **keys) -> str:
        return "/".join([self.root, *[f"{k}={v}" for k, v in keys.items()]])

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, **keys) -> bool:
        store, p = self._hadoop(self._path(**keys))
        return store.exists(p)

    def insert(self, rows: DataFrame, **keys) -> None:
        rows.write.mode("errorifexists").parquet(self._path(**keys))

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.root).parquet(self.root)

    def delete(self, **keys) -> bool:
        store, p = self._hadoop(self._path(**keys))
        return store.exists(p) and store.delete(p, True)

    def versions(self, **keys) -> list[int]:
        """Versions of one key, from folder names."""
        store, p = self._hadoop(self._path(**keys))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in store.listStatus(p)) if store.exists(p) else []


def build_snapshot(store: Store, features: DataFrame, run: dict, project: str, territory: str) -> int:
    """Store ``features`` as the next version of (project, territory) and return it; the run must belong to both."""
    if (run["project"], run["territory"]) != (project, territory):
        raise ValueError("the run does not belong to this project and territory")
    version = max(store.versions(project=project, territory=territory), default=0) + 1
    store.insert(features, project=project, territory=territory, version=version)
    return version


def latest(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest version of each (project, territory); the newest are a partial maximum, joined back."""
    top = snapshots.groupBy("project", "territory").agg(F.max("version").alias("version"))
    return snapshots.join(top, ["project", "territory", "version"])


def query_latest(snapshots: DataFrame, features: DataFrame, order: tuple[str, ...], box: tuple[float, float, float, float] | None = None, domains: tuple | None = None, min_confidence: float | None = None, preferred_only: bool = False) -> DataFrame:
    """project, territory and ``features`` of the latest snapshot of each, filtered before they meet.

    ``snapshots`` has project, territory, snapshot and what orders them; ``features``
    has snapshot, domain, confidence (unknown counts as 0), preferred and bounds
    (west, south, east, north; unknown bounds are in no box), which must meet the
    box, edges included.  A condition that is None or False doesn't filter.
    """
    last = snapshots.groupBy("project", "territory").agg(F.max(F.struct(*order, "snapshot")).alias("last")).select("project", "territory", F.col("last.snapshot").alias("snapshot"))
    if domains is not None:
        features = features.where(F.col("domain").isin(*domains))
    if min_confidence is not None:
        features = features.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    if preferred_only:
        features = features.where("preferred")
    if box is not None:
        west, south, east, north = box
        features = features.where((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north))
    return last.join(features, "snapshot")


def run_status(runs: DataFrame) -> DataFrame:
    """``runs`` (run, requested, completed, errors, warnings: arrays) with missing domains and a status.

    Failed if no domain is complete, partial with missing domains, errors or warnings, else completed.
    """
    missing = F.array_except("requested", "completed")
    status = F.when(F.size("completed") == 0, "failed").when((F.size(missing) > 0) | (F.size("errors") > 0) | (F.size("warnings") > 0), "partial").otherwise("completed")
    return runs.select("*", missing.alias("missing"), status.alias("status"))
