"""Stores whose records are replaced by key: generations of Parquet, merged when read.

An upsert writes only its own rows, as the next generation of its project; what is
read of a key is its row of the newest generation.  Compaction writes the merged
rows of a project as a generation that stands for all before it and deletes those.
A generation counts once its write is complete (its ``_SUCCESS`` is there), so a job
that is lost halfway changes nothing, and a compaction that is lost before it has
deleted leaves old generations that are no longer read.

At scale: projects are partitions, so a scan of one reads its folders alone, and
conditions that don't concern the merge reach the files of a compacted project.
Newest rows are a partial maximum by key; no row is gathered.  The driver lists
generations, a few names for each project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from geoquarry.operators.snapshots import Store

#: Bytes of a raw payload from which it carries a warning (fixed value: 5 MiB).
LARGE_PAYLOAD = 5 * 1024 * 1024


class Upserts(Store):
    """Records of one kind by ``keys``, in partitions by project.

    Rows of one upsert that repeat a key: the one with the largest ``newest`` stays,
    then the largest of all its columns.  Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, root: str, kind: str, keys: tuple[str, ...], newest: str):
        super().__init__(spark, root, kind)
        self.keys, self.newest = keys, newest

    def projects(self) -> list[str]:
        store, p = self._hadoop(self.root)
        return sorted(s.getPath().getName().split("=", 1)[1] for s in store.listStatus(p) if s.isDirectory()) if store.exists(p) else []

    def _names(self, project: str) -> list[str]:
        store, p = self._hadoop(self._path(project=project))
        return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []

    def generations(self, project: str) -> list[str]:
        """Names of the complete generations that count: the last one that stands for all before it, and those behind."""
        whole = [n for n in self._names(project) if self.exists_in(project, n)]
        bases = [i for i, n in enumerate(whole) if n.endswith("-base")]
        return whole[bases[-1] if bases else 0 :]

    def exists_in(self, project: str, name: str) -> bool:
        store, p = self._hadoop(f"{self._path(project=project)}/{name}/_SUCCESS")
        return store.exists(p)

    def _next(self, project: str, base: bool = False) -> str:
        numbers = [int(n.split("=", 1)[1].split("-")[0]) for n in self._names(project)]
        return f"{self._path(project=project)}/generation={max(numbers, default=0) + 1:08d}" + ("-base" if base else "")

    def upsert(self, rows: DataFrame, project: str) -> None:
        """Add or replace the records of ``rows``, which all have the columns of those before."""
        rows.write.mode("errorifexists").parquet(self._next(project))

    def scan(self, *projects: str) -> DataFrame:
        """The records of these projects (all, if none is named), each as its last upsert left it, with ``project``."""
        found = [f"{self._path(project=p)}/{n}" for p in projects or self.projects() for n in self.generations(p)]
        if not found:
            raise ValueError("no complete generation of these projects")
        every = self.spark.read.option("basePath", self.root).parquet(*found)
        columns = [c for c in every.columns if c not in ("project", "generation")]
        last = F.struct(F.col("generation").cast("string").alias("g_"), F.col(self.newest).alias("n_"), F.struct(*columns).alias("row_"))
        by = [F.col(c).alias(f"k{i}_") for i, c in enumerate(self.keys)]
        return every.groupBy("project", *by).agg(F.max(last).alias("last")).select(F.col("project").cast("string").alias("project"), "last.row_.*")

    def compact(self, project: str) -> None:
        """Merge the generations of a project into one, and delete those that it stands for."""
        old = self._names(project)
        if self.generations(project)[1:]:
            self.scan(project).drop("project").write.mode("errorifexists").parquet(self._next(project, base=True))
            for n in old:
                store, p = self._hadoop(f"{self._path(project=project)}/{n}")
                store.delete(p, True)


def raw_records(records: DataFrame, payload: str = "payload", limit: int = LARGE_PAYLOAD) -> DataFrame:
    """``records`` with payload_bytes and storage_warning: both null below ``limit`` UTF-8 bytes, and without a payload."""
    n = F.octet_length(payload).cast("long")
    large = F.coalesce(n >= limit, F.lit(False))
    text = F.concat(F.lit("Raw payload is "), n.cast("string"), F.lit(" bytes; future ingestion should chunk this source response."))
    return records.select("*", F.when(large, n).alias("payload_bytes"), F.when(large, text).alias("storage_warning"))


def newest_first(records: DataFrame, by: tuple[str, ...], created: str, key: str, *where: Column) -> DataFrame:
    """``records`` that meet all conditions, with ``place``: from 1 within ``by``, newest first, ties by ``key``, the largest first.

    A group's order is a sort of its own; callers keep groups to a run or a territory's source.
    """
    for w in where:
        records = records.where(w)
    line = W.partitionBy(*by).orderBy(F.col(created).desc(), F.col(key).desc())
    return records.withColumn("place", F.row_number().over(line))
