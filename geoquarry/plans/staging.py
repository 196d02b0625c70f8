"""Written intermediate tables that survive lost executors.

Iterative plans cut their lineage by writing a table into the folder that the
cluster names in ``spark.checkpoint.dir`` and reading it again.  Parquet keeps
the copy small and lets later steps read single columns of it.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Where ``spark.checkpoint.dir`` is unset, a local master gets a temporary
    folder for the life of this process; a cluster gets an error, because its
    executors and driver share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="geoquarry-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Staging:
    """Intermediate tables of one run, in a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "part") -> DataFrame:
        """Write ``df`` and return it as read again, without its lineage."""
        to = self.path(name)
        df.write.parquet(to)
        back = self.spark.read.schema(df.schema).parquet(to)
        back._staged_at = to
        return back

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does when garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that ``cut`` returned and nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            at = getattr(df, "_staged_at", None)
            if at:
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(conf).delete(p, True)
