"""Connected components of an edge table, and rows dealt by their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoquarry.plans.staging import Staging


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(a, b) edges of integer ids -> (id, component): the smallest id reachable.

    Min-label propagation with pointer jumping: each round takes the smallest
    label among neighbours, then follows labels of labels, so a path of n nodes
    ends in about log n rounds.  Every round is two shuffles of narrow rows and a
    written table; only a changed-row count reaches the driver.  Null ends and
    loops add nothing.  A hot node's incoming labels are pre-aggregated by the
    partial minimum, and its outgoing join is left to adaptive skew splitting.
    """
    ok = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = staging.cut(ok.union(ok.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staging.cut(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")),
        "labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        stepped = labels.join(near.hint("merge"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("up"))
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("top"))
        jumped = stepped.join(up.hint("merge"), "up", "left").select("id", "old", F.least("up", F.coalesce("top", "up")).alias("component"))
        new = staging.cut(jumped, "labels")
        changed = new.where("component <> old").limit(1).count()
        staging.drop(labels)
        labels = new.select("id", "component")
        labels._staged_at = new._staged_at
        if not changed:
            staging.drop(both)
            return labels


#: Rows up to which a component is replayed by one task.
BOUND = 100_000


def by_size(rows: DataFrame, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with ``component``) of the components of at most ``bound`` rows, and those of the larger ones."""
    large = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("component")
    return rows.join(large, "component", "left_anti"), rows.join(large, "component", "left_semi")
