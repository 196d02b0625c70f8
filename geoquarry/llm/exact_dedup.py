"""Exact duplicates by distributed MSD radix partitioning.

Every document starts in one group.  A round splits each group by the next
bytes of the text (white space deleted): documents that share group and bytes
share the next group.  A group of one document, or one whose texts have ended,
is finished and leaves; the others go on with the bytes behind.  Two texts end
in the same group exactly when all their bytes are equal, so no digest decides.

At scale: a round moves only what is still undecided, and the digit widths grow
(128, 1024, ... bytes, eightfold without end), so most documents leave in the first
round and copies of a text of n bytes need about log8(n / 128) rounds.  Group sizes are partial counts of narrow
rows; only groups of two or more are written and joined back, by a merge join
(their number has no bound to broadcast under) whose hot keys adaptive execution
splits over tasks, so a group is never gathered.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.llm.words import WHITE, whole
from geoquarry.plans.staging import Staging

#: Bytes of the first rounds' digits; later rounds go on growing by ``GROWTH``.
WIDTHS, GROWTH = (128, 1024, 8192, 65536), 8


def _bare(text: Column) -> Column:
    return F.translate(text, WHITE, "").cast("binary")


def exact_classes(docs: DataFrame, widths: tuple[int, ...] = WIDTHS, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; the row
    with most code points in the original text stays, then the smallest doc_id.
    Null texts count as empty and are equal to empty and all-white ones.  Rows
    that repeat a doc_id each count; a null doc_id stays only where no other
    does.  An empty table gives no rows; columns beyond doc_id and text are
    ignored, whatever their names.
    """
    out = _classes(docs, widths, growth)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _classes(docs: DataFrame, widths: tuple[int, ...] = WIDTHS, growth: int = GROWTH) -> DataFrame:
    """doc_id, sha, keep_id, keep_points, group_size of each row."""
    staging = Staging(docs.sparkSession, "exact")
    bare = _bare(whole())
    active = docs.select(
        "doc_id",
        F.length(whole()).alias("points"),
        F.unhex(F.sha2(bare, 256)).alias("sha"),
        F.lit(0).cast("long").alias("gid"),
        bare.alias("rest"),
    )
    done, before = [], None
    for depth in count():
        w = widths[depth] if depth < len(widths) else widths[-1] * growth ** (depth - len(widths) + 1)
        step = active.withColumn("digit", F.substring("rest", 1, w)).withColumn("ended", F.length("rest") <= w)
        best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))
        groups = step.groupBy("gid", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        shared = staging.cut(
            groups.where("n > 1").select("gid", "digit", "ended", "n", F.col("best.id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), F.monotonically_increasing_id().alias("next")),
            "shared",
        )
        on = F.col("next").isNotNull() & ~F.col("ended")
        split = step.join(shared.hint("merge"), ["gid", "digit", "ended"], "left").select(
            "doc_id",
            "points",
            "sha",
            F.when(on, F.col("next")).alias("gid"),
            F.when(on, F.expr(f"substring(rest, {w + 1})")).alias("rest"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("next").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("keep_points", "points").alias("keep_points"),
        )
        split = staging.cut(split, "split")
        done.append(split.where("gid IS NULL"))
        staging.drop(shared)
        active = split.where("gid IS NOT NULL").select("doc_id", "points", "sha", "gid", "rest")
        if active.limit(1).count() == 0:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "sha", "keep_id", "keep_points", "group_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies: of each class of equal texts the row that ``exact_classes`` keeps, once.

    A row is known by its id, its text and its length, so rows that repeat an id
    with other texts are judged by their own texts; of rows of one id that differ
    in the kind of white space only, one stays.  Null texts are empty, null ids
    are ids like others (last in order).  All columns stay, whatever their names;
    an empty table stays empty.
    """
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = _classes(docs).where(mine).select(F.struct("doc_id", "sha", "keep_points").alias("row")).distinct()
    name = "row"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.struct("doc_id", F.unhex(F.sha2(_bare(whole()), 256)).alias("sha"), F.length(whole()).alias("keep_points")))
    kept = kept.withColumnRenamed("row", name)
    return rows.join(kept.hint("merge"), name, "left_semi").dropDuplicates([name]).select(*docs.columns)
