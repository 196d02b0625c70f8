"""Sharding by a K-d tree over document metadata, in built-in functions only.

Equal texts form one unit, which never splits.  A unit is a point of four
dimensions (bytes, language, source, first id) with the bytes of all its rows as
weight.  A node that is to hold k shards is cut in two along its widest
dimension, at the weighted quantile that gives each side its share; ties on
that dimension are cut by the text's crc32, so that four languages or a source
with a third of all rows still split where the bytes say.

The quantile is found by bounded histograms: each round bins every open node's
rows into ``BINS`` cells around the cut and descends into the cell that holds
it.  What reaches the driver is a few rows a node: shards and bins are
parameters, so their number doesn't follow the input.  Rows move only in the
partial sums, and once to number slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from geoquarry.llm.words import whole
from geoquarry.plans.staging import Staging

OVERHEAD = 16
BINS = 4096
#: Rows of a shard that are numbered in one task, about.
SLOT_ROWS = 100_000
DIMS = ("size", "lang", "source", "first_id")


@dataclass
class Node:
    """A box of the tree that is to hold shards first .. first + k - 1; once cut, ``low`` holds what is at most ``cut``."""

    first: int
    k: int
    dim: str = ""
    lo: int = 0
    hi: int = 0
    want: float = 0.0
    below: float = 0.0
    unit: float = 0.0
    weight: float = 0.0
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


def units(docs: DataFrame) -> DataFrame:
    """One row a text (told apart by crc32 and bytes): its dimensions and rows."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in docs.columns else F.lit(0)
    each = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("first_id"),
        size.alias("size"),
        F.crc32(whole().cast("binary")).alias("crc"),
        code("lang").cast("long").alias("lang"),
        code("source").cast("long").alias("source"),
    )
    return each.groupBy("crc", "size").agg(F.min("first_id").alias("first_id"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.count(F.lit(1)).alias("rows"))


def scaled(points: DataFrame) -> DataFrame:
    """crc, size, rows, weight and each dimension as x_<dim> from 0 to 65535, by its smallest and largest value."""
    ends = points.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    axes = [F.floor((F.col(d) - (ends[f"lo_{d}"] or 0)) * 65535.0 / max((ends[f"hi_{d}"] or 0) - (ends[f"lo_{d}"] or 0), 1)).cast("long").alias(f"x_{d}") for d in DIMS]
    return points.select("crc", "size", "rows", (F.col("size") * F.col("rows")).cast("double").alias("weight"), *axes)


def _along(dim: str) -> Column:
    """A total order along one dimension: its value above the text's crc32 (below 2**48, so doubles divide it exactly)."""
    return F.col(f"x_{dim}") * F.lit(1 << 32) + F.col("crc")


def _route(node: Node, label: dict[int, int]) -> Column:
    """The label of the box that holds a row (by its first shard; null where it has none): the tree as nested conditions."""
    if node.low is None:
        return F.lit(label.get(node.first)).cast("int")
    return F.when(_along(node.dim) <= node.cut, _route(node.low, label)).otherwise(_route(node.high, label))


def _of_node(values: list, kind: str = "long") -> Column:
    """A literal chosen by the row's node."""
    return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("node")]


def grow(points: DataFrame, shards: int, bins: int = BINS) -> Node:
    """The tree over ``scaled`` units; its leaves are the shards."""
    root = Node(0, shards)
    open_ = [root] if shards > 1 else []
    while open_:
        placed = points.withColumn("node", _route(root, {n.first: i for i, n in enumerate(open_)})).where("node IS NOT NULL")
        ends = [f(f"x_{d}").alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
        for i, n in enumerate(open_):
            if s := stats.get(i):
                n.dim = max(DIMS, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"], -DIMS.index(d)))
                n.lo, n.hi, n.weight = s[f"lo_{n.dim}"] << 32, ((s[f"hi_{n.dim}"] + 1) << 32) - 1, s["w"]
            else:
                n.dim = DIMS[0]
            n.want = n.weight * (n.k // 2) / n.k
        along = F.lit(None).cast("long")
        for d in DIMS:
            if mine := [i for i, n in enumerate(open_) if n.dim == d]:
                along = F.when(F.col("node").isin(mine), _along(d)).otherwise(along)
        placed = placed.select("node", "weight", along.alias("at"))
        while any(n.hi > n.lo for n in open_):
            step = [max(-(-(n.hi - n.lo + 1) // bins), 1) for n in open_]
            lo, hi = _of_node([n.lo for n in open_]), _of_node([n.hi for n in open_])
            sums = placed.where((F.col("at") >= lo) & (F.col("at") <= hi)).groupBy("node", F.floor((F.col("at") - lo) / _of_node(step)).alias("cell")).agg(F.sum("weight").alias("w"))
            sums = sums.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("cell")))
            crossing = sums.where(F.col("upto") >= _of_node([n.want - n.below for n in open_], "double")).groupBy("node").agg(F.min(F.struct("cell", "w", "upto")).alias("x"))
            met = {r["node"]: r["x"] for r in crossing.collect()}
            for i, n in enumerate(open_):
                if n.hi > n.lo and i in met:
                    x = met[i]
                    n.below, n.unit = n.below + x["upto"] - x["w"], x["w"]
                    n.lo, n.hi = n.lo + x["cell"] * step[i], min(n.hi, n.lo + (x["cell"] + 1) * step[i] - 1)
                else:
                    n.lo = n.hi  # found, or no weight left to cross by rounding
        for n in open_:  # the unit at the cut goes to the side that is then nearer to its share
            takes = n.below == 0 or n.below + n.unit - n.want <= n.want - n.below
            held, n.cut = (n.below + n.unit, n.lo) if takes else (n.below, n.lo - 1)
            k = min(max(round(n.k * held / n.weight) if n.weight else n.k // 2, 1), n.k - 1)
            n.low, n.high = Node(n.first, k), Node(n.first + k, n.k - k)
        open_ = [m for n in open_ for m in (n.low, n.high) if m.k > 1]
    return root


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    The law is ``bytes``: shards' sizes are as near to equal as whole units allow
    (a text repeated beyond a shard's share fills one alone).  size is the text's
    UTF-8 bytes plus 16; null counts as empty.  Equal texts share a shard; slots
    run from 0 without gaps; grown_shard is null, as a tree with one more shard
    cuts elsewhere.  lang and source may be missing or null; other columns are
    not read.  Fewer units than shards leave shards empty; an empty table gives
    no rows.
    """
    staging = Staging(docs.sparkSession, "kd")
    points = staging.cut(units(docs), "units")
    points = staging.cut(scaled(points), "points")
    shard = _route(grow(points, shards), {i: i for i in range(shards)})
    placed = staging.cut(points.select("crc", "size", shard.alias("shard")), "placed")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(whole().cast("binary")).alias("crc"),
    )
    rows = rows.join(placed.hint("merge"), ["crc", "size"])
    total = points.agg(F.sum("rows")).first()[0] or 0
    parts = max(1, -(-total // (shards * SLOT_ROWS)))
    rows = staging.cut(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")), "rows")
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("shard", "part").orderBy("doc_id", "crc")
    numbered = rows.withColumn("n", F.row_number().over(order) - 1).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("n") + F.col("offset")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
