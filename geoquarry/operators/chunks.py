"""Splits of ordered features into chunks by a budget of features and bytes.

A chunk ends where the next feature would exceed the budget, so where a chunk
ends depends on where it began, and that on all chunks before.  But every feature
has one successor: the first of the next chunk if a chunk began at it, found by a
search in the running sums of sizes.  Chunks begin at those that the first feature
leads to.  Within a block of consecutive features successors of successors are
found by pointer doubling, which leaves for each feature the last chunk that would
begin in its block.  Chunks still open at a block's end began among the features
at its end, as a chunk holds no more than the budget: those few are mapped
to the chunk open at the next block's end.  Doubling these maps over the blocks
tells which chunk is open at each block's end, and then each block is cut alone.

At scale: blocks are of a fixed number of features, whatever the groups, so one
group over all rows is spread like any other.  The maps are ``max_features`` rows a
block at most; their rounds are as many as the binary logarithm of the blocks.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from geoquarry.operators.prefix import running_total
from geoquarry.plans.staging import Staging

#: Features of a block.
BLOCK = 1 << 20


def successors(first: np.ndarray, sizes: np.ndarray, max_features: int, max_bytes: int) -> np.ndarray:
    """For each of consecutive features the index of the first of the next chunk, if one begins at it; ``len`` if that lies behind.

    ``first`` tells groups apart (equal within a group); a feature larger than the budget is a chunk of its own.
    """
    n = len(sizes)
    at, sums = np.arange(n), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    by_bytes = np.searchsorted(sums, sums[:-1] + max_bytes, "right") - 1  # as many whole features as fit
    change = np.flatnonzero(np.concatenate([first[1:] != first[:-1], [True]])) + 1 if n else at
    group_end = change[np.searchsorted(change, at, "right")] if n else at
    return np.minimum(np.minimum(np.maximum(by_bytes, at + 1), at + max_features), group_end)


def last_starts(after: np.ndarray) -> np.ndarray:
    """For each feature the last chunk start that its successors lead to, by pointer doubling."""
    n = len(after)
    last = np.where(after < n, after, np.arange(n))
    while True:
        far = last[last]
        if (far == last).all():
            return last
        last = far


def starts_of(after: np.ndarray, entry: int) -> np.ndarray:
    """Indexes of all chunk starts from ``entry`` on."""
    out, at = [], entry
    while at < len(after):
        out.append(at)
        at = int(after[at])
    return np.array(out, np.int64)


def by_budget(rows: DataFrame, group: tuple[str, ...], order: str, size: str, max_features: int, max_bytes: int, staging: Staging, block: int = BLOCK) -> DataFrame:
    """``group``, ``order``, chunk: features of each group in order, a new chunk (from 0) before the feature that would exceed either budget.

    A feature larger than the budget is a chunk of its own; a null size is 0.
    ``order`` is unique within a group; nulls in group or order are values like
    others, and come first.  An empty table has no chunks.
    """
    if max_features < 1:
        raise ValueError("a chunk holds at least one feature")
    block = max(block, max_features)
    names = [*group, order]
    sized = rows.select(*names, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("bytes_"))
    placed = staging.cut(running_total(sized, tuple(names), F.lit(1).cast("long"), "pos_", staging), "placed")
    total = placed.count()
    firsts = placed.groupBy(*[F.col(c).alias(f"g{i}_") for i, c in enumerate(group)]).agg(F.min("pos_").alias("first_"))
    same = F.lit(True)
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"g{i}_"))
    spot = F.floor(F.col("pos_") / block).cast("long")
    numbered = placed.join(firsts, same).select(*names, "bytes_", "pos_", "first_", spot.alias("block_"))
    blocks = -(-total // block)
    if blocks > 1:
        numbered = staging.cut(numbered, "numbered")
    opened = _open_chunks(numbered, blocks, block, max_features, max_bytes, staging) if blocks > 1 else None
    begun = numbered.join(opened, "block_", "left") if opened is not None else numbered.withColumns({c: F.lit(None).cast("long") for c in ("open_", "held_")})

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos_")
        pos, first, sizes = (table[c].to_numpy() for c in ("pos_", "first_", "bytes_"))
        after = successors(first, sizes, max_features, max_bytes)
        open_, held = table["open_"][0].as_py(), table["held_"][0].as_py()
        entry = 0 if open_ is None else _entry(open_, held, pos[0], first, sizes, max_features, max_bytes)
        starts = starts_of(after, entry)
        at = np.searchsorted(starts, np.arange(len(pos)), "right") - 1
        begins = np.where(at >= 0, pos[starts[np.maximum(at, 0)]] if len(starts) else 0, -1 if open_ is None else open_)
        return table.select([*names, "first_"]).append_column("start_", pa.array(begins, pa.int64()))

    kinds = {f.name: f for f in numbered.schema.fields}
    schema = T.StructType([*(kinds[c] for c in names), T.StructField("first_", T.LongType()), T.StructField("start_", T.LongType())])
    marked = staging.cut(begun.groupBy("block_").applyInArrow(cut, schema), "marked")
    starts = marked.select("first_", "start_").distinct()
    chunk = (F.row_number().over(W.partitionBy("first_").orderBy("start_")) - 1).cast("long")  # a row for each chunk
    ranks = starts.select(F.col("start_").alias("s_"), chunk.alias("chunk"))
    return marked.join(ranks, F.col("start_") == F.col("s_")).select(*names, "chunk")


def _entry(open_: int, held: int, pos: int, first: np.ndarray, sizes: np.ndarray, max_features: int, max_bytes: int) -> int:
    """Index in a block of the first feature that a chunk open since ``open_``, with ``held`` bytes, doesn't take; ``len`` if it takes all."""
    if first[0] > open_:
        return 0  # another group
    room = np.searchsorted(np.cumsum(sizes, dtype=np.int64), max_bytes - held, "right")
    change = np.flatnonzero(first != first[0])
    return int(min(room, open_ + max_features - pos, change[0] if len(change) else len(sizes), len(sizes)))


def _open_chunks(numbered: DataFrame, blocks: int, block: int, max_features: int, max_bytes: int, staging: Staging) -> DataFrame:
    """block_, open_, held_: the start and bytes of the chunk that is open where each block but the first begins."""
    tail = numbered.where((F.col("pos_") % block >= block - max_features) & (F.col("block_") < blocks - 1))
    halo = numbered.unionByName(tail.withColumn("block_", F.col("block_") + 1)).select("block_", "pos_", "first_", "bytes_")

    def maps(table: pa.Table) -> pa.Table:
        """of (the chunk open before the block, null before the first) -> to (the one open behind it), held (its bytes so far)."""
        table = table.sort_by("pos_")
        number = table["block_"][0].as_py()
        pos, first, sizes = (table[c].to_numpy() for c in ("pos_", "first_", "bytes_"))
        here = int(np.searchsorted(pos, number * block))  # what lies before is the end of the block before
        own_after = successors(first[here:], sizes[here:], max_features, max_bytes)
        last = last_starts(own_after)
        if here:
            after = successors(first, sizes, max_features, max_bytes)[:here]
            tails = np.flatnonzero(after >= here)
            entry = after[tails] - here
            inside = entry < len(last)  # else the chunk takes all of the last block
            of, to = pos[tails[inside]], last[entry[inside]]
        else:
            of, to = np.array([-1]), last[:1]
        sums = np.concatenate([[0], np.cumsum(sizes[here:], dtype=np.int64)])
        return pa.table({"number": pa.array(np.full(len(of), number), pa.int64()), "of": pa.array(of, pa.int64()), "to": pa.array(pos[here:][to], pa.int64()), "held": pa.array(sums[-1] - sums[to], pa.int64())})

    edges = staging.cut(halo.groupBy("block_").applyInArrow(maps, "number long, of long, to long, held long"), "maps")
    step = edges.select("of", "to").where("of >= 0")
    jumps = []
    for level in count():
        jumps.append(step)
        if 1 << (level + 1) >= blocks:
            break
        ahead = step.select(F.col("of").alias("to"), F.col("to").alias("far"))
        step = staging.cut(step.join(ahead, "to").select("of", F.col("far").alias("to")), "jump")
    found = edges.where("of < 0").select(F.col("to").alias("at"))
    for jump in reversed(jumps):
        found = staging.cut(found.unionByName(found.join(jump, F.col("at") == F.col("of")).select(F.col("to").alias("at"))).distinct(), "reached")
    ends = edges.select((F.col("number") + 1).alias("block_"), F.col("to").alias("at"), F.col("held").alias("held_")).distinct()
    return ends.join(found, "at").select("block_", F.col("at").alias("open_"), "held_").where(F.col("block_") < blocks)
