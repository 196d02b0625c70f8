"""Deduplication by either of two keys, in order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoquarry.operators.components import BOUND, by_size, components
from geoquarry.plans.staging import Staging


def _walk(kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """o of the rows of one component that stay, row after row."""

    def run(table: pa.Table) -> pa.Table:
        met_a, met_b, stay = set(), set(), []
        for o, a, b in sorted(zip(*(table[c].to_pylist() for c in ("o", "a", "b")), strict=True), key=lambda r: r[0]):
            if a not in met_a and b not in met_b:
                met_a.add(a)
                met_b.add(b)
                stay.append(o)
        return pa.table({"o": pa.array(stay, kind)})

    return run


def first_by_either(rows: DataFrame, order: str, keys: tuple[str, str], staging: Staging, bound: int = BOUND) -> DataFrame:
    """``order`` of the rows that stay: those that share neither key with a row that stays before them.

    A row that goes leaves its keys free.  ``order`` is a whole number, unique; a null
    key is one like others.  Rows that share keys, directly or by others, are a
    component.  One of at most ``bound`` rows is walked by one task, however
    long its chains; larger ones are decided in rounds (``_in_rounds``).
    """
    a, b = keys
    every = staging.cut(rows.select(F.col(order).alias("o"), F.col(a).alias("a"), F.col(b).alias("b")), "rows")
    # keys are the nodes and rows the edges, so as many edges as pairs of keys; keys of equal hashes only make a component larger
    node = lambda i, k: F.xxhash64(F.lit(i), F.col(k))
    of = components(every.select(node(0, "a").alias("a"), node(1, "b").alias("b")).distinct(), staging)
    met = every.join(of.hint("merge"), node(0, "a") == F.col("id"), "left")
    placed = staging.cut(met.select("o", "a", "b", F.coalesce("component", node(0, "a")).alias("component")), "placed")
    small, large = by_size(placed, bound)
    field = every.schema["o"]
    large = staging.cut(large.select("o", "a", "b"), "undecided")
    some = not large.isEmpty()
    stay = (small if some else placed).groupBy("component").applyInArrow(_walk(_arrow(field.dataType)), f"o {field.dataType.simpleString()}")
    if some:
        stay = stay.unionByName(_in_rounds(large, staging))
    return stay.select(F.col("o").alias(order))


def _arrow(kind) -> pa.DataType:
    return pa.int32() if kind.simpleString() == "int" else pa.int64()


def _in_rounds(left: DataFrame, staging: Staging) -> DataFrame:
    """o of the rows that stay, decided all at once in rounds.

    A row that is the first undecided one of both its keys stays, and those that
    share a key with it go.  A round is partial minima by key and merge joins of
    narrow rows, so a key of any number of rows is never gathered; rounds are as
    many as the longest run of rows of which each waits for the one before, and
    each works on what is still undecided.
    """
    stay = None
    while left.limit(1).count():
        first = left
        for k in ("a", "b"):
            least = left.groupBy(F.col(k).alias(f"k{k}")).agg(F.min("o").alias(f"m{k}"))
            first = first.join(least.hint("merge"), first[k].eqNullSafe(F.col(f"k{k}"))).drop(f"k{k}")
        marked = staging.cut(first, "marked")
        ahead = marked.where("o = ma AND o = mb").select("o", "a", "b")
        stay = ahead if stay is None else stay.unionByName(ahead)
        # the first of a key that stays is its least undecided row, so a row goes if that one stays
        chosen = ahead.select(F.col("o").alias("c"))
        rest = marked
        for k in ("ma", "mb"):
            rest = rest.join(chosen.hint("merge"), rest[k] == chosen["c"], "left_anti")
        new = staging.cut(rest.select("o", "a", "b"), "undecided")
        left = new
    return (stay if stay is not None else left).select("o")
