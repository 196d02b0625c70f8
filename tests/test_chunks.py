"""Chunks by budget in blocks, against one stream over all features."""

import random

import numpy as np
import pytest

from geoquarry.operators import chunks
from geoquarry.plans.staging import Staging


def stream(rows, max_features, max_bytes):
    out, at = [], object()
    for g, o, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = s or 0
        if g != at:
            at, chunk, n, held = g, 0, 0, 0
        if n and (n >= max_features or held + s > max_bytes):
            chunk, n, held = chunk + 1, 0, 0
        n, held = n + 1, held + s
        out.append((g, o, chunk))
    return out


@pytest.mark.parametrize(("groups", "block"), [(1, 64), (1, 7), (5, 50), (40, 33), (3, 1 << 20)])
def test_as_one_stream(spark, groups, block):
    rnd = random.Random(groups * 1000 + block)
    rows = [(rnd.choice([None, *range(groups - 1)]), i, rnd.choice([None, 0, 1, 5, 9, 30, 200])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, o long, s int").repartition(4)
    for max_features, max_bytes in ((7, 60), (3, 10_000), (20, 31)):
        got = [tuple(r) for r in chunks.by_budget(df, ("g",), "o", "s", max_features, max_bytes, Staging(spark, "t"), block).collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(got, key=key) == stream(rows, max_features, max_bytes)
    assert chunks.by_budget(df.limit(0), ("g",), "o", "s", 3, 10, Staging(spark, "t"), block).count() == 0


def test_two_keys_and_successors(spark):
    rows = [(a, b, i, 4) for i, (a, b) in enumerate([("x", 1), ("x", 2), ("y", 1)] * 40)]
    df = spark.createDataFrame(rows, "a string, b int, id long, size long")
    got = chunks.by_budget(df, ("a", "b"), "id", "size", 8, 16, Staging(spark, "t"), 16).groupBy("a", "b", "chunk").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {4}
    after = chunks.successors(np.array([0, 0, 0, 3, 3]), np.array([5, 50, 5, 5, 5]), 10, 10)
    assert after.tolist() == [1, 2, 3, 5, 5]
    assert chunks.last_starts(after).tolist() == [3, 3, 3, 3, 4]
