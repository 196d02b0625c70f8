"""Greedy grouping and session dedup by component: walks and rounds give the same, long chains included."""

import random

import pytest

from geoquarry.operators import fusion, sessions
from geoquarry.plans.staging import Staging


def groups(ids, pairs):
    near, founder = {}, {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    for x in sorted(ids):
        founder[x] = min((a for a in near.get(x, []) if founder[a] == a), default=x)
    return founder


@pytest.mark.parametrize("bound", [100_000, 6])
def test_groups(spark, bound):
    rnd = random.Random(3)
    ids = list(range(400))
    pairs = {tuple(sorted(rnd.sample(range(0, 100), 2))) for _ in range(60)} | {(i, i + 1) for i in range(200, 220)} | {(300, i) for i in range(301, 320)}
    c = spark.createDataFrame([(i,) for i in ids], "ordinal long").repartition(3)
    p = spark.createDataFrame(sorted(pairs), "a long, b long").repartition(3)
    got = {r.ordinal: r.founder for r in fusion.greedy_groups(c, p, Staging(spark, "t"), bound=bound).collect()}
    assert got == groups(ids, pairs)
    assert {r.founder for r in fusion.greedy_groups(c, p.limit(0), Staging(spark, "t"), bound=bound).collect()} == set(ids)


def test_a_chain_of_thousands_takes_no_rounds(spark):
    n = 5000
    p = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    staging = Staging(spark, "t")
    got = fusion.greedy_groups(spark.range(n).selectExpr("id AS ordinal"), p, staging)
    assert {r.ordinal: r.founder for r in got.collect()} == {i: i - i % 2 for i in range(n)}
    assert staging._n < 40  # tables written: in rounds they would be thousands


def stays(rows):
    met_a, met_b, out = set(), set(), set()
    for o, a, b in sorted(rows):
        if a not in met_a and b not in met_b:
            met_a.add(a)
            met_b.add(b)
            out.add(o)
    return out


@pytest.mark.parametrize("bound", [100_000, 4])
def test_sessions(spark, bound):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, *"abcdefghij"]) if i % 3 else f"a{i}", rnd.choice([None, *"klmnopq"]) if i % 5 else f"b{i}") for i in range(200)] + [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(30)]
    df = spark.createDataFrame(rows, "o long, a string, b string").repartition(3)
    assert {r.o for r in sessions.first_by_either(df, "o", ("a", "b"), Staging(spark, "t"), bound).collect()} == stays([(o, a or "", b or "") for o, a, b in rows])
    assert sessions.first_by_either(df.limit(0), "o", ("a", "b"), Staging(spark, "t"), bound).count() == 0
