import random

import numpy as np
import pytest

from geoquarry.llm import exchange


def texts(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        tongue, at = rnd.randrange(3), 0
        line = []
        for _ in range(rnd.randrange(1, 30)):
            at = (at + 1) % 4  # kinds of words follow each other
            line.append(1 + tongue * 40 + at * 10 + rnd.randrange(10))
        out.append([*line, 0])
    return out


def frame(spark, lines):
    return spark.createDataFrame([(np.array(x, np.int32).tobytes(),) for x in lines], "codes binary").repartition(3)


def pairs_of(lines, of, k):
    out = np.zeros((k + 1, k), np.int64)
    for line in lines:
        for a, b in zip([None, *line], line, strict=False):
            out[k if a is None else of[a], of[b]] += 1
    return out


def test_pair_counts_and_objective_rises(spark):
    lines = texts(1)
    enc, units = frame(spark, lines), 121
    of, pairs, history = exchange.cluster(enc, np.arange(0), units, sum(map(len, lines)), 6, 4)
    assert (pairs == pairs_of(lines, of, 6)).all()
    assert len(history) > 2 and all(b > a for a, b in zip(history, history[1:], strict=False))
    assert abs(history[-1] - exchange.objective(pairs[:6])) < 1e-6 * abs(history[-1])
    start = (np.arange(units) % 6).astype(np.uint8)
    assert history[0] == pytest.approx(exchange.objective(pairs_of(lines, start, 6)[:6]))


def test_best_class_is_that_of_brute_force():
    lines, k = texts(2, 40), 5
    rng = np.random.default_rng(4)
    of = rng.integers(0, k, 121).astype(np.uint8)
    pairs = pairs_of(lines, of, k)
    keys = []
    for line in lines:
        for a, b in zip(line, line[1:], strict=False):
            keys += [(b, int(of[a])), (a, k + int(of[b]))]
    at, n = np.unique([u * 2 * k + s for u, s in keys], return_counts=True)
    units, best = exchange.best_classes(at, n, of, pairs[:k])
    for u, c in zip(units, best, strict=True):
        if any(u == a == b for line in lines for a, b in zip(line, line[1:], strict=False)):
            continue  # a word beside itself moves both ends
        scores = []
        for d in range(k):
            moved = of.copy()
            moved[u] = d
            scores.append(exchange.objective(pairs_of(lines, moved, k)[:k]))
        assert scores[c] > max(scores) - 1e-6


def test_few_counts_at_a_time_and_shares_of_heads(spark, monkeypatch):
    lines = texts(3)
    head = np.array([0, *range(1, 60), *[60] * 61], np.int64)  # the last head words share one unit
    whole = exchange.cluster(frame(spark, lines), head, 121, 10, 6, 2)
    monkeypatch.setattr(exchange, "DENSE", 7)
    monkeypatch.setattr(exchange, "PACK", 50)
    monkeypatch.setattr(exchange, "PART", 300)
    split = exchange.cluster(frame(spark, lines), head, 121, sum(map(len, lines)), 6, 2)
    assert (whole[0] == split[0]).all() and (whole[1] == split[1]).all()
    assert len(set(whole[0][60:])) == 1


def test_empty(spark):
    of, pairs, history = exchange.cluster(frame(spark, []), np.arange(2), 4, 0, 3, 2)
    assert pairs.sum() == 0 and history[0] == 0 and len(of) == 4


def test_packing():
    for at in ([], [0], [5, 6, 1 << 31, (1 << 32) + 5], [3, 1 << 40]):
        at, n = np.array(at, np.int64), np.arange(1, len(at) + 1)
        b = exchange._packed(7, at, n)
        got = exchange._unpacked(b.column(1)[0].as_py(), b.column(2)[0].as_py())
        assert (got[0] == at).all() and (got[1] == n).all()


def test_tables_of_small_counts_are_exact(monkeypatch):
    rng = np.random.default_rng(5)
    of, pairs = rng.integers(0, 6, 50).astype(np.uint8), rng.integers(200, 900, (6, 6))
    at = np.unique(rng.integers(0, 50 * 12, 300))
    n = rng.integers(1, 12, len(at))
    whole = exchange.best_classes(at, n, of, pairs)
    monkeypatch.setattr(exchange, "SMALL", 3)
    few = exchange.best_classes(at, n, of, pairs)
    assert (whole[0] == few[0]).all() and (whole[1] == few[1]).all()
