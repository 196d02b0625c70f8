import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from geoquarry.llm import vector_codes
from geoquarry.llm.vector_codes import compress, integers, nearest


def brute(rows, parts, entries, rounds):
    """The contract row by row, with Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = -(-max(len(r[1]) for r in kept) // parts) * parts
    ints = [[math.floor(4096 * x) for x in r[1]] + [0] * (dims - len(r[1])) for r in kept]
    w = dims // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda p, v: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in cut:
                own[find(p, v[p])[1]].append(v[p])
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[find(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[2]], sha) for r, f, e in zip(kept, found, errors, strict=True)), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code int, of string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)


def rounded(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = rounded([(i, [rnd.gauss(0, 0.2) for _ in range(16)], rnd.choice([0, 1, None])) for i in range(300)])
    rows += rows[40:60] + [(7, rows[9][1], 1), (None, rows[3][1], 0)]  # repeats, an id twice, a null id
    rows += [(400, None, 1), (401, [0.1] * 15 + [None], 1), (402, [float("nan")] + [0.0] * 15, 1), (403, [float("-inf")] * 16, 1), (404, [0.0] * 16, 2), (405, [], 2), (406, [0.5] * 5, 2)]
    got = sorted((tuple(r) for r in compress(frame(spark, rows), parts=4, entries=6, rounds=3).collect()), key=str)
    assert got == brute(rows, 4, 6, 3)
    assert sorted((tuple(r) for r in compress(frame(spark, rows)).collect()), key=str) == brute(rows, 8, 16, 6)


def test_equal_vectors_few_rows_and_none(spark):
    rows = rounded([(i, [0.25, -0.25] * 4, 1) for i in range(50)])
    got = compress(frame(spark, rows))
    assert {tuple(r)[1:4] for r in got.collect()} == {("00" * 8, 0, 0)} and got.count() == 50
    odd = rounded([(1, [0.1, -0.3, 0.7], None), (2, [9e30, -9e30, 1.0], 4)])  # three entries' worth of rows, saturating integers
    assert [len(r.code) for r in compress(frame(spark, odd)).collect()] == [16, 16]
    nothing = compress(frame(spark, [(1, None, 1)]))
    assert nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and nothing.count() == 0
    assert compress(frame(spark, [(1, None, 1)]).limit(0)).count() == 0


def test_partial_distances_lose_no_entry_and_no_tie():
    rnd = np.random.default_rng(5)
    for d in (1, 2, 8):
        x, book = rnd.integers(-4, 5, (500, d)), rnd.integers(-4, 5, (16, d))
        book[9] = book[2]
        all_of = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, best = nearest(x, book)
        assert (at == all_of.argmin(axis=1)).all() and (best == all_of.min(axis=1)).all()


def test_saturation_keeps_distances_in_range():
    for dims in (1, 3, 64, 1000, 4096):
        assert dims * (2 * vector_codes.bound(dims)) ** 2 < 1 << 62
    rows, x = integers(pa.array([[1e300, -1e300], None, [None, 1.0]], pa.list_(pa.float64())), 2)
    assert rows.tolist() == [0] and x[0].tolist() == [vector_codes.bound(2), -vector_codes.bound(2)]
