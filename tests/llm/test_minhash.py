import random

import numpy as np

from geoquarry.llm import minhash
from geoquarry.llm.minhash import near_components


def brute(rows, k, pct=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rnd, words, share):
    return [rnd.choice("pqrst") + str(rnd.random())[2:6] if rnd.random() < share else w for w in words]


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([5, 30, 120]))]
        for _ in range(rnd.choice([1, 4, 40])):
            rows.append(" ".join(edited(rnd, base, rnd.choice([0, 0.01, 0.02, 0.04, 0.08]))))
    rows += [None, "", " \n", "one", "ONE", "two words", "Two\twords", "x " * 2000, "x " * 1999]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n int, digest string").repartition(3)
    want = brute(rows, 4)
    assert sorted(tuple(r) for r in near_components(df, 4).collect()) == want
    monkeypatch.setattr(minhash, "ALL_PAIRS", 1)  # all buckets by hubs
    assert sorted(tuple(r) for r in near_components(df, 4).collect()) == want
    monkeypatch.setattr(minhash, "LINEAR", 0)  # to the last level
    assert sorted(tuple(r) for r in near_components(df, 4).collect()) == want


def test_estimate_is_corrected_for_chance():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        err = []
        for _ in range(40):
            pool = rnd.integers(0, 1 << 63, 1000, dtype=np.uint64)
            both = int(2 * 1000 * share / (1 + share) / 2 + 0.5)
            rest = 1000 - both
            a, b = pool[: both + rest // 2], np.concatenate([pool[:both], pool[both + rest // 2 :]])
            s, _ = minhash.signatures([a, b])
            x = s[0] ^ s[1]
            bad = sum(int(v).bit_count() for v in (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
            est = ((minhash.HASHES - bad) / minhash.HASHES - 0.25) / 0.75
            err.append(est - both / 1000)
        assert abs(np.mean(err)) < 0.025


def test_maps_never_part_what_is_near():
    rnd = np.random.default_rng(2)
    for n in (1, 5, 40, 200, 3000):
        pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        for both in range(0, n + 1, max(1, n // 7)):
            x, y = pool[:n], pool[n - both : 2 * n - both]
            a, b = minhash.bitmaps([x, y])
            apart = sum(int(v).bit_count() for v in a ^ b)
            assert 2 * n - apart >= 2 * both
    assert len(minhash.bitmaps([])) == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (None, "q r s t u"), (None, "z")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_components(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True)] * 3 + [(None, 1, 1, False), (None, 1, None, True)], key=str)
    assert near_components(df.limit(0)).count() == 0
    assert near_components(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()[0].component_id == 5


def test_keep_one_judges_rows_and_not_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["x"])
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, " ".join(base)), (1, near), (2, near), (2, other), (3, other), (3, other), (4, None), (5, ""), (6, " "), (None, other)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, row double, component string")
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id, (r.text or "")[:1]) for r in got.collect())
    assert kept == [(1, "w"), (2, "v"), (4, ""), (5, ""), (6, " ")]
    assert minhash.keep_one(df.limit(0)).count() == 0
