import hashlib
import re
from collections import defaultdict

from geoquarry.llm.exact_dedup import exact_classes, keep_one

SCHEMA = "doc_id long, text string, gid string, rest int, n int"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    out = []
    for k, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out += [(r[0], keep, len(g), r[0] == keep, hashlib.sha256(k.encode()).hexdigest()) for r in g]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    long = "xyz " * 3000
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, long), (8, long + "!"), (9, long), (10, "é" * 40), (11, "é" * 40), (12, "a b"), (13, "ab"), (13, "ab"), (None, "zz"), (14, "zz"), (15, "abc" * 11), (16, "abc" * 11 + "d")]
    rows = [(*r, "g", 1, 2) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in exact_classes(df, widths=(2, 8, 64)).collect()), key=str)
    assert got == brute(rows)
    assert sorted((tuple(r) for r in exact_classes(df).collect()), key=str) == brute(rows)


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a "), (3, "b"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [2, 3, 4]
    assert exact_classes(df.limit(0)).count() == 0


def test_keep_one_judges_rows_and_not_ids(spark):
    rows = [(1, "a"), (1, "b"), (2, "b "), (2, "b"), (2, "b\t"), (None, None), (None, ""), (3, "c" * 5000), (4, "c" * 5000), (4, "c" * 5001)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, row string, keep_id int").repartition(4)
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").strip()[:1], len(r.text or "")) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (2, "b", 2), (3, "c", 5000), (4, "c", 5001)]
    assert keep_one(df.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "z" * 3_000_000 + t) for i, t in enumerate(["", "x", "", "y"])], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_classes(long, widths=(4,)).collect()) == [(0, 0), (1, 1), (2, 0), (3, 3)]  # eightfold widths: few rounds
