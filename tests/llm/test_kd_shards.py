import random
import zlib
from collections import defaultdict

from geoquarry.llm.kd_shards import shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, crc long, shard int"


def check(got, rows, shards):
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, units = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        units[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in units.values())
    return slots


def test_near_equal_bytes_and_whole_groups(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * int(rnd.paretovariate(1.2) * 20) + str(i), rnd.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 9}", i, 0) for i in range(1500)]
    rows += [(2000 + i, "same text", "fr", f"s{i}", 0, 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = shard_documents(df, 7).collect()
    check(got, rows, 7)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    largest = max(r.size for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * largest
    again = {r.doc_id: r.shard for r in shard_documents(df.repartition(3), 7).collect()}
    assert again == {r.doc_id: r.shard for r in got}


def test_odd_tables(spark):
    rows = [(1, None, None, None, 0, 0), (2, "", "en", "s", 0, 0), (2, "", "en", "s", 0, 0), (None, "a", "en", "s", 0, 0), (3, "long " * 50000, "en", "s", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(shard_documents(df, 40).collect(), rows, 40)
    assert shard_documents(df.limit(0), 40).count() == 0
    assert {r.shard for r in shard_documents(df, 1).collect()} == {0}
