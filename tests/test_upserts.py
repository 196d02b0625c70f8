"""Stores with replaced records, against a dictionary."""

import random

from pyspark.sql import functions as F

from geoquarry.operators.upserts import LARGE_PAYLOAD, Upserts, newest_first, raw_records
from geoquarry.plans.staging import Staging

SCHEMA = "run long, note string, at int"


def test_generations_are_as_a_dictionary(spark):
    rnd, store, want = random.Random(2), Upserts(spark, Staging(spark, "u").root, "runs", ("run",), "at"), {}
    for step in range(9):
        project = rnd.choice(["a", "b"])
        rows = [(rnd.choice([None, *range(12)]), f"{step}-{i}", rnd.randrange(3)) for i in range(8)]
        store.upsert(spark.createDataFrame(rows, SCHEMA).repartition(2), project)
        newest = {}
        for r in rows:
            newest[r[0]] = max(newest.get(r[0], (None, "", -1)), r, key=lambda x: (x[2], x[1]))
        want |= {(project, k): r for k, r in newest.items()}
        if step in (4, 6):
            store.compact(project)
            assert len(store.generations(project)) == 1
        got = {(r.project, r.run): (r.run, r.note, r.at) for r in store.scan().collect()}
        assert got == want
    assert {r.run for r in store.scan("a").collect()} == {k for p, k in want if p == "a"}
    store.delete(project="a")
    assert store.projects() == ["b"]


def test_writes_that_were_lost_do_not_count(spark):
    store = Upserts(spark, Staging(spark, "u").root, "runs", ("run",), "at")
    store.upsert(spark.createDataFrame([(1, "first", 0)], SCHEMA), "p")
    store.upsert(spark.createDataFrame([(1, "lost", 0)], SCHEMA), "p")
    fs, path = store._hadoop(f"{store._path(project='p')}/generation=00000002/_SUCCESS")
    fs.delete(path, False)
    assert [r.note for r in store.scan("p").collect()] == ["first"]
    store.upsert(spark.createDataFrame([(1, "third", 0)], SCHEMA), "p")
    assert [r.note for r in store.scan("p").collect()] == ["third"]
    store.compact("p")
    assert [r.note for r in store.scan("p").collect()] == ["third"]


def test_payload_warnings_and_order(spark):
    docs = spark.createDataFrame([(1, "x" * LARGE_PAYLOAD), (2, "x" * (LARGE_PAYLOAD - 1)), (3, None), (4, "é" * (LARGE_PAYLOAD // 2))], "id long, payload string")
    got = {r.id: (r.payload_bytes, r.storage_warning) for r in raw_records(docs).collect()}
    assert got[1] == (LARGE_PAYLOAD, f"Raw payload is {LARGE_PAYLOAD} bytes; future ingestion should chunk this source response.")
    assert got[2] == got[3] == (None, None) and got[4][0] == LARGE_PAYLOAD
    runs = spark.createDataFrame([(1, "t", 5), (2, "t", 9), (3, "t", 9), (4, "u", 1), (5, "u", None)], "run long, t string, at int")
    assert {r.run: r.place for r in newest_first(runs, ("t",), "at", "run", F.col("run") < 6).collect()} == {3: 1, 2: 2, 1: 3, 4: 1, 5: 2}
