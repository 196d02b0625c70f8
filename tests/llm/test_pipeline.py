import re

import pytest

import corpus_pipeline
from geoquarry.llm import decontam, exact_dedup, minhash, toxicity
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_minhash import brute as brute_near

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "exact_dedup":
            best = {}
            for d, t in before.items():
                k = re.sub("[\\x20\\x09-\\x0d]", "", t)
                best[k] = min(best.get(k, (1, 0)), (-len(t), d))
            assert set(ids) == {d for _, d in best.values()}
        if name == "near_dedup":
            assert set(ids) == {d for d, _, _, k in brute_near(sorted(before.items()), 5) if k}
        if name == "decontamination":
            assert set(ids) == {r[0] for r in brute_hits(sorted(before.items()), bench) if not r[5]}
        if name != "encoding":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        else:
            assert set(ids) == set(before)
        kept[name] = len(ids)
    assert kept["exact_dedup"] > 0.5 * 200


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0), (None, "a b", None, None, None), (2, "", "en", "s", 0)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == min(len(rows), 2)  # null and empty texts are equal


def test_repeated_ids_nulls_and_clashing_columns(spark):
    base = [f"w{i}" for i in range(60)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, " ".join(base)), (1, "other words of the same id"), (2, "other  words of the same id"), (2, " ".join([*base[:-1], "x"])), (3, f"before {item} behind"), (3, "clean text of id three"),
        (None, " ".join(base)), (None, None), (4, ""), (4, " \n"), (5, "end " * 30_000),
    ]
    more = "row string, fp int, gid string, component int, toxic_score double, words string, count int, item_id string"
    docs = spark.createDataFrame([(*r, "en", "s", 0, "r", 1, "g", 2, 0.5, "w", 3, "i") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}").repartition(3)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    told = toxicity.keep_clean(docs, toxicity.fit([], []))  # without labels nothing is toxic
    assert told.columns == docs.columns and told.count() == len(rows)
    once = exact_dedup.keep_one(told)
    assert once.columns == docs.columns
    kept = sorted(((r.doc_id or 0), (r.text or "").strip()[:9]) for r in once.collect())
    # id 1 and the null id say the same, as do its second text and that of id 2, which is longer; empty texts are one
    assert kept == [(1, "w0 w1 w2 "), (2, "other  wo"), (2, "w0 w1 w2 "), (3, "before al"), (3, "clean tex"), (4, ""), (5, "end end e")]
    near = minhash.keep_one(once)
    assert near.columns == docs.columns
    assert sorted(((r.doc_id or 0), (r.text or "").strip()[:5]) for r in near.collect()) == [(1, "w0 w1"), (2, "other"), (3, "befor"), (3, "clean"), (4, ""), (5, "end e")]
    clean = decontam.keep_clean(near, bench)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id or 0), (r.text or "").strip()[:5]) for r in clean.collect()) == [(1, "w0 w1"), (2, "other"), (3, "clean"), (4, ""), (5, "end e")]
    assert corpus_pipeline.encoding_stage(spark, clean, SF).count() == 5
