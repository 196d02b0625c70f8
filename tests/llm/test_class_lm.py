import math
import random
import zlib
from collections import Counter

import pyarrow as pa

from geoquarry.llm import class_lm
from geoquarry.llm.class_lm import score_documents
from geoquarry.plans.staging import Staging

SCHEMA = "doc_id long, text string, n int, word string"


def words(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def held(d):
    return zlib.crc32(str(d).encode() if d is not None else b"") % 10 == 0


def test_base_is_exact_and_classes_beat_it(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        tongue = rnd.choice("abcd")  # a language's words follow each other
        rows.append((i, " ".join(tongue.upper() + str(min(int(rnd.expovariate(0.05)), 300)) for _ in range(rnd.randrange(1, 60)))))
    rows += [(500, None), (501, ""), (None, "zz \x1c q"), (10, rows[10][1]), (502, "a1 " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA).repartition(3)
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = score_documents(df, classes=8, head=150, own=60).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t in rows:
        ws = words(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[d, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a", "c c a", "a"]
    vocabulary = ["a", "b", "c", "never"]
    train = [(i, t) for i, t in enumerate(texts * 3) if not held(i)]
    tests = [(1000 + i, w) for i, w in enumerate(vocabulary)]
    tests = [(next(j for j in range(10_000 + 100 * i, 10_100 + 100 * i) if held(j)), w) for i, (_, w) in enumerate(tests)] + [(next(j for j in range(20_000, 20_100) if held(j)), "")]
    rows = spark.createDataFrame([(*r, 0, "") for r in train + tests], SCHEMA)
    got = {r.doc_id: r for r in score_documents(rows, classes=1, head=2, own=1).collect()}
    # with one class a text's words are independent: P(word) P(end) over all words and the end sums to P(end)
    end = got[tests[-1][0]].score
    total = sum(10 ** (got[d].score - end) for d, _ in tests[:-1]) + 10**end
    assert abs(total - 1) < 1e-6


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert score_documents(df.limit(0)).count() == 0
    only_held = spark.createDataFrame([(next(j for j in range(100) if held(j)), "a b")], "doc_id long, text string")
    r = score_documents(only_held).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_rare_words_move_by_their_own_contexts(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        tongue = rnd.choice("abcd")  # all words end alike, so their family tells nothing
        rows.append((i, " ".join(f"{tongue}{rnd.randrange(60)}zz" for _ in range(30)), 1, "w"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = [r for r in score_documents(df, classes=8, head=2, own=1).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_units_beyond_those_broadcast_keep_their_classes(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        tongue = rnd.choice("abcd")
        rows.append((i, " ".join(f"{tongue}{rnd.randrange(60)}zz" for _ in range(rnd.randrange(1, 40))), 1, "w"))
    rows += [(900, None, 1, "w"), (901, "new a1zz", 1, "w")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda r: r.doc_id
    whole = sorted(score_documents(df, classes=8, head=2, own=1).collect(), key=key)
    few = sorted(score_documents(df, classes=8, head=2, own=1, most=600).collect(), key=key)  # 240 words are units, all but 86 far
    assert [r.doc_id for r in few] == [r.doc_id for r in whole]
    assert all(abs(a.score - b.score) < 1e-9 * abs(a.score) for a, b in zip(whole, few, strict=True))


def test_words_are_numbered_as_split():
    odd = ["", " ", "\n\t", "A b  a\x0bB\x0c", " É é\xa0É \x1c \x85x ", "a" * 5000, "\x00 \x00", "zz " * 50, "\U0001f600 Z"]
    for texts in (odd, ["", ""], [" "], ["one"], odd[3:4] * 7):
        column = pa.array(["cut off", *texts]).slice(1)
        at, starts, listed = class_lm.number_words(column)
        listed = [w.encode() for w in listed.to_pylist()]
        assert [[listed[i] for i in at[a:b]] for a, b in zip(starts, starts[1:], strict=False)] == [words(t) for t in texts]
        assert len(set(listed)) == len(listed)
        for most in (1, 20, 10**6):
            ranges = list(class_lm.packs(column, most))
            assert [i for lo, hi in ranges for i in range(lo, hi)] == list(range(len(texts)))
            assert all(hi == lo + 1 or sum(len(t.encode()) for t in texts[lo:hi]) <= most for lo, hi in ranges)
    some = ["a", "zz", "É", "\U0001f600", "ab\x00"]
    assert class_lm.families(pa.array(["cut", *some]).slice(1)).tolist() == [class_lm.family(w.encode()) for w in some]


def test_a_pack_asks_for_a_word_once(spark, monkeypatch):
    seen, cut = {}, Staging.cut

    def counted(self, df, name="part"):
        out = cut(self, df, name)
        if name == "begun":
            seen["words"] = sum(len(r.rare) for r in out.select("rare").collect())
        return out

    monkeypatch.setattr(Staging, "cut", counted)
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7, 60)), 1, "w") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = {r.doc_id: r for r in score_documents(df, classes=4, head=10, own=5).collect()}
    assert seen["words"] <= 60  # not once a document
    monkeypatch.setattr(class_lm, "PACK", 1)
    few = {r.doc_id: r for r in score_documents(df, classes=4, head=10, own=5).collect()}
    assert whole.keys() == few.keys()
    for d, r in whole.items():
        assert (r.n_tokens, r.n_known) == (few[d].n_tokens, few[d].n_known)
        assert abs(r.score - few[d].score) < 1e-9 * abs(r.score) and abs(r.base_score - few[d].base_score) < 1e-9 * abs(r.base_score)
