import random

import numpy as np
from pyspark.sql import functions as F

from geoquarry.llm import toxicity


def corpus(n, seed):
    rnd = random.Random(seed)
    bad = ["moronic", "idiotic", "scumbag", "worthless"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 7))) for _ in range(rnd.randrange(5, 80))]
        if y := int(i % 4 == 0):
            for _ in range(1 + len(words) // 15):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        texts.append(" ".join(words))
        labels.append(y)
    return texts, labels


def test_held_out_accuracy_and_unseen_misspellings():
    model = toxicity.fit(*corpus(400, 1))
    s = toxicity.Scorer(model)
    texts, labels = corpus(200, 2)
    assert np.mean([(s(t) >= 0.7) == bool(y) for t, y in zip(texts, labels, strict=True)]) > 0.95
    assert s("abc dea moronicc bagf") > s("abc dea bagfeda bagf") + 0.3  # never seen, shares n-grams


def test_query_shape_and_odd_rows(spark):
    texts, labels = corpus(200, 3)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (None, "abc", "x", 1.0), (5, texts[5], "x", 1.0), (902, "moronic " * 50_000, "x", 1.0)], "doc_id long, text string, toxic string, score double")
    marks = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(900, None, 1), (None, 1, 1), (12345, 1, 1), (5, 0, 1)], "doc_id long, toxic int, score int")
    model = toxicity.train(docs, marks, F.col("doc_id") % 3 != 1)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (900, 901)} == {toxicity.Scorer(model)("")}
    assert [r.score for r in got if r.doc_id == 902][0] > 0.9


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    assert toxicity.score(docs, model).first().score == 0.5
    assert toxicity.Scorer(toxicity.fit(["a", "b"], [0, 0]))("a") < 0.1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_words_in_few_texts_are_trained():
    texts, labels = corpus(400, 4)
    for i in range(0, 20, 4):  # toxic, and in five texts only
        texts[i] += " zyxwv"
    for i in range(1, 200, 4):
        texts[i] += " kindly"
    plain, score = "abc dea bagf", toxicity.Scorer(toxicity.fit(texts, labels))
    assert score(plain + " zyxwv") > score(plain + " pqrst") > score(plain + " kindly")
