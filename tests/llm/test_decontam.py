import hashlib
import random
import re
from collections import Counter

from geoquarry.llm.decontam import contamination, keyed, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def rarest_pairs(docs, bench):
    counts = Counter(t for d in docs for t in split(d[1]))
    for item, text in {(i, tuple(split(t))) for i, t in bench}:
        known = sorted((counts[t], t) for t in set(text) if counts[t])
        if len(known) > 1:
            yield item, known[0][1], known[1][1]


def brute(docs, bench, w=10):
    out, pairs = [], list(rarest_pairs(docs, bench))
    for d in docs:
        words, hit, items = split(d[1]), set(), set()
        for item, text in bench:
            q = split(text)
            size = min(len(q), w)
            for s in range(len(q) - size + 1) if q else ():
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == q[s : s + size]:
                        hit |= set(range(p, p + size))
                        items.add(item)
        ids = ",".join(sorted(str(i) for i in items if i is not None))
        at = lambda t: [p for p, x in enumerate(words) if x == t]
        near = {i for i, t, u in pairs if any(abs(p - q) <= w for p in at(t) for q in at(u))}
        out.append((d[0], len(words), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=str)


def check(spark, docs, bench):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, pos int, term string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in bench], "item_id long, text string, fp int")
    assert sorted((tuple(r) for r in contamination(d, b).collect()), key=str) == brute(docs, bench)


def test_random_texts_and_odd_rows(spark):
    rnd = random.Random(5)
    vocab = ["the", "of", "a", "Ünd", "x1", "rare", "odd", "É", "tail"]
    weights = [30, 20, 10, 5, 2, 1, 1, 1, 1]
    text = lambda n: " ".join(rnd.choices(vocab, weights, k=n))
    bench = [(i, text(rnd.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, "..."), (92, "never seen words"), (3, text(12)), (None, text(14))]
    docs = [(i, text(40)) for i in range(25)]
    for i in range(15):
        piece = rnd.choice(bench)[1] or ""
        cut = rnd.randrange(3)
        docs.append((100 + i, f"{text(5)}, {' '.join(piece.split()[cut:])}! {text(4)}"))
    docs += [(200, None), (201, ""), (202, "the " * 60), (None, bench[4][1]), (None, text(9)), (203, docs[30][1]), (203, docs[30][1]), (203, text(20))]
    check(spark, docs, bench)


def test_empty_tables(spark):
    check(spark, [(1, "a b c")], [])
    check(spark, [], [(1, "a b c")])


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x x b a"), (2, "b x x x x a"), (3, None)], "doc_id long, text string")
    p = spark.createDataFrame([("a", "b")], "term string, term2 string")
    assert sorted((r.doc_id, r.pos, r.pos2) for r in proximity_matches(keyed(d), p, 3).collect()) == [(1, 0, 3), (1, 4, 3)]


def test_one_word_repeated_in_long_texts(spark):
    check(spark, [(1, "a " * 3000), (2, "a b " * 500), (3, "b " * 9)], [(1, "a " * 400), (2, "a b " * 100), (3, "b " * 12), (4, "b b")])
