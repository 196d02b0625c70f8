import random
import re

import pytest

from geoquarry.llm.licenses import BASE, NOTICES, Index, document_counts, scan, scan_labels, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
TEMPLATES = BASE + NOTICES


def plain_words(text):
    return WORD.findall((text or "").translate(UPPER))


def base_places(words):
    found = []
    for t in BASE:
        p = t.text.split()
        found += [(i, t.label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return found


def every_match(index, words):
    """Labels of every place at which a looked-up word stands where the template has it, without votes and bounds."""
    found = set()
    for no, t in enumerate(index.templates):
        ws = index.words[no]
        rare = [o for w, posts in index.postings.items() for n, o in posts if n == no]
        for at in range(-len(ws), len(words) + 1):
            if not t.base and any(0 <= at + o < len(words) and words[at + o] == ws[o] for o in rare) and index._share(no, at, words) >= index.share - 1e-9 and index._keys(no, at, words):
                found.add((t.label, max(at, 0)))
    return found


def texts():
    rnd, out = random.Random(6), [None, "", "...", "CC BY", "cc-by cc.by", "all rights reserved all rights reserved", "All Rights\nReserved", "GENERAL PUBLIC LICENSE", "general public licenses", "ÀLL rights reserved", "a" * 200_000]
    common = "the of and in to is under licensed software public free version copy permission this work with license".split()
    for _ in range(400):
        words = rnd.choices(common + ["zebra", "Ölkanne", "42"], k=rnd.randrange(1, 60))
        for _ in range(rnd.randrange(3)):
            notice = rnd.choice(TEMPLATES).text.split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                notice[rnd.randrange(len(notice))] = rnd.choice(common)
            if rnd.random() < 0.3:
                notice.insert(rnd.randrange(len(notice)), "x")
            at = rnd.randrange(len(words) + 1)
            words[at:at] = notice
        out.append(rnd.choice([" ", ", ", "\n"]).join(words))
    return out + ["word " * 30_000 + "Released under the MIT License."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())]
    rows += [(5, "cc by nc", "x", 1), (None, "all rights reserved", "x", 1), (3, "CC BY", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n_words int").repartition(5)


def test_query_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    words = {t: plain_words(t) for _, t in rows}
    n, counts = document_counts(docs, TEMPLATES)
    vocabulary = {w for t in TEMPLATES for w in plain_words(t.text)}
    assert n == len(rows) and counts == {w.encode(): c for w in vocabulary if (c := sum(w in set(words[t]) for _, t in rows))}
    index, want = Index(TEMPLATES, n, counts), []
    for doc_id, text in rows:
        base = base_places(words[text])
        starts = [i for i, _ in base]
        labels = {x for _, x in base}
        notices = every_match(index, [w.encode() for w in words[text]]) if len(words[text]) < 1000 else {("mit", 30_000)} if words[text][0] == "word" else set()
        want.append((doc_id, len(words[text]), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in notices}))))
    got = scan_labels(docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all((r.score == 1.0) if r.n_base else (0.74 < r.score <= 1.0) if r.labels else r.score == 0 for r in got)


def test_notices_are_found_and_prose_is_not(spark):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "reserved"}
    prose = ["He was released under the terms of the law.", "A license to kill, version one.", "The general public is free.", "Permission was granted to copy the file."]
    docs = spark.createDataFrame([(i, f"The thing of and in that. {t} Thereafter the rest.") for i, t in enumerate([*lines, *prose])], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_labels(docs).collect()}
    assert [got[i].labels for i in range(len(lines))] == list(lines.values())
    assert all(got[i].labels == "" and got[i].score == 0 and got[i].first_word is None for i in range(len(lines), len(got)))
    assert scan_labels(docs.limit(0)).count() == 0
    spans = [m for r in scan(docs).collect() for m in r.matches if m.label == "mit"]
    assert {(m.word_from, m.word_to) for m in spans} == {(6, 11)}


def test_key_phrases_are_mandatory():
    index = Index(TEMPLATES, 1000, {w: 400 for w in (b"under", b"the", b"license", b"mit", b"released")})
    assert {m.label for m in index.find(words_of(b"released under the MIT license"))} == {"mit"}
    assert index.find(words_of(b"released under the license MIT")) == []
    assert [m.label for m in index.find(words_of(b"licensed under the x GNU Lesser General Public License")) if not m.base] == ["lgpl"]
