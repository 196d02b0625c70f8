import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from geoquarry.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
OURS = bpe.Bpe(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="ab e\n'st", max_size=400), st.text(alphabet="aeéß=-", min_size=30, max_size=300)))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_very_long_match_is_joined_from_halves():
    for text in ("a" * 20_000, "ab" * 9_999 + "z", "=-" * 5_000, "hello" * 4_000, " " * 3_001):
        assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "Hello hello", "x"), (2, None, "y"), (3, "", "z"), (None, "éa  b", "w"), (1, "Hello hello", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(spark, docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((a or 0, len(THEIRS.encode_ordinary(t or ""))) for a, t, _ in rows)
    assert bpe.encode_documents(spark, docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
