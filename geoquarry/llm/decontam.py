"""Benchmark decontamination by a distributed positional inverted index, in built-in functions only.

The index is a table of token postings (term, document, position).  A window of
a test item is looked up from its two rarest terms: their posting lists, shifted
by the terms' offsets in the item, are intersected to candidate alignments
(document, item, start); then the shifted lists of the windows' other terms
are intersected along each alignment.  Runs of consecutive matching item words
that hold a whole window are exact phrase matches.  Proximity matches are
documents that have an item's two rarest terms within a window of each other.

At scale: texts are split once, into a written table of words.  Term counts are
partial sums; only the anchor terms' postings are stored, rare ones by choice;
joins run on (document, term, position), which spreads even a passage that a
third of the documents share.  A window that repeats in its item is looked up
once, so a document and an item of one word meet at each position once.  The
benchmark's vocabulary and the candidate ids are broadcast only below a counted
bound, else they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from geoquarry.llm.words import lower_ascii, whole
from geoquarry.plans.staging import Staging

#: What separates words: ASCII outside 0-9 and a-z (letters are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows up to which a narrow table is broadcast.
SMALL = 200_000


def words() -> Column:
    return F.array_remove(F.split(lower_ascii(whole()), BETWEEN), "")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is counted below the bound."""
    return F.broadcast(df) if df.count() <= SMALL else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, fp, words of each row; the id and a fingerprint of the text name a document, so repeated or null ids never mix texts."""
    return docs.select("doc_id", F.xxhash64(whole()).alias("fp"), words().alias("words"))


KEY = ("doc_id", "fp")


def _on_key(a: DataFrame, b: DataFrame, *more: str):
    cond = a["doc_id"].eqNullSafe(b["doc_id"]) & (a["fp"] == b["fp"])
    for c in more:
        cond &= a[c] == b[c]
    return cond


def postings(split: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, fp, term, pos of every occurrence of ``terms`` (column term, distinct) in ``split`` (see ``keyed``)."""
    every = split.select(*KEY, F.posexplode("words").alias("pos", "term"))
    return every.join(small(terms), "term").select(*KEY, "term", "pos")


def term_counts(split: DataFrame, terms: DataFrame) -> DataFrame:
    """term, cf: occurrences in all documents of each of ``terms``; absent terms have 0."""
    tokens = split.select(F.explode("words").alias("term"))
    if terms.count() <= SMALL:
        counted = tokens.join(F.broadcast(terms), "term").groupBy("term").count()
    else:
        counted = tokens.groupBy("term").count()
    return terms.join(counted, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("cf"))


class Index:
    """A benchmark's items looked up in documents' words (``split``, a written table; see ``keyed``)."""

    def __init__(self, split: DataFrame, bench: DataFrame, staging: Staging, window: int = WINDOW):
        self.split, self.staging, self.window = split, staging, window
        items = bench.select("item_id", words().alias("words")).where(F.size("words") > 0).distinct()
        self.items = staging.cut(items.withColumn("item_no", F.monotonically_increasing_id()), "items")
        self.terms = staging.cut(self.items.select("item_no", "item_id", F.size("words").alias("len"), F.posexplode("words").alias("i", "term")), "terms")
        self.counts = staging.cut(term_counts(split, self.terms.select("term").distinct()), "counts")

    def phrase_matches(self) -> DataFrame:
        """doc_id, fp, item_id, item_no, first, n: runs of document words that hold windows of an item.

        ``first`` is the position of the run's first word in the document, ``n`` its
        words.  Items shorter than a window must match whole; items without words
        match nothing.
        """
        split, staging, window = self.split, self.staging, self.window
        weighed = self.terms.join(self.counts, "term").groupBy("item_no").agg(F.sort_array(F.collect_list(F.struct("i", "cf", "term"))).alias("t"))
        starts = F.sequence(F.lit(0), F.greatest(F.size("t") - window, F.lit(0)))
        every = weighed.select("item_no", F.explode(F.transform(starts, lambda s: F.slice("t", s + 1, window))).alias("w"))
        every = every.where(~F.exists("w", lambda x: x["cf"] == 0))
        said = F.transform("w", lambda x: x["term"])
        once = staging.cut(every.groupBy("item_no", said.alias("said")).agg(F.min("w").alias("w")).drop("said"), "windows")
        ordered = F.array_sort(F.transform("w", lambda x: F.struct(x["cf"].alias("cf"), x["i"].alias("i"), x["term"].alias("term"))))
        pick = once.select("item_no", ordered.alias("w"))
        second = F.coalesce(F.get("w", F.lit(1)), F.get("w", F.lit(0)))
        anchors = pick.select("item_no", F.col("w")[0]["term"].alias("term"), F.col("w")[0]["i"].alias("i1"), second["term"].alias("term2"), second["i"].alias("i2"))
        anchors = staging.cut(anchors.distinct(), "anchors")
        spots = once.select("item_no", F.explode("w").alias("x")).select("item_no", "x.i").distinct()
        checked = staging.cut(self.terms.join(spots, ["item_no", "i"]), "checked")

        needed = staging.cut(anchors.select("term").union(anchors.select("term2")).distinct(), "needed")
        index = staging.cut(postings(split, needed), "postings")
        led = index.join(small(anchors), "term").select(*KEY, "item_no", (F.col("pos") - F.col("i1")).alias("start"), F.col("term2").alias("term"), (F.col("pos") - F.col("i1") + F.col("i2")).alias("pos"))
        other = index.distinct()
        found = led.join(other, _on_key(led, other, "term", "pos"), "left_semi").select(*KEY, "item_no", "start").distinct()
        candidates = staging.cut(found, "candidates")

        ids = candidates.select(*KEY).distinct()
        hosts = split.join(small(ids), _on_key(split, ids), "left_semi").distinct().select(*KEY, F.posexplode("words").alias("pos", "term"))
        wanted = candidates.join(small(checked), "item_no").select(*KEY, "item_no", "item_id", "len", "start", "i", "term", (F.col("start") + F.col("i")).alias("pos"))
        hit = wanted.join(hosts, _on_key(wanted, hosts, "term", "pos"), "left_semi")
        line = W.partitionBy(*KEY, "item_no", "start").orderBy("i")
        runs = hit.withColumn("run", F.col("i") - F.row_number().over(line)).groupBy(*KEY, "item_no", "item_id", "start", "run", "len").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
        return runs.where(F.col("n") >= F.least("len", F.lit(window))).select(*KEY, "item_id", "item_no", "first", "n")

    def rarest_pairs(self) -> DataFrame:
        """item_id, term, term2: the two terms of each item that occur least in the documents, then in order; none where fewer occur."""
        of_item = self.terms.select("item_no", "item_id", "term").distinct().join(self.counts.where("cf > 0"), "term")
        two = of_item.groupBy("item_no", "item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("cf", "term"))), 1, 2).alias("t")).where(F.size("t") == 2)
        return two.select("item_id", F.col("t")[0]["term"].alias("term"), F.col("t")[1]["term"].alias("term2"))

    def near_items(self) -> DataFrame:
        """d2, f2, n_near: items whose rarest pair occurs within a window in the document, where there are any."""
        pairs = self.staging.cut(self.rarest_pairs(), "pairs")
        close = proximity_matches(self.split, pairs, self.window).select(*KEY, "term", "term2").distinct()
        of_item = close.join(small(pairs), ["term", "term2"]).select(*KEY, "item_id").distinct()
        return of_item.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near")).withColumnsRenamed({"doc_id": "d2", "fp": "f2"})


def proximity_matches(split: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """doc_id, fp, term, term2, pos, pos2: occurrences of two terms at most ``within`` words apart, in either order.

    Postings meet on (document, bucket of ``within`` + 1 positions), the second
    list in its own and both neighbouring buckets, so nothing is compared
    across a whole document.
    """
    terms = pairs.select("term").union(pairs.select(F.col("term2"))).distinct()
    index = postings(split, terms).distinct()
    width = within + 1
    left = index.join(small(pairs.select("term", "term2").distinct()), "term").withColumn("cell", F.floor(F.col("pos") / width))
    right = index.select(F.col("doc_id").alias("d2"), F.col("fp").alias("f2"), F.col("term").alias("t2"), F.col("pos").alias("pos2"))
    right = right.withColumn("c2", F.explode(F.array(*[F.floor(F.col("pos2") / width) + k for k in (-1, 0, 1)])))
    cond = left["doc_id"].eqNullSafe(right["d2"]) & (left["fp"] == right["f2"]) & (left["term2"] == right["t2"]) & (left["cell"] == right["c2"])
    near = left.join(right, cond & (F.abs(F.col("pos") - F.col("pos2")) <= within) & (F.col("pos") != F.col("pos2")))
    return near.select(*KEY, "term", "term2", "pos", "pos2")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: one row for each row of ``docs``.

    n_near counts the items whose two rarest terms lie at most a window of words apart.

    Null and empty texts have no words and are clean.  Rows that repeat a doc_id
    get the result of their own text.  Rows of the benchmark that share an
    item_id are one item; a null item_id counts as an item but not in the hash.
    Empty tables give no rows, or all clean.  Other columns are not read.
    """
    staging = Staging(docs.sparkSession, "decontam")
    split = staging.cut(keyed(docs), "words")
    index = Index(split, bench, staging, window)
    runs = staging.cut(index.phrase_matches(), "runs")
    spots = runs.select(*KEY, F.explode(F.sequence("first", (F.col("first") + F.col("n") - 1).cast("int")))).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    named = runs.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    named = named.select(F.col("doc_id").alias("d2"), F.col("fp").alias("f2"), "n_items", "items")
    near = index.near_items()
    hits = spots.join(named, spots["doc_id"].eqNullSafe(named["d2"]) & (spots["fp"] == named["f2"])).select(F.col("d2"), F.col("f2"), "n_hit", "n_items", "items")
    all_docs = split.select(*KEY, F.size("words").cast("long").alias("n_words"))
    out = all_docs.join(hits, _is(all_docs, hits), "left").drop("d2", "f2")
    out = out.join(near, _is(out, near), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def _is(docs: DataFrame, hits: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(hits["d2"]) & (docs["fp"] == hits["f2"])


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs; all columns stay, whatever their names.

    Null and empty texts have no words and stay; rows that repeat an id are judged
    by their own texts, repeated rows stay repeated.  Empty tables: no rows, or all of them.
    """
    staging = Staging(docs.sparkSession, "decontam")
    split = staging.cut(keyed(docs), "words")
    hit = Index(split, bench, staging, window).phrase_matches().select(*KEY).distinct()
    hit = staging.cut(hit.select(F.col("doc_id").alias("d2"), F.col("fp").alias("f2")), "hit")
    return docs.join(hit.hint("merge"), docs["doc_id"].eqNullSafe(hit["d2"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["f2"]), "left_anti")
