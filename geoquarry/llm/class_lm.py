"""Brown class-based bigrams: P(word | before) = P(class | class before) * P(word | class).

Exchange clustering (``exchange``) assigns words to classes.  Every training word
seen ``LEAST`` times or more is a unit that moves by its own contexts.  Rarer words
and words never seen share the class of their family (their last two bytes).
Emission uses every word's own count, however rare.

At scale: texts are turned into word codes once, in a written table.  Words are
numbered by Arrow, a pack of texts at a time (``number_words``), and looked up once a
pack: the ``HEAD`` most frequent words (of ``HEAD_BYTES`` at most) in a broadcast
list; all others get their code and count by a merge join.  Classes are a byte a
unit, broadcast for the first ``UNITS`` of them; those of further ones are a table
that is joined (``exchange.Far``), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from geoquarry.llm.exchange import Far, classes_at, cluster, flat
from geoquarry.llm.words import id_bucket, whole
from geoquarry.plans.staging import Staging

CLASSES, OWN, HEAD, FAMILIES = 64, 4096, 1 << 17, 512
#: A word is a unit of its own if it is seen so often, or is one of the ``OWN`` most frequent.
LEAST = 3
#: Bytes of a word that the driver may list, and units whose classes are broadcast, at most.
HEAD_BYTES, UNITS = 64, 1 << 25
SWEEPS = 3
#: Smoothing of unigrams (base and emission) and of class transitions.
ADD, ADD_CLASS = 0.1, 0.05
#: Bytes of the texts whose words are counted together, looked up together, and one row of the coded table; a longer text is alone.
COUNTED, LOOKED_UP, PACK = 4 << 20, 2 << 20, 1 << 18


def packs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are ``most`` bytes of text together, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def number_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all tokens of texts, where each text starts (and the last ends), and the words that have the numbers.

    Tokens are words (A-Z lower-cased, split at ASCII white space), then the end, which is
    the last number.  A number of the empty word may be there that no token has.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten().dictionary_encode()
    words, at, rows = found.dictionary, found.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    real = at != pc.index(words, "").as_py()  # white space at an end of a text leaves an empty word
    starts = np.concatenate([[0], np.cumsum(real)])[rows - rows[0]] + np.arange(len(rows))
    out, ends = np.full(starts[-1], len(words), np.int32), np.zeros(starts[-1], bool)
    ends[starts[1:] - 1] = True
    out[~ends] = at[real]
    return out, starts, pa.concat_arrays([words, pa.array(["\n"], words.type)])


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over the column ``text`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in packs(b.column(0), COUNTED):
                at, _, words = number_words(b.column(0).slice(lo, hi - lo))
                n = np.bincount(at, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["word", "n"])

    return texts.select(whole()).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def family(word: bytes) -> int:
    """Family of a word by its last two bytes."""
    tail = word[-2:]
    return (tail[0] * 131 + tail[-1]) % FAMILIES


def families(words: pa.Array) -> np.ndarray:
    """Families of many words, none of them empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.cast(pa.binary()).buffers()
    at, data = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64), np.frombuffer(data, np.uint8)
    last = at[1:] - 1
    return (data[np.maximum(last - 1, at[:-1])].astype(np.int64) * 131 + data[last]) % FAMILIES


def score_documents(docs: DataFrame, classes: int = CLASSES, head: int = HEAD, own: int = OWN, sweeps: int = SWEEPS, least: int = LEAST, most: int = UNITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row for each row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0 and scores
    all.  A text's tokens are its words and one end, so null and empty texts have
    one token.  base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens;
    score is the class model's log10 probability, perplexity 10 ** (-score /
    n_tokens).  Words never seen get their family's class and the class's share
    for unknown words.  Without training texts there is one unknown word only, and
    classes are uniform.  Repeated and null ids are rows like others (a null id counts
    as the empty text); other columns are not read.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "class-lm")
    held = id_bucket(10) == 0
    counts = staging.cut(word_counts(docs.where(~held)), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, n_words = total["n"] or 0, total["v"] or 0
    top = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(head).collect()  # a fixed number of rows of a fixed width
    listed_words = [r["word"].encode("utf-8", "surrogatepass") for r in top]
    n_head = len(top)
    known_codes = n_head + FAMILIES
    unit_head = np.array([i if i < own or r["n"] >= least else n_head + family(w) for i, (r, w) in enumerate(zip(top, listed_words, strict=True))] + list(range(n_head, known_codes)), np.int64)

    # codes of all other words: of a unit of its own one behind the families', else none here, as the family's follows from the word
    listed = spark.createDataFrame([(r["word"],) for r in top], "word string")
    rest = counts.join(F.broadcast(listed), "word", "left_anti")
    numbered = staging.cut(rest.where(F.col("n") >= least).withColumn("at", F.monotonically_increasing_id()), "units")
    per = numbered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row for each part file
    starts = spark.createDataFrame([(r["p"], known_codes + sum(x["n"] for x in per[:i])) for i, r in enumerate(per)], "p long, start long")
    n_units = known_codes + sum(r["n"] for r in per)
    units = numbered.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("p")).select("word", "n", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("code"))
    vocabulary = staging.cut(units.unionByName(rest.where(F.col("n") < least).select("word", "n", F.lit(None).cast("long").alias("code"))), "vocabulary")
    staging.drop(counts, numbered)
    head_words = spark.sparkContext.broadcast(pa.array([r["word"] for r in top], pa.string()))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    row_type = f"row struct<doc_id:{doc_type},row:bigint>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in packs(b.column(2), LOOKED_UP):
                texts = b.column(2).slice(begin, end - begin)
                at, starts, words = number_words(texts)
                code = pc.index_in(words, head_words.value).fill_null(-1).to_numpy()[at]
                for lo, hi in packs(texts, PACK):
                    u = code[starts[lo] : starts[hi]]
                    where = np.flatnonzero(u < 0)
                    listed, j = np.unique(at[starts[lo] : starts[hi]][where], return_inverse=True)
                    u[where] = -1 - j  # replaced when the word has its code
                    rare, bounds = words.take(pa.array(listed)), pa.array([0, hi - lo], pa.int32())
                    rows, train = (b.column(i).slice(begin + lo, hi - lo) for i in (0, 1))
                    packed = [pa.array([x.tobytes()], pa.binary()) for x in (starts[lo : hi + 1] - starts[lo], u, families(rare).astype(np.uint16))]
                    lists = [pa.ListArray.from_arrays(bounds, rows), pa.ListArray.from_arrays(bounds, train), *packed, pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), rare)]
                    yield pa.RecordBatch.from_arrays([rows.slice(0, 1).field(1), *lists], names=["pack", "rows", "train", "starts", "codes", "families", "rare"])

    ids = docs.select("doc_id", held.alias("held_out"), whole().alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = f"pack long, rows array<struct<doc_id:{doc_type},row:bigint>>, train array<boolean>, starts binary, codes binary, families binary, rare array<string>"
    begun = staging.cut(ids.select(F.struct("doc_id", "row").alias("row"), (~F.col("held_out")).alias("train"), "text").mapInArrow(encode, schema), "begun")
    rare = begun.select(F.col("pack").alias("p"), F.posexplode("rare").alias("i", "word"))
    joined = rare.join(vocabulary.hint("merge"), "word", "left")
    found = joined.select("p", "i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("code", F.lit(-1)).cast("int").alias("code"))
    rares = found.repartition("p").groupBy("p").agg(F.collect_list(F.struct("i", "n", "code")).alias("got"))  # a pack's words, which PACK bounds

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, train = b.column(0)[i].values, b.column(1)[i].values
                starts, u, of = (np.frombuffer(b.column(j)[i].as_py(), kind) for j, kind in ((2, np.int64), (3, np.int32), (4, np.uint16)))
                known, logs = np.zeros(len(rows), np.int64), np.zeros(len(rows))
                if len(of):
                    got = b.column(5)[i].values
                    order = np.argsort(got.field(0).to_numpy())
                    n, code = got.field(1).to_numpy()[order], got.field(2).to_numpy()[order]
                    code = np.where(code < 0, of.astype(np.int32) + n_head, code)
                    at = np.flatnonzero(u < 0)
                    j, text = -1 - u[at], np.searchsorted(starts, at, "right") - 1
                    u = u.copy()
                    u[at] = code[j]
                    known = np.bincount(text, n[j] > 0, len(rows)).astype(np.int64)
                    logs = np.bincount(text, np.log10(n + ADD)[j], len(rows))
                codes = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(u)])
                yield pa.RecordBatch.from_arrays([rows, train, codes, pa.array(known), pa.array(logs)], names=["row", "train", "codes", "rare_known", "rare_log"])

    met = begun.drop("rare").join(rares.hint("merge"), F.col("pack") == F.col("p"), "left")
    encoded = staging.cut(met.select("rows", "train", "starts", "codes", "families", "got").mapInArrow(finish, f"{row_type}, train boolean, codes binary, rare_known long, rare_log double"), "encoded")
    staging.drop(begun)
    head_words.destroy()
    staging.release()  # shuffles of the codes
    near, far, texts = max(most, known_codes), None, encoded.withColumn("r", F.col("row.row"))
    if n_units > near:
        far = Far(texts, near, n_units, classes, staging)
    classes_of, pairs, _ = cluster(texts.where("train").select(*["r"] * (far is not None), "codes"), unit_head, n_units, n_all, classes, sweeps, far)

    # counts of classes: head words by their codes, the others by the vocabulary's
    shared = spark.sparkContext.broadcast(classes_of)

    def of_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(classes), np.zeros(classes)
        for b in batches:
            tail, code = b.column(2), b.column(1).fill_null(-1).to_numpy()
            code = np.where(code < 0, n_head + families(tail), code)  # rare words are in their family
            c = shared.value[np.minimum(code, len(shared.value) - 1)]
            if b.num_columns > 3:  # null for the codes below
                c = np.where(b.column(3).is_null(), c, b.column(3).fill_null(0).to_numpy()).astype(np.int64)
            n += np.bincount(c, b.column(0).to_numpy(), classes)
            v += np.bincount(c, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes), pa.int64()), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["class", "n", "v"])

    words = vocabulary.select("n", "code", F.substring(F.col("word").cast("binary"), -2, 2).alias("tail"))
    if far is not None:
        words = words.join(far.classes.hint("merge"), "code", "left").select("n", "code", "tail", "class")
    of_class = words.mapInArrow(of_classes, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    shared.destroy()
    n_class, v_class = np.zeros(classes), np.zeros(classes)
    for r in of_class:
        n_class[r["class"]] += r["n"]
        v_class[r["class"]] += r["v"]
    head_n = np.array([r["n"] for r in top], np.float64)
    np.add.at(n_class, classes_of[:n_head], head_n)
    np.add.at(v_class, classes_of[:n_head], 1)
    below = np.log10(n_class + ADD * (v_class + 1))
    seen = pairs.sum(1, keepdims=True)
    model = spark.sparkContext.broadcast(
        {
            "classes": classes_of,
            "step": np.log10((pairs + ADD_CLASS) / (seen + ADD_CLASS * classes)),
            "below": below,
            "base": np.append(np.log10(head_n + ADD), 0.0),  # all others bring theirs from the vocabulary
        }
    )

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            u, starts = flat(b.column(1))
            first, n = starts[:-1], np.diff(starts)
            c = classes_at(u, m["classes"], b.column(4) if b.num_columns > 4 else None).astype(np.int64)
            before = np.concatenate([[classes], c[:-1]])[: len(c)]
            before[first] = classes
            own = m["base"][np.minimum(u, n_head)]
            per_token = (u < n_head).astype(np.int64), own, m["step"][before, c] - m["below"][c] + own
            known, base, score = (np.add.reduceat(x, first) if len(u) else x for x in per_token)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), b.column(2), b.column(3)], names=["row", "n_tokens", "known", "base", "score", "rare_known", "rare_log"])

    coded = encoded.select("row", "codes", "rare_known", "rare_log") if far is None else far.met(texts.select("r", "row", "codes", "rare_known", "rare_log"))
    out = coded.mapInArrow(sum_up, f"{row_type}, n_tokens long, known long, base double, score double, rare_known long, rare_log double")
    log = F.coalesce("rare_log", F.lit(0.0))
    scored = out.select(
        F.col("row.doc_id").alias("doc_id"),
        (id_bucket(10, "row.doc_id") == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * float(np.log10(n_all + ADD * (n_words + 1)))).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
