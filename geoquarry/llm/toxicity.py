"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character 3- to 5-grams (with word ends) and itself,
each hashed to a row of an embedding table; a text is the mean over its words;
a linear softmax over that mean gives the class.  Rows weigh by the evidence of
their n-grams; all are trained, jointly with the softmax, by Adam in numpy, on a bounded sample of labelled rows and in one Spark
task.  Words never seen in training are scored through the n-grams they share.

Because the softmax is linear in the mean, the trained table folds into one
logit for each n-gram; scoring is then a map over whole texts with that table
(fixed size) broadcast and the words' logits memoised in each worker.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from geoquarry.llm.words import whole

WORD = re.compile(r"\w+")
SHORT, LONG = 3, 5
BUCKETS, DIM = 1 << 17, 8
#: Labelled rows that the model is fitted on, at most: those whose id hashes lowest.
SAMPLE = 6000
#: Of the sample, one text in so many is held back to tell when to stop, which is after ``PATIENCE`` epochs without gain.
HELD_BACK, PATIENCE = 8, 4
#: Every row is trained, with a weight by the evidence of its n-gram: where its log odds of toxic against other texts
#: lie so many standard errors from zero, on either side, it is a half; ``SHARP`` is the power of the passage.
EVIDENCE, SHARP = 4.0, 6
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.03, 0.1
#: The mean is multiplied by this, as a few words among hundreds decide.
GAIN = 150.0
MEMO = 300_000


def ngrams(word: str) -> list[int]:
    """Rows of the embedding table for one word."""
    return sorted(_hashed(word))


def _hashed(word: str) -> set[int]:
    w = f"<{word}>"
    if w.isascii():  # bytes are characters, so parts need no encoding of their own
        w = w.encode()
        raw = {w}.union(*[[w[i : i + n] for i in range(len(w) - n + 1)] for n in range(SHORT, LONG + 1)])
        return {g % BUCKETS for g in map(crc32, raw)}
    raw = {w}
    for n in range(SHORT, LONG + 1):
        raw.update(w[i : i + n] for i in range(len(w) - n + 1))
    return {crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in raw}


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and weights of a text: each word spreads 1 / words over its n-grams."""
    counts = Counter(tokens(text))
    total, sums = sum(counts.values()), Counter()
    for w, c in counts.items():
        grams = ngrams(w)
        for g in grams:
            sums[g] += c / total / len(grams) * GAIN
    return np.fromiter(sums.keys(), np.int64, len(sums)), np.fromiter(sums.values(), np.float32, len(sums))


def dampers(bags: list, y: np.ndarray) -> np.ndarray:
    """Weight of each row of the table, in training as in scoring; rare n-grams would only memorise label noise at full weight."""
    texts = np.zeros((2, BUCKETS))
    for (rows, _), label in zip(bags, y, strict=True):
        texts[label][rows] += 1
    n = np.bincount(y, minlength=2)
    a = texts + 0.5
    odds = np.log(a / (n[:, None] - texts + 0.5))
    z = np.abs(odds[1] - odds[0]) / np.sqrt((1 / a).sum(0))
    return (z**SHARP / (z**SHARP + EVIDENCE**SHARP)).astype(np.float32)


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> np.ndarray:
    """As ``fit_bags``, from the texts themselves."""
    return fit_bags([bag(t) for t in texts], labels, seed)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> np.ndarray:
    """Logit of class 1 against 0 for each row of the table; the last entry is the bias.

    Without labels the logits are 0; with one class only the bias tells.
    """
    folded = np.zeros(BUCKETS + 1, np.float32)
    if len(set(labels)) < 2:
        folded[-1] = 0 if not labels else 3 if labels[0] else -3
        return folded
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    mixed = rng.permutation(len(y))
    told, taught = mixed[: len(y) // HELD_BACK], mixed[len(y) // HELD_BACK :]
    damp = dampers([bags[i] for i in taught], y[taught])
    kept = np.unique(np.concatenate([r for r, _ in bags]))  # rows that no text has stay at 0
    at = np.full(BUCKETS, -1)
    at[kept] = np.arange(len(kept))
    bags = [(at[r], w * damp[r]) for r, w in bags]
    best, best_loss, since = None, np.inf, 0
    table = rng.normal(0, 0.1, (len(kept), DIM)).astype(np.float32)
    top, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [table, top, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(taught)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            sizes = np.array([len(bags[i][0]) for i in pick])
            rows, weights = np.concatenate([bags[i][0] for i in pick]), np.concatenate([bags[i][1] for i in pick])
            text = np.repeat(np.arange(len(pick)), sizes)
            part = table[rows] * weights[:, None]
            mean = np.stack([np.bincount(text, part[:, d], len(pick)) for d in range(DIM)], 1)
            z = mean @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            up = (p @ top.T)[text] * weights[:, None]
            grads = (np.stack([np.bincount(rows, up[:, d], len(kept)) for d in range(DIM)], 1), mean.T @ p, p.sum(0))
            for (m, v), param, g in zip(moments, params, grads, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                param -= rate * m / (np.sqrt(v) + 1e-4)
            table *= 1 - rate * DECAY
        logit = table @ (top[:, 1] - top[:, 0])
        z = np.array([logit[bags[i][0]] @ bags[i][1] for i in told]) + (bias[1] - bias[0])
        loss = np.logaddexp(0, np.where(y[told] > 0, -z, z)).mean() if len(told) else -epoch
        since = since + 1 if loss >= best_loss else 0
        if not since:
            best, best_loss = (logit, bias[1] - bias[0]), loss
        elif since >= PATIENCE:
            break
    folded[kept] = best[0] * damp[kept]
    folded[-1] = best[1]
    return folded


class _Words(dict):
    """Logit of each word met: the mean over its n-grams."""

    def __init__(self, rows: list[float]):
        self.rows = rows

    def __missing__(self, w: str) -> float:
        grams = _hashed(w)
        found = math.fsum(map(self.rows.__getitem__, grams)) / len(grams)
        if len(self) > MEMO:
            self.clear()
        self[w] = found
        return found


class Scorer:
    """Probability of class 1 for a text, by the folded table."""

    def __init__(self, folded: np.ndarray):
        self.bias, self.memo = float(folded[-1]), _Words((folded[:-1].astype(np.float64) * GAIN).tolist())

    def __call__(self, text: str | None) -> float:
        words = tokens(text)
        z = self.bias + (sum(map(self.memo.__getitem__, words)) / len(words) if words else 0.0)
        return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most ``sample`` labelled rows that fulfil ``learn``, a condition on doc_id.

    Ids are chosen by lowest hash, so the choice neither follows row order nor
    changes between runs.  Null labels and labels without a text are left out; of
    labels that disagree on an id the larger holds; of repeated rows one counts.
    Texts become bags (of the table's size at most, however long they are) where
    they lie; the bags of the sample meet in one task, whose result is one table of fixed size.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [bag(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.astype(np.int32).tobytes() for r, _ in made], pa.binary()), pa.array([w.tobytes() for _, w in made], pa.binary()), b.column(2)], names=["doc_id", "rows", "weights", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ys = [], []
        for b in batches:
            for r, w, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                made.append((np.frombuffer(r, np.int32).astype(np.int64), np.frombuffer(w, np.float32)))
                ys.append(int(y > 0))
        yield pa.RecordBatch.from_arrays([pa.array([fit_bags(made, ys).tobytes()], pa.binary())], names=["model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bagged = rows.select("doc_id", "text", "toxic").mapInArrow(bags, f"doc_id {kind}, rows binary, weights binary, toxic int")
    one = bagged.repartition(1).sortWithinPartitions("doc_id").select("rows", "weights", "toxic").mapInArrow(run, "model binary")
    made = one.first()  # without labelled texts there is no task
    return np.frombuffer(made["model"], np.float32) if made else fit([], [])


def score(docs: DataFrame, model: np.ndarray, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and ``name`` (0 to 1) of each row's whole text; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(got, pa.float64())], names=[*keep, name])

    schema = T.StructType([kinds[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return docs.select(*keep, whole()).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, whatever their names."""
    name = "toxic_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, tuple(docs.columns), name).where(F.col(name) < threshold).drop(name)
