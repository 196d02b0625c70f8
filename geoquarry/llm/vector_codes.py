"""Product codes for vectors, with codebooks refined by partial-distance search.

Vectors become integers and are cut into equal parts; each part position has a
codebook of a few entries.  The nearest entry of a part is found by partial
distances: dimensions are taken in descending variance of the codebook, and a
mask over all vectors of a batch drops those for which an entry's accumulated
distance strictly exceeds the best complete distance so far.  Everything is
integer arithmetic, so neither the batch nor the order of rows changes a result.

At scale: a round is one scan in which each task adds up counts and sums for
each (part, entry, position), a table of fixed size for each task, and one
partial aggregation of those rows.  Only the codebooks, whose size is fixed by
the parameters, are held by the driver and sent to the tasks.  Vectors are never
shuffled or written; the codes are written once, as they are read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from geoquarry.plans.staging import Staging

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest row of ``book`` for each row of ``x``; ties go to the lower index."""
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not x.size:
        return index, best
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    index = np.abs(x[:, order[0], None] - book[None, :, order[0]]).argmin(axis=1)  # a first guess, to have a complete distance
    best = ((x - book[index]) ** 2).sum(axis=1)
    for k in range(len(book)):
        rows = np.flatnonzero(index != k)
        sums = np.zeros(len(rows), np.int64)
        for j in order:
            sums += (x[rows, j] - book[k, j]) ** 2
            alive = sums <= best[rows]
            if not alive.all():
                rows, sums = rows[alive], sums[alive]
        closer = (sums < best[rows]) | (k < index[rows])
        rows, sums = rows[closer], sums[closer]
        index[rows], best[rows] = k, sums
    return index, best


def bound(dims: int) -> int:
    """The magnitude at which integers saturate, so that the squared distance of two vectors fits in 62 bits."""
    return 1 << ((62 - max(dims, 1).bit_length()) // 2 - 1)


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept and their integers, [kept, dims]: no row that is null or holds a null or non-finite component; short ones end in zeros."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    some = column.take(pa.array(there, pa.int64()))
    sizes = np.asarray(some.value_lengths(), dtype=np.int64) if len(there) else np.zeros(0, np.int64)
    values = np.asarray(some.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    row = np.repeat(np.arange(len(there)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fine = np.bincount(row[~np.isfinite(values)], minlength=len(there)) == 0
    out, top = np.zeros((len(there), dims), np.int64), bound(dims)
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, place] = np.nan_to_num(np.clip(np.floor(SCALE * values), -top, top)).astype(np.int64)
    return there[fine], out[fine]


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _statistics(vectors: DataFrame, vector: str, books: np.ndarray) -> DataFrame:
    """part, entry, place, n, total: a row for each task, of the parts that are nearest to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            _, x = integers(b.column(0), parts * width)
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                at, _ = nearest(mine, books[p])
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, mine)
        grid = np.indices(total.shape).reshape(3, -1)
        counts = np.repeat(n.reshape(-1), width)
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in (*grid, counts, total.reshape(-1))], names=["part", "entry", "place", "n", "total"])

    return vectors.select(vector).mapInArrow(run, "part long, entry long, place long, n long, total long")


def train(vectors: DataFrame, vec_id: str, vector: str, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks [part, entry, place] from all kept vectors, or None where there are none."""
    vectors = vectors.select(vec_id, F.col(vector).cast("array<double>").alias(vector))
    kept = _kept(vectors, vector)
    dims = kept.agg(F.max(F.size(vector))).first()[0]
    if dims is None:
        return None
    width = -(-dims // parts)
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).collect()
    _, x = integers(pa.array([r[1] for r in first], pa.list_(pa.float64())), parts * width)
    books = x.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        stats = _statistics(vectors, vector, books).groupBy("part", "entry", "place")
        for r in stats.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # parts x entries x width rows
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers of all entries in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str, vector: str, label: str, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each kept row: the nearest entry of each part in two hex digits, and the squared distances summed up."""
    parts, _, width = books.shape
    kinds = {f.name: f for f in vectors.schema.fields}
    schema = T.StructType([kinds[vec_id], kinds[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = integers(b.column(2), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            packed = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = reduce(np.add, [d for _, d in found])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([c.tobytes().hex() for c in packed], pa.string()), pa.array(error, pa.int64())], names=schema.names)

    return vectors.select(vec_id, label, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, code, error, label_error, codebooks_sha256 for each kept row.

    Component x is floor(4096 * x).  Rows whose vector is null or holds a null, NaN
    or infinite component have no row.  Codebooks start from the ``entries``
    smallest ids (ties by vector, null ids last; fewer rows give fewer entries) and
    are refined ``rounds`` times: each entry becomes the floor of the mean of its
    parts, an unused one stays.  ``label_error`` sums the errors of equal labels,
    nulls being one label.  Vectors of differing lengths, or of a length that the
    parts don't divide, count as ended with zeros; an empty vector is all zeros.
    Integers saturate where distances would leave 62 bits (``bound``: beyond
    2^27 for 64 components, |x| > 32,768).  At most 256 entries.  Repeated
    rows repeat, an empty table gives none, other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    books = train(vectors, vec_id, vector, parts, entries, rounds)
    sha = F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256")
    if books is None:
        return vectors.select(F.col(vec_id), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), sha).limit(0)
    coded = Staging(vectors.sparkSession, "codes").cut(encode(vectors, vec_id, vector, label, books).toDF("id", "mark", "code", "error"), "coded")
    sums = coded.groupBy(F.col("mark").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums.hint("merge"), F.col("mark").eqNullSafe(F.col("of"))).select(F.col("id").alias(vec_id), "code", "error", "label_error", sha)
