"""Near duplicates by b-bit MinHash.

Each set of word shingles gets 128 minima.  Full minima form 32 band keys of 4
rows; what is retained of a minimum for comparing is its low 2 bits, packed 32
to a long.  Sets that meet in a band are compared by counting equal bit pairs,
corrected for chance (a quarter of unequal minima agree in 2 bits); pairs
whose estimate could belong to a similarity of the threshold are confirmed on
their full shingle sets.  A pair at similarity 0.8 misses all 32 bands with a
chance of 5e-8, and falls below the estimate's margin with one of about 1e-7.

Groups of any size stay linear where they can: equal sets are one node; a
bucket of at most ``ALL_PAIRS`` sets compares them all; a larger one compares
its sets with one hub (another in each bucket, by hash), and leaves as soon as its
sets are one component.  Of a bucket that is not, the sets outside its largest
component are compared with all, once the pairs across components are at most
``LINEAR`` for each set; until then a growing sample of hubs (1, 4, 16, ... by hash)
is compared with all, at last every set.  So one side of each join has the few
sets in question and not the bucket.  A pair is handed on from the first band
that it shares, and only if its estimate and an exact bound allow: two sets differ
by at least as many shingles as their 512-bit maps (a bit a shingle, by hash)
differ by bits.  No group is capped; apart from the two chances above, no link is
lost.  Joins of tables that grow with the input are merge joins of plain tables,
which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from geoquarry.llm.words import whole
from geoquarry.operators.components import components
from geoquarry.plans.staging import Staging

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
#: Bits of the map that bounds how near two sets can be.
MAP = 512
ALL_PAIRS = 16
LINEAR = 4096
#: Standard deviations of the estimate that a pair may lie below the threshold.
MARGIN = 5.5
BLOCK = 1 << 16

_GEN = np.random.default_rng(20240229)
_MUL = _GEN.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _GEN.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_WEIGHT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it has fewer words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(k, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        s = s * _WEIGHT + h[j : len(h) - width + 1 + j]
    return np.unique(_mix(s))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (n, 4) and band keys (n, 32) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    mins = np.empty((len(sets), HASHES), np.uint64)
    for i in range(HASHES):
        mins[:, i] = np.minimum.reduceat(flat * _MUL[i] + _ADD[i], at)
    low = _mix(mins) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per) * BITS).astype(np.uint64)
    packed = np.bitwise_or.reduce(low.reshape(len(sets), -1, per) << shifts, axis=2)
    rows = mins.reshape(len(sets), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key * _WEIGHT + rows[:, :, r])
    return packed, key


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bit for each shingle, at its hash modulo ``MAP``: (n, MAP / 64)."""
    on = np.zeros((len(sets), MAP), np.uint8)
    for row, s in zip(on, sets, strict=True):
        row[(s % np.uint64(MAP)).astype(np.int64)] = 1
    return np.packbits(on, axis=1).view(np.uint64)


SIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    + [T.StructField(f"s{i}", T.LongType()) for i in range(HASHES * BITS // 64)]
    + [T.StructField(f"m{i}", T.LongType()) for i in range(MAP // 64)]
    + [T.StructField("bands", T.ArrayType(T.LongType()))]
)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64), pa.int64())


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (print of the text), n (set size), digest of the set (null if empty), packed bits s0.., map m0.., band keys: one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, texts = batch.columns
            lo, sets, size = 0, [], 0
            for i in range(len(ids)):
                sets.append(shingle_set(texts[i].as_py(), k))
                size += len(sets[-1])
                if size >= BLOCK or i == len(ids) - 1:
                    yield out(ids.slice(lo, len(sets)), prints.slice(lo, len(sets)), sets)
                    lo, sets, size = i + 1, [], 0

    def out(ids: pa.Array, prints: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = np.array([len(s) > 0 for s in sets])
        packed, bands = np.zeros((len(sets), HASHES * BITS // 64), np.uint64), np.zeros((0, BANDS), np.uint64)
        if full.any():
            packed[full], bands = signatures([s for s in sets if len(s)])
        maps = bitmaps(sets)
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), _longs(bands.ravel()))
        return pa.RecordBatch.from_arrays(
            [ids, prints, pa.array([len(s) for s in sets], pa.int64()), digests, *[_longs(packed[:, i]) for i in range(packed.shape[1])], *[_longs(maps[:, i]) for i in range(maps.shape[1])], lists],
            names=SIGNED.names,
        )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole()), whole()).mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest, shingles (array of hashes) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                sets = [shingle_set(t.as_py(), k) for t in texts.slice(lo, 256)]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), digests, pa.ListArray.from_arrays(pa.array(offsets), _longs(np.concatenate(sets)))], names=["doc_id", "digest", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), whole()).mapInArrow(run, "doc_id long, digest binary, shingles array<long>")


def agreeing(left: str, right: str) -> Column:
    """How many of the minima agree in their retained bits."""
    unequal = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        unequal = unequal + F.bit_count(pairs)
    return F.lit(HASHES) - unequal


def estimate(left: str, right: str) -> Column:
    """Similarity from bit counts, corrected for pairs of bits that agree by chance."""
    chance = 2.0**-BITS
    return (agreeing(left, right) / HASHES - chance) / (1 - chance)


def most_common(left: str, right: str) -> Column:
    """At least twice as many shingles as two sets can have in common, from their sizes and maps."""
    apart = F.lit(0)
    for i in range(MAP // 64):
        apart = apart + F.bit_count(F.col(f"{left}.m{i}").bitwiseXOR(F.col(f"{right}.m{i}")))
    return F.col(f"{left}.n") + F.col(f"{right}.n") - apart


def least_estimate(threshold: float) -> float:
    p = 2.0**-BITS + (1 - 2.0**-BITS) * threshold
    return threshold - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def met_before(left: str, right: str) -> Column:
    """Whether two sets share a band before the one in which they meet here, by 32-bit prints of the keys."""
    same = F.lit(False)
    for i in range(BANDS // 2):
        x = F.col(f"{left}.p{i}").bitwiseXOR(F.col(f"{right}.p{i}"))
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)) == 0, F.shiftrightunsigned(x, 32) == 0
        same = same | (low & (F.col(f"{left}.no") > 2 * i)) | (high & (F.col(f"{left}.no") > 2 * i + 1))
    return same


def _hub(level: int) -> Column:
    """Whether a set is among its bucket's hubs once 2**level are drawn (of a bucket of 2**height)."""
    left_over = F.greatest(F.col("height") - level, F.lit(0))
    return F.xxhash64("sid").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), left_over) - 1) == 0


def near_components(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked when intersection / union of their shingle sets is at
    least ``threshold``; component_id is the smallest doc_id reachable by links,
    itself included; kept where that is its own.  Null, empty and all-white texts
    have empty sets and are linked with nothing.  Rows that repeat a doc_id are
    linked by their own texts.  A row with a null doc_id can stand for no
    component: its links hold, and alone it has a null component and is kept.
    A doc_id that is no integer is an error.  An empty table gives no rows; other
    columns are not read.
    """
    out = _labelled(docs, k, threshold)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _labelled(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, fp, n, component (an id of its own; null without words), component_id of each row."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    staging = Staging(docs.sparkSession, "minhash")
    bits = [f"s{i}" for i in range(HASHES * BITS // 64)] + [f"m{i}" for i in range(MAP // 64)]
    pct = round(100 * threshold)
    signed = staging.cut(sign(docs, k), "signed")
    held = F.min_by(F.struct("n", *bits, "bands"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    sets = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), held.alias("x"))
    sets = staging.cut(sets.select(F.monotonically_increasing_id().alias("sid"), "digest", "doc_id", "x.*"), "sets")

    band = sets.select("sid", F.posexplode("bands").alias("no", "key"))
    prints = [f"p{i}" for i in range(BANDS // 2)]
    two = [F.shiftrightunsigned(F.col("bands")[2 * i], 32).bitwiseOR(F.col("bands")[2 * i + 1].bitwiseAND(F.lit(-(1 << 32)))).alias(f"p{i}") for i in range(BANDS // 2)]
    live = staging.cut(band.groupBy("key").count().where("count > 1"), "live")
    members = staging.cut(
        band.join(live.hint("merge"), "key").join(sets.select("sid", "n", *bits, *two).hint("merge"), "sid").withColumn("height", F.ceil(F.log2("count")).cast("int")),
        "members",
    )
    staging.drop(live)

    in_bucket = members.select("sid").distinct()
    wanted = sets.join(in_bucket.hint("merge"), "sid").select("sid", F.col("digest").alias("d2"), F.col("doc_id").alias("id2"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hosts = texts.join(wanted.select("id2").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("id2")), "left_semi")
    found = full_sets(hosts, k)
    full = found.join(wanted.hint("merge"), found["digest"] == wanted["d2"]).select("sid", "shingles").dropDuplicates(["sid"])
    full = staging.cut(full, "full")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = staging.cut(pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct(), "pairs")
        left = full.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
        right = full.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        link = 100 * both >= pct * (F.size("sa") + F.size("sb") - both)
        return staging.cut(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(link).select("a", "b"), "edges")

    x, y = members.alias("x"), members.alias("y")
    similar = (
        (F.col("x.key") == F.col("y.key"))
        & (100 * F.least("x.n", "y.n") >= pct * F.greatest("x.n", "y.n"))
        & (estimate("x", "y") >= least_estimate(threshold))
        & ((100 + pct) * most_common("x", "y") >= 2 * pct * (F.col("x.n") + F.col("y.n")))
    )
    large = members.where(F.col("count") > ALL_PAIRS)
    lead = staging.cut(large.groupBy("key").agg(F.min_by("sid", F.xxhash64("key", "sid")).alias("first")), "lead")
    hubs = staging.cut(large.join(lead.withColumnRenamed("key", "k").hint("merge"), (F.col("key") == F.col("k")) & (F.col("sid") == F.col("first"))).drop("k", "first"), "hubs")
    few = x.where(F.col("x.count") <= ALL_PAIRS).join(y.hint("merge"), similar & (F.col("x.sid") < F.col("y.sid"))).select("x.sid", "y.sid")
    stars = hubs.alias("x").join(y.hint("merge"), similar & (F.col("x.sid") != F.col("y.sid"))).select("x.sid", "y.sid")
    edges = confirmed(_named(few).unionByName(_named(stars)))
    labels = components(edges, staging)
    open_, level = large, 0
    while True:
        split = open_.join(labels.withColumnRenamed("id", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        split = staging.cut(split, "split")
        parts = split.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
        parts = parts.groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("component", F.struct("c", "component")).alias("main"))
        across = (F.col("all") * F.col("all") - F.col("squares")) / 2
        apart = staging.cut(parts.where(across > 0).select("key", "main", (across <= LINEAR * F.col("all")).alias("finish")), "apart")
        split = staging.cut(split.join(apart.hint("merge"), "key").select("key", "no", "sid", "n", *bits, *prints, "height", "finish", "component", "main"), "open")
        asked = staging.cut(split.where(F.when(F.col("finish"), F.col("component") != F.col("main")).otherwise(_hub(level))), "asked")
        more = asked.alias("x").join(split.alias("y").hint("merge"), similar & (F.col("x.component") != F.col("y.component")) & ~met_before("x", "y"))
        more = staging.cut(more.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct(), "more")
        if more.limit(1).count():
            labels = joined(labels, confirmed(_named(more)), staging)
        open_ = split.where(~F.col("finish") & (F.col("height") > level)).drop("finish", "component", "main")
        if open_.limit(1).count() == 0:
            break
        level += 2

    of_set = sets.select("sid", "digest", "doc_id").join(labels.withColumnRenamed("id", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    of_set = staging.cut(of_set, "of_set")
    first = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staging.cut(of_set.join(first.hint("merge"), "component").select("digest", "component", "component_id"), "named")
    out = signed.select("doc_id", "fp", "n", "digest").join(named.hint("merge"), "digest", "left")
    return out.select("doc_id", "fp", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def joined(labels: DataFrame, added: DataFrame, staging: Staging) -> DataFrame:
    """``labels`` (id, component) after more links: only components are nodes of the graph that is searched."""
    at = labels.withColumnRenamed("component", "c")
    ends = added.join(at.select(F.col("id").alias("a"), F.col("c").alias("ca")).hint("merge"), "a", "left").join(at.select(F.col("id").alias("b"), F.col("c").alias("cb")).hint("merge"), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    up = components(ends, staging).select(F.col("id").alias("c"), F.col("component").alias("top"))
    old = at.join(up.hint("merge"), "c", "left").select("id", F.coalesce("top", "c").alias("component"))
    new = up.select(F.col("c").alias("id"), F.col("top").alias("component"))  # nodes that had no links before
    return staging.cut(old.union(new).groupBy("id").agg(F.min("component").alias("component")), "labels")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.toDF("a", "b").select(F.struct(F.col("a").alias("sid")).alias("x"), F.struct(F.col("b").alias("sid")).alias("y"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the smallest doc_id, then the smallest print of the text.

    A row is known by its id and its text, so rows that repeat an id are judged by
    their own texts; of rows equal in both, one stays.  Texts without words,
    nulls included, are in no component and stay.  A null id comes last.  All
    columns stay, whatever their names; an empty table stays empty.
    """
    staging = Staging(docs.sparkSession, "minhash")
    rows = staging.cut(_labelled(docs, k, threshold), "labelled")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    stay = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(at).alias("at")).select("at.doc_id", "at.fp")
    stay = stay.union(rows.where("component IS NULL").select("doc_id", "fp")).select(F.struct("doc_id", "fp").alias("row"))
    name = "row"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("fp")))
    kept = keyed.join(staging.cut(stay.withColumnRenamed("row", name).distinct(), "stay").hint("merge"), name, "left_semi")
    return kept.dropDuplicates([name]).select(*docs.columns)
