"""Exchange clustering of word units into classes, for class bigrams.

The objective is that of Brown clusters: the log likelihood of the class bigrams,
the sum of N(c, d) log N(c, d) less both margins'.  A unit (a word, or a family
of rare ones) moves to the class where the objective rises most, its own counts
taken out of its present class first.  Half of the units move at a time, as
neighbours that move together would miss each other; for each half the counts
of neighbours' classes are fresh.  Moves that together don't raise the objective
are taken back, and from then on fewer units move at a time.  The search ends when
a turn of all units brings less than ``LEAST_GAIN``, or after as many sweeps as the
caller allows, a bound on the time that is not the optimum's.

At scale: a task counts how often units stand beside classes, packs the counts by
parts of the units, a shuffle brings equal parts together, and each part's units
move where they lie, from their sparse counts.  The driver holds the table of class
pairs and one byte for each unit, its class, which is broadcast.  Units beyond a
fixed number of these are ``Far``: their classes are a table, which joins bring to
the texts, and no driver or task holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoquarry.plans.staging import Staging

#: Training tokens for each part of the units, and counts that a task packs at once.
PART, PACK = 1_000_000, 1_000_000
#: Counts of which a task makes the table of all their gains at once.
DENSE = 1 << 14
#: Counts below this have their gains in tables.
SMALL = 64
#: A round must raise the objective by this share of the tokens to be followed by another.
LEAST_GAIN = 1e-4
COUNTS = "part long, keys binary, counts binary"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All int32 values of a column of packed lists, and where each list starts (and the last ends)."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.int32, (at[-1] - at[0]) // 4, at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.int32)
    return values, (at - at[0]) // 4


def classes_at(codes: np.ndarray, near: np.ndarray, far: pa.Array | None) -> np.ndarray:
    """Classes of word codes: of the first ones by ``near``, of the others in order as ``Far.met`` has brought them."""
    if far is None:
        return near[codes]
    out = near[np.minimum(codes, len(near) - 1)]
    out[codes >= len(near)] = far.flatten().to_numpy()
    return out


def _coded(b: pa.RecordBatch, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch of texts, where each text starts, and their classes."""
    codes, starts = flat(b.column(0))
    return codes, starts, classes_at(codes, near, b.column(1) if b.num_columns > 1 else None)


class Far:
    """Units from ``near`` on, whose classes are a table (code, class) instead of broadcast; ``rows`` are all texts as r, codes."""

    def __init__(self, rows: DataFrame, near: int, n_units: int, k: int, staging: Staging):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, starts = flat(b.column(1))
                at = np.flatnonzero(codes >= near)
                row = np.repeat(b.column(0).to_numpy(), np.diff(starts))[at]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(codes[at], pa.int64())], names=["r", "i", "code"])

        self.near, self.staging = near, staging
        self.places = staging.cut(rows.select("r", "codes").mapInArrow(run, "r long, i long, code long"), "far-places")  # i rises within a row
        first = rows.sparkSession.range(near, n_units)
        self.classes = staging.cut(first.select(F.col("id").alias("code"), (F.col("id") % k).cast("int").alias("class")), "far")

    def met(self, rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
        """``rows`` with a column ``far`` in place of r: the classes of their far codes in order, null without any."""
        classes = self.classes if classes is None else classes
        found = self.places.join(classes.hint("merge"), "code").groupBy("r").agg(F.sort_array(F.collect_list(F.struct("i", "class"))).alias("got"))
        return rows.join(found.hint("merge"), "r", "left").select(*[c for c in rows.columns if c != "r"], F.col("got.class").alias("far"))

    def after(self, went: DataFrame) -> DataFrame:
        """Classes once the units of ``went`` (packed units and classes) have moved."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for u, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(u, np.int64)), pa.array(np.frombuffer(c, np.uint8), pa.int32())], names=["code", "to"])

        to = went.mapInArrow(run, "code long, to int")
        return self.staging.cut(self.classes.join(to.hint("merge"), "code", "left").select("code", F.coalesce("to", "class").alias("class")), "far")


def pair_counts(encoded: DataFrame, class_of, k: int) -> np.ndarray:
    """(k + 1, k): how often a class follows a class, or a text's start (the last row); partial sums, then k * (k + 1) numbers to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k, np.int64)
        for b in batches:
            _, starts, c = _coded(b, class_of.value)
            c = c.astype(np.int64)
            before = np.concatenate([[k], c[:-1]])[: len(c)]
            before[starts[:-1][starts[:-1] < len(c)]] = k
            total += np.bincount(before * k + c, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    rows = encoded.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    class_of.destroy()
    out = np.zeros((k + 1) * k, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k + 1, k)


def _f(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1.0))


def objective(pairs: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what no clustering changes."""
    n = pairs.astype(np.float64)
    return float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _packed(part: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A record of sorted keys, as steps of four bytes where they fit (else of eight), and counts of four bytes."""
    steps = np.diff(at, prepend=0)
    small = steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([small.tobytes()], pa.binary()), pa.array([n.astype(np.uint32).tobytes()], pa.binary())], names=["part", "keys", "counts"])


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.uint32 if len(keys) == len(counts) else np.int64
    return np.cumsum(np.frombuffer(keys, kind), dtype=np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)


def beside(encoded: DataFrame, class_of, unit_head, k: int, parts: int, turn: int, turns: int) -> DataFrame:
    """part, keys, counts: of units that are ``turn`` modulo ``turns``, unit * 2k + class before it, or + k + class behind it, and how often; packed by each task.

    With far units a unit has 3k keys, the last k for its own class, which its part cannot look up.
    """
    width = 2 * k if len(encoded.columns) == 1 else 3 * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, head = class_of.value, unit_head.value
        keys, held = [], 0

        def pack():
            found = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            at, n = found[first], np.diff(np.append(first, len(found)))
            part = (at // (width * turns) % parts).astype(np.min_scalar_type(parts))  # narrow numbers sort by radix
            order = np.argsort(part, kind="stable")
            at, n, part = at[order], n[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for i, j in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
                yield _packed(int(part[i]), at[i:j], n[i:j])

        for b in batches:
            codes, starts, c = _coded(b, of)
            if len(codes) < 2:
                continue
            u = codes
            if len(head):
                u = codes.copy()
                np.copyto(u, head[np.minimum(codes, len(head) - 1)], where=codes < len(head), casting="same_kind")
            follows = np.ones(len(u), bool)  # a word that starts a text has none before it
            follows[starts[:-1]] = False
            mine = u % turns == turn
            second, first = follows[1:] & mine[1:], follows[1:] & mine[:-1]
            keys.append(u[1:][second].astype(np.int64) * width + c[:-1][second])
            keys.append(u[:-1][first].astype(np.int64) * width + (c[1:][first].astype(np.int64) + k))
            held += len(keys[-2]) + len(keys[-1])
            if width > 2 * k:
                own = u.astype(np.int64) * width + (c.astype(np.int64) + 2 * k)
                keys += [own[1:][second], own[:-1][first]]
                held += len(keys[-2]) + len(keys[-1])
            if held > PACK:
                yield from pack()
                keys, held = [], 0
        if held:
            yield from pack()

    return encoded.mapInArrow(run, COUNTS)


def _where(out: np.ndarray, cells: np.ndarray, row: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> None:
    """Adds F(x + plus - minus) + F(x) - F(x + plus) - F(x - minus) of the rows' cells where both counts are there (else it is 0)."""
    f = lambda x: _f(np.maximum(x, 0))
    some = np.flatnonzero(plus > 0)
    i, j = np.nonzero(minus[some] > 0)
    i = some[i]
    x, p, m = cells[row[i], j], plus[i], minus[i, j]
    out[i, j] += f(x + p - m) + f(x) - f(x + p) - f(x - m)


def _shared_cells(pairs: np.ndarray, owner: np.ndarray, behind: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """What the gains summed slot by slot lack, where a move changes one pair of classes by two slots."""
    f, out, line = lambda x: _f(np.maximum(x, 0)), np.zeros_like(behind), np.arange(len(owner))
    b, a, own = behind[line, owner], ahead[line, owner], np.diag(pairs)[owner]
    _where(out, pairs, owner, b, ahead)
    _where(out, pairs.T, owner, a, behind)
    at = np.nonzero((behind > 0) & (ahead > 0))
    d, x, y = np.diag(pairs)[at[1]], behind[at], ahead[at]
    out[at] += f(d + x + y) - f(d + x) - f(d + y) + f(d)
    out[line, owner] = f(own - b) + f(own - a) - f(own - b - a) - f(own)
    return out


class Gains:
    """What the objective gains by adding a count to a row of numbers, or loses by taking it away; small counts by tables."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.have = rows, _f(rows)
        n = np.arange(SMALL, dtype=np.float64)[:, None, None]
        self.more, self.less = _f(rows[None] + n) - self.have[None], self.have[None] - _f(np.maximum(rows[None] - n, 0))

    def added(self, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each (row, count), the gain in every column."""
        out = self.more[np.minimum(n, SMALL - 1), row]
        big = np.flatnonzero(n >= SMALL)
        out[big] = _f(self.rows[row[big]] + n[big, None]) - self.have[row[big]]
        return out

    def of(self, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A table of the gains in every column, and for each (row, count) its line there."""
        big = np.flatnonzero(n >= SMALL)
        at = np.minimum(n, SMALL - 1) * len(self.rows) + row
        at[big] = SMALL * len(self.rows) + np.arange(len(big))
        return np.concatenate([self.more.reshape(-1, self.rows.shape[1]), self.added(row[big], n[big])]), at

    def taken(self, row: np.ndarray, column: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each (row, column, count), what that column loses."""
        out = self.less[np.minimum(n, SMALL - 1), row, column]
        big = np.flatnonzero(n >= SMALL)
        at = row[big], column[big]
        out[big] = self.have[at] - _f(np.maximum(self.rows[at] - n[big], 0))
        return out


def _summed(table: np.ndarray, at: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range of ``at`` the sum of those lines of the table; the n-th lines of all ranges are added together."""
    length = ends - first
    order = np.argsort(-length, kind="stable")
    out, begin, more = np.zeros((len(first), table.shape[1])), first[order], np.cumsum(np.bincount(length)[::-1])[::-1]
    for i, c in enumerate(more[1:]):  # so many ranges are longer than i
        out[:c] += table[at[begin[:c] + i]]
    back = np.empty_like(out)
    back[order] = out
    return back


def best_classes(at: np.ndarray, n: np.ndarray, of: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of the keys ``at``, and for each the class under which the objective is largest; a unit stays unless another is better."""
    k, pairs = len(pairs), pairs.astype(np.float64)
    cells = Gains(np.concatenate([pairs, pairs.T]))  # by class before a unit, then by class behind it
    margins = Gains(np.stack([pairs.sum(0), pairs.sum(1)]))
    unit, slot = at // (2 * k), at % (2 * k)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    ends, units, best = np.append(first[1:], len(unit)), unit[first], np.empty(len(first), np.uint8)
    table, line_of = cells.of(slot, n)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + DENSE, "right")))
        i, j = first[lo], ends[hi - 1]
        s, m, owner, line = slot[i:j], n[i:j], of[units[lo:hi]].astype(np.int64), np.arange(hi - lo)
        unit_of = np.repeat(line, ends[lo:hi] - first[lo:hi])
        gain = _summed(table, line_of[i:j], first[lo:hi] - i, ends[lo:hi] - i)
        gain[line, owner] = np.bincount(unit_of, cells.taken(s, owner[unit_of], m), hi - lo)
        dense = np.zeros((hi - lo, 2 * k))
        dense[unit_of, s] = m
        gain += _shared_cells(pairs, owner, dense[:, :k], dense[:, k:])
        for row, count in ((0, dense[:, :k].sum(1)), (1, dense[:, k:].sum(1))):
            rows, count = np.full(hi - lo, row), count.astype(np.int64)
            loss = margins.added(rows, count)
            loss[line, owner] = margins.taken(rows, owner, count)
            gain -= loss
        top = gain.argmax(1)
        best[lo:hi] = np.where(gain[line, top] > gain[line, owner] + 1e-9, top, owner)
        lo = hi
    return units, best


def _told_classes(at: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_classes`` of keys that tell the units' own classes, and these classes."""
    k = len(pairs)
    unit, slot = at // (3 * k), at % (3 * k)
    told = slot >= 2 * k
    units, own = unit[told], (slot[told] - 2 * k).astype(np.uint8)  # each unit is told one class, in order of units
    local, best = best_classes(np.searchsorted(units, unit[~told]) * (2 * k) + slot[~told], n[~told], own, pairs)
    return units[local], best, own[local]


def moved(encoded: DataFrame, class_of: np.ndarray, unit_head, pairs: np.ndarray, turn: int, turns: int, parts: int, far: Far | None = None) -> tuple[np.ndarray, DataFrame | None]:
    """Classes of all units after those that are ``turn`` modulo ``turns`` went where each does best; codes and classes of the movers come back, those of far units as a table."""
    k, spark = len(pairs), encoded.sparkSession.sparkContext
    shared, near = spark.broadcast(class_of), len(class_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts = None, [], []

        def done():
            at, n = _added(keys, counts)
            if far_units:
                units, best, own = _told_classes(at, n, pairs)
            else:
                units, best = best_classes(at, n, shared.value, pairs)
                own = shared.value[units]
            kinds = [(best != own) & (units < near), (best != own) & (units >= near)]
            packed = [[x[go].tobytes() for go in kinds] for x in (units, best)]
            return pa.RecordBatch.from_arrays([pa.array([False, True]), *[pa.array(x, pa.binary()) for x in packed]], names=["far", "units", "classes"])

        for b in batches:
            for p, x, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part is not None and p != part:
                    yield done()
                    keys, counts = [], []
                part = p
                at, n = _unpacked(x, y)
                keys.append(at)
                counts.append(n)
                if len(keys) > 16:
                    one = _added(keys, counts)
                    keys, counts = [one[0]], [one[1]]
        if part is not None:
            yield done()

    far_units = far is not None
    packed = beside(encoded, shared, unit_head, k, parts, turn, turns).repartition(parts, "part").sortWithinPartitions("part")
    went, tail = packed.mapInArrow(run, "far boolean, units binary, classes binary"), None
    if far_units:
        went = far.staging.cut(went, "went")
        tail = far.after(went.where("far").select("units", "classes"))
    out = class_of.copy()
    for r in went.where("NOT far").toLocalIterator():
        out[np.frombuffer(r["units"], np.int64)] = np.frombuffer(r["classes"], np.uint8)
    shared.destroy()
    if far_units:
        far.staging.drop(went)
    return out, tail


def cluster(encoded: DataFrame, unit_head: np.ndarray, n_units: int, n_tokens: int, classes: int, sweeps: int, far: Far | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each word code, class bigram counts with the text start as an extra row, and the objective at first and after each kept step.

    ``encoded`` has the word codes of each training text as packed int32;
    ``unit_head`` maps the first codes to units, all others are units themselves.  With
    ``far`` the classes returned are those of the codes below ``far.near``; the
    others' are in ``far.classes``, and ``encoded`` has r beside the codes.
    """
    k, spark = classes, encoded.sparkSession.sparkContext
    if k > 256:
        raise ValueError("a class is one byte")
    parts, staging = 1 + n_tokens // PART, Staging(encoded.sparkSession, "exchange")
    own_units = (unit_head == np.arange(len(unit_head))).all()
    heads = spark.broadcast(unit_head[: 0 if own_units else None].astype(np.int32))

    def spread(class_of: np.ndarray) -> np.ndarray:
        """Head words that are no units have their family's class."""
        class_of[: len(unit_head)] = class_of[unit_head]
        return class_of

    class_of = spread((np.arange(n_units if far is None else far.near) % k).astype(np.uint8))  # round robin by rank: every class starts with words of all frequencies
    texts = encoded if far is None else staging.cut(far.met(encoded), "texts")
    pairs = pair_counts(texts, spark.broadcast(class_of), k)
    history, idle, turns = [objective(pairs[:k])], 0, 2
    for step in range(2 * sweeps):
        tried, tail = moved(texts, class_of, heads, pairs[:k], step % turns, turns, parts, far)
        tried = spread(tried)
        seen = texts if far is None else staging.cut(far.met(encoded, tail), "texts")
        new = pair_counts(seen, spark.broadcast(tried), k)
        up = objective(new[:k]) - history[-1]
        if up > 0:
            class_of, pairs = tried, new
            history.append(history[-1] + up)
        else:
            turns = min(2 * turns, 16)
        if far is not None:
            kept = (seen, tail) if up > 0 else (texts, far.classes)
            staging.drop(*((texts, far.classes) if up > 0 else (seen, tail)))
            texts, far.classes = kept
        idle = 0 if up > LEAST_GAIN * n_tokens else idle + 1
        staging.release()  # the step's counts
        if idle == turns:
            break
    heads.destroy()
    if far is not None:
        staging.drop(texts)
    return class_of, pairs, history
