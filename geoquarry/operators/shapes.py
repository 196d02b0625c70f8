"""Iterative geometry over rows: numpy helpers behind Arrow-batched pandas UDFs.

A line or ring is an array of ``[lon, lat]``.  Null gives null.  Each row is
worked alone, so Spark partitions the work and no geometry meets another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

EARTH_RADIUS = 6371000.0
POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))


def _points(g) -> np.ndarray | None:
    """Positions of one row as an (n, 2) array; null for none."""
    return None if g is None or len(g) == 0 else np.array([np.asarray(p, float)[:2] for p in g])


def _each(rows, f) -> pd.Series:
    """``f`` over the positions (and further values) of each row; null gives null."""
    out = []
    for g, *more in rows:
        pts = _points(g)
        got = None if pts is None else f(pts, *more)
        out.append(None if got is None else [[float(x), float(y)] for x, y in got])
    return pd.Series(out)


def metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle metres between positions, by broadcasting."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 1] - a[..., 1]) / 2) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin((b[..., 0] - a[..., 0]) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def off_base(pts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Metres of the positions between ``a`` and ``b`` from the line through those two: the height of a triangle of three great-circle sides.

    Where the two are one place, as the ends of a ring, there is no such line: the distances are those from the place.
    """
    inner, base = pts[a + 1 : b], float(metres(pts[a], pts[b]))
    left, right = metres(pts[a], inner), metres(pts[b], inner)
    half = (base + left + right) / 2
    return 2 * np.sqrt(np.maximum(half * (half - base) * (half - left) * (half - right), 0)) / base if base else left


def simplified(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker by ``off_base``.  A closed ring stays closed."""
    keep, todo = np.zeros(len(pts), bool), [(0, len(pts) - 1)] if tolerance > 0 else []
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        off = off_base(pts, a, b)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return pts[keep] if tolerance > 0 else pts


#: Positions whose lines are split together; a line is never cut, so a longer one only comes with fewer others.
TOGETHER = 500_000


def significances(pts: np.ndarray, sizes: np.ndarray, least: np.ndarray, unknown: float = np.inf) -> np.ndarray:
    """For each position of many lines, one behind the other, the tolerance below which simplification keeps it; ends stay at any.

    All lines are split level by level at once, so a level costs a few array
    operations and not some for each line.  Splits that a line's ``least``
    tolerance doesn't make are not followed: what lies there has 0.  Positions
    that are no numbers lie ``unknown`` metres off; NaN ends the split.
    """
    ends, out = np.cumsum(sizes), np.zeros(len(pts))
    lon, lat = np.radians(pts[:, 0]), np.radians(pts[:, 1])
    cos = np.cos(lat)

    def apart(i, j):
        h = np.sin((lat[j] - lat[i]) / 2) ** 2 + cos[i] * cos[j] * np.sin((lon[j] - lon[i]) / 2) ** 2
        return 2 * EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    def split(a, b, cap, floor):
        """Splits of one level, and the segments that they leave."""
        n = b - a - 1
        start, of = np.cumsum(n) - n, np.repeat(np.arange(len(a)), n)
        at = np.arange(len(of)) - start[of] + a[of] + 1
        base, left, right = apart(a, b)[of], apart(a[of], at), apart(b[of], at)
        half = (base + left + right) / 2
        height = 2 * np.sqrt(np.maximum(half * (half - base) * (half - left) * (half - right), 0))
        off = np.where(base == 0, left, np.divide(height, base, out=height, where=base != 0))
        off[np.isnan(off)] = unknown
        top = np.maximum.reduceat(off, start)
        hits = np.flatnonzero(off == top[of])
        hits = hits[np.diff(of[hits], prepend=-1) > 0]  # the first of equals
        s = of[hits]
        held = np.minimum(cap[s], top[s])  # a vertex stays only if the splits above it are made
        made = held > floor[s]
        k, s, held = at[hits[made]], s[made], held[made]
        out[k] = held
        return np.concatenate([a[s], k]), np.concatenate([k, b[s]]), np.concatenate([held, held]), np.concatenate([floor[s], floor[s]])

    for lines in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // TOGETHER)) + 1):
        lines = lines[sizes[lines] > 0]
        a, b, floor = ends[lines] - sizes[lines], ends[lines] - 1, least[lines]
        out[a] = out[b] = cap = np.full(len(a), np.inf)
        while (inner := b - a > 1).any():
            a, b, cap, floor = split(a[inner], b[inner], cap[inner], floor[inner])
    return out


def lengths(lists: pa.Array) -> np.ndarray:
    """Items of each list, 0 of null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def listed(items: pa.Array, sizes: np.ndarray, null: pa.Array) -> pa.Array:
    """Lists of ``sizes`` items each, or null."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items, mask=null)


def drawn(pts: np.ndarray, tolerance: float) -> np.ndarray | None:
    """A ring fit for drawing: finite, without adjacent repeats, closed; null below three corners.

    With a tolerance, corners that lie that near to the line between their
    neighbours go, round after round, but never the outermost ones nor the last three.
    """
    pts = pts[np.isfinite(pts).all(1)]
    fresh = np.ones(len(pts), bool)
    fresh[1:] = (pts[1:] != pts[:-1]).any(1)
    pts = pts[fresh]
    if len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    if len(pts) < 3:
        return None
    if tolerance > 0:
        outermost = np.concatenate([pts[pts.argmin(0)], pts[pts.argmax(0)]])
        while len(pts) > 3:
            fixed = (pts[:, None] == outermost[None]).all(2).any(1)
            kept = list(range(len(pts)))
            for i in np.flatnonzero(~fixed & (_off_line(pts) <= tolerance)):
                if len(kept) > 3:
                    kept.remove(i)
            if len(kept) == len(pts):
                break
            pts = pts[kept]
    return np.concatenate([pts, pts[:1]])


def _off_line(pts: np.ndarray) -> np.ndarray:
    """Metres of each corner of a ring from the segment between its neighbours, on the corner's own plane."""
    scale = np.stack([111_320 * np.cos(np.radians(pts[:, 1])), np.full(len(pts), 110_540.0)], 1)
    p, e = (pts - np.roll(pts, 1, 0)) * scale, (np.roll(pts, -1, 0) - np.roll(pts, 1, 0)) * scale
    size = (e * e).sum(1)
    t = np.clip(np.divide((p * e).sum(1), size, out=np.zeros(len(pts)), where=size > 0), 0, 1)
    return np.hypot(*(p - t[:, None] * e).T)


#: Parts into which each side of a box is cut, as parallels are no great circles.
SIDE = 32


def _unit(p: np.ndarray) -> np.ndarray:
    """Unit vectors of positions."""
    lon, lat = np.radians(p[..., 0]), np.radians(p[..., 1])
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit vector of ``a`` less that of ``b``, exact for near places too: differences of angles before their sines."""
    (x, y), (u, v) = np.radians(a), np.radians(b)
    cos_less = lambda p, q: -2 * np.sin((p + q) / 2) * np.sin((p - q) / 2)
    sin_less = lambda p, q: 2 * np.cos((p + q) / 2) * np.sin((p - q) / 2)
    return np.array([(cos_less(y + x, v + u) + cos_less(y - x, v - u)) / 2, (sin_less(y + x, v + u) - sin_less(y - x, v - u)) / 2, sin_less(y, v)])


def voronoi_cell(site: np.ndarray, others: np.ndarray, box: np.ndarray) -> np.ndarray | None:
    """Ring of the part of a box (its ring) that lies nearer to ``site`` than to each of ``others`` on the sphere; null if there is none.

    What is nearer is a half space of unit vectors, so cuts are exact.  Others are
    taken nearest first, and the search ends with those more than twice as far as
    the farthest corner: none of them can cut.
    """
    t = np.linspace(0, 1, SIDE, endpoint=False)[:, None]
    ring = _unit(np.concatenate([a + (b - a) * t for a, b in zip(box[:-1], box[1:], strict=True)]))
    far, here = metres(site, others), _unit(site)
    for k in np.argsort(far, kind="stable"):
        reach = 2 * EARTH_RADIUS * np.arcsin(min(np.linalg.norm(ring - here, axis=1).max() / 2, 1.0))
        if far[k] > 2.01 * reach:
            break
        side = ring @ _chord(site, others[k])
        if (side >= 0).all():
            continue
        before, was = np.roll(ring, 1, axis=0), np.roll(side, 1)
        turns, kept = (side >= 0) != (was >= 0), side >= 0
        at = np.divide(was, was - side, out=np.zeros(len(side)), where=turns)[:, None]
        met = before + at * (ring - before)
        both = np.stack([met / np.linalg.norm(met, axis=1, keepdims=True), ring], axis=1)
        ring = both.reshape(-1, 3)[np.stack([turns, kept], axis=1).reshape(-1)]
        if len(ring) < 3:
            return None
    low, high = box.min(axis=0), box.max(axis=0)
    lon, lat = np.degrees(np.arctan2(ring[:, 1], ring[:, 0])), np.degrees(np.arcsin(np.clip(ring[:, 2], -1, 1)))
    lon += 360 * np.round(((low[0] + high[0]) / 2 - lon) / 360)
    out = np.clip(np.stack([lon, lat], axis=1), low, high)
    out = np.where(np.abs(out - low) < 1e-9, low, np.where(np.abs(out - high) < 1e-9, high, out))
    edge = lambda p, q: ((p == q) & ((p == low) | (p == high))).any(axis=1)  # noqa: E731  both on one side of the box
    out = out[~((edge(np.roll(out, 1, axis=0), out)) & edge(out, np.roll(out, -1, axis=0)) & ~((out == low) | (out == high)).all(axis=1))]
    return np.concatenate([out, out[:1]]) if len(out) > 2 else None


#: Radians that an edge drawn straight in degrees may lie off its great circle (about 6 cm).
DRAWN = 1e-8


def along_great_circles(ring: np.ndarray, box: np.ndarray) -> np.ndarray:
    """A ring within a box with positions added where an edge, drawn straight in degrees, would leave its great circle; sides of the box stay."""
    low, high = box.min(axis=0), box.max(axis=0)
    out = []
    for a, b in zip(ring[:-1], ring[1:], strict=True):
        u, v = _unit(a), _unit(b)
        side = ((a == b) & ((a == low) | (a == high))).any()
        bend = np.linalg.norm(u - v) ** 2 / 8 * np.tan(np.radians(min(np.abs([a[1], b[1]]).max(), 89.0)))
        m = 1 if side else int(np.ceil(np.sqrt(max(bend / DRAWN, 1.0))))
        t = (np.arange(m) / m)[:, None]
        w = u * (1 - t) + v * t
        lon, lat = np.degrees(np.arctan2(w[:, 1], w[:, 0])), np.degrees(np.arctan2(w[:, 2], np.hypot(w[:, 0], w[:, 1])))
        lon += 360 * np.round((a[0] - lon) / 360)
        part = np.clip(np.stack([lon, lat], axis=1), low, high)
        part[0] = a
        out.append(part)
    return np.concatenate([*out, ring[:1]])


def hull(pts: np.ndarray) -> np.ndarray | None:
    """Closed convex hull, counter-clockwise, without collinear points; null for fewer than three distinct points."""
    p = np.unique(pts, axis=0)
    if len(p) < 3:
        return None

    def chain(ordered):
        out: list = []
        for q in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = chain(p) + chain(p[::-1])
    return np.array([*ring, ring[0]]) if len(ring) > 2 else None


@F.arrow_udf(POINTS)
def simplify(points: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Line or ring within ``tolerance`` metres, as ``simplified``; at 0 or less all of it."""
    sizes, places = lengths(points), points.flatten()
    width, numbers = lengths(places), places.flatten().to_numpy(zero_copy_only=False)
    if (width < 2).any():
        raise ValueError("a position has a longitude and a latitude")
    first = np.cumsum(width) - width
    pts, t = np.stack([numbers[first], numbers[first + 1]], 1), tolerance.to_numpy(zero_copy_only=False).astype(float)
    every = ~(t > 0)
    weight = significances(pts, sizes, np.where(every, np.inf, t), unknown=np.nan)
    kept = (weight > 0) | np.repeat(every, sizes)
    left = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])])
    flat = pts[kept].ravel()
    two = np.full(len(flat) // 2, 2)
    return listed(listed(pa.array(flat, pa.float64()), two, pa.array(two < 0)), left, pa.array(sizes == 0))


@F.pandas_udf(POINTS)
def clean_ring(points: pd.Series, tolerance: pd.Series) -> pd.Series:
    return _each(zip(points, tolerance, strict=True), drawn)


@F.pandas_udf(POINTS)
def convex_hull(points: pd.Series) -> pd.Series:
    return _each(zip(points), hull)
