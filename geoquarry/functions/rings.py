"""Measures of rings and lines (arrays of lon/lat structs) by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from geoquarry.functions import geo


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it: Spark would repeat it at each mention in a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def edges(points: Column) -> Column:
    """Array of (x1, y1, x2, y2) between consecutive points; empty below two points."""

    def pairs(p):
        n = F.size(p)
        first, second = F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(n - 1, F.lit(0)))
        return F.zip_with(first, second, lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))

    return once(points, pairs)


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def length(points: Column) -> Column:
    """Metres along the points; each edge's haversine is worked out once."""
    return _sum(F.transform(edges(points), lambda e: geo.half_chord(e["x1"], e["y1"], e["x2"], e["y2"])), geo.arc)


def from_first(points: Column, x=lambda v: v, y=lambda v: v) -> Column:
    """Points after ``x`` and ``y``, relative to the first one: products of small offsets keep their digits."""
    at = lambda p: F.struct(x(p["lon"]).alias("lon"), y(p["lat"]).alias("lat"))
    less = lambda ps, first: F.transform(ps, lambda p: F.struct((p["lon"] - first["lon"]).alias("lon"), (p["lat"] - first["lat"]).alias("lat")))
    return once(F.transform(points, at), lambda ps: once(F.get(ps, F.lit(0)), lambda first: less(ps, first)))


def mercator_area(ring: Column) -> Column:
    """Shoelace in the mercator plane, in square metres; 0 for fewer than four points."""
    area = lambda r: F.when(F.size(r) >= 4, planar_area(from_first(r, F.radians, geo.mercator_y)) * F.lit(geo.EARTH_RADIUS**2)).otherwise(0.0)
    return once(ring, area)


def planar_area(ring: Column) -> Column:
    """Shoelace in square degrees."""
    return F.abs(_sum(edges(from_first(ring)), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def centroid(ring: Column) -> Column:
    """Area centroid of a ring in degrees; the vertex mean if it has no area."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    add = lambda s, e: F.struct(*[(s[n] + v).alias(n) for n, v in (("a", cross(e)), ("x", (e["x1"] + e["x2"]) * cross(e)), ("y", (e["y1"] + e["y2"]) * cross(e)))])

    def of(r):
        first, mean = F.get(r, F.lit(0)), vertex_mean(r)
        sums = F.aggregate(edges(from_first(r)), F.struct(*[F.lit(0.0).alias(n) for n in "axy"]), add)
        heavy = lambda s: F.struct((first["lon"] + s["x"] / (3 * s["a"])).alias("lon"), (first["lat"] + s["y"] / (3 * s["a"])).alias("lat"))
        return once(sums, lambda s: F.when(F.abs(s["a"]) < 1e-18, mean).otherwise(heavy(s)))

    return once(ring, of)


def vertex_mean(points: Column) -> Column:
    """Mean of all points, a closing one included; (0, 0) of none."""

    def mean(ps):
        n = F.greatest(F.size(ps), F.lit(1))
        return F.struct((_sum(ps, lambda p: p["lon"]) / n).alias("lon"), (_sum(ps, lambda p: p["lat"]) / n).alias("lat"))

    return once(points, mean)


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule over the ring's edges; points on the boundary may fall to either side."""
    return within(edges(ring), lon, lat)


def within(sides: Column, lon: Column, lat: Column) -> Column:
    """``contains`` for a ring's edges, where many points are tried against one ring."""

    def crosses(e):
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        return spans & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.aggregate(sides, F.lit(False), lambda inside, e: inside != F.coalesce(crosses(e), F.lit(False)))


def without_repeats(points: Column) -> Column:
    """Consecutive equal points once."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def bbox(points: Column) -> Column:

    def of(ps):
        lon, lat = ps["lon"], ps["lat"]
        return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))

    return once(points, of)


def circle(lon: Column, lat: Column, metres: Column, steps: int = 32) -> Column:
    """Closed ring of destinations around a point; at least eight steps."""
    n = max(8, steps)
    turn = F.sequence(F.lit(0), F.lit(n))
    return F.transform(turn, lambda i: geo.destination(lon, lat, metres, (i % n) * (360.0 / n)))
