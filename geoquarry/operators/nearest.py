"""Nearest neighbours by descent through a pyramid of occupied cells.

The targets' extent is cut into 4 x 4 cells, those again, and so on; a cell is
known by the box of its targets and by one of them.  Every point begins at the
whole extent.  In each round it looks at the occupied cells below those it holds:
one target of a cell is at most so far, its box at least so far, and only cells
that can hold a target no farther than the best one known are held on to.  Cells
of few targets are not descended into: all of theirs are compared at once.

At scale: no point meets all targets, however far it is and however dense they
are: what a point holds is the cells along the front that faces it, a handful in a
round.  Rounds are as many as the base-4 logarithm of the extent over the spacing
where targets are densest.  Cells meet points in an equi-join on the cell; while
they are few (counted), they are broadcast, as the first rounds' keys are hot.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.functions import geo
from geoquarry.plans.staging import Staging

#: Targets of a cell that is not descended into.
FEW = 16
#: Cells (each with at most FEW targets) up to which a round broadcasts them.
SMALL = 10_000
#: Rounds after which two places can't be told apart any more by halves of a double's range.
DEEPEST = 26


class Metric(NamedTuple):
    """How far a target is (lon, lat, target's lon, lat), and how far the targets of a box are at least (lon, lat, box)."""

    far: Callable[[Column, Column, Column, Column], Column]
    least: Callable[[Column, Column, Column], Column]


def _held(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def _least_on_sphere(lon: Column, lat: Column, box: Column) -> Column:
    """Metres to a box, less a micrometre for rounding: along the meridian if that leads into it, else to the nearer of its two meridian sides.

    On a meridian the distance falls towards the foot of the perpendicular and
    rises behind it, so foot and ends are enough.
    """
    aside = lambda side: F.abs(F.pmod(lon - side + 180, F.lit(360.0)) - 180)
    off = F.least(aside(box["west"]), aside(box["east"]))
    foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(F.radians(off))))
    zero = F.lit(0.0)
    ends = [geo.haversine(zero, lat, off, y) for y in (_held(foot, box["south"], box["north"]), box["south"], box["north"])]
    above = F.pmod(lon - box["west"], F.lit(360.0)) <= box["east"] - box["west"]
    return F.when(above, geo.haversine(zero, lat, zero, _held(lat, box["south"], box["north"]))).otherwise(F.least(*ends)) - 1e-6


def _squares(lon: Column, lat: Column, x: Column, y: Column) -> Column:
    return (x - lon) * (x - lon) + (y - lat) * (y - lat)


SPHERE = Metric(geo.haversine, _least_on_sphere)
#: Squared degrees.
PLANE = Metric(_squares, lambda lon, lat, box: _squares(lon, lat, _held(lon, box["west"], box["east"]), _held(lat, box["south"], box["north"])))


def _cells(places: DataFrame, box, level: int, staging: Staging) -> DataFrame:
    """up, cell, box, one (a target), few (all of them, or null if they are many) of each occupied cell of a level."""
    parts = 1 << (2 * level)
    line = lambda v, low, high: F.least(F.floor((F.col(v) - low) / max(high - low, 5e-324) * parts), F.lit(parts - 1))
    at = F.struct(line("t_lon", box["west"], box["east"]).alias("x"), line("t_lat", box["south"], box["north"]).alias("y"))
    placed = places.withColumn("cell", at)
    target = F.struct("id", F.col("t_lon").alias("lon"), F.col("t_lat").alias("lat"))
    extent = F.struct(F.min("t_lon").alias("west"), F.min("t_lat").alias("south"), F.max("t_lon").alias("east"), F.max("t_lat").alias("north"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), extent.alias("box"), F.min(target).alias("one"))
    if level < DEEPEST:
        leaves = cells.where(F.col("n") <= FEW).select("cell")
        few = placed.join(leaves, "cell", "left_semi").groupBy("cell").agg(F.collect_list(target).alias("few"))
    else:
        few = placed.groupBy("cell").agg(F.collect_list(target).alias("few"))  # targets that differ by rounding only
    above = F.struct(F.shiftright("cell.x", 2).alias("x"), F.shiftright("cell.y", 2).alias("y"))
    return staging.cut(cells.join(few, "cell", "left").select(above.alias("up"), "cell", "box", "one", "few"), "cells")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str, metric: Metric, staging: Staging) -> DataFrame:
    """``key``, ``target``, far of every row of ``points`` (lon, lat): its nearest of ``targets`` (t_lon, t_lat), ties by the smallest id.

    Null where the point has no place or there are no targets with one.  Points
    that repeat a key each have a row; of targets at one place the smallest id counts.
    """
    there = lambda df, x, y: df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    places = staging.cut(there(targets, "t_lon", "t_lat").groupBy("t_lon", "t_lat").agg(F.min(target).alias("id")), "places")
    box = places.agg(F.min("t_lon").alias("west"), F.max("t_lon").alias("east"), F.min("t_lat").alias("south"), F.max("t_lat").alias("north")).first()
    kind = places.schema["id"].dataType.simpleString()
    none = F.lit(None).cast(f"struct<far:double,id:{kind}>")
    base = points.select(F.col(key).alias("key"), "lon", "lat")
    if box["west"] is None:
        return base.select(F.col("key").alias(key), F.lit(None).cast(kind).alias(target), F.lit(None).cast("double").alias("far"))
    root = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    here = ("lon", "lat")
    state = there(base, *here).distinct().withColumns({"best": none, "open": root})
    done, lon, lat = None, F.col("lon"), F.col("lat")
    known = lambda t: F.struct(metric.far(lon, lat, t["lon"], t["lat"]).alias("far"), t["id"].alias("id"))
    for level in range(1, DEEPEST + 1):
        cells = _cells(places, box, level, staging)
        few_cells = F.broadcast(cells) if cells.count() <= SMALL else cells
        met = state.withColumn("up", F.explode("open")).join(few_cells, "up")
        met = met.withColumn("least", metric.least(lon, lat, F.col("box")) * (1 - 1e-9))
        open_ = F.col("best").isNull() | (F.col("least") <= F.col("best.far"))
        near = F.when(F.col("few").isNull(), known(F.col("one"))).otherwise(F.array_min(F.transform("few", known)))
        near = F.when(open_, F.least(near, F.coalesce("best", near))).otherwise(F.col("best"))
        deeper = F.when(open_ & F.col("few").isNull(), F.struct("least", "cell"))
        round_ = met.withColumn("near", near).groupBy("key", *here).agg(F.min("near").alias("best"), F.collect_list(deeper).alias("held"))
        kept = F.transform(F.filter("held", lambda h: h["least"] <= F.col("best.far")), lambda h: h["cell"])
        tried = staging.cut(round_.select("key", *here, "best", kept.alias("open")), "nearest")
        settled = tried.where(F.size("open") == 0)
        done = settled if done is None else done.unionByName(settled)
        state = tried.where(F.size("open") > 0)
        staging.drop(cells)
        if state.isEmpty():
            break
    best = done.select(F.col("key").alias("k"), F.col("lon").alias("x"), F.col("lat").alias("y"), "best")
    found = base.join(best.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (lon == F.col("x")) & (lat == F.col("y")), "left")
    return found.select(F.col("key").alias(key), F.col("best.id").alias(target), F.col("best.far").alias("far"))
