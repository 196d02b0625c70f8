"""Edges that meet, by an index of edges: for lines and rings too long to hold every pair of edges in one row.

Lines are exploded to edges; each lies in the grid of many levels at its own size,
and edges of one key meet there in an equi-join on key and cell.  What is compared
are edges whose boxes meet, near as many as there are edges, and a line of any number
of edges is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from geoquarry.functions import geometries as G, rings
from geoquarry.operators import spatial
from geoquarry.plans.staging import Staging
from geoquarry.sources.tables import spread

EDGE = ("x1", "y1", "x2", "y2")


def edges_of(rows: DataFrame, key: str, line: Column) -> DataFrame:
    """key, n (from 0), x1, y1, x2, y2 of every edge of a row's line."""
    return rows.select(F.col(key).alias("key"), F.posexplode(rings.edges(line)).alias("n", "e")).select("key", "n", "e.*")


def _boxed(edges: DataFrame, touch: bool) -> DataFrame:
    """key, n, e, box; with ``touch`` the box is grown by what edges may lie apart and still touch."""
    x1, y1, x2, y2 = (F.col(c) for c in EDGE)
    apart = F.lit(G.ON_SEGMENT) / F.greatest(F.hypot(x2 - x1, y2 - y1), F.lit(1e-5)) if touch else F.lit(0.0)
    box = F.struct((F.least(x1, x2) - apart).alias("west"), (F.least(y1, y2) - apart).alias("south"), (F.greatest(x1, x2) + apart).alias("east"), (F.greatest(y1, y2) + apart).alias("north"))
    return edges.select("key", "n", F.struct(*EDGE).alias("e"), box.alias("box"))


def lines_meet(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """``key``, meet of each key of ``rows``: whether an edge of the line ``a`` crosses or touches one of ``b``, as ``segments_meet`` says.

    Ends may lie as far beyond an edge as ``segments_meet`` allows edges of a
    metre; shorter ones touch no farther.  Without edges nothing meets.
    """
    left = _boxed(edges_of(rows, key, a), True).toDF("key", "n1", "e1", "b1")
    right = _boxed(edges_of(rows, key, b), True).toDF("key", "n2", "e2", "b2")
    met = spatial.meeting(left, right, "b1", "b2", on=("key",)).where(G.segments_meet(F.col("e1"), F.col("e2")))
    found = met.select(F.col("key").alias("met")).distinct()
    return rows.select(key).join(found, F.col(key) == F.col("met"), "left").select(key, F.col("met").isNotNull().alias("meet"))


#: How far a cell is taken to reach beyond its sides: more than a computed crossing lies off its edges.
REACH = 1e-9


def _passed(e: Column, z: Column) -> Column:
    """Array of (z, x, y) of the cells of a level that an edge passes, those within ``REACH`` of it included: column by column, so a long thin edge is no full box."""
    size = F.pow(F.lit(2.0), z)
    apart = F.greatest(size * REACH, F.lit(1e-12))
    low, high = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    bottom, top = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    slope = (e["y2"] - e["y1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))

    def column(x):
        at = lambda v: F.least(top, F.greatest(bottom, e["y1"] + (F.least(high, F.greatest(low, v)) - e["x1"]) * slope))
        a, b = at(x * size - apart), at((x + 1) * size + apart)
        upright = slope.isNull()
        ys = F.sequence(spatial.cell(F.when(upright, bottom).otherwise(F.least(a, b)) - apart, size), spatial.cell(F.when(upright, top).otherwise(F.greatest(a, b)) + apart, size))
        return F.transform(ys, lambda y: F.struct(z.alias("z"), x.alias("x"), y.alias("y")))

    return F.flatten(F.transform(F.sequence(spatial.cell(low - apart, size), spatial.cell(high + apart, size)), column))


def self_crossings(edges: DataFrame) -> DataFrame:
    """key, i, j (i < j) of the edges of one line that properly cross; ``edges`` has key, n, x1, y1, x2, y2, numbered along the line.

    Neighbours share an end and don't cross properly; nor do first and last of a ring.
    No edge lies at a level above that of the mean edge: longer ones pass through
    many cells there, together no more than a few for each edge, so long edges among
    many short ones meet only those along their way.  A pair counts in the cell of its crossing.
    """
    b = spatial._finite(_boxed(edges, False), "box").select("key", "n", "e", spatial.level(F.col("box")).alias("own"))
    side_ = F.greatest(F.abs(F.col("e.x2") - F.col("e.x1")), F.abs(F.col("e.y2") - F.col("e.y1")))
    mean = b.agg(F.avg(side_)).first()[0]
    cap = max(math.ceil(math.log2(mean)), spatial.LEAST) if mean else spatial.LEAST
    b = b.withColumn("own", F.least("own", F.lit(cap)))
    levels = sorted(r[0] for r in b.select("own").distinct().collect())  # a few numbers
    known = F.array(*[F.lit(z) for z in levels]) if levels else F.array().cast("array<int>")
    asked = b.withColumn("z", F.explode(F.filter(known, lambda z: z >= F.col("own"))))
    asks = asked.withColumn("at", F.explode(_passed(F.col("e"), F.col("z")))).select("key", "n", "e", "own", "at").toDF("key", "n1", "e1", "z1", "at")
    holds = b.withColumn("at", F.explode(_passed(F.col("e"), F.col("own")))).toDF("key", "n2", "e2", "z2", "at")
    once = (F.col("n1") < F.col("n2")) | ((F.col("n1") > F.col("n2")) & (F.col("z1") < F.col("z2")))  # of one level each asks the other
    first = F.col("n1") < F.col("n2")
    a, c = F.when(first, F.col("e1")).otherwise(F.col("e2")), F.when(first, F.col("e2")).otherwise(F.col("e1"))
    met = asks.join(holds.hint("merge"), ["key", "at"]).where(once)
    met = met.select("key", "at", F.least("n1", "n2").alias("i"), F.greatest("n1", "n2").alias("j"), a.alias("a"), c.alias("c"))
    a, c = F.col("a"), F.col("c")
    side = lambda e, x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    from_a, to_a = side(c, a["x1"], a["y1"]), side(c, a["x2"], a["y2"])
    proper = (side(a, c["x1"], c["y1"]) * side(a, c["x2"], c["y2"]) < 0) & (from_a * to_a < 0)
    shares = ((a["x2"] == c["x1"]) & (a["y2"] == c["y1"])) | ((c["x2"] == a["x1"]) & (c["y2"] == a["y1"]))
    t, size = from_a / F.nullif(from_a - to_a, F.lit(0.0)), F.pow(F.lit(2.0), F.col("at.z"))
    here = (F.col("at.x") == spatial.cell(a["x1"] + t * (a["x2"] - a["x1"]), size)) & (F.col("at.y") == spatial.cell(a["y1"] + t * (a["y2"] - a["y1"]), size))
    return met.where(~shares & proper & here).select("key", "i", "j")


#: Edges are summed up in spans of 2^16 numbers, so no window is longer than a few of these.
SPAN_BITS = 16


def later_crossings(edges: DataFrame, staging: Staging) -> DataFrame:
    """key, i, crossings, first, last of the edges that later ones of their line properly cross: how many, and the first and last of them; ``edges`` as for ``self_crossings``.

    A line that goes one way again and again crosses itself with the square of its rounds.
    Equal edges cross the same others, so crossings are looked for among different edges
    alone, each known by its first number, and no pair of repeated ones is made: to each different
    edge come the numbers of those that cross it, and these are summed up from the last to
    the first, span by span and then within a span.  A row that repeats counts as often.
    """
    edges = staging.cut(edges.groupBy("key", "n", *EDGE).agg(F.count(F.lit(1)).alias("times")), "edges")
    ways = staging.cut(spread(edges.groupBy("key", *EDGE).agg(F.min("n").alias("way")), "key", "way"), "ways")
    met = staging.cut(self_crossings(ways.withColumnRenamed("way", "n")), "met")
    of = staging.cut(edges.join(ways.hint("merge"), ["key", *EDGE]).select("key", "way", F.col("n").cast("long").alias("n"), "times"), "of")
    both = met.toDF("key", "way", "other").unionByName(met.toDF("key", "other", "way"))
    hits = both.join(of.withColumnRenamed("way", "other").hint("merge"), ["key", "other"]).where("n > way")  # none before crosses later

    nothing, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = of.select("key", "way", "n", F.col("times").alias("own"), nothing.alias("crossings"), null.alias("first"), null.alias("last"))
    marks = own.unionByName(hits.select("key", "way", "n", nothing.alias("own"), F.col("times").alias("crossings"), F.col("n").alias("first"), F.col("n").alias("last")))
    marks = staging.cut(marks.withColumn("span", F.shiftright("n", SPAN_BITS)), "marks")
    sums = lambda over: [f(c).over(over).alias(c) for f, c in ((F.sum, "crossings"), (F.min, "first"), (F.max, "last"))]
    spans = marks.groupBy("key", "way", "span").agg(F.sum("crossings").alias("crossings"), F.min("first").alias("first"), F.max("last").alias("last"))
    behind = spans.select("key", "way", "span", null.alias("n"), nothing.alias("own"), *sums(W.partitionBy("key", "way").orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)))
    line = W.partitionBy("key", "way", "span").orderBy(F.desc_nulls_first("n"), F.desc("own")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = marks.unionByName(behind.where("crossings > 0")).select("key", F.col("n").alias("i"), "own", *sums(line))
    return summed.where("own > 0 AND crossings > 0").select("key", "i", (F.col("own") * F.col("crossings")).alias("crossings"), "first", "last")
