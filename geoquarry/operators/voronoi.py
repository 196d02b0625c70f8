"""Cells of sites (Voronoi) on the sphere, within a box, for any number of sites.

A cell is the box less all that is nearer to another site.  It is first cut by the
sites of the nine blocks around its own; the blocks are as large as hold few
enough, so dense and sparse regions have blocks of their own sizes.  What the
blocks know ends at a block's width: a cell whose corners are all within half
that (its security radius) is closed.  Of the others every corner is looked up
among all sites: if one is nearer to the corner than the cell's own, it cuts too.
A cell is closed when no corner has a nearer site, as a cell that a site cuts
loses a corner.  Edges between corners are great circles; long ones have positions
added, so that drawn straight in degrees, as all geometry here, they stay on them.

At scale: no task holds all sites; a site meets at most ``NEAR`` others at first and
then those that cut it.  Corners are looked up by descent through the pyramid of
occupied cells (``nearest``), and only those of cells that are still open: by and
large the outermost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoquarry.operators.nearest import SPHERE, nearest
from geoquarry.operators.shapes import along_great_circles, metres, voronoi_cell
from geoquarry.plans.staging import Staging

#: Sites that nine blocks hold at most, and how often blocks are quartered in each direction.
NEAR, DEEPEST = 128, 24
#: Metres of a degree of latitude, as on the sphere of ``metres``.
DEGREE = 6371000.0 * np.pi / 180
#: Share by which a corner's nearest site must be nearer than its own, beyond what corners are exact to.
ROUNDING = 1e-6


def _block(level: int, box) -> tuple[list, float]:
    """Columns of the block that a place lies in, and the blocks' width in degrees."""
    size = max(box[2] - box[0], box[3] - box[1]) / (1 << (2 * level))
    return [F.floor((F.col("lon") - box[0]) / size).alias("bx"), F.floor((F.col("lat") - box[1]) / size).alias("by")], size


def _around(df: DataFrame) -> DataFrame:
    """Each row for the nine blocks around its own (bx, by)."""
    nine = F.array(*[F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("nine", F.explode(nine)).drop("bx", "by").select("*", "nine.bx", "nine.by").drop("nine")


def _first_neighbours(places: DataFrame, box, staging: Staging) -> DataFrame:
    """site, lon, lat, known (metres around the site within which all others are listed), others."""
    rest, parts = places, []
    for level in range(DEEPEST + 1):
        block, size = _block(level, box)
        here = places.select("site", "lon", "lat", *block)
        counts = here.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
        near = _around(counts).groupBy("bx", "by").agg(F.sum("n").alias("near"))
        mine = rest.select("site", "lon", "lat", *block).join(near, ["bx", "by"])
        if level == DEEPEST:
            mine = mine.withColumn("near", F.lit(0))  # places that doubles hardly tell apart
        mine = staging.cut(mine, "blocks")
        asked = _around(mine.where(F.col("near") <= NEAR).select("site", "bx", "by"))
        met = asked.join(here.select("bx", "by", F.struct("lon", "lat").alias("o"), F.col("site").alias("other")), ["bx", "by"]).where(F.col("other") != F.col("site"))
        others = met.groupBy("site").agg(F.collect_list("o").alias("others"))
        narrow = F.lit(size * DEGREE) * F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(90.0))))
        known = F.lit(float("inf")) if level == 0 else F.when(F.abs("lon") + size > 180, 0.0).otherwise(narrow)  # all are listed; blocks don't reach over the date line
        parts.append(mine.where(F.col("near") <= NEAR).join(others, "site", "left").select("site", "lon", "lat", known.alias("known"), "others"))
        rest = mine.where(F.col("near") > NEAR).select("site", "lon", "lat")
        if rest.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cut(sites: DataFrame, kind: str, frame: np.ndarray) -> DataFrame:
    """site, lon, lat, ring (null: nothing left), used, open: the frame cut by all others known so far, nearest first, which are then used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                site, r["used"] = np.array([r["lon"], r["lat"]]), (r["used"] or []) + (r["others"] or [])
                cut = voronoi_cell(site, np.array([[o["lon"], o["lat"]] for o in r["used"]]).reshape(-1, 2), frame)
                r["ring"] = None if cut is None else cut.tolist()
                r["open"] = cut is not None and bool(2.01 * metres(site, cut).max() > r["known"])
            place = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
            take = lambda c: [r[c] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(take("lon"), pa.float64()), pa.array(take("lat"), pa.float64()), pa.array(take("ring"), pa.list_(pa.list_(pa.float64()))), pa.array(take("used"), pa.list_(place)), pa.array(take("open"), pa.bool_())],
                names=["site", "lon", "lat", "ring", "used", "open"],
            )

    wanted = sites.select("site", "lon", "lat", "known", "others", "used")
    return wanted.mapInArrow(run, f"site {kind}, lon double, lat double, ring array<array<double>>, used array<struct<lon:double,lat:double>>, open boolean")


def _drawn(cells: DataFrame, kind: str, frame: np.ndarray) -> DataFrame:
    """site, ring: the cells with positions added along edges that are long enough to bend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings = [along_great_circles(np.array(r), frame).tolist() for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rings, pa.list_(pa.list_(pa.float64())))], names=["site", "ring"])

    return cells.select("site", "ring").mapInArrow(run, f"site {kind}, ring array<array<double>>")


def voronoi(sites: DataFrame, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """``key``, ring: cell of each of ``sites`` (lon, lat) within a box; sites without a cell have no row.

    Sites that share a place share a cell; sites without a place have none.  Sites
    outside the box have a cell if a part of the box is nearest to them.
    """
    staging = Staging(sites.sparkSession, "voronoi")
    there = sites.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    places = staging.cut(there.groupBy("lon", "lat").agg(F.min(key).alias("site")).select("site", "lon", "lat"), "places")
    kind = places.schema["site"].dataType.simpleString()
    e = places.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    if e[0] is None:
        return sites.select(key).limit(0).withColumn("ring", F.lit(None).cast("array<array<double>>"))
    west, south, east, north = box
    frame = np.array([(west, south), (east, south), (east, north), (west, north), (west, south)], float)
    extent = (e[0], e[1], max(e[2], e[0] + 1e-9), max(e[3], e[1] + 1e-9))
    begun = _first_neighbours(places, extent, staging).withColumn("used", F.lit(None).cast("array<struct<lon:double,lat:double>>"))
    cells = staging.cut(_cut(begun, kind, frame), "cells")
    done, open_ = cells.where(~F.col("open")).select("site", "ring"), cells.where("open")
    targets = places.select(F.col("site").alias("other"), F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
    while not open_.isEmpty():
        corners = open_.select("site", "lon", "lat", "used", F.explode(F.slice("ring", 2, F.size("ring") - 1)).alias("c")).withColumns({"s_lon": F.col("lon"), "s_lat": F.col("lat"), "lon": F.col("c")[0], "lat": F.col("c")[1]})
        asked = corners.select(F.monotonically_increasing_id().alias("corner"), "site", "used", "s_lon", "s_lat", "lon", "lat")
        asked = staging.cut(asked, "corners")
        found = nearest(asked.select("corner", "lon", "lat"), targets, "corner", "other", SPHERE, staging).join(targets, "other")
        own = SPHERE.far(F.col("lon"), F.col("lat"), F.col("s_lon"), F.col("s_lat"))
        cutter = F.struct(F.col("t_lon").alias("lon"), F.col("t_lat").alias("lat"))
        nearer = asked.join(found, "corner").where((F.col("far") < own * (1 - ROUNDING)) & ~F.array_contains("used", cutter))
        more = nearer.groupBy("site").agg(F.collect_set(cutter).alias("others"))
        step = open_.drop("open").join(more, "site", "left").withColumn("known", F.when(F.col("others").isNull(), F.lit(float("inf"))).otherwise(0.0))
        tried = staging.cut(_cut(step, kind, frame), "cells")
        done, open_ = done.unionByName(tried.where(~F.col("open")).select("site", "ring")), tried.where("open")
    cells = _drawn(done.where(F.col("ring").isNotNull()), kind, frame)
    at = there.select(key, "lon", "lat").join(places, ["lon", "lat"])
    return at.join(cells, "site").select(key, "ring")
