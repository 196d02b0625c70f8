"""Tile pyramids: geometry simplified for each zoom, and the tiles that it covers.

Douglas and Peucker's rule splits a line at the same vertices whatever the
tolerance; only how far it goes depends on it.  So one pass gives every vertex
the largest tolerance at which it still stays, and each zoom is a filter of the
same vertices.  Features are held once, with a weight for each vertex.

At scale: weights are made batch by batch where the geometry lies.  A vertex is
counted once, in its tile of the largest zoom and with the first zoom at which it
stays; zooms are made of these counts, not of vertices.  Partial aggregations go
before both shuffles, so a low zoom, whose one tile all vertices touch, costs a row
for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from geoquarry.functions import geometries as G, tiles
from geoquarry.operators import shapes

WEIGHTS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


def lod_tolerance(zoom: int, max_zoom: int, base: float = 2.0) -> float:
    """Metres at a zoom: ``base`` from ``max_zoom`` on, doubled for each zoom below."""
    return base * 2.0 ** max(max_zoom - zoom, 0)


def significance(pts: np.ndarray) -> np.ndarray:
    """For each position of a line the tolerance below which simplification keeps it; ends stay at any."""
    return shapes.significances(pts, np.array([len(pts)]), np.zeros(1))


@F.arrow_udf(WEIGHTS)
def _weights(parts: pa.Array, drawn: pa.Array) -> pa.Array:
    lines = parts.flatten()
    paths = lines.flatten()
    places = paths.flatten()
    n_lines, n_paths, n_places = shapes.lengths(parts), shapes.lengths(lines), shapes.lengths(paths)
    pts = np.stack([pc.struct_field(places, name).to_numpy(zero_copy_only=False).astype(float) for name in ("lon", "lat")], 1)
    simple = ~pc.fill_null(drawn, False).to_numpy(zero_copy_only=False).astype(bool)
    simple = np.repeat(np.repeat(simple, n_lines), n_paths)
    w = shapes.significances(pts, n_places, np.where(simple, np.inf, 0.0))
    w[np.repeat(simple, n_places)] = np.inf
    return shapes.listed(shapes.listed(shapes.listed(pa.array(w, pa.float64()), n_places, paths.is_null()), n_paths, lines.is_null()), n_lines, parts.is_null())


def weights(g: Column) -> Column:
    """Significance of each position of a geometry, nested as its parts; points and lines of two positions are never simplified.  Null gives null."""
    return _weights(g["parts"], G.is_area(g) | G.is_line(g))


def simplified(g: Column, weight: Column, tolerance: Column | float) -> Column:
    """The geometry at a tolerance in metres, by ``weights``; at 0 or less all of it."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    kept = F.transform(g["parts"], lambda part, i: F.transform(part, lambda line, j: F.filter(line, lambda p, k: (t <= 0) | (F.get(F.get(F.get(weight, i), j), k) > t))))
    return F.when(g.isNotNull(), G.geometry(g["type"], kept))


def vertices(features: DataFrame, key: str) -> DataFrame:
    """``key``, lon, lat, weight of every position of the geometries ``g``."""
    flat = F.arrays_zip(G.positions(F.col("g")).alias("p"), F.flatten(F.flatten("w")).alias("w"))
    return features.withColumn("w", weights(F.col("g"))).select(key, F.inline(flat).alias("p", "weight")).select(key, "p.lon", "p.lat", "weight")


def first_zoom(weight: Column, min_zoom: int, max_zoom: int, base: float = 2.0) -> Column:
    """The least zoom at which a position stays, as it then does at all above; null if it never does."""
    tolerances = [(z, lod_tolerance(z, max_zoom, base)) for z in range(min_zoom, max_zoom + 1)]
    return F.coalesce(*[F.when((weight > t) | F.lit(t <= 0), F.lit(z)) for z, t in tolerances])


def levels(features: DataFrame, min_zoom: int, max_zoom: int, base: float = 2.0, key: str = "id") -> DataFrame:
    """zoom, x, y, tolerance_m, vertices: the tiles that the geometries ``g`` cover when simplified for each zoom.

    A tile is covered if a position that stays at its zoom lies in it; ``vertices``
    are those positions.  Tolerances are ``lod_tolerance``'s.  Features without a
    geometry or without positions cover nothing; repeated rows count again.
    """
    if not 0 <= min_zoom <= max_zoom:
        raise ValueError("zooms go from 0 up")
    zoom = F.col("zoom")
    x, y = tiles.tile_x(F.col("lon"), max_zoom).alias("x"), tiles.tile_y(F.col("lat"), max_zoom).alias("y")
    v = vertices(features, key).select(x, y, first_zoom(F.col("weight"), min_zoom, max_zoom, base).alias("first")).where("first IS NOT NULL")
    held = v.groupBy("x", "y", "first").agg(F.count(F.lit(1)).alias("n"))
    above = held.select("x", "y", "n", F.explode(F.sequence("first", F.lit(max_zoom))).alias("zoom"))
    tile = [F.call_function("shiftright", F.col(c), F.lit(max_zoom) - zoom).alias(c) for c in "xy"]  # a tile's parent is half of it, the clamped ones' too
    tolerance = F.get(F.array(*[F.lit(lod_tolerance(z, max_zoom, base)) for z in range(max_zoom + 1)]), zoom)
    return above.select("zoom", *tile, tolerance.alias("tolerance_m"), "n").groupBy("zoom", "x", "y", "tolerance_m").agg(F.sum("n").alias("vertices"))
