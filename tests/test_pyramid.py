"""Significance of vertices and tile pyramids, against simplification done anew for each zoom."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from geoquarry.functions import geometries as G
from geoquarry.operators import pyramid, shapes
from geoquarry.plans.registry import QUERIES


def wiggle(n, seed, closed=False):
    rnd, p, out = random.Random(seed), [37.5, 55.6], []
    for _ in range(n):
        p = [p[0] + rnd.gauss(0, 0.001), p[1] + rnd.gauss(0, 0.0006)]
        out.append(tuple(p))
    return out + [out[0]] if closed else out


def test_one_pass_is_every_tolerance():
    for seed in range(12):
        pts = np.array(wiggle(5 + 40 * seed, seed, closed=seed % 3 == 0))
        weight = pyramid.significance(pts)
        assert np.isinf(weight[[0, -1]]).all()
        for tolerance in (0.5, 3, 10, 40, 77.7, 200, 1e4):
            assert (pts[weight > tolerance] == shapes.simplified(pts, tolerance)).all()
    assert pyramid.significance(np.array([[1.0, 1.0]] * 5)).tolist() == [math.inf, 0, 0, 0, math.inf]


def tile(lon, lat, z):
    n, r = 2**z, math.radians(max(-85.05112878, min(85.05112878, lat)))
    hold = lambda v: max(0, min(n - 1, math.floor(v)))
    return hold((lon + 180) / 360 * n), hold((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)


def test_tiles_of_simplified_geometry(spark):
    lines = {1: ("LineString", [[wiggle(300, 1)]]), 2: ("Polygon", [[wiggle(120, 2, True), wiggle(20, 3, True)]]), 3: ("MultiPoint", [[[(37.5, 55.6)]], [[(179.9999, 89.0)]]]), 4: ("MultiLineString", [[wiggle(3, 4)], [wiggle(2, 5)]]), 5: ("LineString", [[]]), 6: (None, None)}
    rows = [(k, t, None if ps is None else [[[{"lon": x, "lat": y} for x, y in line] for line in part] for part in ps]) for k, (t, ps) in lines.items()]
    f = spark.createDataFrame(rows, "id long, t string, parts array<array<array<struct<lon:double,lat:double>>>>").select("id", F.when(F.col("t").isNotNull(), G.geometry(F.col("t"), F.col("parts"))).alias("g"))
    want = {}
    for z in range(4, 13):
        for t, ps in lines.values():
            for line in [line for part in ps or [] for line in part if line]:
                kept = shapes.simplified(np.array(line), 2.0 * 2 ** (12 - z)) if t != "MultiPoint" else line
                for lon, lat in kept:
                    key = (z, *tile(lon, lat, z), 2.0 * 2 ** (12 - z))
                    want[key] = want.get(key, 0) + 1
    got = {(r.zoom, r.x, r.y, r.tolerance_m): r.vertices for r in pyramid.levels(f, 4, 12).collect()}
    assert got == want
    assert pyramid.levels(f.limit(0), 0, 3).count() == 0
    shown = f.withColumn("w", pyramid.weights(F.col("g"))).select("id", pyramid.simplified(F.col("g"), F.col("w"), 50.0).alias("s"), pyramid.simplified(F.col("g"), F.col("w"), 0.0).alias("same"), "g").collect()
    by = {r.id: r for r in shown}
    assert all(by[k].same == by[k].g for k in lines)
    assert [(p.lon, p.lat) for p in by[1].s.parts[0][0]] == [tuple(p) for p in shapes.simplified(np.array(lines[1][1][0][0]), 50.0).tolist()]
    assert by[3].s == by[3].g and by[6].s is None


def test_lines_split_together_are_as_split_alone(monkeypatch):
    monkeypatch.setattr(shapes, "TOGETHER", 100)  # several groups, lines longer than one
    lines = [np.array(wiggle(n, n, closed=n % 3 == 0)) for n in (1, 2, 3, 70, 5, 240, 9, 1, 33)] + [np.array([[1.0, 1.0]] * 5), np.array(wiggle(40, 1)).round(3)]
    pts, sizes = np.concatenate(lines), np.array([len(x) for x in lines])
    weight = shapes.significances(pts, sizes, np.zeros(len(lines)))
    for tolerance in (0.5, 10, 77.7, 1e4):
        want = np.concatenate([shapes.simplified(x, tolerance) for x in lines])
        assert (pts[weight > tolerance] == want).all()
        assert (pts[shapes.significances(pts, sizes, np.full(len(lines), tolerance)) > 0] == want).all()
    assert len(shapes.significances(pts[:0], sizes[:0], np.zeros(0))) == 0


def test_weights_follow_the_nesting_with_its_nulls(spark):
    at = [{"lon": x, "lat": y} for x, y in wiggle(6, 9)]
    rows = [(1, "Polygon", [[at, []], []]), (2, "LineString", [[None, at[:2]], None]), (3, "MultiPoint", [[at[:1]], [at[1:3]]]), (4, "LineString", None), (5, None, [[at]])]
    f = spark.createDataFrame(rows, "id long, t string, parts array<array<array<struct<lon:double,lat:double>>>>").select("id", G.geometry(F.col("t"), F.col("parts")).alias("g"))
    got = {r.id: r.w for r in f.coalesce(1).select("id", pyramid.weights(F.col("g")).alias("w")).collect()}
    inf, six = math.inf, pyramid.significance(np.array(wiggle(6, 9))).tolist()
    assert got == {1: [[six, []], []], 2: [[None, [inf, inf]], None], 3: [[[inf]], [[inf, inf]]], 4: None, 5: [[[inf] * 6]]}


def test_zooms_are_made_of_counts_and_not_of_vertices(spark):
    for name in ("tp6_pyramid_levels", "sf33_lod_tolerance"):
        df = QUERIES[name].run(spark, "/root/testdata/sf0.001")
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        zooms = next(i for i, x in enumerate(lines) if "Generate explode" in x or "Generate inline" in x)
        assert any("Aggregate [" in x and "first" in x for x in lines[zooms:]), name


def test_simplify_keeps_nulls_and_whole_lines(spark):
    line = [list(p) for p in wiggle(8, 4)]
    df = spark.createDataFrame([(1, line, 0.0), (2, None, 5.0), (3, [], 5.0), (4, line[:1], 5.0), (5, [[*p, 7.0] for p in line], None), (6, line, 60.0)], "id long, l array<array<double>>, t double").coalesce(1)
    got = {r.id: r.s for r in df.select("id", shapes.simplify("l", "t").alias("s")).collect()}
    assert got == {1: line, 2: None, 3: None, 4: line[:1], 5: line, 6: shapes.simplified(np.array(line), 60.0).tolist()}
