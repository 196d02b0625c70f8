"""Geometry that SQL cannot express, against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from geoquarry.operators import shapes, voronoi
from geoquarry.plans import figures as X
from geoquarry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def even_odd(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def on(p, a, b):
    cross = (p[1] - a[1]) * (b[0] - a[0]) - (p[0] - a[0]) * (b[1] - a[1])
    dot = (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
    return abs(cross) <= 1e-9 and -1e-9 <= dot <= (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2 + 1e-9


def covers(ring, p):
    return any(on(p, a, b) for a, b in zip(ring, ring[1:], strict=False)) or even_odd(ring, *p)


def parts_of(g):
    return [[[(p.lon, p.lat) for p in line] for line in part] for part in g.parts]


def flat(g):
    return [p for part in parts_of(g) for line in part for p in line]


def metres(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_longest_runs_in_a_territory(spark):
    rows = X.in_ells(spark, SF).collect()
    lines = 0
    for r in rows:
        ring = [(p.lon, p.lat) for p in r.ring]
        if r.g.type != "LineString":
            continue
        line, best, run = flat(r.g), [], []
        for a, b in zip(line, line[1:], strict=False):
            cuts = [0.0, 1.0]
            for c, d in zip(ring, ring[1:], strict=False):
                det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
                if abs(det) > 1e-12:
                    t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
                    u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / det
                    if -1e-10 <= t <= 1 + 1e-10 and -1e-10 <= u <= 1 + 1e-10:
                        cuts.append(min(1.0, max(0.0, t)))
            cuts.sort()
            at = lambda t, a=a, b=b: (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
            for f, t in zip(cuts, cuts[1:], strict=False):
                if t - f <= 1e-10:
                    continue
                if even_odd(ring, *at((f + t) / 2)):
                    run = [*run, at(t)] if run and math.dist(run[-1], at(f)) < 1e-9 else [at(f), at(t)]
                    best = run if len(run) > len(best) else best
                else:
                    run = []
        lines += 1
        got = [] if r.cut is None else flat(r.cut)
        assert len(got) == len(best) and all(math.dist(p, q) < 1e-9 for p, q in zip(got, best, strict=True))
    assert lines > 20


def meet(s, t):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sign = lambda v: 0 if abs(v) < 1e-12 else (1 if v > 0 else -1)
    d = [sign(turn(*s, t[0])), sign(turn(*s, t[1])), sign(turn(*t, s[0])), sign(turn(*t, s[1]))]
    if d[0] * d[1] < 0 and d[2] * d[3] < 0:
        return True
    return any(d[i] == 0 and on(p, *e) for i, (p, e) in enumerate([(t[0], s), (t[1], s), (s[0], t), (s[1], t)]))


def test_predicates_of_pairs(spark):
    got = {r.id: r for r in QUERIES["fp16_predicates"].run(spark, SF).collect()}
    seen = set()
    for r in X.pairs_of(spark, SF).collect():
        a, b = r.g, r.h
        pa, pb = flat(a), flat(b)
        box = lambda ps: (min(x for x, _ in ps), min(y for _, y in ps), max(x for x, _ in ps), max(y for _, y in ps))
        ba, bb = box(pa), box(pb)
        near = ba[0] <= bb[2] and ba[2] >= bb[0] and ba[1] <= bb[3] and ba[3] >= bb[1]
        ring = lambda g: parts_of(g)[0][0]
        edges = lambda g: [e for line in parts_of(g)[0] for e in zip(line, line[1:], strict=False)] if g.type in ("LineString", "Polygon") else []
        on_line = lambda p, g: any(on(p, *e) for e in edges(g))

        def hits():
            if not near:
                return False
            for p, q in ((a, b), (b, a)):
                if p.type == "Point" and q.type == "Polygon":
                    return covers(ring(q), flat(p)[0])
            for p, q in ((a, b), (b, a)):
                if p.type == "Point" and q.type == "LineString":
                    return on_line(flat(p)[0], q)
            if any(meet(s, t) for s in edges(a) for t in edges(b)):
                return True
            if a.type == "Polygon":
                return any(covers(ring(a), p) for p in pb)
            if b.type == "Polygon":
                return any(covers(ring(b), p) for p in pa)
            return True

        holds = lambda p, q, bp, bq: bp[0] <= bq[0] and bp[1] <= bq[1] and bp[2] >= bq[2] and bp[3] >= bq[3] and (all(covers(ring(p), z) for z in flat(q)) if p.type == "Polygon" else p == q)
        want = (hits(), not hits(), holds(a, b, ba, bb), holds(b, a, bb, ba), a == b, a.type == "Point" and b.type == "Polygon" and covers(ring(b), pa[0]), a.type == "Point" and b.type == "LineString" and on_line(pa[0], b))
        g = got[r.id]
        assert (g.intersects, g.disjoint, g.contains, g.within, g.equals, g.point_in_polygon, g.point_on_line) == want, r
        seen.add(want)
    assert len(seen) > 4


def thinned(line, tolerance):
    if len(line) < 3:
        return line
    base, worst, at = metres(line[0], line[-1]), 0.0, 0
    for i in range(1, len(line) - 1):
        p, q = metres(line[0], line[i]), metres(line[-1], line[i])
        s = (base + p + q) / 2
        d = 2 * math.sqrt(max(s * (s - base) * (s - p) * (s - q), 0)) / base if base else p
        if d > worst:
            worst, at = d, i
    if worst <= tolerance:
        return [line[0], line[-1]]
    return thinned(line[: at + 1], tolerance)[:-1] + thinned(line[at:], tolerance)


def test_simplification(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(40):
        x, y, line = 37.5, 55.6, []
        for _ in range(rnd.randrange(2, 40)):
            x, y = x + rnd.random() * 1e-3, y + (rnd.random() - 0.5) * 1e-3
            line.append([x, y])
        rows.append((i, line if i % 3 else [*line, line[0]]))
    df = spark.createDataFrame(rows, "id int, line array<array<double>>")
    for r in df.select("id", shapes.simplify("line", F.lit(40.0)).alias("s")).collect():
        assert [tuple(p) for p in r.s] == thinned([tuple(p) for p in rows[r.id][1]], 40.0)


def test_rings_for_drawing(spark):
    ring = [[float(x), float(y)] for x, y in ((0, 0), (0, 0), (0.5, 1e-6), (1, 0), (float("nan"), 1), (1, 1), (0, 1), (0, 0))]
    df = spark.createDataFrame([(1, ring, 0.0), (2, ring, 1.25), (3, [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]], 0.0), (4, None, 0.0)], "id int, ring array<array<double>>, t double")
    got = {r.id: r.d for r in df.select("id", shapes.clean_ring("ring", "t").alias("d")).collect()}
    assert got[1] == [[0, 0], [0.5, 1e-6], [1, 0], [1, 1], [0, 1], [0, 0]]
    assert got[2] == [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    assert got[3] is None and got[4] is None
    cleaned = QUERIES["ge25_drawn_rings"].run(spark, SF).collect()
    assert {r.positions for r in cleaned} == {8, 6} and all(abs(r.planar - 25.5) < 0.01 for r in cleaned)


def test_cells_share_the_box(spark):
    rnd = random.Random(6)
    box = (10.0, 50.0, 10.4, 50.3)
    sites = [(i, 10 + rnd.random() * 0.4, 50 + rnd.random() * 0.3) for i in range(30)]
    df = spark.createDataFrame([*sites, (99, sites[0][1], sites[0][2])], "id int, lon double, lat double")
    cells = {r.id: [tuple(p) for p in r.ring] for r in voronoi.voronoi(df, "id", box).collect()}
    assert cells[99] == cells[0] and len(cells) == 31
    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2
    assert abs(sum(area(c) for k, c in cells.items() if k != 99) - 0.4 * 0.3) < 1e-4
    for _ in range(200):
        p = (10 + rnd.random() * 0.4, 50 + rnd.random() * 0.3)
        far = sorted((metres(p, s[1:]), s[0]) for s in sites)
        if far[1][0] - far[0][0] > 50:
            assert covers(cells[far[0][1]], p)


def test_cells_of_uneven_sites_are_closed_by_all_sites(spark, monkeypatch):
    """Dense pockets beside far single sites: every cell is what all other sites leave of the box."""
    monkeypatch.setattr(voronoi, "NEAR", 60)  # most cells need more than their own blocks
    rnd, box = random.Random(12), (20.0, 40.0, 20.4, 40.3)
    sites = [(i, 20.1 + rnd.gauss(0, 0.004), 40.1 + rnd.gauss(0, 0.004)) for i in range(90)] + [(200 + i, rnd.uniform(19.9, 20.5), rnd.uniform(39.9, 40.4)) for i in range(30)]
    df = spark.createDataFrame([*sites, (500, None, 41.0)], "id long, lon double, lat double").repartition(3)
    got = {r.id: np.array(r.ring) for r in voronoi.voronoi(df, "id", box).collect()}
    frame = np.array([(20.0, 40.0), (20.4, 40.0), (20.4, 40.3), (20.0, 40.3), (20.0, 40.0)])
    area = lambda r: abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2
    for k, *at in sites:
        want = shapes.voronoi_cell(np.array(at), np.array([s[1:] for s in sites if s[0] != k]), frame)
        assert (k in got) == (want is not None)
        if want is not None:
            want = shapes.along_great_circles(want, frame)
            assert abs(area(got[k] - frame[0]) - area(want - frame[0])) <= 1e-9 + 1e-5 * area(want - frame[0])
            corners = np.array([[shapes.metres(c, np.array(s[1:])) for s in sites] for c in got[k]])
            own = corners[:, [s[0] for s in sites].index(k)]
            assert (own <= corners.min(axis=1) * (1 + 1e-5) + 0.01).all()  # no site is nearer to a corner
    assert voronoi.voronoi(df.limit(0), "id", box).count() == 0
