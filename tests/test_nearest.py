import math
import random

import pytest

from geoquarry.functions import geo
from geoquarry.operators.nearest import PLANE, SPHERE, nearest
from geoquarry.plans.staging import Staging


def metres(a, b, c, d):
    h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * geo.EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


def squares(a, b, c, d):
    return (a - c) ** 2 + (b - d) ** 2


def frames(spark, points, stops):
    p = spark.createDataFrame(points, "poi_id long, lon double, lat double")
    return p.repartition(4), spark.createDataFrame(stops, "stop_id long, t_lon double, t_lat double").repartition(3)


def test_far_stops_are_found_and_no_stops_give_null(spark):
    # 1: a stop at 5 km of latitude, a nearer one by longitude; 2: nothing near; 3: over the date line
    points = [(1, 37.5001, 55.6), (2, 10.0, -20.0), (3, 179.99, 0.0), (4, None, 1.0), (5, float("nan"), 1.0), (5, 37.5, 55.6)]
    stops = [(10, 37.5001, 55.645), (11, 37.5621, 55.6), (12, -179.99, 0.0), (13, 178.0, 0.0), (14, None, 0.0)]
    p, s = frames(spark, points, stops)
    got = {(r.poi_id, str(r.far is None)): r for r in nearest(p, s, "poi_id", "stop_id", SPHERE, Staging(spark, "t")).collect()}
    for k, lon, lat in points[:3]:
        m, at = min((metres(lon, lat, x, y), i) for i, x, y in stops[:4])
        assert got[k, "False"].stop_id == at and abs(got[k, "False"].far - m) < 1e-3
    assert got[4, "True"].stop_id is None and {k for k in got if k[0] == 5} == {(5, "True"), (5, "False")}
    none = nearest(p, s.limit(0), "poi_id", "stop_id", SPHERE, Staging(spark, "t")).collect()
    assert sorted((r.poi_id, r.far) for r in none) == [(i, None) for i in (1, 2, 3, 4, 5, 5)]
    assert nearest(p.limit(0), s, "poi_id", "stop_id", SPHERE, Staging(spark, "t")).count() == 0


def places(rnd, n):
    """Dense pockets, single places, ties on a lattice, repeats, all over the sphere."""
    out = []
    for _ in range(n):
        kind = rnd.randrange(4)
        if kind == 0:
            out.append((37.5 + rnd.gauss(0, 1e-4), 55.6 + rnd.gauss(0, 1e-4)))
        elif kind == 1:
            out.append((rnd.uniform(-180, 180), rnd.uniform(-90, 90)))
        elif kind == 2:
            out.append((float(rnd.randrange(-180, 181, 60)), float(rnd.randrange(-90, 91, 30))))
        else:
            out.append((rnd.choice([-179.999, 179.999]) + rnd.uniform(-1e-3, 1e-3), rnd.uniform(-1, 1)))
    return out


@pytest.mark.parametrize(("metric", "far"), [(SPHERE, metres), (PLANE, squares)])
def test_against_all_pairs(spark, metric, far):
    rnd = random.Random(8)
    stops = [(i % 700, x, y) for i, (x, y) in enumerate(places(rnd, 800))]
    points = [(i, x, y) for i, (x, y) in enumerate(places(rnd, 150))]
    p, s = frames(spark, points, stops)
    got = {r.poi_id: (r.stop_id, r.far) for r in nearest(p, s, "poi_id", "stop_id", metric, Staging(spark, "t")).collect()}
    assert len(got) == len(points)
    for k, lon, lat in points:
        best = min(far(lon, lat, x, y) for _, x, y in stops)
        assert abs(got[k][1] - best) <= 1e-6 * max(best, 1e-6) + (1e-5 if far is metres else 0)
        near = {i for i, x, y in stops if far(lon, lat, x, y) <= best * (1 + 1e-12) + 1e-12}
        assert got[k][0] == min(near) or (len(near) > 1 and got[k][0] in near)


def test_dense_targets_and_far_points_stay_linear(spark):
    rnd = random.Random(9)
    stops = [(i, 37.5 + rnd.gauss(0, 0.01), 55.6 + rnd.gauss(0, 0.01)) for i in range(20_000)]
    points = [(i, rnd.uniform(30, 45), rnd.uniform(50, 60)) for i in range(1000)]
    p, s = frames(spark, points, stops)
    staging = Staging(spark, "t")
    got = nearest(p, s, "poi_id", "stop_id", PLANE, staging)
    held = spark.read.option("pathGlobFilter", "*.parquet").parquet(*[f"{staging.root}/*-nearest"]).selectExpr("sum(size(open)) AS n", "max(size(open)) AS most").first()
    assert held.n < 30 * len(points) and held.most < 60  # cells held over all rounds; all pairs would be 20,000 a point
    at = {r.poi_id: r.stop_id for r in got.collect()}
    for k, lon, lat in points[:40]:
        assert at[k] == min((squares(lon, lat, x, y), i) for i, x, y in stops)[1]
