"""Joins of boxes of all sizes, against all pairs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from geoquarry.operators import spatial
from geoquarry.plans import joins
from geoquarry.plans.staging import Staging


def boxes(seed, n):
    rnd, out = random.Random(seed), []
    for i in range(n):
        size = 10 ** rnd.uniform(-5, 1.3) if i % 3 else 10 ** rnd.uniform(-4, -2)
        x, y = (rnd.uniform(-180, 180), rnd.uniform(-80, 80)) if i % 2 else (37.5 + rnd.gauss(0, 0.01), 55.6 + rnd.gauss(0, 0.01))
        out.append((i, x, y, x + size * rnd.random(), y + size * rnd.random()))
    return [*out, (n, -180.0, -90.0, 180.0, 90.0), (n + 1, 37.5, 55.6, 37.5, 55.6), (n + 2, 37.25, 55.5, 37.5, 55.625), (n + 3, 37.5, 55.625, 37.75, 55.75)]


ODD = [(9001, None, 0.0, 1.0, 1.0), (9002, float("nan"), 0.0, 1.0, 1.0), (9003, 0.0, 0.0, float("inf"), 1.0)]


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, west double, south double, east double, north double").repartition(3)


def met(a, b):
    return a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]


def test_overlaps_of_sizes_over_six_magnitudes(spark):
    rows = boxes(1, 500)
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            small = min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))
            if w > 0 and h > 0 and small > 0 and w * h / small >= 0.3:
                want[min(a[0], b[0]), max(a[0], b[0])] = w * h / small
    found = spatial.overlap_pairs(frame(spark, rows + ODD), "id", 0.3).collect()
    assert len(found) == len(want) > 500
    assert all(abs(want[r.a, r.b] - r.ratio) < 1e-12 for r in found)
    b = frame(spark, rows).select("id", F.struct(*spatial.EDGES).alias("box"))
    each = spatial.stored(b).groupBy("id").count().agg(F.max("count")).first()[0]
    levels = spatial.levels_of(b)
    asked = spatial.asking(b, levels).groupBy("id").count().agg(F.max("count")).first()[0]
    assert each <= 4 and asked <= 4 * len(levels) and len(levels) < 32  # the box of the whole sphere too


def test_meeting_and_points_against_all_pairs(spark):
    a, b = boxes(2, 150), boxes(3, 120)
    left = frame(spark, a + ODD).select("id", F.struct(*spatial.EDGES).alias("la"))
    right = frame(spark, b + ODD, "other").select("other", F.struct(*spatial.EDGES).alias("lb"))
    got = [(r.id, r.other) for r in spatial.meeting(left, right, "la", "lb").select("id", "other").collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if met(x, y))
    points = [(x[0], x[1], x[2]) for x in a] + [(9001, None, 1.0), (9002, 37.25, 55.5), (9003, 37.5, 55.5)]
    p = spark.createDataFrame(points, "pid long, lon double, lat double")
    inside = [(r.pid, r.other) for r in spatial.points_in_boxes(p, frame(spark, b + ODD, "other")).collect()]
    assert sorted(inside) == sorted((k, y[0]) for k, x1, y1 in points if x1 is not None for y in b if y[1] <= x1 < y[3] and y[2] <= y1 < y[4])
    assert spatial.overlap_pairs(frame(spark, a).limit(0), "id", 0.3).count() == 0
    assert spatial.meeting(left.limit(0), right, "la", "lb").count() == 0


def all_pairs(rows, least):
    """(a, b, ratio to 9 places) of rows of distinct boxes, counted: repeated keys are no pair, repeated rows are several."""
    found = Counter()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            small = min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))
            if a[0] != b[0] and w > 0 and h > 0 and small > 0 and w * h / small >= least:
                found[min(a[0], b[0]), max(a[0], b[0]), round(w * h / small, 9)] += 1
    return found


def test_equal_boxes_are_compared_once_and_crowded_cells_part_by_part(spark, monkeypatch):
    """900 boxes of 30 shapes have some 100,000 pairs; of shapes there are a few hundred, however many copies each has."""
    rnd = random.Random(5)
    shapes = [(37.5 + rnd.randrange(4) * 0.001, 55.6, 37.51 + rnd.randrange(9) * 0.002, 55.61 + rnd.randrange(3) * 0.02) for _ in range(30)]
    rows = [(i, *shapes[i % 30]) for i in range(900)]
    rows += [*rows[:3], (5, *shapes[9]), (2000, -0.0, -0.0, 0.5, 0.5), (2001, 0.0, 0.0, 0.5, 0.5)]
    want = all_pairs(rows, 0.45)
    nulls = [(None, *shapes[0]), *ODD, *[(k, 1.0, 1.0, 1.0, 2.0) for k in (9004, 9005)]]
    met = spatial.overlapping(frame(spark, rows + nulls), "id", 0.45, Staging(spark, "test")).cache()
    assert sum(want.values()) > 50_000 and met.count() <= 31 * 32 / 2 * 4
    as_rows = lambda df: Counter((r.a, r.b, round(r.ratio, 9)) for r in df.collect())
    assert as_rows(spatial.each_pair(met)) == want
    monkeypatch.setattr(spatial, "PACK", 4)
    monkeypatch.setattr(spatial, "CROWD", 8)
    assert as_rows(spatial.overlap_pairs(frame(spark, rows + nulls), "id", 0.45)) == want
    packs = spatial._packs(frame(spark, rows), "id", Staging(spark, "test")).select(F.size("ids").alias("n")).collect()
    assert sum(r.n for r in packs) == len(rows) and max(r.n for r in packs) <= 6 * 4


def test_footprints_that_lie_on_one_another(spark, tmp_path, monkeypatch):
    """jn1 of parts whose footprints repeat: shapes that are compared do not grow with the copies."""
    seen, each = [], spatial.each_pair
    monkeypatch.setattr(spatial, "each_pair", lambda met: (seen.append(met.count()), each(met))[1])
    for copies in (2, 8):
        k = F.col("id") % 6 + F.floor(F.col("id") / 6) * 8633 * 15  # position, thirds and order of copies
        parts = spark.range(6 * copies).select(k.alias("p_partkey"), F.lit(30).alias("p_size"), F.lit("PROMO").alias("p_type"))
        parts.coalesce(1).write.parquet(f"{tmp_path}/{copies}/part.parquet")
        n = joins.jn1(spark, f"{tmp_path}/{copies}").count()
        assert n > 6 * copies * copies
    assert seen[0] == seen[1] > 0
