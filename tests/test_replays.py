"""Queries that SQL cannot express, against plain loops."""

from geoquarry.plans import fixtures
from geoquarry.plans.registry import QUERIES
from geoquarry.plans.joins import FUNCTION, GEOMETRY

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    w, h = min(a.east, b.east) - max(a.west, b.west), min(a.north, b.north) - max(a.south, b.south)
    small = min((a.east - a.west) * (a.north - a.south), (b.east - b.west) * (b.north - b.south))
    return w * h / small if w > 0 and h > 0 and small > 0 else 0.0


def replay(rows):
    """ordinal -> founder, candidate by candidate."""
    founders, of = [], {}
    for c in sorted(rows, key=lambda r: r.ordinal):
        met = next((f for f in founders if ratio(c, f) >= 0.45), None)
        if met is None:
            founders.append(c)
        of[c.ordinal] = (met or c).ordinal
    return of


def test_greedy_groups_and_fusion(spark):
    rows = fixtures.candidates(spark, SF).collect()
    of = replay(rows)
    got = {r.ordinal: r.founder for r in QUERIES["jn2_greedy_groups"].run(spark, SF).collect()}
    assert got == of
    one = QUERIES["ag21_fusion_statistics"].run(spark, SF).first()
    assert (one.input, one.fused, one.collapsed) == (len(rows), len(set(of.values())), len(rows) - len(set(of.values())))

    groups = {}
    for r in sorted(rows, key=lambda r: r.ordinal):
        groups.setdefault(of[r.ordinal], []).append(r)

    def pick(members, field, order):
        for s in order:
            for m in members:
                if m.source == s and getattr(m, field) is not None:
                    return getattr(m, field)

    fused = {r.founder: r for r in QUERIES["tk3_pl4_fused_buildings"].run(spark, SF).collect()}
    assert set(fused) == set(groups)
    for f, members in groups.items():
        assert fused[f].members == len(members)
        assert fused[f].source == pick(members, "source", GEOMETRY)
        assert fused[f].height == pick(members, "height", GEOMETRY)
        assert fused[f].levels == pick(members, "levels", FUNCTION)
        assert fused[f].usage == pick(members, "usage", FUNCTION)


def test_hilbert_ids(spark):
    def along(x, y, z):
        d, s = 0, (1 << z) >> 1
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * ((3 * rx) ^ ry)
            if not ry:
                if rx:
                    x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
                x, y = y, x
            s >>= 1
        return d + sum(4**i for i in range(z))

    for r in QUERIES["tp4_hilbert_ids"].run(spark, SF).collect():
        assert r.tile_id == along(r.x, r.y, 10)
