"""Edges that meet on lines of any length, against the pairs of one row and against each other."""

import math
import random

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G
from geoquarry.operators import edge_index
from geoquarry.plans import figures
from geoquarry.plans.staging import Staging


def star(n, dx=0.0, turns=1):
    at = [2 * math.pi * turns * i / n for i in range(n)]
    ring = [(37.5 + dx + 0.3 * math.cos(t) * (1 + 0.05 * math.sin(9 * t)), 55.6 + 0.2 * math.sin(t)) for t in at]
    return [*ring, ring[0]]


def frame(spark, rows):
    place = "array<struct<lon:double,lat:double>>"
    return spark.createDataFrame([(k, *[[{"lon": x, "lat": y} for x, y in line] for line in lines]) for k, *lines in rows], f"id long, a {place}, b {place}")


def test_same_answers_as_pairs_in_a_row(spark):
    rnd = random.Random(4)
    line = lambda n: [(37 + rnd.randrange(12) * 0.125, 55 + rnd.randrange(12) * 0.125) for _ in range(n)]  # noqa: E731  many touches
    df = frame(spark, [(i, line(rnd.randrange(2, 6)), line(rnd.randrange(2, 5))) for i in range(150)] + [(900, line(1), line(3))])
    direct = F.exists(G.rings.edges(F.col("a")), lambda x: F.exists(G.rings.edges(F.col("b")), lambda y: G.segments_meet(x, y)))
    edge = lambda c: F.exists(G.rings.edges(F.col(c)), lambda e: (e["x1"] == e["x2"]) & (e["y1"] == e["y2"]))  # noqa: E731  no edge: its end would touch anything
    df = df.where(~edge("a") & ~edge("b"))
    want = {r.id: r.meet for r in df.select("id", direct.alias("meet")).collect()}
    assert {r.id: r.meet for r in edge_index.lines_meet(df, "id", F.col("a"), F.col("b")).collect()} == want
    assert {True, False} <= set(want.values())
    rings_ = df.select("id", F.concat("a", F.slice("a", 1, 1)).alias("r")).where(F.size("r") > 3)
    crossing = {r.id for r in rings_.where(G.crosses_itself(F.col("r"))).collect()}
    assert {r.key for r in edge_index.self_crossings(edge_index.edges_of(rings_, "id", F.col("r"))).collect()} == crossing


def test_rings_of_a_hundred_thousand_vertices(spark):
    n = 100_000
    df = frame(spark, [(1, star(n), star(n, 0.1)), (2, star(n), star(n, 5.0))])
    assert {r.id: r.meet for r in edge_index.lines_meet(df, "id", F.col("a"), F.col("b")).collect()} == {1: True, 2: False}
    once = edge_index.edges_of(df.where("id = 1"), "id", F.col("a"))
    assert edge_index.self_crossings(once).count() == 0
    twice = spark.createDataFrame([(7, i, *p, *q) for i, (p, q) in enumerate(zip(star(9999, turns=2), star(9999, turns=2)[1:], strict=False))], "key long, n long, x1 double, y1 double, x2 double, y2 double")
    pairs = edge_index.self_crossings(twice).collect()
    assert pairs and all(r.i < r.j for r in pairs) and len({(r.i, r.j) for r in pairs}) == len(pairs)


def test_long_edges_among_short_ones_meet_along_their_way(spark):
    """Short steps and jumps right across them: jumps used to meet every short edge of their box."""
    line = [(i * 0.001 % 0.2, (i // 200) * 0.0011 + i * 0.001 % 0.2) for i in range(3000)]
    edges = [(0, n, *line[n], *line[n + 1]) for n in range(len(line) - 1)]
    side = lambda e, x, y: (e[4] - e[2]) * (y - e[3]) - (e[5] - e[3]) * (x - e[2])
    jumps = [e for e in edges if abs(e[4] - e[2]) > 0.01]
    want = set()
    for a in jumps:
        for b in edges:
            if abs(a[1] - b[1]) > 1 and side(a, b[2], b[3]) * side(a, b[4], b[5]) < 0 and side(b, a[2], a[3]) * side(b, a[4], a[5]) < 0:
                want.add((min(a[1], b[1]), max(a[1], b[1])))
    df = spark.createDataFrame(edges, "key int, n long, x1 double, y1 double, x2 double, y2 double")
    got = [(r.i, r.j) for r in edge_index.self_crossings(df).collect()]
    assert len(got) == len(set(got)) and {(i, j) for i, j in got if edges[i] in jumps or edges[j] in jumps} == want
    cells = df.select(F.struct("x1", "y1", "x2", "y2").alias("e")).select(F.size(edge_index._passed(F.col("e"), F.lit(-8))).alias("n"))
    assert cells.agg(F.sum("n")).first()[0] < 5 * len(edges)


def test_a_line_that_repeats_its_way_makes_no_pairs_of_repeats(spark, tmp_path, monkeypatch):
    """Crossings grow with the square of the rounds; edges that are looked at do not grow with them at all."""
    rnd, seen, crossings = random.Random(9), [], edge_index.self_crossings
    monkeypatch.setattr(edge_index, "self_crossings", lambda e: (seen.append(e.count()), crossings(e))[1])
    monkeypatch.setattr(edge_index, "SPAN_BITS", 3)  # sums go over many spans
    way = [(rnd.randrange(40) * 0.125, rnd.randrange(40) * 0.125) for _ in range(12)]
    line = [*way, *way, (7.0, 1.0), *way[:5], (-1.0, -1.0), *way * 9]
    edges = [(7, n, *line[n], *line[n + 1]) for n in range(len(line) - 1)]
    edges += [*edges[20:23], *[(8, n, *way[n], *way[n + 1]) for n in range(11)], (9, 0, None, 0.0, 1.0, 1.0)]
    side = lambda e, x, y: (e[4] - e[2]) * (y - e[3]) - (e[5] - e[3]) * (x - e[2])
    cross = lambda a, b: side(a, b[2], b[3]) * side(a, b[4], b[5]) < 0 and side(b, a[2], a[3]) * side(b, a[4], a[5]) < 0
    want = {}
    for a in edges[:-1]:
        for b in edges[:-1]:
            if a[0] == b[0] and a[1] + 1 < b[1] and cross(a, b):
                n, first, last = want.get(a[:2], (0, b[1], b[1]))
                want[a[:2]] = (n + 1, min(first, b[1]), max(last, b[1]))
    df = spark.createDataFrame(edges, "key int, n long, x1 double, y1 double, x2 double, y2 double")
    found = edge_index.later_crossings(df, Staging(spark, "test")).collect()
    assert len(found) == len(want) > 100 and {(r.key, r.i): (r.crossings, r["first"], r["last"]) for r in found} == want
    assert seen == [len({(e[0], *e[2:]) for e in edges})]
    customers = spark.range(4 * 211 * 197, 4 * 211 * 197 + 300).union(spark.range(300)).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"))
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    twice = {r.i: r.crossings for r in figures.long_line(spark, str(tmp_path)).collect()}
    assert seen[1] == 299 and twice  # of 598 edges
    assert all(twice[i] >= twice[i + 4 * 211 * 197] for i in twice if i + 4 * 211 * 197 in twice)
