"""Plans and readers whose memory or tasks must not grow with the whole table."""

import tracemalloc

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G
from geoquarry.operators import sessions, spatial
from geoquarry.operators.components import components
from geoquarry.plans import hub
from geoquarry.plans.staging import Staging
from geoquarry.sources import binary

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_dxf_entities_are_read_one_after_the_other():
    section = "0\nSECTION\n2\nENTITIES\n0\nPOLYLINE\n8\nl1\n0\nVERTEX\n10\n1.5\n20\n2.5\n0\nVERTEX\r\n10\n3\n20\n4\n0\nSEQEND\n0\nPOINT\n8\nl  10\n7\n20\n8\n0\nENDSEC\n0\nPOINT\n10\n1\n20\n1\n"
    kinds = [(r["id"], r["type"], len(r["parts"][0][0])) for r in binary.dxf_rows((section * 2 + "0").encode())]
    assert kinds == [("0", "LineString", 2), ("1", "Point", 1), ("2", "LineString", 2), ("3", "Point", 1)]
    data = (section * 20_000).encode()
    tracemalloc.start()
    n = sum(1 for _ in binary.dxf_rows(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and peak < 2 * len(data)


def test_roles_make_no_groups_of_their_own(spark):
    lines = [x for x in plan_of(hub.first_available(spark, SF)) if "Aggregate [" in x]
    assert len(lines) == 1 and "Aggregate [building_id" in lines[0] and "role" not in lines[0].split("]")[0]


def test_territory_candidates_are_dealt_before_rings_are_tested(spark):
    box = lambda w, s, e, n: F.array(G.point(F.lit(w), F.lit(s)), G.point(F.lit(e), F.lit(s)), G.point(F.lit(e), F.lit(n)), G.point(F.lit(w), F.lit(n)), G.point(F.lit(w), F.lit(s)))
    spot = G.geometry("Point", F.array(F.array(F.array(G.point(F.col("id") * 0.1, F.lit(0.5))))))
    features = spark.range(30).repartition(2, "id").select("id", spot.alias("g"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    empty = spark.range(1).select((F.col("id") - 1).alias("id"), G.geometry("Point", F.array().cast("array<array<array<struct<lon:double,lat:double>>>>")).alias("g"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    territories = spark.range(1).select(F.col("id").alias("t"), box(0.05, 0.0, 1.05, 1.0).alias("ring"))
    met = spatial.in_territories(features.unionByName(empty), territories)
    assert sorted(r.id for r in met.collect()) == list(range(1, 11))
    lines = plan_of(met)
    first = lambda kind: next(i for i, x in enumerate(lines) if kind in x)
    assert first("RepartitionByExpression") < first("Join")


def test_links_of_sessions_are_pairs_of_keys_and_not_rows(spark, monkeypatch):
    df = spark.range(600).select("id", F.concat(F.lit("a"), F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "b").alias("b"))
    seen = []
    monkeypatch.setattr(sessions, "components", lambda edges, staging: seen.append(edges.count()) or components(edges, staging))
    stay = sessions.first_by_either(df, "id", ("a", "b"), Staging(spark, "t"))
    assert sorted(r.id for r in stay.collect()) == [0, 1] and seen == [6]
