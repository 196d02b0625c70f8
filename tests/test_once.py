"""Expressions name a value worked out before once, and rows of a small file are dealt to many tasks."""

from pyspark.sql import functions as F

from geoquarry.functions import geometries as G, rings
from geoquarry.plans.registry import QUERIES


def test_clip_is_worked_out_once(spark):
    ring = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    clip = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 1), (9, 1), (9, 9), (1, 9), (1, 1))])
    area = rings.planar_area(G.clipped_to_ring(ring, clip))
    assert str(area).count("aggregate(") == 2  # the clip's and the area's own; it was dozens
    assert spark.range(1).select(area).first()[0] == 9.0
    none = rings.planar_area(G.clipped_to_ring(F.lit(None).cast(G.POSITIONS), clip))
    assert spark.range(1).select(none).first()[0] is None


def test_rows_of_one_file_are_dealt_out(spark):
    got = QUERIES["ge12_clipped_to_box"].run(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_as_many_names_as_geometries(spark, tmp_path):
    """Of 150,000 geometries some share a hash of 32 bits."""
    spark.range(300_000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    one = QUERIES["sf22_geometry_identities"].run(spark, str(tmp_path)).first()
    assert one.ids == one.features > 100_000


def test_territory_is_worked_out_once(spark):
    cut = str(G.in_territory(F.col("figure"), F.col("outline")))
    assert cut.count("outline") == 2  # its box and its edges, not at each test of a point


def test_half_chords_are_worked_out_once(spark):
    metres = str(rings.length(F.col("line")))
    assert metres.lower().count("cos(") == 2  # of both latitudes; the squared half chord was written out twice


def test_lengths_of_figures_are_worked_out_once(spark):
    plan = QUERIES["ge4_ge5_figure_measures"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("atan2(") == 1
