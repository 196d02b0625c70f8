from geoquarry.operators.versions import against_previous
from geoquarry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
COLS = "id string, domain string, source string, geometry string, state int"


def test_other_id_in_the_same_place_continues(spark):
    before = spark.createDataFrame([("a", "d", "s", "g1", 1, 4), ("b", "d", "s", "g2", 1, 2), ("c", "d", "s", "g3", 1, 1), ("e", "d", "s", "g3", 1, 1)], COLS + ", version int")
    now = spark.createDataFrame([("a", "d", "s", "g9", 1), ("x", "d", "s", "g2", 2), ("y", "d", "s", "g3", 1), ("z", "d", "t", "g2", 1)], COLS)
    got = {(r.id, r.version, r.is_new, r.moved_id) for r in against_previous(now, before).collect()}
    # y stands where two stood and z is of another source: both are new
    assert got == {("a", 4, False, False), ("b", 3, False, True), ("y", 1, True, False), ("z", 1, True, False)}


def test_all_rows_are_versioned(spark):
    rows = QUERIES["jn4_previous_versions"].run(spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert {(r.is_new, r.moved_id) for r in rows.select("is_new", "moved_id").distinct().collect()} == {(True, False), (False, True), (False, False)}
