import json

import pytest
from pyspark.sql import functions as F

from geoquarry.sources import formats, writers
from geoquarry.streaming import ingest

SF = "/root/testdata/sf0.001"
POINT = {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"n": "x"}}


def test_geojson_collections_lists_and_single_features(spark, tmp_path):
    no_shape = {"type": "Feature", "geometry": None, "properties": {}}
    by_property = {"type": "Feature", "geometry": POINT["geometry"], "properties": {"fid": 7}}
    for name, value in (("a", {"type": "FeatureCollection", "features": [POINT, no_shape]}), ("b", [by_property]), ("c", POINT), ("d", {"type": "Point"})):
        (tmp_path / f"{name}.geojson").write_text(json.dumps(value, indent=1))
    got = {(r.dataset, r.id) for r in formats.read_geojson(spark, str(tmp_path)).collect()}
    assert got == {("a.geojson", "a"), ("b.geojson", "7"), ("c.geojson", "a")}


def test_csv_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text('name,X,lat\n"a ""b"", c",1.5,2\nd,east,3\ne,,4\nf,5,NaN\n')
    rows = formats.read_csv_points(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in rows] == [('a "b", c', 1.5, 2.0)]
    (tmp_path / "q.csv").write_text("name,east\na,1\n")
    with pytest.raises(ValueError):
        formats.read_csv_points(spark, str(tmp_path / "q.csv"))


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -1\n1 2 -1\n4 5 6.5\n")
    rows = {(r.row, r.col): (r.lon, r.lat, r.elevation) for r in formats.read_ascii_grid(spark, str(tmp_path)).collect()}
    assert rows == {(0, 0): (10.5, 21.5, 1.0), (0, 1): (11.5, 21.5, 2.0), (1, 0): (10.5, 20.5, 4.0), (1, 1): (11.5, 20.5, 5.0), (1, 2): (12.5, 20.5, 6.5)}


def test_sizes_names_and_prisms(spark):
    df = spark.createDataFrame([("12.5MB", "A b/c"), ("3", None), ("x", "--"), (None, "ok.txt")], "t string, n string")
    rows = df.select(formats.size_bytes(F.col("t")), writers.safe_name(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(13107200, "a-b-c"), (3, "export"), (None, "export"), (None, "ok.txt")]
    ring = F.expr("array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 1D, 'lat', 0D), named_struct('lon', 1D, 'lat', 1D))")
    lines = spark.range(1).select(writers.prism(ring, F.lit(9.0), F.lit(6))).first()[0]
    assert len(lines) == 6 + 3 + 1 and lines[3] == "v 0.0 0.0 9.0" and lines[6] == "f 7 8 11 10" and lines[8] == "f 9 7 10 12" and lines[9] == "f 10 11 12"


def test_stream_counts_what_a_table_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = ingest.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("windowed")) == key(ingest.windowed_counts(events))
    once = ingest.first_of_key(stream, "event_type").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == events.select("event_type").distinct().count()
