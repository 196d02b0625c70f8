"""Readers of spatial file formats, as scans and built-in functions.

Formats with a feature a line split within files; a format that is one document
a file (GeoJSON collections, KML, ASCII grids) is read whole by one task a file,
so large inputs should come as many files.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Accepted names of coordinate columns, in order of preference; nodata default of grids.
LON_NAMES, LAT_NAMES = ("lon", "lng", "longitude", "x"), ("lat", "latitude", "y")
NODATA = -9999.0
FEATURE = "struct<type:string,id:string,geometry:string,properties:string>"


def features_of(text: Column) -> Column:
    """Array of features (nested values as JSON text) of a collection, a list of features or a single one; else empty."""
    listed = F.from_json(text, f"array<{FEATURE}>")
    held = F.from_json(text, f"struct<features:array<{FEATURE}>>")["features"]
    one = F.from_json(text, FEATURE)
    kind = F.get_json_object(text, "$.type")
    none = F.from_json(F.lit("[]"), f"array<{FEATURE}>")
    return F.coalesce(F.when(F.ltrim(text).startswith("["), listed).when(kind == "FeatureCollection", held).when(kind == "Feature", F.array(one)), none)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, geometry, properties (JSON text), dataset (file name) of every feature in a file or folder; features without geometry are left out."""
    whole = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("dataset"))
    return _features(whole.select(F.explode(features_of(F.col("value"))).alias("f"), "dataset"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of one feature a line (plain or gzip)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _features(lines.select(F.from_json("value", FEATURE).alias("f"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("dataset")))


def _features(f: DataFrame) -> DataFrame:
    names = F.coalesce(F.col("f.id"), *[F.get_json_object("f.properties", f"$.{k}") for k in ("id", "fid", "wikidata")])
    return f.where(F.col("f.geometry").isNotNull()).select(names.alias("id"), F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"), "dataset")


def read_csv_points(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, then lon and lat as doubles, found by column name; rows without finite coordinates are left out.

    Quoted fields may hold line breaks, so a file is read by one task; with
    ``multi_line`` off, for files that are known to have none, files split.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    found = {c.strip().lstrip("\ufeff").lower(): c for c in reversed(rows.columns)}
    x, y = (next((found[n] for n in names if n in found), None) for names in (LON_NAMES, LAT_NAMES))
    if x is None or y is None:
        raise ValueError(f"no coordinate columns among {rows.columns}")
    lon, lat = F.expr(f"try_cast(trim(`{x}`) AS double)"), F.expr(f"try_cast(trim(`{y}`) AS double)")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (x, y)]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.select(*others, lon.alias("lon"), lat.alias("lat")).where(finite("lon") & finite("lat"))


def size_bytes(text: Column) -> Column:
    """Bytes of texts such as ``12.3MB``, by powers of 1024; null where it is none."""
    upper, pattern = F.upper(text), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?\s*$"
    number = F.nullif(F.regexp_extract(upper, pattern, 1), F.lit("")).cast("double")
    unit = F.regexp_extract(upper, pattern, 2)
    power = F.when(unit == "", 0).otherwise(F.position(unit, F.lit("KMGT")))
    return F.round(number * F.pow(F.lit(1024.0), power)).cast("long")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, lon, lat, elevation of every cell with data of ASCII grids.

    The header gives columns, rows, cell size, nodata and either the lower-left
    corner or the lower-left centre; row 0 is the northernmost.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("t"))
    key = lambda k: F.expr(f"try_cast(nullif(regexp_extract(t, '(?im)^[ \\\\t]*{k}[ \\\\t]+(\\\\S+)', 1), '') AS double)")
    size = key("cellsize")
    west = F.coalesce(key("xllcorner") + size / 2, key("xllcenter"))
    south = F.coalesce(key("yllcorner") + size / 2, key("yllcenter"))
    body = F.filter(F.split("t", r"\r?\n"), lambda r: r.rlike(r"^\s*-?[0-9.]"))
    g = whole.select("file", size.alias("size"), west.alias("west"), south.alias("south"), key("nrows").alias("n"), F.coalesce(key("nodata_value"), F.lit(NODATA)).alias("nodata"), F.posexplode(body).alias("row", "line"))
    cells = g.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "cell")).withColumn("elevation", F.col("cell").try_cast("double"))
    lat = F.col("south") + (F.col("n") - 1 - F.col("row")) * F.col("size")
    return cells.where("elevation IS NOT NULL AND elevation <> nodata").select("file", "row", "col", (F.col("west") + F.col("col") * F.col("size")).alias("lon"), lat.alias("lat"), "elevation")


def read_kml_points(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat of the placemarks with a point."""
    marks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<Placemark\b.*?</Placemark>"), F.lit(0))).alias("m"))
    at = F.split(F.trim(F.regexp_extract("m", r"(?is)<Point>.*?<coordinates>(.*?)</coordinates>", 1)), r"\s*,\s*")
    name = F.regexp_extract("m", r"(?is)<name>(.*?)</name>", 1)
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        name = F.replace(name, F.lit(mark), F.lit(char))
    out = marks.select(name.alias("name"), F.get(at, 0).try_cast("double").alias("lon"), F.get(at, 1).try_cast("double").alias("lat"))
    return out.where("lon IS NOT NULL AND lat IS NOT NULL")


# Formats that are known but not read, with what they would need.
UNSUPPORTED = {
    "geotiff": "raster bands",
    "geoparquet": "columnar metadata and geometry",
    "dem": "raster bands",
    "raster-dem": "raster bands",
}


def parse_box(text: str | None) -> tuple[float, float, float, float]:
    """``west,south,east,north`` of four finite numbers with west below east and south below north; else an error."""
    try:
        west, south, east, north = (float(x) for x in (text or "").split(","))
    except ValueError as e:
        raise ValueError(f"a box is four numbers, not {text!r}") from e
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError(f"no box: {text!r}")
    return west, south, east, north


def in_box(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose west, south, east, north meet a box, edges included: four comparisons that reach the scan."""
    west, south, east, north = (F.lit(x) for x in box)
    return rows.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))


def read_quadkey_partitions(spark: SparkSession, index: str, box: tuple, zoom: int = 9, max_files: int = 64, max_bytes: int = 128 << 20) -> tuple[DataFrame | None, dict]:
    """Features of the gzip line files that an index (QuadKey, Url, Size) lists for the tiles of a box, and how complete that is.

    The index is filtered by Spark; what comes to the driver are the paths of at
    most ``max_files`` files, as there are no more to read.  Files above ``max_bytes`` are left out.
    """
    from geoquarry.functions import tiles

    west, south, east, north = (F.lit(x) for x in box)
    span = lambda a, b: F.sequence(a, b)
    xs, ys = span(tiles.tile_x(west, zoom), tiles.tile_x(east, zoom)), span(tiles.tile_y(north, zoom), tiles.tile_y(south, zoom))
    keys = spark.range(1).select(F.explode(xs).alias("x"), ys.alias("ys")).select("x", F.explode("ys").alias("y")).select(tiles.quadkey(F.col("x"), F.col("y"), zoom).alias("QuadKey"))
    listed = spark.read.csv(index, header=True).join(F.broadcast(keys), "QuadKey", "left_semi").withColumn("bytes", size_bytes(F.col("Size")))
    matching = listed.count()
    rows = listed.orderBy("QuadKey", "Url").limit(max_files).select("Url", "bytes").collect()
    paths = [r["Url"] for r in rows if r["bytes"] is None or r["bytes"] <= max_bytes]
    state = {"matching": matching, "files": len(rows), "oversized": len(rows) - len(paths), "truncated": matching > len(rows) or len(paths) < len(rows)}
    return (read_geojson_lines(spark, paths) if paths else None), state


def sampled(grid: DataFrame, max_samples: int) -> DataFrame:
    """Every stride-th row and column of grids (file, row, col, ...), the stride by how many cells ``max_samples`` allows."""
    size = grid.groupBy("file").agg(((F.max("row") + 1) * (F.max("col") + 1)).alias("cells"))
    stride = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("cells") / F.lit(max_samples)))).cast("int")
    g = grid.join(F.broadcast(size.withColumn("stride", stride).select("file", "stride")), "file")
    return g.where((F.col("row") % F.col("stride") == 0) & (F.col("col") % F.col("stride") == 0))


def read_gml(spark: SparkSession, path: str) -> DataFrame:
    """id, g of the members of GML files."""
    from geoquarry.sources import geometry_text as T

    members = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<(?:\w+:)?featureMember[^>]*>(.*?)</(?:\w+:)?featureMember>"), F.lit(1))).alias("i", "m"))
    return members.select(F.concat(F.lit("gml-"), F.col("i").cast("string")).alias("id"), T.from_gml(F.col("m")).alias("g")).where("g IS NOT NULL")


def read_esri_json(spark: SparkSession, path: str) -> DataFrame:
    """attributes (JSON text), g of the features of Esri JSON files."""
    from geoquarry.sources import geometry_text as T

    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<features:array<struct<attributes:string,geometry:string>>>")["features"]).alias("f"))
    return f.select(F.col("f.attributes").alias("attributes"), T.from_esri(F.col("f.geometry")).alias("g")).where("g IS NOT NULL")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """name, g of the placemarks of KML files."""
    from geoquarry.sources import geometry_text as T

    marks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))).alias("m"))
    name = F.regexp_extract("m", r"(?is)<name>(.*?)</name>", 1)
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        name = F.replace(name, F.lit(mark), F.lit(char))
    return marks.select(name.alias("name"), T.from_kml(F.col("m")).alias("g")).where("g IS NOT NULL")


def catalog_resources(records: Column) -> Column:
    """url, format, name of the resources of a catalogue record (JSON text); a record without a list is one itself.  Those without a url are left out."""
    one = "struct<url:string,format:string,name:string>"
    listed = F.from_json(F.get_json_object(records, "$.resources"), f"array<{one}>")
    return F.filter(F.coalesce(listed, F.array(F.from_json(records, one))), lambda r: r["url"].isNotNull())


def catalog_assets(item: Column) -> Column:
    """name, href, type of the assets of an item (JSON text); those without a href are left out."""
    entries = F.map_entries(F.from_json(F.get_json_object(item, "$.assets"), "map<string,struct<href:string,type:string>>"))
    return F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"]["href"].alias("href"), e["value"]["type"].alias("type"))), lambda a: a["href"].isNotNull())


def first_with_rows(candidates: list[DataFrame]) -> DataFrame:
    """The first of the sources in order that has any rows; the last if none has."""
    for c in candidates[:-1]:
        if not c.isEmpty():
            return c
    return candidates[-1]


def reader(name: str):
    """The reader of a format; an error that says what a known format would need."""
    if name in UNSUPPORTED:
        raise NotImplementedError(f"{name} needs {UNSUPPORTED[name]}")
    return {"geojson": read_geojson, "geojsonl": read_geojson_lines, "csv": read_csv_points, "kml": read_kml, "gml": read_gml, "esri-json": read_esri_json, "ascii-grid": read_ascii_grid, "geopackage": read_geopackage, "shapefile": read_shapefiles, "dxf": read_dxf}[name]


def _decoded(spark: SparkSession, path: str, decode) -> DataFrame:
    """Rows that ``decode`` makes of each whole file, a file a row; the files' bytes stay in the task that reads them."""
    import pyarrow as pa

    position = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
    kinds = pa.schema([("file", pa.string()), ("id", pa.string()), ("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(position)))), ("properties", pa.string())])

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = iter(decode(data.as_py()))
                while some := [{"file": name.rsplit("/", 1)[-1], **r} for r in itertools.islice(rows, 4096)]:
                    yield pa.RecordBatch.from_pylist(some, schema=kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DECODED)


DECODED = "file string, id string, type string, parts array<array<array<struct<lon:double,lat:double>>>>, properties string"


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """file, id, g, properties (JSON text) of the rows of all geometry tables of GeoPackage files."""
    from geoquarry.sources.binary import geopackage_rows

    return _with_geometry(_decoded(spark, path, geopackage_rows))


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """file, id, g, properties of the shapes of zipped or plain Shapefiles."""
    from geoquarry.sources.binary import shapefile_rows

    return _with_geometry(_decoded(spark, path, shapefile_rows))


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """file, id, g, properties of the points, lines, polylines and circles of DXF files."""
    from geoquarry.sources.binary import dxf_rows

    return _with_geometry(_decoded(spark, path, dxf_rows))


def _with_geometry(rows: DataFrame) -> DataFrame:
    return rows.select("file", "id", F.struct("type", "parts").alias("g"), "properties")
