"""Writers of spatial file formats: a column of text for each row, written by Spark's text and CSV sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def feature(fid: Column, geometry: Column, properties: Column) -> Column:
    """A GeoJSON feature as text; ``geometry`` and ``properties`` are structs."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), fid.cast("string").alias("id"), geometry.alias("geometry"), properties.alias("properties")))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def polygon(ring: Column) -> Column:
    """A polygon of one ring (array of lon/lat structs)."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))


def write_geojson_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line: splits on reading, whatever the size."""
    features.select(column).write.text(path)


def xml_text(c: Column) -> Column:
    for char, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(mark))
    return c


def placemark(name: Column, lon: Column, lat: Column) -> Column:
    """A KML placemark with a point."""
    at = F.concat_ws(",", lon.cast("string"), lat.cast("string"), F.lit("0"))
    return F.concat(F.lit("<Placemark><name>"), xml_text(F.coalesce(name.cast("string"), F.lit(""))), F.lit("</name><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>"))


def csv_field(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break; quotes are doubled."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def safe_name(c: Column) -> Column:
    """A file name: what isn't a letter, digit, dot, dash or underscore becomes one dash; empty becomes ``export``."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}._-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "export").otherwise(t)


def file_name(c: Column, default: str = "export") -> Column:
    """A download's name: runs of characters that file systems refuse become a dash, then runs of white space; empty and null become ``default``."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|]+', "-"), r"\s+", "-")
    return F.when(F.coalesce(t, F.lit("")) == "", default).otherwise(t)


def prism(ring: Column, height: Column, offset: Column) -> Column:
    """OBJ lines of an extruded ring without its closing point; ``offset`` is the number of vertices before it.

    Vertices of floor and roof, one quad a wall, and the roof.
    """
    n = F.size(ring)
    vertex = lambda z: lambda p: F.concat_ws(" ", F.lit("v"), p["lon"].cast("string"), p["lat"].cast("string"), z.cast("string"))
    at = lambda i: (offset + 1 + i).cast("string")
    walls = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", F.lit("f"), at(i), at((i + 1) % n), at((i + 1) % n + n), at(i + n)))
    roof = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(n, 2 * n - 1), at), " "))
    return F.concat(F.transform(ring, vertex(F.lit(0.0))), F.transform(ring, vertex(height)), walls, F.array(roof))


# Columns of a CSV export unless others are asked for.
CSV_COLUMNS = ("id", "type", "source", "confidence", "name", "height", "levels", "area", "length", "category", "longitude", "latitude")
# Formats that are registered but not written.
UNSUPPORTED = ("shapefile", "geopackage", "pmtiles", "mbtiles", "geoparquet")


def write_csv(entities: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """CSV with a byte-order mark before the header of each file; columns that the entities lack are empty."""
    have = set(entities.columns)
    out = entities.select(*[(F.col(c) if c in have else F.lit(None)).cast("string").alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(columns)])
    out.write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def collections(features: DataFrame, chunk: Column, project: Column) -> DataFrame:
    """chunk, n, document: a FeatureCollection with a project block for each chunk of ``features`` (column feature, text).

    A chunk is a bounded number of features (callers number them so), so no
    document outgrows a row.
    """
    g = features.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("body"))
    return g.select("chunk", "n", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("body"), F.lit('],"project":'), project, F.lit("}")).alias("document"))


def placemarks(name: Column, style: Column, data: Column, kml: Column) -> Column:
    """A KML placemark with extended data (a map of texts); null where the geometry has no KML form."""
    entry = lambda e: F.concat(F.lit('<Data name="'), xml_text(e["key"]), F.lit('"><value>'), xml_text(F.coalesce(e["value"], F.lit(""))), F.lit("</value></Data>"))
    more = F.array_join(F.transform(F.map_entries(data), entry), "")
    return F.concat(F.lit("<Placemark><name>"), xml_text(F.coalesce(name.cast("string"), F.lit(""))), F.lit("</name><styleUrl>#"), style, F.lit("</styleUrl><ExtendedData>"), more, F.lit("</ExtendedData>"), kml, F.lit("</Placemark>"))


def writer(name: str):
    """The writer of a format; an error for those that are registered without one."""
    if name in UNSUPPORTED:
        raise NotImplementedError(f"{name} is not written")
    return {"geojsonl": write_geojson_lines, "csv": write_csv}[name]
