"""Geometries (see ``functions.geometries``) from and to GeoJSON, KML, DXF, OBJ and glTF texts, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geoquarry.functions import geometries as G

NUMBERS = {1: "array<double>", 2: "array<array<double>>", 3: "array<array<array<double>>>", 4: "array<array<array<array<double>>>>"}
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
PARTS = "array<array<array<struct<lon:double,lat:double>>>>"


def _pair(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def coordinates(g: Column) -> Column:
    """GeoJSON coordinates as text, nested as the type asks."""
    line = lambda ps: F.transform(ps, _pair)
    part = lambda ls: F.transform(ls, line)
    parts = g["parts"]
    return (
        F.when(g["type"] == "Point", F.to_json(_pair(F.get(G.positions(g), F.lit(0)))))
        .when(g["type"].isin("MultiPoint", "LineString"), F.to_json(line(G.positions(g))))
        .when(g["type"] == "MultiLineString", F.to_json(part(F.flatten(parts))))
        .when(g["type"] == "Polygon", F.to_json(part(F.get(parts, F.lit(0)))))
        .when(g["type"] == "MultiPolygon", F.to_json(F.transform(parts, part)))
    )


def to_geojson(g: Column) -> Column:
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), coordinates(g), F.lit("}"))


def from_geojson(text: Column) -> Column:
    """The geometry struct of a GeoJSON geometry text; null for other types and for what is no geometry."""
    kind, raw = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    point = lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    line = lambda ps: F.transform(ps, point)
    part = lambda ls: F.transform(ls, line)
    at = {d: F.from_json(raw, kind_) for d, kind_ in NUMBERS.items()}
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(point(at[1])))).cast(PARTS))
        .when(kind == "MultiPoint", F.transform(at[2], lambda p: F.array(F.array(point(p)))).cast(PARTS))
        .when(kind == "LineString", F.array(F.array(line(at[2]))).cast(PARTS))
        .when(kind == "MultiLineString", F.transform(at[3], lambda ps: F.array(line(ps))).cast(PARTS))
        .when(kind == "Polygon", F.array(part(at[3])).cast(PARTS))
        .when(kind == "MultiPolygon", F.transform(at[4], part).cast(PARTS))
    )
    return F.when(parts.isNotNull(), G.geometry(kind, parts))


def from_esri(geometry: Column) -> Column:
    """The geometry struct of an Esri JSON geometry text: x and y, points, paths or rings; several paths or rings are a Multi*."""
    point = lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    line = lambda ps: F.transform(ps, point)
    x, y = F.get_json_object(geometry, "$.x").try_cast("double"), F.get_json_object(geometry, "$.y").try_cast("double")
    paths, rings = (F.from_json(F.get_json_object(geometry, f"$.{k}"), NUMBERS[3]) for k in ("paths", "rings"))
    one = lambda t, parts: G.geometry(t, parts.cast(PARTS))
    return (
        F.when(x.isNotNull() & y.isNotNull(), one("Point", F.array(F.array(F.array(G.point(x, y))))))
        .when(F.size(paths) == 1, one("LineString", F.transform(paths, lambda p: F.array(line(p)))))
        .when(F.size(paths) > 1, one("MultiLineString", F.transform(paths, lambda p: F.array(line(p)))))
        .when(F.size(rings) == 1, one("Polygon", F.transform(rings, lambda r: F.array(line(r)))))
        .when(F.size(rings) > 1, one("MultiPolygon", F.transform(rings, lambda r: F.array(line(r)))))
    )


def from_gml(member: Column) -> Column:
    """A point or a line of the positions in a GML member; null without any."""
    found = F.regexp_extract_all(member, F.lit(r"(?is)<(?:\w+:)?(?:pos|coordinates)[^>]*>\s*([^<]+?)\s*</"), F.lit(1))
    number = lambda t, i: F.get(F.split(F.trim(t), r"[ ,]+"), F.lit(i)).try_cast("double")
    ps = F.filter(F.transform(found, lambda t: G.point(number(t, 0), number(t, 1))), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.when(F.size(ps) == 1, G.geometry("Point", F.array(F.array(ps)).cast(PARTS))).when(F.size(ps) > 1, G.geometry("LineString", F.array(F.array(ps)).cast(PARTS)))


def _tuples(ps: Column) -> Column:
    return F.array_join(F.transform(ps, lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"), F.lit("0"))), " ")


def to_kml(g: Column) -> Column:
    """KML of a point, a line or a polygon with its holes; null for Multi*."""
    ring = lambda name: lambda r: F.concat(F.lit(f"<{name}><LinearRing><coordinates>"), _tuples(r), F.lit(f"</coordinates></LinearRing></{name}>"))
    rings = F.get(g["parts"], F.lit(0))
    holes = F.array_join(F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), ring("innerBoundaryIs")), "")
    return (
        F.when(g["type"] == "Point", F.concat(F.lit("<Point><coordinates>"), _tuples(G.positions(g)), F.lit("</coordinates></Point>")))
        .when(g["type"] == "LineString", F.concat(F.lit("<LineString><coordinates>"), _tuples(G.positions(g)), F.lit("</coordinates></LineString>")))
        .when(g["type"] == "Polygon", F.concat(F.lit("<Polygon>"), ring("outerBoundaryIs")(F.get(rings, F.lit(0))), holes, F.lit("</Polygon>")))
    )


def from_kml(mark: Column) -> Column:
    """Geometry of a placemark by its first coordinates: a polygon (closed again by its first position), a line or a point; null without coordinates."""
    text = F.regexp_extract(mark, r"(?s)<coordinates>(.*?)</coordinates>", 1)
    number = lambda t, i: F.get(F.split(t, ","), F.lit(i)).try_cast("double")
    ps = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: G.point(number(t, 0), number(t, 1)))
    ps = F.filter(ps, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    closed = F.concat(ps, F.slice(ps, 1, 1))
    return F.when(F.size(ps) == 0, F.lit(None)).when(mark.contains("<Polygon"), G.geometry("Polygon", F.array(F.array(closed)).cast(PARTS))).when(mark.contains("<LineString"), G.geometry("LineString", F.array(F.array(ps)).cast(PARTS))).otherwise(G.geometry("Point", F.array(F.array(F.slice(ps, 1, 1))).cast(PARTS)))


def to_dxf(g: Column, layer: Column, height: Column) -> Column:
    """Lines of DXF: a POINT, an open LWPOLYLINE, or a closed one a ring and a 3DFACE for what has a height."""
    text = lambda c: c.cast("string")
    p = F.get(G.positions(g), F.lit(0))
    point = F.array(F.lit("0"), F.lit("POINT"), F.lit("8"), layer, F.lit("10"), text(p["lon"]), F.lit("20"), text(p["lat"]), F.lit("30"), F.lit("0"))

    def polyline(ps, closed):
        head = F.array(F.lit("0"), F.lit("LWPOLYLINE"), F.lit("8"), layer, F.lit("90"), text(F.size(ps)), F.lit("70"), F.lit(closed))
        return F.concat(head, F.flatten(F.transform(ps, lambda q: F.array(F.lit("10"), text(q["lon"]), F.lit("20"), text(q["lat"])))))

    ring = G.outer(g)
    four = F.when(F.size(ring) == 3, F.concat(ring, F.slice(ring, 3, 1))).otherwise(F.slice(ring, 1, 4))
    corner = lambda q, i: F.array(text(10 + i), text(q["lon"]), text(20 + i), text(q["lat"]), text(30 + i), text(height))
    face = F.when((height > 0) & (F.size(ring) >= 3), F.concat(F.array(F.lit("0"), F.lit("3DFACE"), F.lit("8"), layer), F.flatten(F.transform(four, corner)))).otherwise(F.slice(point, 1, 0))
    rings = F.flatten(F.transform(F.get(g["parts"], F.lit(0)), lambda r: polyline(r, "1")))
    return F.when(g["type"] == "Point", point).when(g["type"] == "LineString", polyline(G.positions(g), "0")).when(g["type"] == "Polygon", F.concat(rings, face))


def gltf_node(name: Column, number: Column, geometry_text: Column, extras: Column) -> Column:
    """One node and its mesh of a glTF scene without buffers, as text."""
    return F.to_json(F.struct(name.alias("name"), number.alias("mesh"), extras.alias("extras"), geometry_text.alias("geometry")))
