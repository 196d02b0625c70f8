"""Decoders of files that Spark has no reader for: small helpers that turn one file's bytes into rows of geometry parts."""

from __future__ import annotations

import io
import json
import math
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

WKB = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def _points(flat) -> list[dict]:
    return [{"lon": float(x), "lat": float(y)} for x, y in flat]


def wkb(data: bytes, at: int = 0) -> tuple[str | None, list, int]:
    """Type, parts and end of a well-known binary geometry, plain or extended; heights and measures are passed over."""
    order = "<" if data[at] == 1 else ">"
    raw = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5
    family, base = (raw & 0xFFFF) // 1000, (raw & 0xFFFF) % 1000
    size = 2 + bool(raw & 0x80000000 or family in (1, 3)) + bool(raw & 0x40000000 or family in (2, 3))
    if raw & 0x20000000:
        at += 4

    def count():
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", data, at - 4)[0]

    def positions(n):
        nonlocal at
        values = struct.unpack_from(f"{order}{n * size}d", data, at)
        at += 8 * n * size
        return _points(zip(values[::size], values[1::size], strict=True))

    if base == 1:
        return "Point", [[positions(1)]], at
    if base == 2:
        return "LineString", [[positions(count())]], at
    if base == 3:
        return "Polygon", [[positions(count()) for _ in range(count())]], at
    if base in (4, 5, 6):
        parts = []
        for _ in range(count()):
            kind, part, at = wkb(data, at)
            parts += part if kind == WKB[base - 3] else []
        return WKB[base], parts, at
    return None, [], at


def geopackage_rows(data: bytes) -> Iterator[dict]:
    """Rows of the geometry tables; other blobs are told by their size."""
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    for table, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        rows = con.execute(f"SELECT * FROM {quoted(table)}")
        names = [d[0] for d in rows.description]
        for i, row in enumerate(rows):
            blob = row[names.index(column)]
            if not isinstance(blob, bytes) or blob[:2] != b"GP":
                continue
            envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get((blob[3] >> 1) & 7, 0)
            kind, parts, _ = wkb(blob, 8 + envelope)
            if kind:
                properties = {n: f"[{len(v)} bytes]" if isinstance(v, bytes) else v for n, v in zip(names, row, strict=True) if n != column}
                yield {"id": f"{table}:{i}", "type": kind, "parts": parts, "properties": json.dumps(properties)}
    con.close()


def _turns_left(ring: list[dict]) -> bool:
    return sum(a["lon"] * b["lat"] - b["lon"] * a["lat"] for a, b in zip(ring, ring[1:], strict=False)) > 0


def shapes_of(data: bytes) -> Iterator[tuple[str, list]]:
    """Type and parts of the records of a .shp file: points, multipoints, lines and polygons, with or without heights and measures."""
    at = 100
    while at + 12 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        body, kind = at + 8, struct.unpack_from("<i", data, at + 8)[0] % 10
        if kind == 1:
            yield "Point", [[_points([struct.unpack_from("<2d", data, body + 4)])]]
        elif kind == 8:
            n = struct.unpack_from("<i", data, body + 36)[0]
            flat = struct.unpack_from(f"<{2 * n}d", data, body + 40)
            yield "MultiPoint", [[[p]] for p in _points(zip(flat[::2], flat[1::2], strict=True))]
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", data, body + 44 + 4 * parts)
            points = _points(zip(flat[::2], flat[1::2], strict=True))
            lines = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind == 3:
                yield ("LineString" if len(lines) == 1 else "MultiLineString"), [[line] for line in lines]
            else:
                polygons: list = []
                for ring in lines:  # outer rings turn right, the holes that follow them left
                    if polygons and _turns_left(ring):
                        polygons[-1].append(ring)
                    else:
                        polygons.append([ring])
                yield ("Polygon" if len(polygons) == 1 else "MultiPolygon"), polygons
        at += 8 + length


def table_of(data: bytes) -> list[dict]:
    """Records of a .dbf file, values as trimmed texts."""
    rows, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for i in range(rows):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            row[name] = data[at : at + size].decode("utf-8", "replace").strip()
            at += size
        out.append(row)
    return out


def shapefile_rows(data: bytes) -> Iterator[dict]:
    """Shapes of all layers of a zip, with the records beside them; of a plain .shp without."""
    layers = {}
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                stem, _, end = name.rpartition(".")
                layers.setdefault(stem, {})[end.lower()] = z.read(name)
    else:
        layers["shape"] = {"shp": data}
    for stem, files in layers.items():
        if "shp" not in files:
            continue
        records = table_of(files["dbf"]) if "dbf" in files else []
        for i, (kind, parts) in enumerate(shapes_of(files["shp"])):
            yield {"id": f"{stem}:{i}", "type": kind, "parts": parts, "properties": json.dumps(records[i] if i < len(records) else {})}


def _dxf_entities(data: bytes) -> Iterator[tuple[str, list]]:
    """Kind and (code, value) pairs of the entities, one after the other: only the one being read is held beside the file's bytes."""
    lines = (x.strip() for line in io.TextIOWrapper(io.BytesIO(data), "utf-8", "replace") for x in line.splitlines())
    entity, inside = None, False
    for code, value in zip(lines, lines, strict=False):
        if code == "2" and value == "ENTITIES":
            inside = True
        elif code == "0":
            if value == "ENDSEC":
                inside = False
            elif inside and value == "VERTEX" and entity:
                continue
            elif inside and value != "SEQEND":
                if entity:
                    yield entity
                entity = value, []
        elif inside and entity:
            entity[1].append((code, value))
    if entity:
        yield entity


def dxf_rows(data: bytes) -> Iterator[dict]:
    """Entities of the ENTITIES section: POINT, LINE, (LW)POLYLINE (a polygon where it ends as it began), CIRCLE of 48 corners."""
    for i, (kind, codes) in enumerate(_dxf_entities(data)):
        of = lambda c, codes=codes: [float(v) for k, v in codes if k == c]
        layer = next((v for k, v in codes if k == "8"), "0")
        points = _points(zip(of("10"), of("20"), strict=False))
        shape = None
        if kind == "POINT" and points:
            shape = "Point", [[points[:1]]]
        elif kind == "LINE" and of("11"):
            shape = "LineString", [[points[:1] + _points(zip(of("11"), of("21"), strict=False))]]
        elif kind in ("LWPOLYLINE", "POLYLINE") and points:
            shape = ("Polygon" if len(points) > 2 and points[0] == points[-1] else "LineString"), [[points]]
        elif kind == "CIRCLE" and of("40"):
            c, r = points[0], of("40")[0]
            ring = _points((c["lon"] + math.cos(k / 48 * 2 * math.pi) * r, c["lat"] + math.sin(k / 48 * 2 * math.pi) * r) for k in range(48))
            shape = "Polygon", [[ring + ring[:1]]]
        if shape:
            yield {"id": str(i), "type": shape[0], "parts": shape[1], "properties": json.dumps({"layer": layer, "sourceType": kind})}
