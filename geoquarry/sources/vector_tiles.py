"""Vector tiles: archives read by ranges, and the decoding of tiles, as small helpers inside Spark tasks.

The tiles that a box covers are rows; tasks look each up in the archive's
directories, read its range, and decode it.  Nothing but a box reaches the driver.
"""

from __future__ import annotations

import gzip
import json
import math
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.functions import geometries as G, tiles

HEADER = 127
GZIP = 2
FEATURES = "z int, x int, y int, layer string, id string, type string, parts array<array<array<struct<lon:double,lat:double>>>>, properties string"


def varints(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Each number and where it ends."""
    while at < end:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
        yield value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a message: integers, floats, doubles or bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = next(varints(data, at, end))
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = next(varints(data, at, end))
        elif wire == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif wire == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif wire == 2:
            size, at = next(varints(data, at, end))
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def _signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _value(data: bytes):
    for number, v in fields(data):
        return v.decode("utf-8", "replace") if number == 1 else _signed(v) if number == 6 else bool(v) if number == 7 else v - (1 << 64) if number == 4 and v >= 1 << 63 else v
    return None


def _paths(data: bytes) -> list[list[tuple[int, int]]]:
    """Runs of positions in tile units; a closed one ends where it began."""
    numbers, paths, x, y, i = [v for v, _ in varints(data, 0, len(data))], [], 0, 0, 0
    while i < len(numbers):
        command, count = numbers[i] & 7, numbers[i] >> 3
        i += 1
        if command == 7:
            paths[-1].append(paths[-1][0])
            continue
        for _ in range(count):
            x, y = x + _signed(numbers[i]), y + _signed(numbers[i + 1])
            i += 2
            if command == 1:
                paths.append([])
            paths[-1].append((x, y))
    return paths


def _twice_area(ring) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def decode(tile: bytes, z: int, x: int, y: int) -> Iterator[dict]:
    """Features of all layers of a tile: layer, id, type, parts in degrees, properties."""
    for number, layer in fields(tile):
        if number != 3:
            continue
        name, extent, keys, values, found = "", 4096, [], [], []
        for k, v in fields(layer):
            if k == 1:
                name = v.decode("utf-8", "replace")
            elif k == 2:
                found.append(v)
            elif k == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif k == 4:
                values.append(_value(v))
            elif k == 5:
                extent = v

        def place(p, extent=extent):
            mercator = math.pi * (1 - 2 * (y + p[1] / extent) / 2**z)
            return {"lon": (x + p[0] / extent) / 2**z * 360 - 180, "lat": math.degrees(math.atan(math.sinh(mercator)))}

        for feature in found:
            fid, kind, tags, paths = None, 0, [], []
            for k, v in fields(feature):
                if k == 1:
                    fid = v
                elif k == 2:
                    tags = [n for n, _ in varints(v, 0, len(v))]
                elif k == 3:
                    kind = v
                elif k == 4:
                    paths = _paths(v)
            lines = [[place(p) for p in path] for path in paths]
            if kind == 1:
                type_, parts = ("Point" if len(lines) == 1 else "MultiPoint"), [[[p]] for line in lines for p in line]
            elif kind == 2:
                type_, parts = ("LineString" if len(lines) == 1 else "MultiLineString"), [[line] for line in lines]
            elif kind == 3:
                parts = []
                for path, line in zip(paths, lines, strict=True):  # in tile units, whose y goes down, outer rings have a positive area
                    if _twice_area(path) > 0 or not parts:
                        parts.append([line])
                    else:
                        parts[-1].append(line)
                type_ = "Polygon" if len(parts) == 1 else "MultiPolygon"
            else:
                continue
            properties = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=False)}
            yield {"layer": name, "id": None if fid is None else str(fid), "type": type_, "parts": parts, "properties": json.dumps(properties)}


def directory(data: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    """Tile ids, run lengths, lengths and offsets of a directory."""
    numbers = [v for v, _ in varints(data, 0, len(data))]
    n, ids, at = numbers[0], [], 0
    for d in numbers[1 : n + 1]:
        at += d
        ids.append(at)
    runs, lengths, raw = (numbers[1 + n * i : 1 + n * (i + 1)] for i in (1, 2, 3))
    offsets: list[int] = []
    for i, v in enumerate(raw):
        offsets.append(offsets[i - 1] + lengths[i - 1] if v == 0 and i else v - 1)
    return ids, runs, lengths, offsets


class Archive:
    """A tile archive: the header and root are read once, leaves and tiles by range."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(HEADER, 0)
        if head[:7] != b"PMTiles" or head[7] != 3:
            raise ValueError("no tile archive of version 3")
        (root, root_size, _, _, self.leaves, _, self.data) = struct.unpack_from("<7Q", head, 8)
        self.inner, self.packed = head[97], head[98]
        self.min_zoom, self.max_zoom = head[100], head[101]
        self.root, self.cache = directory(self._open(root, root_size, self.inner)), {}

    def _open(self, at: int, size: int, compression: int) -> bytes:
        raw = self.file.read_at(size, at)
        return gzip.decompress(raw) if compression == GZIP else raw

    def tile(self, tile_id: int) -> bytes | None:
        """A tile's bytes by its id along the curve; null where the archive has none."""
        entries = self.root
        for _ in range(4):  # the format allows so many levels
            ids, runs, lengths, offsets = entries
            i = bisect_right(ids, tile_id) - 1
            if i < 0:
                return None
            if runs[i]:
                return self._open(self.data + offsets[i], lengths[i], self.packed) if tile_id < ids[i] + runs[i] else None
            at = (offsets[i], lengths[i])
            if at not in self.cache:
                self.cache[at] = directory(self._open(self.leaves + at[0], at[1], self.inner))
            entries = self.cache[at]
        return None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file; Hadoop's names for S3 are not pyarrow's."""
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = "s3://" + path.removeprefix(scheme)
    return fs.FileSystem.from_uri(path)


def read_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """z, x, y, layer, id, g, properties of the features in the tiles of a zoom that cover a box, whose own box meets it."""
    zoom = min(max(zoom, 0), 14)
    west, south, east, north = (F.lit(v) for v in box)
    xs, ys = F.sequence(tiles.tile_x(west, zoom), tiles.tile_x(east, zoom)), F.sequence(tiles.tile_y(north, zoom), tiles.tile_y(south, zoom))
    wanted = spark.range(1).select(F.explode(xs).alias("x"), ys.alias("ys")).select("x", F.explode("ys").alias("y"))
    wanted = wanted.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), tiles.hilbert(F.col("x"), F.col("y"), zoom).alias("tile_id"))

    position = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
    kinds = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("layer", pa.string()), ("id", pa.string()), ("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(position)))), ("properties", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        with store.open_input_file(at) as file:
            archive = Archive(file)
            for b in batches:
                rows = []
                for x, y, tile_id in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    data = archive.tile(tile_id)
                    rows += [{"z": zoom, "x": x, "y": y, **f} for f in (decode(data, zoom, x, y) if data else ())]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    by_place = wanted.repartitionByRange("tile_id").sortWithinPartitions("tile_id")  # neighbours share leaves
    found = by_place.mapInArrow(run, FEATURES)
    g = found.select("z", "x", "y", "layer", "id", F.struct("type", "parts").alias("g"), "properties")
    return g.where(G.boxes_meet(G.bbox(F.col("g")), F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))))
