"""WARC archives with a two-level capture index.

Captures are ordered by reversed-host URL key and page.  Each range of keys is
one shard: a task writes its records to a WARC file (one gzip member a record)
and, beside it, the index: lines of key, offset and length in compressed blocks,
and a sparse directory with each block's first key.  A manifest row a shard
makes the top level.  A lookup bisects the manifest, then the shard's directory,
reads one block's range, and then the record's range of the archive.

At scale: pages move once, by a range shuffle on (key, page), which splits even
a host or URL that has a third of all captures.  Lookups of many keys are sorted
by shard and key, in as many tasks as there are shards, so that a task reads
about one shard, its blocks and records in file order.  The manifest, which every task gets, has at most
``spark.sql.shuffle.partitions`` rows.  Files lie in
the shared folder; each task attempt writes names of its own and only those of
successful ones are in the manifest, so retries can't mix.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoquarry.plans.staging import Staging

#: Lines of an index block.
BLOCK = 512
#: Rows up to which the table of repeated payloads is broadcast.
SMALL = 200_000
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str = "url") -> Column:
    """Sort key: host reversed by its labels, then path and query; a fragment is no part of it.

    ``https://Blog.example.com/a?b#c`` gives ``com,example,blog)/a?b``.  What has no
    host is kept as it is; null gives the empty key.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
    host, rest = F.lower(F.regexp_extract(u, parts, 1)), F.regexp_extract(u, parts, 2)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    plain = F.when(host == "", u).otherwise(F.concat(turned, F.lit(")"), F.when(rest == "", "/").otherwise(rest)))
    return F.regexp_replace(plain, r"[\x00-\x20]", "%20")


def capture_key(url: str = "url", page_id: str = "page_id") -> Column:
    """The URL key and the page, in one string that sorts by both."""
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.format_string("%020d", F.col(page_id).cast("long")), F.lit("-")))


def _header(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_key: str | None, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit has no payload."""
    head = [f"WARC-Type: {'response' if refers_key is None else 'revisit'}", f"WARC-Record-ID: {_record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    head += [f"WARC-Target-URI: {_header(url)}"] if url is not None else []
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if refers_key is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_key)}", f"X-Refers-To-Key: {_header(refers_key)}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_key is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; Hadoop's names for S3 are not pyarrow's."""
    for scheme in ("s3a://", "s3n://"):
        if root.startswith(scheme):
            root = "s3://" + root.removeprefix(scheme)
    return fs.FileSystem.from_uri(root)


def write_archive(pages: DataFrame, root: str, min_bytes: int = 0, partitions: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``root``; returns the manifest: first_key, stem, records.

    Of records with equal payloads of at least ``min_bytes`` the one with the
    largest page_id is a response and the others revisit it.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", "url", html.alias("payload"), F.unhex(F.sha1(html)).alias("sha"), capture_key().alias("key"))
    same = base.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"), F.max_by("key", "page_id").alias("refers_key")).where("n > 1 AND refers_to IS NOT NULL")
    same = Staging(pages.sparkSession, "warc").cut(same.drop("n"), "same")
    held = base.join(F.broadcast(same) if same.count() <= SMALL else same.hint("merge"), "sha", "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    held = held.select("key", "page_id", "url", "payload", F.when(again, F.col("refers_key")).alias("refers_key"), F.when(again, F.col("refers_to")).alias("refers_to"))
    count = [partitions] if partitions else []
    ordered = held.repartitionByRange(*count, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(root)
        stem = f"{at}/shard-{uuid.uuid4().hex}"
        store.create_dir(at, recursive=True)
        first, n, offset, index_at, lines, directory = None, 0, 0, 0, [], []
        with store.open_output_stream(f"{stem}.warc.gz", compression=None) as warc, store.open_output_stream(f"{stem}.idx") as index:

            def close_block():
                nonlocal index_at
                if lines:
                    packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), LEVEL)
                    directory.append([lines[0].split("\t")[0], index_at, len(packed)])
                    index.write(packed)
                    index_at += len(packed)
                    lines.clear()

            for b in batches:
                for i in range(len(b)):
                    key, page_id, url, payload, refers_key, refers_to = (b.column(c)[i].as_py() for c in range(6))
                    data = gzip.compress(record(key, page_id, url, payload, digest(payload), refers_key, refers_to), LEVEL, mtime=0)
                    warc.write(data)
                    lines.append(f"{key}\t{offset}\t{len(data)}")
                    offset, n, first = offset + len(data), n + 1, key if first is None else first
                    if len(lines) == BLOCK:
                        close_block()
            close_block()
        with store.open_output_stream(f"{stem}.dir") as out:
            out.write(json.dumps(directory).encode())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([stem]), pa.array([n], pa.int64())], names=["first_key", "stem", "records"])
        else:
            for end in ("warc.gz", "idx", "dir"):
                store.delete_file(f"{stem}.{end}")

    return ordered.mapInArrow(run, "first_key string, stem string, records long")


class Shard:
    """Reads one shard: directory, blocks and records by range."""

    def __init__(self, store, stem: str):
        self.warc, self.index = store.open_input_file(f"{stem}.warc.gz"), store.open_input_file(f"{stem}.idx")
        with store.open_input_file(f"{stem}.dir") as f:
            self.directory = json.loads(f.read())
        self.firsts = [d[0] for d in self.directory]
        self.block_no, self.lines, self.keys = -1, [], []

    def _open(self, no: int) -> None:
        if no != self.block_no:
            _, at, size = self.directory[no]
            text = zlib.decompress(self.index.read_at(size, at)).decode("utf-8", "surrogatepass")
            self.block_no, self.lines = no, [line.split("\t") for line in text.split("\n")]
            self.keys = [line[0] for line in self.lines]

    def find(self, key: str) -> Iterator[bytes]:
        """Records of a key; one that repeats may run on into further blocks."""
        no = max(0, bisect_right(self.firsts, key) - 1)
        while no > 0 and self.firsts[no] == key:
            no -= 1
        while no < len(self.firsts) and self.firsts[no] <= key:
            self._open(no)
            for k, at, size in self.lines[bisect_right(self.keys, key) - self.keys.count(key) :]:
                if k != key:
                    break
                yield gzip.decompress(self.warc.read_at(int(size), int(at)))
            no += 1

    def close(self) -> None:
        self.warc.close()
        self.index.close()


def lookup(spark: SparkSession, keys: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """key, page_id, payload_bytes, payload_digest, record_type, refers_key, refers_to of each capture of ``keys`` (column key, distinct).

    A key may lie at the end of one shard and the start of the next; both are
    searched.  A record whose payload doesn't match its digest is an error.
    """
    shards = sorted((r["first_key"], r["stem"]) for r in manifest.select("first_key", "stem").collect())  # one a partition
    top = spark.sparkContext.broadcast(shards)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [s[0] for s in top.value]
        for b in batches:
            out_key, out_no = [], []
            for key in b.column(0).to_pylist():
                no = bisect_right(firsts, key) - 1
                while no >= 0:
                    out_key.append(key)
                    out_no.append(no)
                    if firsts[no] != key:
                        break
                    no -= 1
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.string()), pa.array(out_no, pa.int32())], names=["key", "no"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        open_no, shard = -1, None
        for b in batches:
            rows = []
            for key, no in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if no != open_no:
                    if shard:
                        shard.close()
                    open_no, shard = no, Shard(store, top.value[no][1])
                for data in shard.find(key):
                    fields, payload = parse(data)
                    revisit = fields["WARC-Type"] == "revisit"
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and said != digest(payload):
                        raise ValueError(f"corrupt record of {key}")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    rows.append((key, int(page) if page else None, None if revisit else len(payload), said, fields["WARC-Type"], fields.get("X-Refers-To-Key"), int(refers) if refers else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_key", "refers_to"])
        if shard:
            shard.close()

    routed = keys.select("key").mapInArrow(route, "key string, no int")
    near = routed.repartitionByRange(max(1, len(shards)), "no", "key").sortWithinPartitions("no", "key")
    return near.mapInArrow(read, "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_key string, refers_to long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what the archives say of each row of ``pages``.

    Every page is looked up by its key; a revisit's payload is that of the
    response it refers to, looked up in turn.  Null html is an empty payload;
    null and odd URLs are keys like others; rows that repeat the largest page_id
    are responses each; a null page_id is never referred to unless no other is
    there (then all are responses).  An empty table gives no rows; other columns
    are not read.
    """
    spark = pages.sparkSession
    staging = Staging(spark, "warc")
    root = staging.path("archive")
    manifest = staging.cut(write_archive(pages, root, min_bytes), "manifest")
    found = staging.cut(lookup(spark, pages.select(capture_key().alias("key")).distinct(), manifest, root), "found")
    targets = found.where("refers_key IS NOT NULL").select(F.col("refers_key").alias("key")).distinct()
    answered = lookup(spark, targets, manifest, root).where("record_type = 'response'")
    answered = staging.cut(answered.groupBy("key").agg(F.max("payload_bytes").alias("full")), "answered")
    out = found.join(answered.withColumnRenamed("key", "refers_key").hint("merge"), "refers_key", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
