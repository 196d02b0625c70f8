import base64
import gzip
import hashlib


from geoquarry.llm import warc_index as wi

SCHEMA = "page_id long, url string, html string, key string, sha int"


def brute(rows, least=0):
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, x in rows if (x or "").encode() == data and q is not None]
        top = max(same, default=None)
        revisit = len(data) >= least and top is not None and p != top
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def rows():
    made = [(i, f"http://{'www' if i % 2 else 'Blog'}.site{i % 7}.example.com/p/{i % 50}?q={i}#f", f"<p>page {i % 90} é</p>") for i in range(300)]
    made += [(1000 + i, "https://hot.example.org/", "same") for i in range(200)]
    made += [(2000, None, None), (2001, "not a url\n", ""), (None, "http://a.b/", "x"), (None, "http://a.b/", "same"), (2002, "http://a.b", "y\r\n\r\nz"), (2002, "http://a.b", "y\r\n\r\nz"), (2003, "http://long.example/", "w" * 300_000)]
    return made


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wi, "BLOCK", 7)
    df = spark.createDataFrame([(*r, "k", 0) for r in rows()], SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in wi.archive_round_trip(df).collect()), key=str) == brute(rows())
    assert sorted((tuple(r) for r in wi.archive_round_trip(df, min_bytes=6).collect()), key=str) == brute(rows(), 6)
    assert wi.archive_round_trip(df.limit(0)).count() == 0


def test_one_key_over_blocks_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wi, "BLOCK", 2)
    pages = spark.createDataFrame([(1, "http://a.b/", f"{i}") for i in range(9)] + [(2, "http://a.c/", "z")], "page_id long, url string, html string")
    root = f"file://{tmp_path}"
    manifest = wi.write_archive(pages, root, partitions=3).cache()
    manifest.count()
    keys = pages.select(wi.capture_key().alias("key")).distinct()
    assert wi.lookup(spark, keys, manifest, root).count() == 10
    assert wi.lookup(spark, spark.createDataFrame([("aaa",), ("zzz",)], "key string"), manifest, root).count() == 0


def test_keys_and_records(spark):
    df = spark.createDataFrame([("https://Blog.example.com/a?b#c",), ("http://x.org",), ("mailto:me",), (None,)], "url string")
    assert [r[0] for r in df.select(wi.url_key()).collect()] == ["com,example,blog)/a?b", "org,x)/", "mailto:me", ""]
    data = wi.record("k", 5, "http://a/\r\nX: y", b"<p>\r\n\r\n", "D", None, None)
    fields, payload = wi.parse(gzip.decompress(gzip.compress(data)))
    assert payload == b"<p>\r\n\r\n" and fields["WARC-Target-URI"] == "http://a/%0D%0AX: y" and "X" not in fields
