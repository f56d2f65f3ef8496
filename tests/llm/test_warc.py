"""WARC records and revisits."""

import gzip
import random

from pyspark.sql import functions as F

from framequarry.llm import warc


def test_records_round_trip(spark, tmp_path):
    one = warc.record_bytes("http://a.example/x", "2026-01-01T00:00:00Z", 200, {"ETag": '"1"', "X": "y"}, b"body\r\n\r\nWARC/1.1", record_id="<urn:1>")
    two = warc.record_bytes("http://a.example/x", "2026-01-02T00:00:00Z", 304, {"ETag": '"1"'}, b"", "revisit", "<urn:2>")
    (tmp_path / "a.warc").write_bytes(one + two + one[:40])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 4
    full = [r for r in rows if r["warc_type"] == "response"]
    assert all(bytes(r["body"]) == b"body\r\n\r\nWARC/1.1" and r["http_status"] == 200 and r["headers"]["etag"] == '"1"' for r in full)


def test_canonical_urls(spark):
    same = ["http://WWW.Example.com:80/a/", "https://example.com/a", "http://user:pw@example.com/a#top", "http://example.com/a?utm_source=x&ref=y", "http://example.com/a/index.html"]
    rows = spark.createDataFrame([(u,) for u in same], "url string").select(warc.canonical_url(F.col("url")).alias("c")).collect()
    assert {r["c"] for r in rows} == {"example.com/a"}
    two = spark.createDataFrame([("http://e.x/p?b=2&a=1",), ("http://e.x/p?a=1&b=2&gclid=3",), (None,)], "url string").select(warc.canonical_url(F.col("url")).alias("c")).collect()
    assert [r["c"] for r in two] == ["e.x/p?a=1&b=2"] * 2 + [None]


SCHEMA = "record_id string, warc_type string, url string, captured string, http_status int, headers map<string,string>"


def brute(rows):
    out = {}
    for r in rows:
        rid, kind, url, at, status, headers = r
        revisit = kind == "revisit" or status == 304
        if not revisit:
            out[rid] = ("full", rid, headers)
            continue
        prior = [p for p in rows if url and p[2] == url and p[1] == "response" and p[4] == 200 and p[3] and at and (p[3], p[0]) < (at, rid)]
        if not prior:
            out[rid] = ("unresolved", None, headers)
            continue
        best = max(prior, key=lambda p: (p[3], p[0]))
        h, old = headers or {}, best[5] or {}
        tag, was = (x.get("etag") and x["etag"].removeprefix("W/") for x in (h, old))
        if tag and was:
            status = "resolved" if tag == was else "mismatch"
        elif h.get("last-modified") and old.get("last-modified"):
            status = "resolved" if h["last-modified"] == old["last-modified"] else "mismatch"
        else:
            status = "unverified"
        taken = status in ("resolved", "unverified")
        out[rid] = (status, best[0] if taken else None, old | {k: v for k, v in h.items() if k in warc.PERMITTED} if taken else headers)
    return out


def test_resolution_matches_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        url = None if rng.random() < 0.03 else "http://hot.example/p" if rng.random() < 0.4 else f"http://h{rng.randrange(30)}.example/p"
        revisit = rng.random() < 0.5
        headers = None if rng.random() < 0.05 else {k: v for k, v in (("etag", rng.choice(['"a"', 'W/"a"', '"b"'])), ("last-modified", rng.choice("xy")), ("date", str(i)), ("content-type", "t")) if rng.random() < 0.6}
        rows.append((f"r{i:04d}", "revisit" if revisit else "response", url, None if rng.random() < 0.03 else f"2026-01-{1 + rng.randrange(28):02d}", 304 if revisit else rng.choice([200, 200, 404]), headers))
    got = {r["record_id"]: (r["status"], r["resolved_id"], r["merged"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    want = brute([(a, b, c.replace("http://", "") if c else None, d, e, f) for a, b, c, d, e, f in rows])
    assert got == want


def test_edges(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>", "clash"), (1, "http://a.example/", "<p>", "clash"), (None, None, None, None)], "page_id long, url string, html string, status string")
    rows = warc.revisit_digests(pages).collect()
    assert len(rows) == 6
    assert sum(r["status"] == "resolved" for r in rows) == 2
