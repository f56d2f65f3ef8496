"""WARC captures: reading and writing records, canonical URLs, and resolving not-modified revisits.

A revisit stands for the latest earlier full response of the same canonical URL. The as-of join is done over sorted
order instead of over groups: captures are range-partitioned by (URL, time, id), so one URL's captures may span many
partitions; each partition carries the last full response forward inside itself, and what a partition leaves open is
closed from a narrow table with one row per URL and partition. Then validators are checked and permitted headers
merged. Bodies and pages never move: a resolved revisit names the response that has the body.

Defined cases: a null URL is never joined; a null time comes before all others and resolves nothing; a revisit without
an earlier response stays, with status "unresolved"; ties in time go by id, so a response and a revisit at one instant
are ordered by id; null headers and validators are absent ones; equal rows resolve alike; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequarry.runtime import materialise, shuffle_width

#: Headers that a not-modified response may update in what is stored (RFC 9110 section 15.4.5 names
#: those that it must carry; the content's own description stays that of the stored response).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "warning"]

#: Query parameters that only track where a visit came from.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "gclid", "fbclid", "sessionid"]

RECORD_SCHEMA = "record_id string, warc_type string, url string, captured string, refers_to string, profile string, http_status int, headers map<string,string>, body binary, error string"


# Reading and writing -------------------------------------------------------------------------------------------------


def header_block(stream, line: bytes | None = None) -> tuple[str, dict[str, str]] | None:
    """First line, unless it has been read, and lower-cased fields up to an empty line; None at the end of the stream."""
    line = stream.readline() if line is None else line
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    first, fields, name = line.decode("utf-8", "replace").strip(), {}, None
    for line in iter(stream.readline, b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return first, fields


def failed(fields: dict[str, str], error: str) -> dict:
    """The row of a record that can't be read, with what its header tells."""
    known = {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "url": fields.get("warc-target-uri", "").strip("<>") or None, "captured": fields.get("warc-date")}
    return known | {"refers_to": None, "profile": None, "http_status": None, "headers": [], "body": None, "error": error}


def next_start(stream) -> bytes:
    """The next line that begins a record; empty at the end."""
    return next((line for line in iter(stream.readline, b"") if line.startswith(b"WARC/")), b"")


def records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped by record. One that can't be read (no length, other bytes before it, or its
    block cut short) is a row with an error, and reading goes on at the next line that begins a record. A file that ends
    inside a header ends there."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    line = stream.readline()
    while line:
        if not line.strip():
            line = stream.readline()
            continue
        if not line.startswith(b"WARC/"):
            yield failed({}, "bytes between records")
            line = next_start(stream)
            continue
        _, fields = header_block(stream, line)
        size = fields.get("content-length", "")
        if not size.isdigit():
            line = stream.readline()
            if not line:
                return  # the file ends inside a header
            yield failed(fields, "no length")
            line = line if line.startswith(b"WARC/") else next_start(stream)
            continue
        block = stream.read(int(size))
        if len(block) < int(size):  # the rest may hold records, if the length is wrong
            yield failed(fields, f"{len(block)} of {size} bytes")
            stream = io.BytesIO(block)
            line = next_start(stream)
            continue
        line = stream.readline()
        status, http, body = None, {}, block
        if fields.get("content-type", "").startswith("application/http"):
            inner = io.BytesIO(block)
            if (got := header_block(inner)) is not None:
                words, http = got[0].split(None, 2), got[1]
                status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            body = inner.read()
        yield {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "url": fields.get("warc-target-uri", "").strip("<>") or None, "captured": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "profile": fields.get("warc-profile"), "http_status": status, "headers": list(http.items()), "body": body, "error": None}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files at a path, read by Spark, each file whole; those that can't be read have an error."""

    def run(batches):
        kind = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()), ("captured", pa.string()), ("refers_to", pa.string()), ("profile", pa.string()), ("http_status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                held = []
                for record in records(content.as_py()):
                    held.append(record)
                    if len(held) == 512:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def record_bytes(url: str, captured: str, status: int, headers: dict[str, str], body: bytes, warc_type: str = "response", record_id: str | None = None) -> bytes:
    """One record with an HTTP block."""
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + body
    head = {"WARC-Type": warc_type, "WARC-Record-ID": record_id or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": captured, "WARC-Target-URI": url, "Content-Type": f"application/http; msgtype={'response'}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


# Resolution ----------------------------------------------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """Scheme dropped; host in lower case without www., a default port or credentials; tracking parameters, the
    fragment, a trailing slash and an index page dropped; other parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(/index\.html?)?/*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def as_of(captures: DataFrame, full: Column, order: list[str], payload: list[str]) -> DataFrame:
    """Adds `prior`: a struct of payload columns of the latest earlier row of the same `key` for which full holds.

    Rows are sorted over all partitions by key and order, so no key, however frequent, gathers in one task. The sorted
    rows are kept as a table with their partition's number; every partition then resolves inside itself, and from one
    row per key and partition what it inherits.
    """
    spark = captures.sparkSession
    spread = captures.withColumn("is_full", F.coalesce(full, F.lit(False)))
    dealt = spread.repartitionByRange(shuffle_width(spark), "key", *order).withColumn("part", F.spark_partition_id())
    rows = materialise(dealt, "captures")
    found = F.when(F.col("is_full") & F.col("key").isNotNull(), F.struct(*payload))
    inside = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.struct(*payload), F.struct(*order))
    ends = rows.where(F.col("is_full") & F.col("key").isNotNull()).groupBy("key", "part").agg(last.alias("end"))
    reached = rows.where(F.col("key").isNotNull()).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).drop("n")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = reached.join(ends, ["key", "part"], "left").withColumn("carry", F.last("end", ignorenulls=True).over(earlier)).where("carry is not null").select(F.col("key").alias("c_key"), F.col("part").alias("c_part"), "carry")
    resolved = rows.withColumn("own", F.last(found, ignorenulls=True).over(inside))
    joined = resolved.join(carried, (F.col("key") == F.col("c_key")) & (F.col("part") == F.col("c_part")), "left")
    return joined.withColumn("prior", F.coalesce("own", "carry")).drop("own", "carry", "c_key", "c_part", "part", "is_full")


def header(name: str, of: str = "headers") -> Column:
    return F.try_element_at(F.col(of), F.lit(name))


def strong(tag: Column) -> Column:
    """An entity tag without its weakness mark, as not-modified answers are compared weakly."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Adds to captures (record_id, warc_type, url, captured, http_status, headers with lower-cased names):
    canonical, resolved_id, status and merged headers.

    status: full; unresolved (no earlier full response); mismatch (a validator differs: the content may have changed);
    unverified (no validator on both sides); resolved (an equal entity tag, else an equal modification time).
    """
    rows = captures.withColumn("key", canonical_url(F.col("url")))
    is_full = (F.col("warc_type") == "response") & (F.col("http_status") == 200) & F.col("captured").isNotNull()
    joined = as_of(rows, is_full, ["captured", "record_id"], ["record_id", "captured", "headers"])
    own_tag, old_tag = strong(header("etag")), strong(F.try_element_at(F.col("prior.headers"), F.lit("etag")))
    own_time, old_time = header("last-modified"), F.try_element_at(F.col("prior.headers"), F.lit("last-modified"))
    same_tag, same_time = own_tag == old_tag, own_time == old_time
    revisit = (F.col("warc_type") == "revisit") | (F.col("http_status") == 304)
    usable = F.col("prior").isNotNull() & F.col("captured").isNotNull()
    status = (
        F.when(~F.coalesce(revisit, F.lit(False)), "full")
        .when(~usable, "unresolved")
        .when(same_tag.isNotNull(), F.when(same_tag, "resolved").otherwise("mismatch"))
        .when(same_time.isNotNull(), F.when(same_time, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    old = F.coalesce("prior.headers", F.create_map().cast("map<string,string>"))
    stays = F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k))
    taken = F.col("status").isin("resolved", "unverified")
    return (
        joined.withColumn("status", status)
        .withColumn("resolved_id", F.when(F.col("status") == "full", F.col("record_id")).when(taken, F.col("prior.record_id")))
        .withColumn("merged", F.when(taken, F.map_concat(stays, fresh)).otherwise(F.col("headers")))
        .withColumnRenamed("key", "canonical")
        .drop("prior")
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl's captures of a table of pages (page_id, url, html): each page is fetched in full, and later revisited.

    Times follow page ids. Revisits are answered 304 with a validator: mostly the page's own (a weak entity tag, or
    only a modification time), now and then one of another content, none at all, or before the page was fetched.
    """
    pid = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    digest = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", digest.alias("digest"), pid.alias("n"))
    kind = F.pmod("n", F.lit(7))
    at = F.col("n") * 60
    stamp = lambda seconds: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    full = base.select("page_id", "url", F.concat(F.lit("r"), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))).alias("record_id"), F.lit("response").alias("warc_type"), stamp(at).alias("captured"), F.lit(200).alias("http_status"), F.create_map(F.lit("etag"), F.concat(F.lit('"'), "digest", F.lit('"')), F.lit("last-modified"), stamp(at - 30), F.lit("date"), stamp(at), F.lit("content-type"), F.lit("text/html")).alias("headers"))
    back = F.when(kind == 6, at - 45).otherwise(at + 3600 + kind)
    validator = (
        F.when(kind == 3, F.create_map(F.lit("etag"), F.concat(F.lit('"'), F.reverse("digest"), F.lit('"'))))
        .when(kind == 4, F.create_map(F.lit("last-modified"), stamp(at - 30)))
        .when(kind == 5, F.create_map(F.lit("server"), F.lit("edge")))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), "digest", F.lit('"'))))
    )
    again = base.select("page_id", "url", F.concat(F.lit("v"), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))).alias("record_id"), F.lit("revisit").alias("warc_type"), stamp(back).alias("captured"), F.lit(304).alias("http_status"), F.map_concat(validator, F.create_map(F.lit("date"), stamp(back), F.lit("content-type"), F.lit("text/plain"))).alias("headers"))
    return full.unionByName(again)


def revisit_digests(pages: DataFrame) -> DataFrame:
    """All captures of the pages, resolved; merged headers as one string in the order of their names."""
    rows = resolve_revisits(page_captures(pages))
    entries = F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("page_id", "record_id", "warc_type", "captured", "canonical", "status", "resolved_id", F.array_join(entries, ";").alias("merged_headers"))
