"""Where results go: files, objects under idempotent keys, a webhook. All are off unless called."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ALL_FIELDS = {"ignoreNullFields": "false"}


def to_json_rows(results: DataFrame) -> DataFrame:
    """One JSON text per row, nulls written out."""
    return results.select(F.to_json(F.struct(*results.columns), ALL_FIELDS).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(results: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    results.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def show_json(results: DataFrame, rows: int = 20) -> None:
    to_json_rows(results).show(rows, truncate=False)


def put_objects(objects: DataFrame, put: Callable[[str, bytes, str, dict], None]) -> DataFrame:
    """(key, content, content_type, metadata map) through put, on executors; key, ok and error of each.

    A task that is run again writes the same keys again, so put must overwrite. Failures become rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, content, kind, meta in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    put(key, content, kind, dict(meta or {}))
                    out.append((key, True, None))
                except Exception as failure:
                    out.append((key, False, str(failure)))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], names=["key", "ok", "error"])

    return objects.select("key", "content", "content_type", "metadata").mapInArrow(run, "key string, ok boolean, error string")


def archive_metadata(job_id, source_url, title, archived_at, frames):
    """The five fields kept with an archived video, as a map column; nulls become empty texts."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.create_map(F.lit("job-id"), text(job_id), F.lit("source-url"), text(source_url), F.lit("title"), text(title), F.lit("archived-at"), text(archived_at), F.lit("total-frames"), text(frames))


def archived(jobs: DataFrame, content: DataFrame, put: Callable[[str, bytes, str, dict], None], at: Column, url_base: str = "") -> DataFrame:
    """(video_id, archived_s3_key, archived_s3_url); both null where the upload failed, which fails nothing else.

    jobs: video_id, job_id, base_path, source_url, total_frames and metadata; content: video_id and content.
    """
    title = F.try_element_at("metadata", F.lit("broadcast_title"))
    rows = jobs.join(content.select("video_id", "content"), "video_id").select("video_id", F.concat("base_path", F.lit("/video.mp4")).alias("key"), "content", F.lit("video/mp4").alias("content_type"), archive_metadata(F.col("job_id"), F.col("source_url"), title, at, F.col("total_frames")).alias("metadata"))
    stored = put_objects(rows, put).where("ok").select(F.col("key").alias("archived_s3_key"))
    found = rows.select("video_id", F.col("key").alias("archived_s3_key")).join(stored, "archived_s3_key")
    done = found.select("video_id", "archived_s3_key", F.concat(F.lit(url_base), "archived_s3_key").alias("archived_s3_url"))
    return jobs.select("video_id").join(done, "video_id", "left")


def iso_now() -> Column:
    """The current time as ISO-8601 text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def post_results(results: DataFrame, url: str | None, timeout: float = 5.0, post: Callable[[str, bytes, float], None] | None = None) -> None:
    """Posts each row as JSON; no URL, no post. Best effort: errors are ignored, and a retried task posts again."""
    if not url:
        return

    def send(target: str, body: bytes, seconds: float) -> None:
        urllib.request.urlopen(urllib.request.Request(target, body, {"Content-Type": "application/json"}), timeout=seconds).close()

    used = post or send

    def each(rows) -> None:
        for row in rows:
            try:
                used(url, row["value"].encode(), timeout)
            except Exception:
                continue

    to_json_rows(results).foreachPartition(each)


def payload_of(results: DataFrame) -> list[dict]:
    """Results of a few requests as Python objects, for callers that asked for them."""
    return [json.loads(r["value"]) for r in to_json_rows(results).collect()]
