"""Large files in parts: ranges of a file, or segments of a stream, fetched and stored by many tasks as one object.

Every part is a row: a byte range of a file whose size is known, or a segment. Parts are dealt over tasks by hash, so one
stream is fetched by several, and a task holds one part at a time. A part goes to the store under its number; parts that
can't be fetched are skipped. Where all parts of an object are, their sizes give their offsets by a prefix sum, they are
put in place by tasks of their own, and the object appears at once when it is completed; nothing of it is seen before.
All steps give the same result when they run again, so tasks may be retried at any time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framequarry.runtime import materialise, shuffle_width

PART_BYTES = 8 << 20
#: Parts whose sizes one window adds up.
RUN = 1024


class RangeFetcher(Protocol):
    def size(self, url: str) -> int: ...

    def read(self, url: str, start: int, end: int | None) -> bytes:
        """Bytes from start to before end, or to the last."""
        ...


class HttpRanges:
    """Byte ranges over HTTP."""

    def __init__(self, timeout: float = 60.0):
        self.timeout = timeout

    def size(self, url: str) -> int:
        import urllib.request

        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=self.timeout) as answer:
            return int(answer.headers["Content-Length"])

    def read(self, url: str, start: int, end: int | None) -> bytes:
        import urllib.request

        ask = {} if not start and end is None else {"Range": f"bytes={start}-{'' if end is None else end - 1}"}
        with urllib.request.urlopen(urllib.request.Request(url, headers=ask), timeout=self.timeout) as answer:
            if ask and answer.status != 206:
                raise OSError(f"{url} does not answer ranges")
            return answer.read()


class Multipart(Protocol):
    """A store that takes an object in parts: numbers ascend, and may have gaps."""

    def put(self, key: str, number: int, content: bytes) -> None: ...

    def place(self, key: str, number: int, offset: int, size: int) -> None: ...

    def complete(self, key: str, size: int) -> None: ...


class FolderParts:
    """Parts and objects in a folder that all tasks share. A part is written aside and renamed, so half of one is never
    read; placing copies it to its offset, and completing renames the whole."""

    def __init__(self, root: str):
        self.root = root

    def _aside(self, key: str, name: str) -> str:
        folder = os.path.join(self.root, "_parts", key)
        os.makedirs(folder, exist_ok=True)
        return os.path.join(folder, name)

    def put(self, key: str, number: int, content: bytes) -> None:
        path = self._aside(key, f"{number:08d}")
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(content)
        os.replace(f.name, path)

    def place(self, key: str, number: int, offset: int, size: int) -> None:
        with open(self._aside(key, f"{number:08d}"), "rb") as f:
            content = f.read()
        if len(content) != size:
            raise OSError(f"part {number} of {key} has {len(content)} bytes, not {size}")
        whole = os.open(self._aside(key, "whole"), os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            done = 0
            while done < size:
                done += os.pwrite(whole, content[done:], offset + done)
        finally:
            os.close(whole)

    def complete(self, key: str, size: int) -> None:
        whole, target = self._aside(key, "whole"), os.path.join(self.root, key)
        if not os.path.exists(whole):
            if os.path.exists(target) and os.path.getsize(target) == size:
                return  # done by a run before
            raise OSError(f"{key} has no parts in place")
        os.truncate(whole, size)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(whole, target)


def ranges(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, url, size) to (key, number, url, start, end), a row for every part_bytes bytes; none of an empty file."""
    rows = files.where("size > 0").select("key", "url", "size", F.posexplode(F.expr(f"sequence(0L, size - 1, {int(part_bytes)}L)")).alias("number", "start"))
    return rows.select("key", F.col("number").cast("long").alias("number"), "url", "start", F.least("size", F.col("start") + int(part_bytes)).alias("end"))


def sized(files: DataFrame, fetcher: RangeFetcher) -> DataFrame:
    """(key, url) with size, and error where it can't be told."""

    def run(batches):
        for batch in batches:
            sizes, errors = [], []
            for url in batch.column(1).to_pylist():
                try:
                    sizes.append(fetcher.size(url))
                    errors.append(None)
                except Exception as failure:
                    sizes.append(None)
                    errors.append(str(failure))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["key", "url", "size", "error"])

    return files.select("key", "url").mapInArrow(run, "key string, url string, size long, error string")


def stored(parts: DataFrame, fetcher: RangeFetcher, store: Multipart) -> DataFrame:
    """(key, number, size, error): every part fetched and put, one at a time; size is null where that failed."""

    def run(batches):
        for batch in batches:
            sizes, errors = [], []
            for key, number, url, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    content = fetcher.read(url, start, end)
                    if end is not None and len(content) != end - start:
                        raise OSError(f"{len(content)} bytes of {url}, not {end - start}")
                    store.put(key, number, content)
                    sizes.append(len(content))
                    errors.append(None)
                except Exception as failure:
                    sizes.append(None)
                    errors.append(str(failure))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["key", "number", "size", "error"])

    rows = parts.select("key", "number", "url", "start", "end").repartition(shuffle_width(parts.sparkSession), F.xxhash64("key", "number"))
    return rows.mapInArrow(run, "key string, number long, size long, error string")


def offsets(sizes: DataFrame) -> DataFrame:
    """(key, number, size) with offset, the sum of the sizes before: sums of runs of RUN numbers, added up, and then sums
    inside a run, so no window holds more than a run or a row a run."""
    rows = sizes.withColumn("run", F.floor(F.col("number") / RUN))
    runs = rows.groupBy("key", "run").agg(F.sum("size").alias("held"))
    before = runs.selectExpr("key", "run", "coalesce(sum(held) over (partition by key order by run rows between unbounded preceding and 1 preceding), 0) as base")
    inside = rows.selectExpr("*", "coalesce(sum(size) over (partition by key, run order by number rows between unbounded preceding and 1 preceding), 0) as within")
    return inside.join(before, ["key", "run"]).select("key", "number", "size", (F.col("base") + F.col("within")).alias("offset"))


def placed(rows: DataFrame, store: Multipart) -> DataFrame:
    """(key, number, size, offset) put in place: key, size and error of each."""

    def run(batches):
        for batch in batches:
            errors = []
            for key, number, size, offset in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    store.place(key, number, offset, size)
                    errors.append(None)
                except Exception as failure:
                    errors.append(str(failure))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(errors, pa.string())], names=["key", "size", "error"])

    spread = rows.select("key", "number", "size", "offset").repartition(shuffle_width(rows.sparkSession), F.xxhash64("key", "number"))
    return spread.mapInArrow(run, "key string, size long, error string")


def completed(objects: DataFrame, store: Multipart) -> DataFrame:
    """(key, parts, size, error) with the objects completed that have no error."""

    def run(batches):
        for batch in batches:
            errors = []
            for key, _, size, error in zip(*(c.to_pylist() for c in batch.columns)):
                if error is None:
                    try:
                        store.complete(key, size)
                    except Exception as failure:
                        error = str(failure)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(errors, pa.string())], names=["key", "parts", "size", "error"])

    return objects.select("key", "parts", "size", "error").mapInArrow(run, "key string, parts long, size long, error string")


def store_parts(parts: DataFrame, fetcher: RangeFetcher, store: Multipart, whole: bool = False) -> DataFrame:
    """(key, parts, fetched, size, error): objects made of parts (key, number, url, start, end), one row each.

    Parts that can't be fetched are left out; whole: an object that misses one is an error. One of which none could be
    fetched is an error, too, and so is an empty one.
    """
    got = materialise(stored(parts, fetcher, store), "parts")
    asked = got.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.count("size").alias("fetched"), F.sum("size").alias("size"), F.min("error").alias("why"))
    lost = F.when(F.col("fetched") == 0, "Failed to download any segments").when(F.col("size") == 0, "assembled file is empty")
    asked = asked.withColumn("error", lost if not whole else F.coalesce(F.when(F.col("fetched") < F.col("parts"), F.col("why")), lost))
    asked = materialise(asked, "objects")
    good = got.where("size is not null").join(asked.where("error is null").select("key"), "key", "left_semi")
    put = materialise(placed(offsets(good.select("key", "number", "size")), store), "placed")
    broken = put.groupBy("key").agg(F.min("error").alias("broken"))
    ready = asked.join(broken, "key", "left").select("key", "parts", "fetched", "size", F.coalesce("error", "broken").alias("error"))
    done = materialise(completed(ready, store), "completed")
    return ready.select("key", "fetched").join(done, "key").select("key", "parts", "fetched", F.when(F.col("error").isNull(), F.col("size")).alias("size"), "error")


def store_files(files: DataFrame, fetcher: RangeFetcher, store: Multipart, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, url) fetched by byte ranges; an object that misses a range is an error."""
    known = materialise(sized(files, fetcher), "sizes")
    empty = known.where("error is not null or size = 0").select("key", F.lit(0).cast("long").alias("parts"), F.lit(0).cast("long").alias("fetched"), F.lit(None).cast("long").alias("size"), F.coalesce("error", F.lit("assembled file is empty")).alias("error"))
    return store_parts(ranges(known.where("error is null"), part_bytes), fetcher, store, whole=True).unionByName(empty)


def store_streams(segments: DataFrame, fetcher: RangeFetcher, store: Multipart) -> DataFrame:
    """(key, pos, url) fetched segment by segment, in order; failed segments are skipped."""
    nothing = F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end")
    return store_parts(segments.select("key", F.col("pos").cast("long").alias("number"), "url", *nothing), fetcher, store)


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Ranges of the files that match the path's pattern; the driver lists names and sizes only."""
        import fnmatch

        from pyarrow import fs

        path, part = self.options["path"], int(self.options.get("partBytes", PART_BYTES))
        fixed = re.match(r"[^*?\[]*", path)[0]
        folder, scheme = fixed[: fixed.rindex("/") + 1], re.match(r"[A-Za-z][A-Za-z0-9+.-]*://|", path)[0]
        system, root = fs.FileSystem.from_uri(folder)
        pattern = root.rstrip("/") + "/" + path[len(folder) :]
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive="/" in path[len(folder) :])) if f.is_file and fnmatch.fnmatch(f.path, pattern)]
        return [FileRange(scheme + f.path, at, min(f.size, at + part)) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, part)]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as f:
            f.seek(partition.start)
            yield partition.path, partition.start, partition.end, f.read(partition.end - partition.start)


class RangeSource(DataSource):
    """spark.read.format("byte_ranges").option("partBytes", n).load(glob): path, start, end, content; a partition a range."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start long, end long, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)
