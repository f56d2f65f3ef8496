"""A sink for objects in two phases: tasks write aside, a commit names what counts, and then it is published.

`df.write.format("objects").option("run", ...).save(folder)` writes every row's content under `_aside`, each task attempt in
a folder of its own with a manifest of its keys. The driver's commit lists the manifests of the attempts that Spark took,
one line a task, and so decides what exists; attempts that failed, or ran twice, are in none. `publish` moves what the
manifests list to its keys, in tasks, and may be repeated; the mark of success comes last. Nothing is posted before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from framequarry.runtime import materialise

OBJECT_SCHEMA = "key string, content binary, content_type string, metadata map<string,string>"


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    objects: int
    bytes: int


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root.rstrip("/"), run

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.root)
        context = TaskContext.get()
        aside = f"{root}/_aside/{self.run}/{context.partitionId()}-{uuid.uuid4().hex}"
        system.create_dir(aside, recursive=True)
        count = size = 0
        with system.open_output_stream(f"{aside}/manifest.json") as manifest:
            for row in rows:
                path, content = f"{aside}/{count:08d}", bytes(row["content"] or b"")
                with system.open_output_stream(path) as f:
                    f.write(content)
                line = {"key": row["key"], "aside": path, "size": len(content), "content_type": row["content_type"], "metadata": dict(row["metadata"] or {})}
                manifest.write((json.dumps(line) + "\n").encode())
                count, size = count + 1, size + len(content)
        return Written(f"{aside}/manifest.json", count, size)

    def commit(self, messages: list[Written | None]) -> None:
        """One line for each task; from here on, what the manifests list is the run's result."""
        system, root = opened(self.root)
        system.create_dir(f"{root}/_runs/{self.run}", recursive=True)
        lines = [{"manifest": m.manifest, "objects": m.objects, "bytes": m.bytes} for m in messages if m is not None]
        with system.open_output_stream(f"{root}/_runs/{self.run}/committing") as f:
            f.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        system.move(f"{root}/_runs/{self.run}/committing", f"{root}/_runs/{self.run}/committed")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.root)
        if system.get_file_info(f"{root}/_aside/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_aside/{self.run}")


class ObjectSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return OBJECT_SCHEMA

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"], self.options["run"])


def committed(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(key, aside, size, content_type, metadata) of all objects of a committed run, read from the tasks' manifests."""
    from pyarrow import fs

    system, folder = opened(root)
    path = f"{folder.rstrip('/')}/_runs/{run}/committed"
    if system.get_file_info(path).type != fs.FileType.File:
        raise FileNotFoundError(f"run {run} is not committed")
    with system.open_input_stream(path) as f:
        manifests = [(json.loads(x)["manifest"],) for x in f.read().decode().splitlines()]  # one a task
    kind = pa.schema([("key", pa.string()), ("aside", pa.string()), ("size", pa.int64()), ("content_type", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])

    def run_(batches):
        inner, _ = opened(root)
        for batch in batches:
            for manifest in batch.column(0).to_pylist():
                with inner.open_input_stream(manifest) as f:
                    rows = [json.loads(x) for x in f.read().decode().splitlines()]
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist([r | {"metadata": list(r["metadata"].items())} for r in rows[at : at + 5000]], schema=kind)

    named = spark.createDataFrame(manifests, "manifest string").repartition(max(1, len(manifests)))
    return named.mapInArrow(run_, "key string, aside string, size long, content_type string, metadata map<string,string>")


def publish(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(key, size, content_type, metadata, error): a run's objects moved to their keys; of equal keys one stays. Moving is
    done once however often this runs; the run's mark `published` follows when all is in place."""

    def move(batches):
        from pyarrow import fs

        system, folder = opened(root)
        for batch in batches:
            errors = []
            for key, aside, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                target = f"{folder.rstrip('/')}/{key}"
                try:
                    if system.get_file_info(aside).type == fs.FileType.File:
                        system.create_dir(target.rpartition("/")[0], recursive=True)
                        system.move(aside, target)
                    elif system.get_file_info(target).size != size:
                        raise OSError(f"{key} is neither aside nor in place")
                    errors.append(None)
                except Exception as failure:
                    errors.append(str(failure))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(batch.column(i) for i in (3, 4)), pa.array(errors, pa.string())], names=["key", "size", "content_type", "metadata", "error"])

    listed = committed(spark, root, run)
    one = listed.groupBy("key").agg(F.min_by(F.struct("aside", "size", "content_type", "metadata"), "aside").alias("o")).select("key", "o.*")
    done = materialise(one.mapInArrow(move, "key string, size long, content_type string, metadata map<string,string>, error string"), "published")
    if done.where("error is not null").isEmpty():
        system, folder = opened(root)
        with system.open_output_stream(f"{folder.rstrip('/')}/_runs/{run}/published") as f:
            f.write(b"")
    return done


def store_objects(objects: DataFrame, root: str, run: str | None = None) -> DataFrame:
    """(key, ok, error) of objects (key, content, content_type, metadata) written, committed and published under root."""
    spark, run = objects.sparkSession, run or uuid.uuid4().hex
    spark.dataSource.register(ObjectSink)
    rows = objects.select("key", "content", "content_type", "metadata")
    rows.write.format("objects").option("run", run).mode("append").save(root)
    return publish(spark, root, run).select("key", F.col("error").isNull().alias("ok"), "error")
