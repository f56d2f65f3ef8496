"""Large files in parts, and objects that are there once or not at all."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framequarry.sources import objects, parts, playlist, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Ranges:
    """Contents by URL; says in a folder which process asked for what."""

    def __init__(self, contents, folder):
        self.contents, self.folder = contents, str(folder)

    def size(self, url):
        return len(self.contents[url])

    def read(self, url, start, end):
        if url not in self.contents:
            raise OSError("404")
        got = self.contents[url][start:end]
        with open(os.path.join(self.folder, f"asked-{os.getpid()}"), "a") as f:
            f.write(f"{len(got)}\n")
        return got


def asked(folder):
    return {name: [int(x) for x in open(os.path.join(folder, name)).read().split()] for name in os.listdir(folder) if name.startswith("asked-")}


def test_one_file_by_many_tasks(spark, tmp_path):
    content = bytes(i * 7 % 251 for i in range(100_003))
    fetcher = Ranges({"u/a": content, "u/b": b"small", "u/empty": b""}, tmp_path)
    files = spark.createDataFrame([("v/a.mp4", "u/a"), ("v/b.mp4", "u/b"), ("v/e.mp4", "u/empty"), ("v/no.mp4", "u/no")], "key string, url string")
    root = str(tmp_path / "out")
    for _ in range(2):  # a run again changes nothing
        got = {r["key"]: r for r in parts.store_files(files, fetcher, parts.FolderParts(root), part_bytes=1000).collect()}
    assert open(f"{root}/v/a.mp4", "rb").read() == content and open(f"{root}/v/b.mp4", "rb").read() == b"small"
    assert (got["v/a.mp4"]["parts"], got["v/a.mp4"]["size"], got["v/a.mp4"]["error"]) == (101, 100_003, None)
    assert got["v/e.mp4"]["error"] == "assembled file is empty" and "u/no" in got["v/no.mp4"]["error"] and not os.path.exists(f"{root}/v/e.mp4")
    seen = asked(tmp_path)
    assert len(seen) > 1 and max(max(x) for x in seen.values()) <= 1000


def test_a_stream_with_lost_segments(spark, tmp_path):
    contents = {f"https://h.example.test/s/{i}.ts": bytes([71, i]) * (i + 1) for i in range(40) if i % 9 != 4}
    text = "#EXTM3U\n" + "".join(f"#EXTINF:4,\n{i}.ts\n" for i in range(40))
    lists = spark.createDataFrame([("https://h.example.test/s/m.m3u8", text), ("https://h.example.test/gone/m.m3u8", text)], "playlist_url string, text string")
    found = playlist.segment_urls(playlist.segments(lists)).withColumn("key", F.when(F.col("playlist_url").contains("gone"), "gone.ts").otherwise("whole.ts"))
    got = {r["key"]: r for r in parts.store_streams(found, Ranges(contents, tmp_path), parts.FolderParts(str(tmp_path / "out"))).collect()}
    want = b"".join(contents[k] for k in sorted(contents, key=lambda k: int(k.rsplit("/", 1)[1][:-3])))
    assert (tmp_path / "out/whole.ts").read_bytes() == want
    assert (got["whole.ts"]["parts"], got["whole.ts"]["fetched"], got["whole.ts"]["size"]) == (40, len(contents), len(want))
    assert got["gone.ts"]["error"] == "Failed to download any segments" and not (tmp_path / "out/gone.ts").exists()


def test_offsets_are_sums_of_what_stands_before(spark, monkeypatch):
    monkeypatch.setattr(parts, "RUN", 8)
    rows = [(key, n, (n * 37 + len(key)) % 11) for key, count in (("hot", 500), ("b", 3)) for n in range(count) if n % 5]
    got = {(r["key"], r["number"]): r["offset"] for r in parts.offsets(spark.createDataFrame(rows, "key string, number long, size long")).collect()}
    for key in ("hot", "b"):
        at = 0
        for k, n, size in rows:
            if k == key:
                assert got[k, n] == at
                at += size


def test_files_as_ranges(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes(range(256)) * 5)
    (tmp_path / "y.bin").write_bytes(b"yy")
    spark.dataSource.register(parts.RangeSource)
    found = spark.read.format("byte_ranges").option("partBytes", 500).load(f"file://{tmp_path}/*.bin")
    assert found.rdd.getNumPartitions() == 4
    rows = sorted((r["path"][-5:], r["start"], r["end"], bytes(r["content"])) for r in found.collect())
    assert b"".join(r[3] for r in rows if r[0] == "x.bin") == bytes(range(256)) * 5 and [r[1:3] for r in rows if r[0] == "x.bin"] == [(0, 500), (500, 1000), (1000, 1280)]


def stored_under(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if "_aside" not in d and "_runs" not in d)


def made(spark, count):
    return spark.range(count).repartition(3, "id").select(F.concat(F.lit("k/"), F.col("id").cast("string")).alias("key"), F.encode(F.concat(F.lit("c"), F.col("id").cast("string")), "UTF-8").alias("content"), F.lit("text/plain").alias("content_type"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("metadata"))


def test_objects_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    got = objects.store_objects(made(spark, 50), root, "one").collect()
    assert len(got) == 50 and all(r["ok"] for r in got)
    assert stored_under(tmp_path) == sorted(f"k/{i}" for i in range(50)) and (tmp_path / "k/7").read_bytes() == b"c7"
    assert (tmp_path / "_runs/one/published").exists()
    again = objects.publish(spark, root, "one").collect()  # repeated, as after a lost executor
    assert all(r["error"] is None for r in again) and {r["metadata"]["n"] for r in again} == {str(i) for i in range(50)}
    assert objects.committed(spark, root, "one").count() == 50


def test_a_failed_write_leaves_nothing_and_posts_nothing(spark, tmp_path):
    root, posted = f"file://{tmp_path}", tmp_path / "posted"

    def broken(batches):
        for k, batch in enumerate(batches):
            yield batch
            raise OSError("the store went away")

    failing = made(spark, 50).mapInArrow(broken, objects.OBJECT_SCHEMA)

    def post(url, body, timeout):
        with open(posted, "a") as f:
            f.write(json.dumps({"after": os.path.exists(tmp_path / "_runs/two/published")}) + "\n")

    def deliver(rows):
        objects.store_objects(rows, root, "two")
        sinks.post_results(rows.select("key").limit(1), "http://hook.example.test", post=post)

    with pytest.raises(Exception, match="store went away"):
        deliver(failing)
    assert stored_under(tmp_path) == [] and not posted.exists() and not (tmp_path / "_runs/two/committed").exists()
    with pytest.raises(FileNotFoundError):
        objects.publish(spark, root, "two")
    deliver(made(spark, 50))
    assert len([x for x in stored_under(tmp_path) if x.startswith("k/")]) == 50
    assert [json.loads(x)["after"] for x in posted.read_text().splitlines()] == [True]
