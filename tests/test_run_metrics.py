"""Progress and time of a run, catalog records as variants, and person ids of a stream."""

import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framequarry.operators import requests
from framequarry.plans import pipeline, profiles
from framequarry.progress import Progress
from framequarry.sources import media
from framequarry.streaming import persons

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class SlowDetector:
    """Finds one face a frame; video b takes longer, and ends early."""

    def available(self):
        return True

    def detect(self, video_id, frame_idx):
        if video_id == "b" and frame_idx >= 100:
            raise EOFError
        time.sleep(0.05 if video_id == "b" else 0.005)
        return [{"embedding": [1.0, 0.0, 0.0], "det_score": 0.9}]


def test_frames_and_seconds_are_each_video_s_own(spark):
    videos = spark.createDataFrame([("a", 25.0, 500, 640, 360), ("b", 25.0, 500, 640, 360)], "video_id string, fps double, total_frames long, width int, height int")
    asked = spark.createDataFrame([(v, f"https://h.example.test/{v}.mp4", None) for v in "ab"], "request_id string, video_url string, transcript_url string").select("*", F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast(requests.LISTING).alias("listing"))
    said = []
    rows, errors = pipeline.run(asked, pipeline.Plugins(videos=videos, detector=SlowDetector(), log=said.append), profiles.JOB)
    got = {r["video_id"]: r["processing_metrics"] for r in rows.collect()}
    assert errors.count() == 0
    # 42 short looks and 9 long ones, besides an equal share of all else.
    assert got["b"]["duration_seconds"] >= 9 * 0.05 and got["a"]["duration_seconds"] >= 42 * 0.005
    assert got["b"]["duration_seconds"] > got["a"]["duration_seconds"] + 0.03
    assert got["b"]["inference_fps"] < 20.5 and got["a"]["inference_fps"] > 20.5
    assert got["a"]["estimated_cost_usd"] == pytest.approx(got["a"]["duration_seconds"] * profiles.JOB.price_per_second, abs=1e-4)
    assert len(said) == 1 and said[0].startswith("detect: ") and "51 frames" in said[0]


def test_watched_rows_tell_frames_and_seconds(spark):
    samples = spark.createDataFrame([(v, f) for v in "ab" for f in range(0, 300, 50)], "video_id string, frame_idx long")
    found = media.watched(samples, SlowDetector())
    told = {r["video_id"]: (r["frames"], r["seconds"]) for r in found.where("det_ord is null").collect()}
    assert told["a"][0] == 6 and told["b"][0] == 2 and told["b"][1] >= 0.1
    assert media.detected(samples, SlowDetector()).count() == 8


def test_progress(spark):
    said = []
    progress = Progress(spark, said.append)
    with progress.following(0.05):
        progress.watch(spark.range(0, 1000, 1, 8).where("id % 3 = 0"), "thirds", total=F.col("id")).write.format("noop").mode("overwrite").save()
        spark.range(0, 10_000_000, 1, 8).selectExpr("sum(sqrt(id))").collect()
    assert progress.done("thirds") == {"rows": 334, "total": sum(range(0, 1000, 3))}
    assert said[-1] == f"thirds: 334 rows, {sum(range(0, 1000, 3))} total"


def test_variants(spark):
    texts = ['{"id": "7", "title": "t", "hlsUrl": "u", "channelTitle": "c", "relatedProductsAsins": ["a", "b"], "videoPreviewAssets": [{"url": "x", "type": "clip", "mimeType": "video/mp4"}]}',
             '{"contentId": "8", "url": "v", "creator": {"publicName": "p"}, "relatedProductsAsins": "a , b", "extra": {"new": [1, 2.5]}}', '{"id": 9, "hlsUrl": ""}', '{"id": ', "[1, 2]", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    got = requests.variant_assets(rows).collect()
    assert [tuple(r)[:5] for r in got] == [("7", "aggregated", "t", "u", "c"), ("8", "detail", None, "v", "p"), ("9", "aggregated", None, None, None), (None, None, None, None, None), (None, "aggregated", None, None, None), (None, None, None, None, None)]
    assert [r["products"] for r in got][:3] == [["a", "b"], ["a", "b"], None] and got[0]["assets"][0]["url"] == "x"
    assert got[3]["error"] == 'malformed JSON: {"id": ' and [r["error"] for r in got if r["error"]] == [got[3]["error"]]
    fields = {(r["n"], r["field"]): (r["kind"], r["text"]) for r in requests.variant_fields(rows, ["n"]).where("field is not null").collect()}
    assert fields[1, "extra"] == ("OBJECT<new: ARRAY<DECIMAL(11,1)>>", '{"new":[1,2.5]}') or fields[1, "extra"][1] == '{"new":[1,2.5]}'
    assert fields[2, "id"] == ("BIGINT", "9") and fields[0, "title"] == ("STRING", "t")
    told = requests.inferred_schema(rows.where("n < 4")).first()
    assert told["malformed"] == 1 and "contentId: STRING" in told["schema"] and told["schema"].startswith("OBJECT<")


def detections(people, count, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((people, 16))
    return [(v, i, [float(x) for x in centres[(i * 7 + len(v)) % people] + 0.05 * rng.standard_normal(16)]) for v in ("a", "bb") for i in range(count)]


def streamed(spark, folder, batches, restart):
    """Ids of detections that arrive in files, one a trigger; restart: each trigger is a query of its own."""
    schema = "video_id string, det_ord long, embedding array<float>"

    def start():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
        return persons.person_ids(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        time.sleep(0.05)
        if restart or k == len(batches) - 1:
            assert start().awaitTermination(60)
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


@pytest.fixture
def with_timers(spark):
    """A state store with timers, and queries that end when their input does."""
    held = {"spark.sql.streaming.stateStore.providerClass": persons.ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


def test_person_ids_however_the_stream_is_cut(spark, tmp_path, with_timers):
    rows = detections(4, 24, 5)
    third = [[r for r in rows if lo <= r[1] < lo + 8] for lo in (0, 8, 16)]
    one = streamed(spark, tmp_path / "one", [rows], False)
    three = streamed(spark, tmp_path / "three", third, True)  # a restart goes on from the checkpoint
    assert one == three and len(one) == len(rows)
    assert {(v, i) for v, _, i in one} == {(v, i) for v in ("a", "bb") for i in range(4)}
    by_person = {}
    for v, o, i in one:
        by_person.setdefault((v, i), set()).add((o * 7 + len(v)) % 4)
    assert all(len(x) == 1 for x in by_person.values())


def test_person_ids_need_their_state_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        persons.person_ids(spark.createDataFrame([], "video_id string, det_ord long, embedding array<float>"))


def test_persons_expire():
    held = persons.Persons(0.65)
    assert [held.meet(v, now) for v, now in (([1, 0], 0), ([0, 1], 50), ([1, 0.1], 60), ([0, 0], 70))] == [0, 1, 0, 2]
    again = persons.Persons(0.65, held.state())
    again.drop(55)
    assert again.ids == [0, 2] and again.meet([0, 1], 80) == 3 and again.meet([1, 0], 81) == 0
