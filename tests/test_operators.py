"""Boundary rows and small models of the engine's operators."""

import json
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framequarry.functions import scalars
from framequarry.operators import clustering, context, payload, requests, sampling, scoring, selection
from framequarry.operators.components import connected_components
from framequarry.plans import pipeline
from framequarry.plans.profiles import CANONICAL, JOB, LEGACY, ORGANIZED, PROFILES
from framequarry.sources import config, media, playlist, sinks, vtt
from framequarry.streaming import ingest


def value(spark, column, **columns):
    names = list(columns) or ["x"]
    kinds = {str: "string", float: "double", int: "long", bytes: "binary", bool: "boolean", type(None): "string"}
    row = tuple(columns.values()) or (1,)
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, row))
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x,places,want", [(2.675, 2, 2.67), (0.125, 2, 0.12), (0.375, 2, 0.38), (1234567.891, 2, 1234567.89), (-2.5, 0, -2.0)])
def test_rounding_is_python_s(spark, x, places, want):
    assert value(spark, scalars.py_round(F.col("x"), places), x=x) == want == round(x, places)


def test_fixed_places(spark):
    rng = random.Random(1)
    xs = [0.25, 0.05, 1.45, 12345.65] + [rng.randrange(10**6) / 80 for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(scalars.py_fixed(F.col("x"), 1).alias("v")).collect()
    assert [r["v"] for r in rows] == [f"{x:.1f}" for x in xs]


def test_strings(spark):
    assert value(spark, scalars.strip(F.col("x")), x=" \t\n a b \n") == "a b"
    assert value(spark, scalars.after_comma(F.col("x")), x="en,https://h.example/a,b.vtt") == "https://h.example/a,b.vtt"
    assert value(spark, scalars.after_comma(F.col("x")), x="https://h.example/a.vtt") == "https://h.example/a.vtt"
    assert value(spark, F.length(scalars.shortened(F.col("x"))), x="a" * 1000) == 1000
    assert value(spark, scalars.shortened(F.col("x")), x="a" * 1001) == "a" * 997 + "..."
    assert value(spark, scalars.first_present(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert value(spark, scalars.vtt_seconds(F.col("x")), x="01:02:03.250") == 3723.25
    assert value(spark, scalars.vtt_seconds(F.col("x")), x="02:03.5") == 123.5
    assert value(spark, scalars.vtt_seconds(F.col("x")), x="nonsense") is None
    assert value(spark, scalars.stream_error(F.col("x")), x="No segments found in variant") == "no_segments"
    assert value(spark, scalars.stream_error(F.col("x")), x="Bad Variant") == "bad_variant_playlist"
    assert value(spark, scalars.is_transport_stream(F.col("x")), x=b"G\x00") and not value(spark, scalars.is_transport_stream(F.col("x")), x=b"\x00G")
    assert value(spark, scalars.decoded(F.col("x")), x="é".encode()) == "é"
    assert value(spark, scalars.is_playlist_url(F.col("x")), x="https://h/a.M3U8?x")
    assert value(spark, scalars.masked(F.col("x")), x="secretkey") == "...tkey"


@pytest.mark.parametrize(
    "line,speaker,text",
    [("x" * 39 + ": hi", "x" * 39, "hi"), ("x" * 40 + ": hi", None, "x" * 40 + ": hi"), ("12:30 we start", "12", "30 we start"), (": hi", "", "hi"), ("no colon", None, "no colon")],
)
def test_speakers(spark, line, speaker, text):
    assert value(spark, scalars.speaker_of(F.col("x")), x=line) == speaker
    assert value(spark, scalars.speech_of(F.col("x")), x=line) == text


@pytest.mark.parametrize("w,h,want", [(640, 640, (1920, 1080)), (640, 641, (1080, 1920))])
def test_target_size(spark, w, h, want):
    got = value(spark, scalars.target_size(F.col("w"), F.col("h")), w=w, h=h)
    assert (got["width"], got["height"]) == want


def test_url_join_and_maps(spark):
    assert value(spark, scalars.url_join("a", "b"), a="https://h/x/y.m3u8", b="z.ts") == "https://h/x/z.ts"
    assert value(spark, scalars.url_join("a", "b"), a="https://h/x/y.m3u8", b="/z.ts") == "https://h/z.ts"
    left, right = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))
    assert value(spark, scalars.merged_maps(left, right)) == {"a": "1", "b": "3"}
    assert value(spark, scalars.merged_maps(F.lit(None).cast("map<string,string>"), right)) == {"b": "3"}


def candidates(n):
    picks = {0, min(29, n - 1), max(0, n - 31), max(0, n - 2)}
    if n > 10:
        picks |= {int(x) for x in np.linspace(30, n - 31, 10)[1:-1]}
    return picks


def test_representative_frames(spark):
    golden = {1: [0], 5: [0, 3, 4], 11: [0, 2, 7, 9, 10], 30: [0, 2, 5, 9, 12, 16, 19, 23, 26, 28], 60: [0, 29, 58], 61: [0, 29, 30, 59], 100: [0, 29, 34, 38, 43, 47, 51, 56, 60, 64], 1000: [0, 29, 134, 238, 343, 447, 551, 656, 760, 864]}
    ns = sorted(set(golden) | set(range(1, 200)) | {4999, 12345})
    rows = sampling.representative_frames(spark.createDataFrame([(n, n) for n in ns], "video_id long, total_frames long")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["video_id"], r["ordinal"])):
        got.setdefault(r["video_id"], []).append((r["ordinal"], r["frame_idx"]))
    for n in ns:
        want = [(i, f) for i, f in enumerate(sorted(candidates(n))[:10]) if 0 <= f < n]
        assert got[n] == want, n
    assert all([f for _, f in got[n]] == golden[n] for n in golden)


def test_padding(spark):
    rows = sampling.representative_frames(spark.createDataFrame([(n, n) for n in (0, 1, 3, 5, 10, 15, 60, 61, 500)], "video_id long, total_frames long"), padded=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["video_id"], r["ordinal"])):
        got.setdefault(r["video_id"], []).append(r["frame_idx"])
    assert got[60] == [0, 3, 4, 5, 6, 7, 8, 9, 29, 58] and got[61] == [0, 4, 5, 6, 7, 8, 9, 29, 30, 59]
    assert got[5] == [0, 1, 2, 3, 4] and got[10] == list(range(10)) and 0 not in got
    raw = sampling.representative_frames(spark.createDataFrame([(15, 15)], "video_id long, total_frames long"), padded=True, strict=True)
    assert raw.count() == 10 and len(got[15]) == sum(0 <= r["frame_idx"] < 15 for r in raw.collect())


@pytest.mark.parametrize("profile,seconds,want", [(CANONICAL, 599.9, 25), (CANONICAL, 600.0, 50), (ORGANIZED, 599.9, 25), (ORGANIZED, 600.0, 50), (ORGANIZED, 1800.0, 125), (JOB, 29.9, 12), (JOB, 30.0, 25), (LEGACY, 5.0, 25)])
def test_strides(spark, profile, seconds, want):
    assert value(spark, sampling.stride_frames(profile, F.col("s"), F.lit(25.0)), s=seconds) == want


def test_regions_and_refinement(spark):
    points = spark.createDataFrame([("v", float(t)) for t in (0, 5, 2)], "video_id string, ts double")
    got = sorted((r["start"], r["end"]) for r in sampling.regions(points).collect())
    assert got == [(0.0, 3.0), (4.0, 6.0)]
    assert value(spark, sampling.refine_step(F.col("s"), F.lit(1.0)), s=600.0) == 5
    assert value(spark, sampling.refine_step(F.col("s"), F.lit(1.0)), s=1500.0) == 10
    bad = sampling.quarantine(spark.createDataFrame([("a", 0.0, 10), ("b", 25.0, 0), ("c", 25.0, 10)], "video_id string, fps double, total_frames long"))
    assert {r["video_id"] for r in bad.where("error is null").collect()} == {"c"}


def test_threshold_boundary(spark):
    rows = spark.createDataFrame([(0.6,), (0.61,)], "det_score double")
    assert scoring.confident(rows).count() == 1 and scoring.confident(rows, inclusive=True).count() == 2


def test_best_per_group_ties(spark):
    rows = [("g", i, [0.5, 0.9, 0.9, None][i % 4]) for i in range(40)]
    for parts in (1, 7):
        got = selection.best_per_group(spark.createDataFrame(rows, "k string, det_ord long, score double").repartition(parts), ["k"], "score", "det_ord").collect()
        assert [(r["det_ord"], r["score"]) for r in got] == [(1, 0.9)]


def find_context(ts, captions):
    for c in captions:
        if c[2] <= ts <= c[3]:
            return c[4], c[5]
    for c in captions:
        if abs(c[2] - ts) < 2.0:
            return c[4], c[5]
    return None, None


def test_context_matches_loops(spark):
    rng = random.Random(2)
    captions = [("v", i, float(s := rng.randrange(0, 400) / 4), s + rng.choice([0.0, 0.5, 3.0, 40.0]), rng.choice([None, "", "Ann", "Bo"]), f"t{i}") for i in range(60)]
    moments = [("v", i, rng.randrange(0, 480) / 4) for i in range(400)] + [("w", 1000, 5.0)]
    got = context.with_context(spark.createDataFrame(moments, "video_id string, m long, ts double"), spark.createDataFrame(captions, "video_id string, ordinal int, start double, end double, speaker string, text string")).collect()
    assert len(got) == len(moments)
    for r in got:
        assert (r["speaker"], r["context_text"]) == find_context(r["ts"], captions if r["video_id"] == "v" else [])


def test_clusters_agree(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(v, i, [float(x) for x in (centres[i % 6] + rng.standard_normal(8) * rng.choice([0.2, 0.9]))]) for v in ("a", "b") for i in range(80)] + [("c", 0, [0.0] * 8), ("c", 1, [0.0] * 8)]
    points = spark.createDataFrame(rows, "video_id string, det_ord long, embedding array<float>")
    one = sorted(map(tuple, clustering.clusters(points.repartition(5)).collect()))
    assert one == sorted(map(tuple, clustering.clusters_grouped(points).collect()))
    assert len({label for _, _, label in one}) > 2
    blocks = np.array([r[2] for r in rows if r[0] == "a"])
    assert (clustering.dbscan(blocks, block=7) == clustering.dbscan(blocks)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 202), (202, 201), (None, 3)] + [(500, 500 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(9)
    for local in (10**6, 30):
        got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b", local).collect()}
        assert all(got[i] == 0 for i in range(61)) and got[100] == 100 and got[201] == got[202] == 200 and all(got[500 + i] == 500 for i in range(300))
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


VTT = "WEBVTT\n\ncue1\n00:00:01.000 --> 00:00:04.000 align:start\nAnn: <b>hello</b>\nthere\n\nNOTE nothing\n\n00:05.500 --> 00:07.000\nplain line\n\nbroken --> 00:09.000\nlost\n"


def test_vtt(spark, tmp_path):
    rows = sorted(map(tuple, vtt.parse_captions(spark.createDataFrame([("v", VTT.replace("\n", "\r\n")), ("n", None)], "video_id string, vtt string")).collect()))
    assert rows == [("v", 0, 1.0, 4.0, "Ann", "hello there"), ("v", 1, 5.5, 7.0, None, "plain line")]
    text = vtt.transcripts(vtt.parse_captions(spark.createDataFrame([("v", VTT)], "video_id string, vtt string"))).first()["transcription"]
    assert text == "[1.0s] Ann: hello there [5.5s] plain line"
    (tmp_path / "a.vtt").write_text(VTT)
    spark.dataSource.register(vtt.VttSource)
    assert spark.read.format("vtt").load(str(tmp_path / "*.vtt")).count() == 2
    assert vtt.read_captions(spark, str(tmp_path)).count() == 2


MASTER = "#EXTM3U\n#EXT-X-STREAM-INF:RESOLUTION=640x360\na.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=5,RESOLUTION=1280x720\nsub/b.m3u8\n#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=9,BANDWIDTH=5\nc.m3u8\n"
MEDIA = "#EXTM3U\n#EXTINF:4,\n#EXT-X-BYTERANGE:5\ns1.ts\n\n#EXTINF:4,\ns2.ts\n#EXTINF:4,\nhttps://other/s3.ts\n#EXT-X-ENDLIST\n"


def test_playlists(spark):
    rows = spark.createDataFrame([("https://h/x/m.m3u8", MASTER), ("https://h/y/m.m3u8", MEDIA), ("https://h/z.m3u8", None)], "playlist_url string, text string")
    best = playlist.best_variants(playlist.variants(rows)).collect()
    assert [(r["uri"], r["bandwidth"], r["width"], r["url"]) for r in best] == [("sub/b.m3u8", 5, 1280, "https://h/x/sub/b.m3u8")]
    parts = sorted((r["pos"], r["url"]) for r in playlist.segment_urls(playlist.segments(rows)).collect())
    assert parts == [(0, "https://h/y/s1.ts"), (1, "https://h/y/s2.ts"), (2, "https://other/s3.ts")]
    told = {r["playlist_url"]: r for r in playlist.diagnostics(rows).collect()}
    assert told["https://h/x/m.m3u8"]["is_variant_playlist"] and told["https://h/x/m.m3u8"]["variant_count"] == 3
    assert told["https://h/y/m.m3u8"]["segment_count"] == 3 and told["https://h/y/m.m3u8"]["first_segment_url"] == "https://h/y/s1.ts"
    fetch = media.DictFetcher({"https://h/y/s1.ts": b"Gone", "https://other/s3.ts": b"three"})
    whole = playlist.assembled(playlist.fetch_segments(playlist.segments(rows), fetch)).first()
    assert bytes(whole["content"]) == b"Gonethree" and (whole["segments"], whole["fetched"], whole["is_ts"]) == (3, 2, True)
    none = playlist.assembled(playlist.fetch_segments(playlist.segments(rows), media.DictFetcher({}))).first()
    assert none["error"] == "Failed to download any segments"
    heads = media.fetched(playlist.segment_urls(playlist.segments(rows)), "url", fetch, content=False).collect()
    assert sum(r["ok"] for r in heads) == 2


def test_streams_from_urls(spark):
    pages = {"https://h/x/m.m3u8": MASTER, "https://h/x/sub/b.m3u8": MEDIA, "https://h/x/a.m3u8": MEDIA, "https://h/y.m3u8": MEDIA, "https://h/e.m3u8": "#EXTM3U\n"}
    contents = {u: t.encode() for u, t in pages.items()} | {"https://h/x/sub/s1.ts": b"G1", "https://h/x/sub/s2.ts": b"2", "https://h/x/s1.ts": b"G"}
    urls = spark.createDataFrame([(u,) for u in ("https://h/x/m.m3u8", "https://h/y.m3u8", "https://h/e.m3u8", "https://h/none.m3u8")], "playlist_url string")
    got = {r["playlist_url"]: r for r in playlist.assemble_streams(urls, media.DictFetcher(contents)).collect()}
    assert bytes(got["https://h/x/m.m3u8"]["content"]) == b"G12" and got["https://h/x/m.m3u8"]["is_ts"]
    assert got["https://h/y.m3u8"]["error"] == "Failed to download any segments"
    assert got["https://h/e.m3u8"]["error"] == "No segments found" and "404" in got["https://h/none.m3u8"]["error"]
    told = {r["playlist_url"]: r for r in playlist.tested(urls, media.DictFetcher(contents)).collect()}
    assert told["https://h/x/m.m3u8"]["variant_segment_count"] == 3 and told["https://h/x/m.m3u8"]["first_segment_accessible"]
    assert not told["https://h/none.m3u8"]["playlist_accessible"] and not told["https://h/y.m3u8"]["first_segment_accessible"]


def test_credentials():
    env = {"OBJECT_STORE_ACCESS_KEY": "", "OBJECT_STORE_REGION": "eu"}
    with pytest.raises(ValueError, match="SECRET"):
        config.credentials({}, env)
    got = config.credentials({"access_key": "abcdefgh", "secret_key": "s"}, env)
    assert (got.access_key, got.region) == ("abcdefgh", "eu") and "abcd" not in repr(got)
    assert config.credentials({"access_key": "a", "secret_key": "s"}, {}).region == config.DEFAULT_REGION


class Draws:
    def encode(self, video_id, frame_idx, width, height):
        if frame_idx > 9:
            raise EOFError
        return f"{video_id}:{frame_idx}:{width}x{height}".encode()


def test_encoding_and_archive(spark):
    frames = spark.createDataFrame([("v", 1, "k1", 640, 360), ("v", 99, "k2", 640, 360), ("w", 2, "k3", 3, 4)], "video_id string, frame_idx long, key string, width int, height int")
    got = {r["key"]: bytes(r["content"]) for r in media.encoded_frames(frames, Draws()).collect()}
    assert got == {"k1": b"v:1:1920x1080", "k3": b"w:2:1080x1920"}

    def put(key, content, kind, meta):
        if "bad" in key or set(meta) != {"job-id", "source-url", "title", "archived-at", "total-frames"}:
            raise OSError

    jobs = spark.createDataFrame([("v", "j", "good", "u", 5), ("w", "j", "bad", "u", 5)], "video_id string, job_id string, base_path string, source_url string, total_frames long").withColumn("metadata", F.create_map().cast("map<string,string>"))
    content = spark.createDataFrame([("v", b"x"), ("w", b"y")], "video_id string, content binary")
    rows = {r["video_id"]: r["archived_s3_url"] for r in sinks.archived(jobs, content, put, sinks.iso_now(), "s://").collect()}
    assert rows == {"v": "s://good/video.mp4", "w": None}


def test_requests(spark):
    texts = [
        {"request_id": "1", "video_url": "https://v/1.mp4", "metadata": {"a": "1"}},
        {"request_id": "2", "listing": {"hls_url": "", "video_preview_assets": [{"url": "https://v/22", "mimeType": "video/mp4"}, {"url": "https://v/2b", "mimeType": "video/mp4"}, {"url": "https://v/longest", "mimeType": "image/png"}], "closed_captions": "en,https://h/a,b.vtt", "shop_id": "s"}, "metadata": {"shop_id": "old", "k": "v"}},
        {"request_id": "3", "listing": {"broadcast_id": "b3"}},
        {"request_id": "4"},
    ]
    raw = spark.createDataFrame([(json.dumps(t),) for t in texts] + [("not json",)], "value string")
    got = {r["request_id"]: r for r in requests.resolved(requests.parse_requests(raw), "https://base").collect()}
    assert got["1"]["source_url"] == "https://v/1.mp4" and got["1"]["error"] is None
    assert got["2"]["source_url"] == "https://v/22" and got["2"]["caption_url"] == "https://h/a,b.vtt" and got["2"]["metadata"]["shop_id"] == "s" and got["2"]["metadata"]["k"] == "v"
    assert got["3"]["source_url"] == "https://base/b3/default.mp4"
    assert got["4"]["error"] and got[None]["error"]
    need = requests.missing_parameters(spark.createDataFrame([("b", "f", "", None, "k")], "bucket string, main_folder string, account_id string, content_id string, video_key string"))
    assert need.first()["error"] == "missing: account_id, content_id"
    loose = requests.missing_parameters(need.drop("error"), empty_is_missing=False)
    assert loose.first()["error"] == "missing: content_id"


def test_catalog_shapes(spark):
    one = {"id": "c1", "title": "T", "hlsUrl": "https://h/1.m3u8", "relatedProductsAsins": ["p", "q"], "creationDate": "2026-01-02T03:04:05Z", "creatorType": "x", "videoPreviewAssets": [{"url": "u", "type": "t", "mimeType": "video/mp4"}]}
    two = {"contentId": "c2", "title": "T2", "url": "https://h/2.mp4", "relatedProductsAsins": "p", "creator": {"publicName": "N", "creatorType": "y"}, "width": 3, "height": 4}
    got = {r["content_id"]: r for r in requests.catalog_assets(spark.createDataFrame([(json.dumps(one),), (json.dumps(two),)], "value string")).collect()}
    assert got["c1"]["products"] == ["p", "q"] and got["c1"]["stream_url"] == "https://h/1.m3u8" and got["c1"]["assets"][0]["url"] == "u"
    assert got["c2"]["products"] == ["p"] and got["c2"]["creator"] == "N" and got["c2"]["shape"] == "detail"


def run_small(spark, profile):
    face = lambda k, score: {"embedding": [1.0, 0.02 * k, 0.0], "det_score": score, "bbox": {"x1": 0.0, "y1": 0.0, "x2": 64.0, "y2": 36.0}, "pose": {"yaw": 0.0, "pitch": 0.0, "roll": 0.0}}
    step = 12 if profile.name == "job" else 25
    found = {("v", step * i): [face(i, 0.7 + 0.01 * i)] for i in range(8)} | {("v", step * 9): [face(0, 0.5)]}
    videos = spark.createDataFrame([("v", 25.0, 260, 640, 360), ("bad", 0.0, 0, 0, 0)], "video_id string, fps double, total_frames long, width int, height int")
    captions = spark.createDataFrame([("v", 0, 6.0, 8.0, "Ann", "hi")], "video_id string, ordinal int, start double, end double, speaker string, text string")
    texts = [{"request_id": i, "video_url": "https://v/x", "transcript_url": "https://v/x.vtt", "bucket": "b", "main_folder": "m", "account_id": "a", "content_id": "c", "video_key": "k", "metadata": {}} for i in ("v", "bad")] + [{"request_id": "none"}]
    rows = requests.parse_requests(spark.createDataFrame([(json.dumps(t),) for t in texts], "value string"))
    plugins = pipeline.Plugins(videos=videos, detector=media.TableDetector(found, {"v": 225}), captions=captions, date=F.lit("2026-01-01"), job_id=F.lit("j"), elapsed=F.lit(10.0))
    return pipeline.run(rows, plugins, profile)


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_whole_plan(spark, name):
    profile = PROFILES[name]
    results, errors = run_small(spark, profile)
    (row,) = results.collect()
    assert row["status"] == "success" and row["talent_count"] == 1
    talent = row["talent_frames"][0]
    assert talent["person_id"] == 0 and talent["timestamp"] == (3.36 if name == "job" else 7.0)
    assert talent["name"] == ("Ann" if profile.transcript and name != "job" else "Person 0")
    assert ("representative_frames" in row.asDict()) == profile.representative_frames
    assert {r["request_id"] for r in errors.collect()} == {"bad", "none"}
    told = json.loads(sinks.to_json_rows(results).first()["value"])
    assert told["processing_metrics"]["estimated_cost_usd"] == 0.0042
    if name == "job":
        assert told["processing_metrics"]["inference_fps"] > 0
    if profile.archive:
        assert "archived_s3_key" in told["video_metadata"] and told["video_metadata"]["archived_s3_key"] is None


def test_two_pass(spark):
    videos = spark.createDataFrame([("v", 1.0, 1000, 64, 36)], "video_id string, fps double, total_frames long, width int, height int")
    detections = spark.createDataFrame([("v", i, f) for i, f in enumerate((99, 100, 499, 500))], "video_id string, det_ord long, frame_idx long")
    samples, seen = pipeline.sampled(videos, detections, LEGACY.with_(two_pass_from=300), None)
    assert 0 < samples.count() < 10 and sorted(r["frame_idx"] for r in seen.collect()) == [99, 499]


# Plug-ins defined here travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Copying:
    def remux(self, source, target, copy):
        if copy and source.endswith("odd"):
            raise OSError("codec")
        if source == "dead":
            raise OSError("gone")


def test_plugins(spark):
    rows = {r["url"]: (r["method"], r["error"]) for r in media.remuxed(spark.createDataFrame([("a", "t"), ("odd", "t"), ("dead", "t")], "url string, target string"), Copying()).collect()}
    assert rows == {"a": ("copy", None), "odd": ("encode", None), "dead": (None, "gone")}

    class Probe:
        def probe(self, path):
            return {"fps": 25.0, "total_frames": int(path), "width": 1, "height": 2}

    got = {r["video_id"]: (r["total_frames"], r["error"] is None) for r in media.probed(spark.createDataFrame([("a", "5"), ("b", "x")], "video_id string, path string"), Probe()).collect()}
    assert got == {"a": (5, True), "b": (None, False)}

    class Off(media.TableDetector):
        def available(self):
            return False

    with pytest.raises(RuntimeError):
        media.require(Off({}))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", 2)], "k string, v long")
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).where("value like '%null%'").count() == 1
    sinks.write_parquet(rows, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    target = str(tmp_path / "o")
    (tmp_path / "o").mkdir()

    def put(key, content, kind, meta):
        if key == "bad":
            raise OSError("no")
        with open(f"{target}/{key}", "wb") as f:
            f.write(content)

    objects = spark.createDataFrame([("good", b"x", "image/jpeg", {"a": "b"}), ("bad", b"y", "image/jpeg", None)], "key string, content binary, content_type string, metadata map<string,string>")
    assert {r["key"]: r["ok"] for r in sinks.put_objects(objects, put).collect()} == {"good": True, "bad": False}
    assert (tmp_path / "o" / "good").read_bytes() == b"x"
    sinks.post_results(rows, None)

    def refuse(url, body, seconds):
        raise OSError

    sinks.post_results(rows, "http://unused.invalid", post=refuse)
    assert sinks.payload_of(rows)[0] == {"k": "a", "v": None}
    assert media.read_files(spark, str(tmp_path / "o"), "good").first()["length"] == 1
    assert media.read_texts(spark, str(tmp_path / "o" / "good")).first()["text"] == "x"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"request_id": "1", "video_url": "https://v/1"}) + "\n" + json.dumps({"request_id": "2"}) + "\n")
    got = []
    query = ingest.each_batch(ingest.request_stream(spark, str(tmp_path / "in")), lambda df, _: got.extend(requests.resolved(df).select("request_id", "error").collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert {(r["request_id"], r["error"] is None) for r in got} == {("1", True), ("2", False)}
    points = spark.createDataFrame([("v", s, 0.9) for s in (0, 2, 5)] + [("v", 100, 0.1)], "video_id string, s long, det_score double").select("video_id", F.timestamp_seconds("s").alias("at"), "det_score")
    points.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "d"))
    q = ingest.live_regions(stream).writeStream.outputMode("complete").format("memory").queryName("roi").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = sorted((r["start"].timestamp(), r["end"].timestamp(), r["points"]) for r in spark.table("roi").collect())
    assert [(b - a, n) for a, b, n in found] == [(4.0, 2), (2.0, 1)]
