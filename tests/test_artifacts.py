"""From URLs to stored artifacts, command-line tools, bounded blocks."""

import json
import os
import stat
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framequarry.operators import clustering, requests
from framequarry.plans import pipeline
from framequarry.plans.profiles import CANONICAL, JOB
from framequarry.sources import media, playlist, vtt

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACE = {"embedding": [1.0, 0.0], "bbox": {"x1": 0.0, "y1": 0.0, "x2": 64.0, "y2": 36.0}, "pose": {"yaw": 0.0, "pitch": 0.0, "roll": 0.0}}


class Probe:
    def probe(self, path):
        if not path.endswith(".mp4"):
            raise OSError(f"no video at {path}")
        return {"fps": 25.0, "total_frames": 260, "width": 640, "height": 360}


class Remux:
    def remux(self, source, target, copy):
        if "dead" in source:
            raise OSError("gone")


class Draws:
    def encode(self, video_id, frame_idx, width, height):
        if frame_idx == 258:
            raise EOFError
        return f"{video_id}:{frame_idx}:{width}x{height}".encode()


def asked(spark):
    texts = [
        {"request_id": "file", "video_url": "https://v/a.mp4", "transcript_url": "https://v/a.vtt"},
        {"request_id": "stream", "video_url": "https://v/b.m3u8?x=1", "transcript_url": "https://v/none.vtt"},
        {"request_id": "dead", "video_url": "https://v/dead.m3u8"},
        {"request_id": "text", "video_url": "https://v/notes.txt"},
        {"request_id": "empty"},
    ]
    return requests.parse_requests(spark.createDataFrame([(json.dumps(t | {"metadata": {"broadcast_title": "T"}}),) for t in texts], "value string"))


def plugins(tmp_path, **more):
    found = {(v, 25 * i): [FACE | {"det_score": 0.7 + 0.01 * i}] for v in ("file", "stream") for i in range(8)}
    captions = "WEBVTT\n\n00:06.000 --> 00:08.000\nAnn: hello\n"
    contents = {"https://v/a.vtt": captions.encode(), "https://v/a.mp4": b"video bytes"}

    def put(key, content, kind, meta):
        path = tmp_path / "store" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    return pipeline.Plugins(detector=media.TableDetector(found), fetcher=media.DictFetcher(contents), prober=Probe(), remuxer=Remux(), work_dir=str(tmp_path / "work"), encoder=Draws(), put=put, date=F.lit("2026-01-01"), job_id=F.concat(F.lit("j-"), "video_id"), url_base="s3://b/", **more)


def test_from_url_to_artifacts(spark, tmp_path):
    posted = tmp_path / "posted"
    posted.mkdir()

    def post(url, body, timeout):
        (posted / json.loads(body)["video_id"]).write_bytes(body)

    results, errors = pipeline.analyse(asked(spark), plugins(tmp_path, webhook="https://hook", post=post), CANONICAL, str(tmp_path / "out"))
    rows = {r["video_id"]: r for r in results.collect()}
    assert set(rows) == {"file", "stream"}
    why = {r["request_id"]: r["error"] for r in errors.collect()}
    assert why == {"dead": "gone", "text": "no video at https://v/notes.txt", "empty": "no video URL"}
    store = {str(p.relative_to(tmp_path / "store")): p.read_bytes() for p in (tmp_path / "store").rglob("*") if p.is_file()}
    base = "extracted-frames/2026-01-01/j-file"
    assert store[f"{base}/talent/person_0.jpg"] == b"file:175:1920x1080" and store[f"{base}/video.mp4"] == b"video bytes"
    one = rows["file"]
    assert one["talent_frames"][0]["s3_url"] == f"s3://b/{base}/talent/person_0.jpg" and one["talent_frames"][0]["name"] == "Ann"
    assert one["video_metadata"]["archived_s3_url"] == f"s3://b/{base}/video.mp4" and rows["stream"]["video_metadata"]["archived_s3_key"] is None
    assert one["transcription"] == "[6.0s] Ann: hello" and rows["stream"]["transcription"] == ""
    frames = [f["s3_key"] for f in one["representative_frames"]]
    assert frames and all(f in store for f in frames) and 258 not in [f["frame_index"] for f in one["representative_frames"]]
    assert one["processing_metrics"]["duration_seconds"] > 0 and one["processing_metrics"]["estimated_cost_usd"] > 0
    assert {p.name for p in posted.iterdir()} == {"file", "stream"}
    assert {json.loads(line)["video_id"] for line in spark.read.text(str(tmp_path / "out")).toPandas()["value"]} == {"file", "stream"}


def test_captions_that_fail_a_request(spark, tmp_path):
    results, errors = pipeline.run(asked(spark), plugins(tmp_path), JOB)
    assert [r["video_id"] for r in results.collect()] == ["file"]
    assert "404" in {r["request_id"]: r["error"] for r in errors.collect()}["stream"]


def tool(folder, name, body):
    path = folder / name
    path.write_text(f"#!{sys.executable}\nimport sys\n{body}\n")
    path.chmod(path.stat().st_mode | stat.S_IEXEC)


def test_command_line_tools(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(RuntimeError, match="not installed"):
        media.FfprobeProber().probe("x")
    tool(tmp_path, "ffprobe", 'import json; print(json.dumps({"streams": [{"width": 640, "height": 360, "avg_frame_rate": "30000/1001", "duration": "10.01"}]}))')
    assert media.FfprobeProber().probe("x") == {"fps": 30000 / 1001, "total_frames": 300, "width": 640, "height": 360}
    tool(tmp_path, "ffmpeg", 'a = sys.argv\nif "copy" in a: sys.exit("codec")\nif a[-1] == "-": sys.stdout.write("" if "n\\\\,9" in " ".join(a) else "jpeg " + a[a.index("-vf") + 1])\nelse: open(a[-1], "w").write(a[a.index("-i") + 1])')
    target = tmp_path / "t.mp4"
    with pytest.raises(RuntimeError, match="codec"):
        media.FfmpegRemuxer().remux("in.m3u8", str(target), True)
    media.FfmpegRemuxer().remux("in.m3u8", str(target), False)
    assert target.read_text() == "in.m3u8"
    encoder = media.FfmpegEncoder(lambda v: f"/videos/{v}")
    assert encoder.encode("v", 12, 1920, 1080) == b"jpeg select=eq(n\\,12),scale=1920:1080"
    with pytest.raises(EOFError):
        encoder.encode("v", 9, 1920, 1080)
    tool(tmp_path, "ffprobe", "import time; time.sleep(30)")
    with pytest.raises(Exception, match="timed out"):
        media.FfprobeProber(timeout=0.3).probe("x")


def test_blocks_of_a_hot_video(spark):
    """A video that holds most rows meets in many groups of two blocks, and its labels are those of one task."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((9, 6))
    rows = [("hot", i, [float(x) for x in centres[i % 9] + 0.15 * rng.standard_normal(6)]) for i in range(900)] + [(f"v{i % 30}", i, [1.0, *([0.0] * 5)]) for i in range(90)]
    points = spark.createDataFrame(rows, "video_id string, det_ord long, embedding array<float>")
    got = sorted(map(tuple, clustering.neighbours(points, 0.65, block=100).collect()))
    assert got == sorted(map(tuple, clustering.neighbours(points, 0.65).collect())) and len(set(got)) == len(got)
    assert sorted(map(tuple, clustering.clusters(points).collect())) == sorted(map(tuple, clustering.clusters_grouped(points).collect()))


class Files:
    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, playlist_url):
        return open(os.path.join(self.folder, playlist_url.rsplit("/", 1)[1]), "wb")


def test_streams_are_written_segment_by_segment(spark, tmp_path):
    found = spark.createDataFrame([(f"https://h/{p}", i, f"https://h/{p}/{i}") for p in "abc" for i in range(5)], "playlist_url string, pos int, url string").repartition(7)
    contents = {f"https://h/a/{i}": f"a{i}".encode() for i in range(5) if i != 2} | {f"https://h/b/{i}": b"" for i in range(5)}
    got = {r["playlist_url"]: tuple(r)[1:] for r in playlist.write_streams(found, media.DictFetcher(contents), Files(tmp_path)).collect()}
    assert got == {"https://h/a": (5, 4, 8, None), "https://h/b": (5, 5, 0, "assembled file is empty"), "https://h/c": (5, 0, 0, "Failed to download any segments")}
    assert (tmp_path / "a").read_bytes() == b"a0a1a3a4"


def test_long_transcripts_are_cut_before_they_are_gathered(spark):
    rows = [("v", i, float(i), float(i + 1), None, f"line {i}") for i in range(5000)] + [("w", 0, 0.0, 1.0, "Ann", "short")]
    captions = spark.createDataFrame(rows, "video_id string, ordinal int, start double, end double, speaker string, text string")
    got = {r["video_id"]: r["transcription"] for r in vtt.transcripts(captions).collect()}
    whole = " ".join(f"[{i}.0s] line {i}" for i in range(5000))
    assert got == {"v": whole[:997] + "...", "w": "[0.0s] Ann: short"}


def test_the_face_model_is_asked_for_before_a_run(monkeypatch):
    """Without the libraries a run ends early; with stand-ins for them, frames are read forwards and faces become rows."""
    detector = media.FaceModelDetector(lambda v: f"/videos/{v}")
    if not detector.available():
        with pytest.raises(RuntimeError, match="not available"):
            media.require(detector)
        with pytest.raises(RuntimeError, match="not installed"):
            detector.detect("v", 0)
    import types

    opened, sought = [], []

    class Capture:
        def __init__(self, path):
            self.at = 0
            opened.append(path)

        def get(self, what):
            return self.at

        def set(self, what, frame):
            self.at = frame
            sought.append(frame)

        def read(self):
            self.at += 1
            return self.at <= 5, f"frame {self.at - 1}"

        def release(self):
            opened.append("closed")

    class App:
        def __init__(self, **options):
            pass

        def prepare(self, **options):
            pass

        def get(self, image):
            face = types.SimpleNamespace(embedding=[1, 2], det_score=0.9, bbox=[1, 2, 3, 4], pose=[5, 6, 7])
            return [face] if image == "frame 1" else [types.SimpleNamespace(embedding=[1, 2], det_score=0.9, bbox=[1, 2, 3, 4])]

    monkeypatch.setattr(media.FaceModelDetector, "available", lambda self: True)
    monkeypatch.setitem(sys.modules, "cv2", types.SimpleNamespace(VideoCapture=Capture, CAP_PROP_POS_FRAMES=1))
    monkeypatch.setitem(sys.modules, "insightface", types.SimpleNamespace())
    monkeypatch.setitem(sys.modules, "insightface.app", types.SimpleNamespace(FaceAnalysis=App))
    assert detector.detect("v", 0)[0]["pose"] is None
    assert detector.detect("v", 1) == [{"embedding": [1.0, 2.0], "det_score": 0.9, "bbox": {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}, "pose": {"pitch": 5.0, "yaw": 6.0, "roll": 7.0}}]
    assert sought == [] and detector.detect("v", 4) and sought == [4]
    with pytest.raises(EOFError):
        detector.detect("v", 9)
    assert detector.detect("w", 0) and opened == ["/videos/v", "closed", "/videos/w"]
