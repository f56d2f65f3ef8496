"""Plug-ins for what Spark has no reader for: fetching, probing, decoding, detecting, remuxing.

Each is a small protocol whose objects are shipped to executors and run there per Arrow batch; a failure is a row with
an error, never an exception that loses the batch. Table-backed fakes stand in for all of them in tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequarry.functions.scalars import target_size

DETECTION_SCHEMA = "video_id string, det_ord long, frame_idx long, embedding array<float>, det_score float, bbox struct<x1:double,y1:double,x2:double,y2:double>, pose struct<yaw:double,pitch:double,roll:double>"


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[int, bytes]:
        """Status and content; raises on failure."""

    def head(self, url: str) -> int:
        """Status alone; raises on failure."""


class Prober(Protocol):
    def probe(self, path: str) -> dict[str, Any]:
        """fps, total_frames, width, height of a video."""


class Detector(Protocol):
    def available(self) -> bool:
        """Whether the hardware and model that it needs are there."""

    def detect(self, video_id: str, frame_idx: int) -> Iterable[dict[str, Any]]:
        """Detections of a frame: embedding, det_score, bbox, pose; raises EOFError where the frame can't be read."""


class Remuxer(Protocol):
    def remux(self, source: str, target: str, copy: bool) -> None:
        """Writes target from a stream, by copying its packets or by encoding anew; raises on failure."""


class Encoder(Protocol):
    def encode(self, video_id: str, frame_idx: int, width: int, height: int) -> bytes:
        """A frame, resized and encoded as JPEG; raises EOFError where it can't be read."""


def tool_output(tool: str, arguments: list[str], timeout: float) -> bytes:
    """What a command-line tool writes; raises where it is absent, fails, or takes too long."""
    import shutil
    import subprocess

    found = shutil.which(tool)
    if found is None:
        raise RuntimeError(f"{tool} is not installed on this executor")
    ended = subprocess.run([found, *arguments], capture_output=True, timeout=timeout, check=False)
    if ended.returncode:
        raise RuntimeError(ended.stderr.decode("utf-8", "replace")[-500:] or f"{tool} ended with {ended.returncode}")
    return ended.stdout


class FfmpegRemuxer:
    """Streams to MP4 files by the ffmpeg tool."""

    def __init__(self, timeout: float = 1800.0):
        self.timeout = timeout

    def remux(self, source: str, target: str, copy: bool) -> None:
        codec = ["-c", "copy", "-bsf:a", "aac_adtstoasc"] if copy else ["-c:v", "libx264", "-c:a", "aac"]
        tool_output("ffmpeg", ["-y", "-loglevel", "error", "-i", source, *codec, "-movflags", "+faststart", target], self.timeout)


class FfprobeProber:
    """Container metadata by the ffprobe tool."""

    def __init__(self, timeout: float = 60.0):
        self.timeout = timeout

    def probe(self, path: str) -> dict[str, Any]:
        import json

        told = json.loads(tool_output("ffprobe", ["-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,avg_frame_rate,nb_frames,duration:format=duration", "-of", "json", path], self.timeout))
        if not told.get("streams"):
            raise ValueError("no video stream")
        stream = told["streams"][0]
        above, _, below = stream["avg_frame_rate"].partition("/")
        fps = float(above) / float(below or 1) if float(below or 1) else 0.0
        seconds = float(stream.get("duration") or told.get("format", {}).get("duration") or 0)
        frames = stream.get("nb_frames")
        return {"fps": fps, "total_frames": int(frames) if frames and frames.isdigit() else int(seconds * fps), "width": int(stream["width"]), "height": int(stream["height"])}


class FfmpegEncoder:
    """Frames as JPEG by the ffmpeg tool; locate: gives a video's path or URL by its id."""

    def __init__(self, locate: Callable[[str], str], timeout: float = 300.0):
        self.locate, self.timeout = locate, timeout

    def encode(self, video_id: str, frame_idx: int, width: int, height: int) -> bytes:
        picked = f"select=eq(n\\,{frame_idx}),scale={width}:{height}"
        frame = tool_output("ffmpeg", ["-loglevel", "error", "-i", self.locate(video_id), "-vf", picked, "-frames:v", "1", "-q:v", "2", "-f", "image2pipe", "-vcodec", "mjpeg", "-"], self.timeout)
        if not frame:
            raise EOFError
        return frame


class FaceModelDetector:
    """Faces by the insightface model over frames that OpenCV reads, where both are installed on the executors.

    locate: gives a video's path by its id. A task's videos arrive one after the other and their frames ascending, so
    one file is open at a time and it is only read forwards.
    """

    def __init__(self, locate: Callable[[str], str], size: int = 640, model: str = "buffalo_l", accelerator: bool = True):
        self.locate, self.size, self.model, self.accelerator = locate, size, model, accelerator
        self.app = self.video = self.open_id = None

    def __getstate__(self):
        return self.__dict__ | {"app": None, "video": None, "open_id": None}

    def available(self) -> bool:
        import importlib.util

        return all(importlib.util.find_spec(m) is not None for m in ("cv2", "insightface"))

    def frame(self, video_id: str, frame_idx: int):
        import cv2

        if video_id != self.open_id:
            if self.video is not None:
                self.video.release()
            self.video, self.open_id = cv2.VideoCapture(self.locate(video_id)), video_id
        if int(self.video.get(cv2.CAP_PROP_POS_FRAMES)) != frame_idx:
            self.video.set(cv2.CAP_PROP_POS_FRAMES, frame_idx)
        good, image = self.video.read()
        if not good:
            raise EOFError
        return image

    def detect(self, video_id: str, frame_idx: int) -> list[dict[str, Any]]:
        if not self.available():
            raise RuntimeError("cv2 and insightface are not installed on this executor")
        if self.app is None:
            from insightface.app import FaceAnalysis

            self.app = FaceAnalysis(name=self.model, providers=["CUDAExecutionProvider", "CPUExecutionProvider"] if self.accelerator else ["CPUExecutionProvider"])
            self.app.prepare(ctx_id=0 if self.accelerator else -1, det_size=(self.size, self.size))
        out = []
        for face in self.app.get(self.frame(video_id, frame_idx)):
            pose = getattr(face, "pose", None)
            turn = dict(zip(("pitch", "yaw", "roll"), map(float, pose))) if pose is not None else None
            out.append({"embedding": [float(x) for x in face.embedding], "det_score": float(face.det_score), "bbox": dict(zip(("x1", "y1", "x2", "y2"), map(float, face.bbox))), "pose": turn})
        return out


class HttpFetcher:
    """Plain HTTP; statuses from 400 on are failures."""

    def __init__(self, timeout: float = 60.0):
        self.timeout = timeout

    def fetch(self, url: str) -> tuple[int, bytes]:
        import urllib.request

        with urllib.request.urlopen(url, timeout=self.timeout) as answer:
            parts = iter(lambda: answer.read(8192), b"")
            return answer.status, b"".join(parts)

    def head(self, url: str) -> int:
        import urllib.request

        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=self.timeout) as answer:
            return answer.status


class DictFetcher:
    """A fake: contents by URL."""

    def __init__(self, contents: dict[str, bytes]):
        self.contents = contents

    def fetch(self, url: str) -> tuple[int, bytes]:
        if url not in self.contents:
            raise OSError(f"404 for {url}")
        return 200, self.contents[url]

    def head(self, url: str) -> int:
        return self.fetch(url)[0]


#: Bytes of contents that a task holds before it passes them on; one content may be larger.
HELD_BYTES = 8 << 20


def fetched(rows: DataFrame, url: str, fetcher: Fetcher, content: bool = True) -> DataFrame:
    """Adds ok, status, content (null unless asked for) and error of each row's URL. A task holds HELD_BYTES of contents,
    or one; what is larger than memory goes through sources.parts."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ok boolean, status int, content binary, error string"
    kinds = [pa.bool_(), pa.int32(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            got, first, held = [], 0, 0

            def out(end):
                columns = list(zip(*got)) if got else [(), (), (), ()]
                part = batch.slice(first, end - first)
                return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*names, "ok", "status", "content", "error"])

            for at, value in enumerate(batch.column(names.index(url)).to_pylist()):
                try:
                    status, data = fetcher.fetch(value) if content else (fetcher.head(value), None)
                    got.append((status < 400, status, data if status < 400 else None, None if status < 400 else f"status {status}"))
                    held += len(data or b"")
                except Exception as failure:
                    got.append((False, None, None, str(failure)))
                if held > HELD_BYTES:
                    yield out(at + 1)
                    got, first, held = [], at + 1, 0
            yield out(batch.num_rows)

    return rows.mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of any store that Spark reads: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def probed(files: DataFrame, prober: Prober) -> DataFrame:
    """(video_id, path) to (video_id, fps, total_frames, width, height, error, seconds), seconds as each video took."""

    def run(batches):
        kind = pa.schema([("video_id", pa.string()), ("fps", pa.float64()), ("total_frames", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string()), ("seconds", pa.float64())])
        for batch in batches:
            rows = []
            for video_id, path in zip(*(c.to_pylist() for c in batch.columns)):
                began = time.perf_counter()
                try:
                    rows.append({"video_id": video_id, "error": None} | prober.probe(path))
                except Exception as failure:
                    rows.append({"video_id": video_id, "error": str(failure)})
                rows[-1]["seconds"] = time.perf_counter() - began
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select(F.col("video_id").cast("string").alias("video_id"), "path").mapInArrow(run, "video_id string, fps double, total_frames long, width int, height int, error string, seconds double")


def require(detector: Detector) -> None:
    """Ends a job early where the detector can't run."""
    if not detector.available():
        raise RuntimeError("the detector's hardware or model is not available")


def watched(samples: DataFrame, detector: Detector) -> DataFrame:
    """Detections of sampled frames (video_id, frame_idx), in sampling order per video, up to the first unreadable frame;
    and a row for each video and task, without det_ord, with the frames looked at and the seconds that took.

    Videos are dealt over tasks and sorted inside, so a decoder moves forward only; pixels never enter a shuffle.
    """

    def run(batches):
        kind = pa.schema([("video_id", pa.string()), ("det_ord", pa.int64()), ("frame_idx", pa.int64()), ("embedding", pa.list_(pa.float32())), ("det_score", pa.float32()), ("bbox", pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])), ("pose", pa.struct([(c, pa.float64()) for c in ("yaw", "pitch", "roll")])), ("frames", pa.int64()), ("seconds", pa.float64())])
        video, ordinal, stopped, frames, seconds = None, 0, False, 0, 0.0

        def looked():
            return {"video_id": video, "frames": frames, "seconds": seconds}

        for batch in batches:
            rows = []
            for video_id, frame_idx in zip(*(c.to_pylist() for c in batch.columns)):
                if video_id != video:
                    if video is not None:
                        rows.append(looked())
                    video, ordinal, stopped, frames, seconds = video_id, 0, False, 0, 0.0
                if stopped:
                    continue
                began = time.perf_counter()
                try:
                    found = list(detector.detect(video_id, frame_idx))
                    frames += 1
                except EOFError:
                    stopped, found = True, []
                seconds += time.perf_counter() - began
                for d in found:
                    rows.append({"video_id": video_id, "det_ord": ordinal, "frame_idx": frame_idx, "bbox": None, "pose": None} | d)
                    ordinal += 1
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
        if video is not None:
            yield pa.RecordBatch.from_pylist([looked()], schema=kind)

    ordered = samples.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx")).repartition("video_id").sortWithinPartitions("video_id", "frame_idx")
    return ordered.mapInArrow(run, DETECTION_SCHEMA + ", frames long, seconds double")


def detected(samples: DataFrame, detector: Detector) -> DataFrame:
    """The detections of watched alone."""
    return watched(samples, detector).where("det_ord is not null").drop("frames", "seconds")


def remuxed(streams: DataFrame, remuxer: Remuxer) -> DataFrame:
    """(url, target) to (url, target, method, error): packets are copied, and encoded anew only where that fails."""

    def run(batches):
        for batch in batches:
            out = []
            for url, target in zip(*(c.to_pylist() for c in batch.columns)):
                method, error = None, None
                for name, copy in (("copy", True), ("encode", False)):
                    try:
                        remuxer.remux(url, target, copy)
                        method, error = name, None
                        break
                    except Exception as failure:
                        error = str(failure)
                out.append((url, target, method, error))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["url", "target", "method", "error"])

    return streams.select("url", "target").mapInArrow(run, "url string, target string, method string, error string")


def encoded_frames(frames: DataFrame, encoder: Encoder) -> DataFrame:
    """(video_id, frame_idx, key, width, height) to objects: key, content, content_type, metadata, with video_id and
    frame_idx. Frames that can't be read are dropped, so their person or pick is, too; sizes are those of the video."""
    size = target_size(F.col("width"), F.col("height"))
    rows = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "key", size["width"].alias("w"), size["height"].alias("h"))

    def run(batches):
        kind = pa.schema([("video_id", pa.string()), ("frame_idx", pa.int64()), ("key", pa.string()), ("content", pa.binary()), ("content_type", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            out, held = [], 0
            for video_id, frame_idx, key, w, h in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out.append({"video_id": video_id, "frame_idx": frame_idx, "key": key, "content": encoder.encode(video_id, frame_idx, w, h), "content_type": "image/jpeg", "metadata": []})
                except EOFError:
                    continue
                held += len(out[-1]["content"])
                if held > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.mapInArrow(run, "video_id string, frame_idx long, key string, content binary, content_type string, metadata map<string,string>")


class TableDetector:
    """A fake: detections by (video_id, frame_idx)."""

    def __init__(self, found: dict[tuple[str, int], list[dict]], last_frame: dict[str, int] | None = None):
        self.found, self.last_frame = found, last_frame or {}

    def available(self) -> bool:
        return True

    def detect(self, video_id: str, frame_idx: int) -> list[dict]:
        if frame_idx > self.last_frame.get(video_id, frame_idx):
            raise EOFError
        return self.found.get((video_id, frame_idx), [])


class Stopwatch:
    """Elapsed seconds of the driver, for metrics that a run injects: since it was made, or, if that is not asked for, inside
    its with blocks."""

    def __init__(self, running: bool = True):
        self.began, self.before = time.monotonic() if running else None, 0.0

    def __enter__(self) -> Stopwatch:
        self.began = time.monotonic()
        return self

    def __exit__(self, *failure) -> None:
        self.before, self.began = self.seconds(), None

    def seconds(self) -> float:
        return self.before + (time.monotonic() - self.began if self.began is not None else 0.0)
