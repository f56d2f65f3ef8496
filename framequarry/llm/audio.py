"""Media columns: bytes stored as 8-bit audio, with log-mel features and time spans.

The bytes of a text, zero-padded to a positive multiple of 64, become the samples of an 8-bit mono WAV file, which is
lossless. What is read back from that file is resampled by a polyphase filter (one short filter per output phase),
cut into overlapped windows, turned into log-mel energies and segmented by energy with hysteresis: a segment opens
where the energy passes the upper threshold and reaches as far as it stays above the lower one. The energies are
stored as Arrow tensors of one fixed shape (PATCH frames x MELS), each with the time it spans: a column of Arrow streams,
one a document, of start_s, end_s, frames and tensor.

Every document is computed alone and in one fixed order, so equal texts give equal values on any partitioning.

Defined cases: null and empty texts are 64 zero bytes; null ids stay; equal rows give equal rows; an empty table gives
none; other columns of the input are ignored. Long texts are filtered and transformed in blocks.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequarry.runtime import bounded_batches, lean

PAD = 64
RATE = 8000
UP, DOWN = 2, 5
FRAME, HOP = 128, 64
MELS = 16
PATCH = 32
HEADER = 44
#: Output samples that are filtered at a time, and frames that are transformed at a time.
BLOCK = 1 << 16

SCHEMA = "doc_id long, n_bytes long, media binary, feature string, segments array<struct<start_s:double,end_s:double>>, n_tensors long, tensors binary"
TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=["frame", "mel"])
SEGMENT_TYPE = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with one byte a sample."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.lru_cache(maxsize=4)
def phases(up: int, down: int, taps: int = 12) -> np.ndarray:
    """The low-pass filter for a change of rate by up/down, one row of taps per output phase, newest sample last."""
    n = taps * max(up, down)
    n += -n % up
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1])


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: output m takes phase (m*down) % up at input (m*down)//up; ends are zero-padded."""
    bank = phases(up, down)
    width = bank.shape[1]
    total = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(width // 2), x, np.zeros(width)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(total)
    for r in range(up):  # outputs r, r+up, r+2*up, ... lie `down` input samples apart and share a phase
        first, phase = divmod(r * down, up)
        mine = out[r::up]
        for at in range(0, len(mine), BLOCK):
            n = min(BLOCK, len(mine) - at)
            mine[at : at + n] = views[first + at * down :: down][:n] @ bank[phase]
    return out


@functools.lru_cache(maxsize=4)
def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a real transform."""
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(0, to_mel(rate / 2), mels + 2))
    bins = np.fft.rfftfreq(frame, 1 / rate)
    rise = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[:-1]
    fall = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Log energies, frames x mels, of windows that overlap by frame - hop; the last window is zero-padded."""
    n = 1 + max(0, -(-(len(x) - frame) // hop))
    padded = np.zeros((n - 1) * hop + frame)
    padded[: len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop]
    taper, bank, out = np.hanning(frame), mel_bank(rate, frame), np.empty((n, MELS))
    for at in range(0, n, BLOCK // frame):
        part = windows[at : at + BLOCK // frame] * taper
        out[at : at + len(part)] = np.log(np.abs(np.fft.rfft(part, axis=1)) ** 2 @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Hysteresis: maximal runs of frames at or above low that hold a frame at or above high; (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (energy >= low).astype(np.int8), [0]])))
    peaks = np.concatenate([[0], np.cumsum(energy >= high)])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if peaks[b] > peaks[a]]


def features(payload: bytes) -> tuple[str, list, np.ndarray]:
    """(summary, segments, log-mel energies) of 8-bit samples."""
    rate = RATE * UP / DOWN
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resample(x), rate)
    energy = mel.mean(axis=1)
    middle, spread = float(energy.mean()), float(energy.std())
    found = segments(energy, middle, middle + 0.5 * spread)
    spans = [{"start_s": a * HOP / rate, "end_s": ((b - 1) * HOP + FRAME) / rate} for a, b in found]
    profile = ",".join(f"{v:.2f}" for v in (mel.mean(axis=0) + 0.0).tolist())
    return f"frames={len(mel)};segments={len(found)};active={sum(b - a for a, b in found)};mel={profile}", spans, mel


def tensor_stream(mel: np.ndarray, rate: float = RATE * UP / DOWN) -> tuple[int, bytes]:
    """How many tensors, and the Arrow stream that holds them; the last is zero-padded."""
    n = -(-len(mel) // PATCH)
    fixed = np.zeros((n * PATCH, MELS), np.float32)
    fixed[: len(mel)] = mel
    first = np.arange(n) * PATCH
    frames = np.minimum(PATCH, len(mel) - first)
    columns = [first * HOP / rate, ((first + frames - 1) * HOP + FRAME) / rate, frames.astype(np.int32)]
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(fixed.ravel(), PATCH * MELS))
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), tensor], names=["start_s", "end_s", "frames", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return n, sink.getvalue().to_pybytes()


def tensors_of(stream: bytes) -> pa.Table:
    """start_s, end_s, frames and tensor of a document's stream."""
    return pa.ipc.open_stream(stream).read_all()


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the WAV file, a summary, active time spans, and the log-mel tensors with theirs."""

    @lean
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                media = wav(raw + bytes(-len(raw) % PAD or (PAD if not raw else 0)))
                feature, spans, mel = features(samples_of(media))
                rows.append((doc_id, len(raw), media, feature, spans, *tensor_stream(mel)))
                size += len(media) + len(rows[-1][-1])
                if size >= 4 << 20:
                    yield media_batch(rows)
                    rows, size = [], 0
            yield media_batch(rows)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def media_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "feature": pa.string(), "segments": pa.list_(SEGMENT_TYPE), "n_tensors": pa.int64(), "tensors": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def media_digests(docs: DataFrame) -> DataFrame:
    """The stored files and tensors reduced to sizes and checksums, all taken from the stored form."""
    payload = F.expr(f"substring(media, {HEADER + 1})")
    return media_columns(docs).select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(media, -{PAD})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_tensors",
        F.sha2("tensors", 256).alias("tensors_sha256"),
    )
