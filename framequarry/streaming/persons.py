"""Person ids given as detections arrive: keyed state with centroids, and expiry by timers.

Each video is a key. Its state holds a row a person: the sum of the person's vectors, how many, and when it was seen
last, and the next id. A detection belongs to the person whose centroid is nearest, if that is within the radius, and
else begins a new one. Ids count up and are never given again while the video has state. The rows of one trigger are
taken in order of their ordinals, so on well separated persons the ids are the same however the stream is cut. A timer
drops persons that have not been seen for a while, and the video's state with the last of them.

Timers look at the clock, so the engine would run batches without data for ever: a query that is to end when its input
does needs spark.sql.streaming.noDataMicroBatches.enabled=false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPS = 0.65
KEEP_MS = 3_600_000

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "ids array<int>, totals array<array<double>>, counts array<long>, seen array<long>, next int"


def unit(vector: np.ndarray) -> np.ndarray:
    norm = float(np.linalg.norm(vector))
    return vector / norm if norm > 0 else vector


class Persons:
    """The persons of one video."""

    def __init__(self, eps: float, held: tuple | None = None):
        self.floor = 1 - eps * eps / 2
        ids, totals, counts, seen, self.next = held or ((), (), (), (), 0)
        self.ids, self.counts, self.seen = list(ids), list(counts), list(seen)
        self.totals = [np.array(t, np.float64) for t in totals]
        self.centroids = [unit(t) for t in self.totals]

    def drop(self, before: int) -> None:
        keep = [i for i, at in enumerate(self.seen) if at > before]
        for name in ("ids", "counts", "seen", "totals", "centroids"):
            setattr(self, name, [getattr(self, name)[i] for i in keep])

    def meet(self, embedding, now: int) -> int:
        vector = unit(np.asarray(embedding, np.float64))
        near = np.array([c @ vector for c in self.centroids])
        if len(near) and near.max() >= self.floor:
            at = int(near.argmax())
        else:
            at = len(self.ids)
            self.ids.append(self.next)
            self.counts.append(0)
            self.seen.append(now)
            self.totals.append(np.zeros(len(vector)))
            self.centroids.append(vector)
            self.next += 1
        self.totals[at] = self.totals[at] + vector
        self.centroids[at] = unit(self.totals[at])
        self.counts[at] += 1
        self.seen[at] = now
        return self.ids[at]

    def state(self) -> tuple:
        return [int(i) for i in self.ids], [t.tolist() for t in self.totals], [int(c) for c in self.counts], [int(s) for s in self.seen], int(self.next)


class PersonIds(StatefulProcessor):
    def __init__(self, eps: float, keep_ms: int):
        self.eps, self.keep = eps, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("persons", STATE)

    def persons(self) -> Persons:
        return Persons(self.eps, tuple(self.held.get()) if self.held.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        persons = self.persons()
        if not self.held.exists():
            self.handle.registerTimer(now + self.keep)
        persons.drop(now - self.keep)
        whole = pd.concat(list(rows)).sort_values("det_ord")
        out = [(int(o), persons.meet(e, now)) for o, e in zip(whole["det_ord"], whole["embedding"])]
        self.held.update(persons.state())
        yield pd.DataFrame({"video_id": [key[0]] * len(out), "det_ord": [o for o, _ in out], "person_id": pd.Series([i for _, i in out], dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drops who has not been seen for a while, and looks again when the next could be due."""
        persons = self.persons()
        persons.drop(int(timerValues.getCurrentProcessingTimeInMs()) - self.keep)
        if persons.ids:
            self.held.update(persons.state())
            self.handle.registerTimer(min(persons.seen) + self.keep)
        else:
            self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def person_ids(detections: DataFrame, eps: float = EPS, keep_ms: int = KEEP_MS) -> DataFrame:
    """(video_id, det_ord, person_id) of a stream of detections (video_id, det_ord, embedding); for append output. Needs the
    state store that keeps timers."""
    if detections.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    kind = detections.schema["video_id"].dataType.simpleString()
    keyed = detections.select("video_id", "det_ord", "embedding").groupBy("video_id")
    return keyed.transformWithStateInPandas(PersonIds(eps, keep_ms), f"video_id {kind}, det_ord long, person_id int", "Append", "ProcessingTime")
