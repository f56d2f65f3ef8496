"""Progress of a plan's stages: observed counts, and a line now and then while a stage runs."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


class Progress:
    """What has passed the stages that are watched.

    Counts travel with the job that a stage is part of, as observed metrics, so watching reads nothing twice; a stage's
    counts are those of the last job that ran it.
    """

    def __init__(self, spark: SparkSession, log: Callable[[str], None] | None = None):
        self.spark, self.log, self.stages = spark, log, {}

    def watch(self, df: DataFrame, stage: str, **sums: Column) -> DataFrame:
        """df, whose rows, and the sums named, are counted as a stage when a job runs it."""
        seen = Observation(f"{stage}-{len(self.stages)}")
        self.stages[stage] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))

    def done(self, stage: str) -> dict:
        """Counts of a stage that has run; waits for a job that is running it."""
        counts = dict(self.stages[stage].get)
        if self.log is not None:
            self.log(f"{stage}: " + ", ".join(f"{v} {k}" for k, v in counts.items()))
        return counts

    @contextmanager
    def following(self, every: float = 10.0):
        """Logs the tasks of running stages every so many seconds while the block runs."""
        tracker, ended = self.spark.sparkContext.statusTracker(), threading.Event()

        def follow():
            while not ended.wait(every):
                for stage in tracker.getActiveStageIds():
                    info = tracker.getStageInfo(stage)
                    if info is not None and self.log is not None:
                        self.log(f"{info.name.split(' at ')[0]}: {info.numCompletedTasks} of {info.numTasks} tasks")

        thread = threading.Thread(target=follow, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            ended.set()
            thread.join()
