"""Cancellation and progress of running operators, by Spark's own job groups."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Progress:
    """Finished and known tasks of a group's active and completed stages."""

    done: int
    total: int


class Job:
    """A named group of Spark jobs that can be watched and cancelled from another thread."""

    def __init__(self, spark: SparkSession, description: str = ""):
        self.spark, self.id, self.description = spark, f"spanloom-{uuid.uuid4().hex}", description
        self.cancelled = threading.Event()

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self.id)

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for j in tracker.getJobIdsForGroup(self.id):
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else ():
                if stage := tracker.getStageInfo(s):
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return Progress(done, total)


@contextmanager
def job(spark: SparkSession, description: str = "") -> Iterator[Job]:
    """Run the actions inside under one group: ``with job(spark) as j: ...; j.cancel()``."""
    j = Job(spark, description)
    spark.sparkContext.setJobGroup(j.id, description, interruptOnCancel=True)
    try:
        yield j
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def run_cancellable(spark: SparkSession, action: Callable[[], object], description: str = "") -> tuple[Job, threading.Thread, list]:
    """Start an action in a thread of its own; the list receives its result, or None if it was cancelled."""
    from pyspark import InheritableThread

    j, out = Job(spark, description), []

    def work() -> None:
        spark.sparkContext.setJobGroup(j.id, description, interruptOnCancel=True)
        try:
            out.append(action())
        except Exception:
            if not j.cancelled.is_set():
                raise
            out.append(None)

    t = InheritableThread(target=work)
    t.start()
    return j, t, out
