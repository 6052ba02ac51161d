"""A watch over running jobs: records how far they are, and cancels them once they stand still."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import SparkSession

from fluxloom.sources import writers


class Stalled(RuntimeError):
    """No task ended for longer than allowed, and the jobs were cancelled."""


def progress(sc: SparkContext, group: str) -> dict:
    """Jobs of a group, those that run, and the tasks of these that are done and at work."""
    tracker = sc.statusTracker()
    jobs = list(tracker.getJobIdsForGroup(group))
    running = [j for j in map(tracker.getJobInfo, jobs) if j is not None and j.status == "RUNNING"]
    stages = [s for j in running for s in map(tracker.getStageInfo, j.stageIds) if s is not None]
    return {"jobs": len(jobs), "running": len(running), "tasks_done": sum(s.numCompletedTasks + s.numFailedTasks for s in stages), "tasks_active": sum(s.numActiveTasks for s in stages)}


@contextmanager
def watched(spark: SparkSession, stall_seconds: float, record: str | None = None, every: float = 1.0, counts: Callable[[], dict] | None = None) -> Iterator[str]:
    """The jobs that the block starts, as a group under watch.

    Every so many seconds their progress, and what counts() says, is put into the
    record.  While jobs run and none of their tasks starts or ends, and no job
    follows, for stall_seconds, the record says so, the group is cancelled and the
    block raises Stalled.  Time between jobs, when the driver works, doesn't count.
    """
    sc, group, over, stalled = spark.sparkContext, f"watched-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def note(now: dict, **more) -> None:
        if record:
            writers.record({"at": time.time()} | now | more | ({"counts": counts()} if counts else {}), record)

    def look() -> None:
        last, since = None, time.monotonic()
        while not over.wait(every):
            now = progress(sc, group)
            if now != last or not now["running"]:
                last, since = now, time.monotonic()
            elif time.monotonic() - since > stall_seconds:
                stalled.set()
                sc.cancelJobGroup(group)
                note(now, stalled_seconds=time.monotonic() - since)
                return
            note(now)

    sc.setJobGroup(group, "watched", interruptOnCancel=True)
    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield group
    except Exception as e:
        if stalled.is_set():
            raise Stalled(f"no task ended for {stall_seconds} seconds") from e
        raise
    finally:
        over.set()
        thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
