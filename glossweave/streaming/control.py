"""Progress and cancellation of long work, and going on from where it stopped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener


def scaled(done: int, total: int, first: int = 0, last: int = 100) -> int:
    """Progress as a whole number between ``first`` and ``last``; unknown totals count as no progress."""
    return first if total <= 0 else first + (last - first) * min(max(done, 0), total) // total


class Progress(StreamingQueryListener):
    """Rows and micro-batches of one query, told to ``report`` as (batches, rows, progress) after each of them."""

    def __init__(self, name: str, total: int = 0, report: Callable[[int, int, int], None] | None = None, first: int = 0, last: int = 100) -> None:
        self.name, self.total, self.report, self.ends = name, total, report, (first, last)
        self.batches = self.rows = 0
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name != self.name or not event.progress.numInputRows:
            return
        self.batches += 1
        self.rows += event.progress.numInputRows
        if self.report:
            self.report(self.batches, self.rows, scaled(self.rows, self.total, *self.ends))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception


def run(writer: DataStreamWriter, cancelled: Callable[[], bool], poll_s: float = 0.05) -> bool:
    """Run a stream until it ends or ``cancelled`` says so; true if it ended by itself.

    A batch that is cut off is not in the checkpoint, so the next run does it again: nothing is lost and nothing comes twice.
    """
    query = writer.start()
    while query.isActive:
        if cancelled():
            query.stop()
            query.awaitTermination()
            return False
        time.sleep(poll_s)
    query.awaitTermination()
    return True


@contextmanager
def interruptible(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs of this thread carry ``tag``, so that another thread can end them by ``cancel``."""
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield
    finally:
        context.setInterruptOnCancel(False)
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
