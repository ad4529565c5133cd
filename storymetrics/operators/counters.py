"""Counters that a run gives in passing, of batches and of streams."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def of_frames() -> tuple[Column, ...]:
    """What is counted of scored frames, as frames.counts() would in a pass of its own."""
    good, bad = F.col("label") == "GOOD", F.col("label") == "BAD"
    return F.count(F.lit(1)).alias("total_frames"), F.count_if(good).alias("good_frames"), F.count_if(bad).alias("bad_frames"), F.count_if(F.col("label").isNull()).alias("failed_frames")


def observed(rows: DataFrame, *counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, which are counted when they are written, and where the counts will be."""
    seen = Observation()
    return rows.observe(seen, *counts), seen


class StreamCounters(StreamingQueryListener):
    """Adds up what streams count with observe(name, ...), by name; add it to the session's streams."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.totals.setdefault(name, Counter()).update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryTerminated(self, event) -> None:
        pass
