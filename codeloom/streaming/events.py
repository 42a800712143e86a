"""Streaming twins of the stateful operators.

Each takes a streaming DataFrame and returns one; late rows are dropped only behind the
watermark the caller chooses, and state is kept per key with a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Events(session, path, at, hash) whose hash differs from the last one seen for the session and path; A-B-A fires again.

    The state of a key is its last hash alone. Rows of one key in a batch are taken in order of
    time; with idle_ms a key that is idle for longer is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        seen = state.exists
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        keep = []
        for h in rows["hash"]:
            keep.append(not seen or h != last)
            last, seen = h, True
        state.update((last,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows[keep][["session", "path", "at", "hash"]]

    return events.groupBy("session", "path").applyInPandasWithState(step, "session long, path string, at timestamp, hash string", "hash string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def session_totals(events: DataFrame) -> DataFrame:
    """Running counts per session of events(session, kind): errors, writes, checks."""
    return events.groupBy("session").agg(*[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("error", "write", "check")])


def windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of events(at, kind, value) per event-time window and kind."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "kind", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of events(at, session): runs without a pause longer than the gap."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "session").agg(F.count(F.lit(1)).alias("n")).select("session", "w.start", "w.end", "n")
