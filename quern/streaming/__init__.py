"""Extensions beyond a bounded extraction: incremental windows, and event-time aggregation.

Windows are half-open ``(low, high]`` ranges over a watermark column that a caller keeps;
they become ordinary filters.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import And, Cmp, Col, Lit, Node


@dataclass(frozen=True)
class IncrementalWindow:
    column: str
    low: dt.datetime | None
    high: dt.datetime

    def filter(self) -> Node:
        upper = Cmp(Col(self.column), "<=", Lit(self.high))
        return upper if self.low is None else And(Cmp(Col(self.column), ">", Lit(self.low)), upper)


def next_window(column: str, mark: dt.datetime | None, now: dt.datetime, safety_lag: dt.timedelta = dt.timedelta(0), max_window: dt.timedelta | None = None, overlap: dt.timedelta = dt.timedelta(0)) -> IncrementalWindow | None:
    """The next range after the high-water mark, or None if nothing is old enough yet.

    ``safety_lag`` leaves out what writers may still be committing, ``overlap`` reads a
    stretch again, ``max_window`` bounds one run.
    """
    high = now - safety_lag
    low = None if mark is None else mark - overlap
    if mark is not None:
        if high <= mark:
            return None
        if max_window is not None:
            high = min(high, mark + max_window)
    return IncrementalWindow(column, low, high)


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, late: str | None = None, aggregates: list = ()) -> DataFrame:
    """Counts (or ``aggregates``) in event-time windows; with ``late``, also on streams."""
    df = events.withWatermark(time, late) if late else events
    return df.groupBy(F.window(time, width), *keys).agg(*(aggregates or [F.count("*").alias("n")]))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark(time, late) if late else events
    return df.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
