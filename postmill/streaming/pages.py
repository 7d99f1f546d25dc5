"""What a watched page tells once: bursts of changes settle before they are read, and a key is reported when it is
first seen. Keys live in spaces (a result's URL, an opened detail, an enriched detail), so the space is one of the
key columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import blank_to_null
from .buckets import BUCKETS, Bucket, as_text, bucketed, cast_to

# Fixed value: milliseconds without a change after which a page is read.
SETTLED_MS = 500


def _sessions(rows: DataFrame, keys: list[str], at: str, gap_ms: int, chosen, order: str, *more: Column) -> DataFrame:
    own = [c for c in rows.columns if c not in keys]
    session = F.session_window(F.timestamp_millis(at) if dict(rows.dtypes)[at] == "bigint" else F.col(at), f"{gap_ms} milliseconds")
    return rows.groupBy(*keys, session).agg(chosen(F.struct(*own), F.struct(at, order)).alias("_row"), *more)


def settled(changes: DataFrame, keys: list[str], at: str = "at", order: str = "ord", gap_ms: int = SETTLED_MS) -> DataFrame:
    """The last change of each burst with ``read_at`` (milliseconds: the gap after it, when the page is read) and
    ``n``, its changes. Changes at most the gap apart are one burst. ``at`` are milliseconds, or in a stream
    a timestamp with a watermark, behind which a burst is given out. Sessions are merged before they move."""
    out = _sessions(changes, keys, at, gap_ms, F.max_by, order, F.count("*").alias("n"))
    return out.select(*keys, "_row.*", F.unix_millis("session_window.end").alias("read_at"), "n")


def enriched(changes: DataFrame, page: list[str], at: str = "at", order: str = "ord", gap_ms: int = SETTLED_MS) -> DataFrame:
    """Details that a page's settled changes (title, url, description) add: those with a description, each key (the
    URL, or the title without one) once for a page, when it is first read."""
    read = settled(changes, page, at, order, gap_ms).filter(blank_to_null(F.col("description")).isNotNull())
    read = read.withColumn("key", F.coalesce(blank_to_null(F.col("url")), F.col("title")))
    own = [c for c in read.columns if c not in (*page, "key")]
    first = read.groupBy(*page, "key").agg(F.min_by(F.struct(*own), "read_at").alias("_row"))
    return first.select(*page, "key", "_row.*")


def first_seen_within(rows: DataFrame, keys: list[str], at: str = "at", order: str = "ord", horizon_ms: int = 86_400_000) -> DataFrame:
    """Rows whose key was not seen within the horizon (milliseconds) before: a key that stays unseen that long is
    forgotten. Aggregates before it moves rows."""
    return _sessions(rows, keys, at, horizon_ms, F.min_by, order).select(*keys, "_row.*").select(*rows.columns)


class _First(Bucket):
    """State of a key: when it was last seen, until the horizon after that."""

    def __init__(self, names: list[str], at: str, order: str, horizon: int | None):
        self.names, self.at, self.order, self.horizon = names, at, order, horizon
        if horizon is not None:
            self.due = lambda last: last + horizon

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, kept, n = [], [], 0
        for frame in rows:
            frame = frame.sort_values([self.at, self.order])
            # A row can only be a first one if nothing of its own frame stands closely before it.
            times = frame.groupby("key_", dropna=False)[self.at]
            may = (times.cumcount() == 0).to_numpy() if self.horizon is None else ~(times.diff() <= self.horizon).to_numpy()
            kept.append(frame[may][self.names])
            place = np.where(may, np.cumsum(may) - 1 + n, -1)
            held += zip(frame[self.at].tolist(), frame[self.order].tolist(), frame["key_"].tolist(), place.tolist())
            n += int(may.sum())
        known, timer = self.load()
        seen, first = {}, []
        for at, _, own, place in sorted(held, key=lambda r: r[:2]):
            before = seen[own] if own in seen else known.get(own)
            if place >= 0 and (before is None or self.horizon is not None and at - before > self.horizon):
                first.append(place)
            seen[own] = at
        later = {k: at for k, at in seen.items() if at > known.get(k, at - 1)}
        if later:
            self.save(known | later, timer)
        yield pd.concat(kept).iloc[first].astype(object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expired(timerValues, expiredTimerInfo)
        yield pd.DataFrame({n: [] for n in self.names}, dtype=object)


def first_seen_stream(rows: DataFrame, keys: list[str], at: str = "at", order: str = "ord", horizon_ms: int | None = None, late: str = "1 second", buckets: int = BUCKETS) -> DataFrame:
    """First sightings of keys in a stream whose rows come in order of ``at`` (milliseconds) but for ``late``: the rows
    of ``first_seen_within``, or without a horizon of ``batch.first_seen``, however the stream is cut. State is a
    number for each key seen within the horizon, without one for each key, by buckets of keys. A bucket's rows in a
    micro-batch are not held, but for what can be a first one and their times. Without a horizon there are no timers,
    so no watermark, no micro-batches without rows to move it, and no row is too late."""
    schema = as_text(rows.schema, (at, order))
    timed, mode = rows.select(*cast_to(schema)), "None"
    if horizon_ms is not None:
        timed, mode = timed.withColumn("_at", F.timestamp_millis(at)).withWatermark("_at", late), "EventTime"
    out = bucketed(timed, keys, buckets).transformWithStateInPandas(_First(rows.columns, at, order, horizon_ms), schema, "append", mode)
    return out.select(*cast_to(rows.schema))
