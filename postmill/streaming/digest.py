"""Digests with a cooldown per recipient, as a stream with state and as a batch over recorded events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .buckets import BUCKETS, Bucket, bucketed, cast_to
from .replay import state_on_disk

# Fixed value: minutes between two digests to a recipient.
COOLDOWN_MINUTES = 30
SENT = "recipient string, sent_at long, n long, items array<long>"


class _Cooldown(Bucket):
    """State of a recipient: when a digest was last sent, and what waits."""

    def __init__(self, gap: int):
        self.gap = gap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((e for f in rows for e in zip(f["at"].tolist(), f["item"].tolist(), f["key_"].tolist())), key=lambda e: e[:2])
        known, _ = self.load()
        out = []
        for now, item, who in events:
            last, waits = known.setdefault(who, (None, []))
            waits.append(item)
            if last is None or now - last >= self.gap:
                out.append((who, now, len(waits), waits))
                known[who] = (now, [])
        self.save(known, None)
        yield pd.DataFrame(out, columns=["recipient", "sent_at", "n", "items"], dtype=object)


def _as_recipients(rows: DataFrame, processor: Bucket, schema: str, mode: str, buckets: int) -> DataFrame:
    """``processor`` over buckets of recipients, whose type ``schema`` names."""
    whole = StructType.fromDDL(schema)
    text = StructType([StructField("recipient", StringType()), *whole.fields[1:]])
    return bucketed(rows, ["recipient"], buckets).transformWithStateInPandas(processor, text, "append", mode).select(*cast_to(whole))


def cooldown_stream(events: DataFrame, minutes: float = COOLDOWN_MINUTES, schema: str = SENT, buckets: int = BUCKETS) -> DataFrame:
    """Digests (recipient, sent_at, n, items) of a stream of events (recipient, at in milliseconds, item).

    An event at least the cooldown after the last digest sends what is pending and itself; others wait.
    Nothing is sent without an event. State is the time of the last digest and the list of what is pending,
    by buckets of recipients on disk. ``schema`` names the recipient's type."""
    state_on_disk(events.sparkSession)
    return _as_recipients(events, _Cooldown(int(minutes * 60_000)), schema, "None", buckets)


def _scanned(rows: DataFrame, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Rows (recipient, *order) scanned by recipient in that order. ``step(state, *values)`` gives the next
    state, None at a recipient's first row, and a line or None. Only the state is held, whatever a
    recipient's share of the rows; ``schema`` is that of a line."""
    lines = StructType.fromDDL(schema)
    out = StructType([rows.schema["recipient"], *lines.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, types = None, None, None
        for batch in batches:
            types = types or [batch.schema.field(0).type, *(f.type for f in to_arrow_schema(lines))]
            made: list = []
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or own[0] != key:
                    own, state = (key,), None
                state, line = step(state, *values)
                if line is not None:
                    made.append((key, *line))
            columns = zip(*made) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], out.names)

    return rows.repartition("recipient").sortWithinPartitions("recipient", *order).mapInArrow(scan, out)


def cooldown_batch(events: DataFrame, minutes: float = COOLDOWN_MINUTES, recipient: str = "recipient", at: str = "at", item: str = "item") -> DataFrame:
    """The same over recorded events: rows (recipient, sent_at, n) for each digest. One sorted pass over a
    recipient's events that holds the time of the last digest and the number of pending events."""
    gap = int(minutes * 60_000)

    def step(state, now, _):
        last, n = state or (None, 0)
        if last is None or now is not None and now - last >= gap:
            return (now, 0), (now, n + 1)
        return (last, n + 1), None

    rows = events.select(F.col(recipient).alias("recipient"), F.col(at).cast("long").alias("at"), F.col(item).alias("item"))
    return _scanned(rows, ["at", "item"], step, "sent_at long, n long").withColumnRenamed("recipient", recipient)


def rate_limited(requests: DataFrame, minutes: float = COOLDOWN_MINUTES, recipient: str = "recipient", at: str = "at", delivered: str = "delivered", configured: bool = True, matches: str | None = None, keep: bool = False) -> DataFrame:
    """Adds ``result`` and ``retry_after`` (seconds) to requests (recipient, at in milliseconds, delivered):
    sent, rate_limited, smtp_not_configured (``configured`` is false: no mail server is known), or send_failed;
    only what is sent starts the cooldown. One sorted pass that holds the time of a recipient's last sent
    request.

    With ``matches`` (a column of numbers) also ``n``: matches that the mail holds, 0 if none is sent. Matches of a
    refused request are lost, as the sender forgets them, or stay for the next one with ``keep``."""
    gap = int(minutes * 60_000)

    def step(state, now, ok, n):
        last, left = state or (None, 0)
        n, wait = left + n, 0 if last is None or now is None else last + gap - now
        sent = wait <= 0 and configured and ok
        result = "rate_limited" if wait > 0 else "smtp_not_configured" if not configured else "sent" if ok else "send_failed"
        return (now if sent else last, n if keep and not sent else 0), (now, result, -(-wait // 1000) if wait > 0 else None, n if sent else 0)

    count = F.coalesce(F.col(matches), F.lit(0)).cast("long") if matches else F.lit(0).cast("long")
    rows = requests.select(F.col(recipient).alias("recipient"), F.col(at).cast("long").alias("at"), F.coalesce(F.col(delivered), F.lit(False)).alias("ok"), count.alias("n"))
    out = _scanned(rows, ["at", "ok", "n"], step, "at long, result string, retry_after long, n long").withColumnRenamed("recipient", recipient)
    return out if matches else out.drop("n")


LIMITED = "recipient long, at long, result string, retry_after long"


class _Limiter(Bucket):
    """State of a recipient: when mail was last sent, until the cooldown after it is over."""

    def __init__(self, gap: int, configured: bool):
        self.gap, self.configured = gap, configured

    def due(self, last: int) -> int:
        return last + self.gap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = sorted((r for f in rows for r in zip(f["at"].tolist(), f["delivered"].fillna(False).astype(bool).tolist(), f["key_"].tolist())), key=lambda r: r[:2])
        known, timer = self.load()
        changed, out = False, []
        for now, ok, who in asked:
            last = known.get(who)
            wait = 0 if last is None else last + self.gap - now
            result = "rate_limited" if wait > 0 else "smtp_not_configured" if not self.configured else "sent" if ok else "send_failed"
            out.append((who, now, result, -(-wait // 1000) if wait > 0 else None))
            if result == "sent":
                known[who], changed = now, True
        if changed:
            self.save(known, timer)
        yield pd.DataFrame(out, columns=["recipient", "at", "result", "retry_after"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expired(timerValues, expiredTimerInfo)  # requests to come are later than the cooldown
        yield pd.DataFrame({"recipient": [], "at": [], "result": [], "retry_after": []}, dtype=object)


def rate_limit_stream(requests: DataFrame, minutes: float = COOLDOWN_MINUTES, configured: bool = True, late: str = "1 second", schema: str = LIMITED, buckets: int = BUCKETS) -> DataFrame:
    """``rate_limited`` over a stream of requests (recipient, at in milliseconds, delivered), which come in order but
    for ``late``. State is a number for each recipient to whom mail was sent within the cooldown, by buckets of
    recipients; a timer removes it after that. ``schema`` names the recipient's type."""
    timed = requests.withColumn("_at", F.timestamp_millis("at")).withWatermark("_at", late)
    return _as_recipients(timed, _Limiter(int(minutes * 60_000), configured), schema, "EventTime", buckets)


def alarm_times(profiles: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (id, runs_at): the scans of enabled profiles (id, interval in minutes, enabled) between two times,
    the first one period after the start."""
    from ..functions.formats import alarm_period

    on = profiles.filter("enabled").select("id", alarm_period(F.col("interval")).cast("long").alias("m"))
    step = F.make_dt_interval(mins=F.col("m").cast("int"))
    first = F.lit(start).cast("timestamp") + step
    return on.filter(first <= F.lit(end).cast("timestamp")).select("id", F.explode(F.sequence(first, F.lit(end).cast("timestamp"), step)).alias("runs_at"))


def alarm_history(versions: DataFrame, end: str) -> DataFrame:
    """Rows (owner, id, runs_at): all scans until ``end`` of profiles that change. ``versions``: rows (owner, at, id,
    interval in minutes, enabled, deleted), a profile as saved at a time. Each save of an owner sets all its alarms
    anew: a profile that is enabled then runs one period after the save and so on, up to the owner's next
    save. A profile is what its last version up to a save says; of versions at one time the largest counts.

    Versions become ranges of time, and saves meet the ranges that hold them by owner."""
    from ..functions.formats import alarm_period

    last = F.lit(end).cast("timestamp")
    state = F.max(F.struct("deleted", "enabled", "interval")).alias("v")
    known = versions.filter(F.col("at") <= last).groupBy("owner", "id", "at").agg(state)
    until = F.lead("at").over(Window.partitionBy("owner", "id").orderBy("at"))
    ranges = known.select("owner", "id", "v.*", F.col("at").alias("since"), until.alias("until")).filter(F.col("enabled") & ~F.coalesce("deleted", F.lit(False)))
    saves = known.select("owner", "at").distinct()
    saves = saves.select(F.col("owner").alias("o"), "at", F.lead("at").over(Window.partitionBy("owner").orderBy("at")).alias("next"))
    met = ranges.join(saves, F.col("owner").eqNullSafe(F.col("o")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    step = F.make_dt_interval(mins=alarm_period(F.col("interval")).cast("int"))
    first, bound = F.col("at") + step, F.coalesce(F.col("next"), last)
    runs = met.filter(first <= bound).select("owner", "id", "next", F.explode(F.sequence(first, bound, step)).alias("runs_at"))
    return runs.filter(F.col("next").isNull() | (F.col("runs_at") < F.col("next"))).drop("next")


def changes(visits: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Visits at which the value differs from the one before: when a page has been left for another."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return visits.withColumn("before", before).filter(~F.col(value).eqNullSafe(F.col("before"))).drop("before")
