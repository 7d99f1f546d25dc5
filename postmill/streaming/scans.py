"""The life of scheduled scans: they start, report progress, and end with their answer or without one in time.

Messages are rows (scan, profile, at in milliseconds, ord, kind, step, nth, max_passes, jobs). A ``start`` opens a
scan; ``progress`` counts while it is open; ``jobs`` ends it; without one a timeout ends it empty. What comes
before the start or after the end is ignored. Statuses are rows (scan, profile, at, state, step, progress,
jobs_found, elapsed)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.formats import elapsed_seconds, scan_progress
from .buckets import BUCKETS, Bucket, as_text, bucketed, cast_to

# Milliseconds that a scan may take, and progress when its page loads.
TIMEOUT_MS, LOADING = 20_000, 10
STATUS = "scan long, profile long, at long, state string, step string, progress long, jobs_found long, elapsed long"
_COLUMNS = ["scan", "profile", "at", "state", "step", "progress", "jobs_found", "elapsed"]


def scan_statuses(messages: DataFrame, until: int, timeout: int = TIMEOUT_MS) -> DataFrame:
    """Statuses of recorded messages, as known at ``until`` (milliseconds): a scan whose time is not up by then and
    that has no answer is still open. The first start of a scan counts. Starts and answers are aggregated before
    they move; progress meets its scan by key."""
    by = lambda kind, c: F.when(F.col("kind") == kind, c)
    start = messages.groupBy("scan").agg(F.min(by("start", F.struct("at", "ord", "profile"))).alias("s")).filter("s is not null")
    answers = messages.filter("kind = 'jobs'").join(start, "scan").filter((F.struct("at", "ord") > F.struct("s.at", "s.ord")) & (F.col("at") < F.col("s.at") + timeout))
    answers = answers.groupBy("scan").agg(F.min(F.struct("at", "ord", "jobs")).alias("a"))
    scans = start.join(answers, "scan", "left")
    up = F.col("s.at") + timeout
    ended = F.when(F.col("a").isNotNull(), F.col("a.at")).when(up <= until, up)
    end = F.when(F.col("a").isNotNull(), F.struct(F.col("a.at").alias("at"), F.col("a.ord").alias("ord"))).otherwise(F.struct(up.alias("at"), F.lit(-1).cast("long").alias("ord")))
    scans = scans.select("scan", "s", end.alias("x"), F.coalesce("a.jobs", F.lit(0)).cast("long").alias("jobs"), ended.alias("ended"))
    none = F.lit(None).cast("long")
    opened = scans.select("scan", F.col("s.profile").alias("profile"), F.col("s.at").alias("at"), F.lit("scanning").alias("state"), F.lit("loading").alias("step"), F.lit(LOADING).cast("long").alias("progress"), none.alias("jobs_found"), none.alias("elapsed"))
    done = scans.filter("ended is not null").select("scan", F.col("s.profile").alias("profile"), F.col("ended").alias("at"), F.lit("idle").alias("state"), F.lit(None).cast("string").alias("step"), F.lit(100).cast("long").alias("progress"), F.col("jobs").alias("jobs_found"), elapsed_seconds(F.col("s.at"), F.col("ended")).cast("long").alias("elapsed"))
    place = F.struct("at", "ord")
    during = messages.filter("kind = 'progress'").join(scans.select("scan", "s", "x"), "scan").filter((place > F.struct("s.at", "s.ord")) & (place < F.col("x")))
    during = during.select("scan", F.col("s.profile").alias("profile"), "at", F.lit("scanning").alias("state"), "step", scan_progress(F.col("nth"), F.col("max_passes")).cast("long").alias("progress"), none.alias("jobs_found"), none.alias("elapsed"))
    return opened.unionByName(during).unionByName(done)


class _Scan(Bucket):
    """State of a scan: when it was started, for whom, and whether it is over. It is forgotten at its timeout, as
    nothing of it could count any more; one that is open then ends."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def due(self, scan) -> int:
        return scan[0] + self.timeout

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "ord", "key_", "kind", "profile", "step", "nth", "max_passes", "jobs"]
        messages = sorted((m for frame in rows for m in zip(*(frame[c].tolist() for c in names))), key=lambda m: m[:2])
        known, timer = self.load()
        changed, out = False, []
        for now, _, scan, kind, who, step, n, most, jobs in messages:
            at, profile, over = known.get(scan, (None, None, False))
            if at is None:
                if kind == "start":
                    at, profile = int(now), None if pd.isna(who) else who
                    known[scan], changed = (at, profile, False), True
                    out.append((scan, profile, at, "scanning", "loading", LOADING, None, None))
            elif over or now >= at + self.timeout:
                continue
            elif kind == "progress":
                done = min(85, 10 + int(int(n) / int(most) * 75 + 0.5))
                out.append((scan, profile, int(now), "scanning", step, done, None, None))
            elif kind == "jobs":
                known[scan], changed = (at, profile, True), True
                out.append((scan, profile, int(now), "idle", None, 100, 0 if pd.isna(jobs) else int(jobs), int((now - at) / 1000 + 0.5)))
        if changed:
            self.save(known, timer)
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = self.expired(timerValues, expiredTimerInfo)
        out = [(scan, profile, at + self.timeout, "idle", None, 100, 0, int(self.timeout / 1000 + 0.5)) for scan, (at, profile, over) in ended if not over]
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)


def scan_stream(messages: DataFrame, timeout: int = TIMEOUT_MS, late: str = "1 second", buckets: int = BUCKETS) -> DataFrame:
    """The same over a stream of messages. Time is that of the messages: a timeout is known once messages later
    than it by ``late`` have come. State is a scan whose timeout lies ahead, by buckets of scans."""
    exact = messages.select(*cast_to(as_text(messages.schema, ("at", "ord"))))
    timed = exact.withColumn("_at", F.timestamp_millis("at")).withWatermark("_at", late)
    schema = StructType.fromDDL(STATUS)
    out = bucketed(timed, ["scan"], buckets).transformWithStateInPandas(_Scan(timeout), as_text(schema, tuple(_COLUMNS[2:])), "append", "EventTime")
    return out.select(*cast_to(schema))
