"""State of many keys in one row: keys are dealt over buckets by hash, and a bucket is what Spark groups by.

A call of Python, its frames and its state cost about a millisecond, however few rows a key has; a bucket
pays that once for all its keys. A micro-batch reads and rewrites the state of the buckets that it touches, so the number
of buckets bounds both that and the rows that a task holds at a time; it is fixed for a checkpoint."""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

BUCKETS = 512


def bucketed(rows: DataFrame, keys: list[str], buckets: int):
    """Rows grouped by bucket. ``key_`` is the key as a text, null for a null key of one column."""
    one = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys))
    return rows.withColumns({"key_": one, "bucket_": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")}).groupBy("bucket_")


def as_text(schema: StructType, but: tuple[str, ...] = ()) -> StructType:
    """The schema with whole numbers as texts: beside nulls, pandas would make them floating-point ones."""
    return StructType([StructField(f.name, StringType()) if isinstance(f.dataType, IntegralType) and f.name not in but else f for f in schema])


def cast_to(schema: StructType) -> list[Column]:
    return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]


class Bucket(StatefulProcessor):
    """``load`` gives {key: value} and the time of the bucket's timer, ``save`` keeps them. With ``due``, the time at which a
    value is over, the bucket has one timer at the earliest of these."""

    due = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "known binary, timer long")

    def load(self) -> tuple[dict, int | None]:
        if not self.held.exists():
            return {}, None
        known, timer = self.held.get()
        return pickle.loads(bytes(known)), timer

    def save(self, known: dict, timer: int | None) -> None:
        first = min(map(self.due, known.values())) if self.due and known else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if known:
            self.held.update((pickle.dumps(known), first))
        else:
            self.held.clear()

    def expired(self, timerValues, expiredTimerInfo) -> list:
        """(key, value) of what is over, which the bucket forgets."""
        known, timer = self.load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs())
        over = [(k, v) for k, v in known.items() if self.due(v) <= now]
        for k, _ in over:
            del known[k]
        self.save(known, None if timer == fired else timer)
        return over

    def close(self) -> None:
        pass
