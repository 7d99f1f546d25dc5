"""Labels, intervals and small rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import blank_to_null, r2


def score_category(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("low")


def hybrid_score(local: Column, model: Column, weight: float | None = None) -> Column:
    """Local and model score blended; a weight of 0 counts as not given. Without a model score the
    local one stays."""
    w = weight or 0.3
    return F.when(model.isNull(), local).otherwise(r2((1 - w) * local + w * model))


def number_text(x: Column) -> Column:
    """A number as people write it: no decimals that aren't there."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def time_ago(ts: Column, now: Column) -> Column:
    """``ts`` and ``now`` in seconds since the epoch."""
    minutes = F.floor((now - ts) / 60)
    label = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "").when(minutes < 1, "just now").when(minutes < 60, label(minutes, "m")).when(minutes < 1440, label(minutes / 60, "h")).otherwise(label(minutes / 1440, "d"))


def interval_label(minutes: Column) -> Column:
    return F.when(minutes < 60, F.concat(F.lit("Every "), minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.lit("Every "), number_text(minutes / 60), F.lit("h"))).otherwise("Daily")


def alarm_period(interval: Column) -> Column:
    """Minutes between scans: 60 if not given or 0, at least 15."""
    return F.greatest(F.coalesce(F.nullif(interval, F.lit(0)), F.lit(60)), F.lit(15))


def scan_progress(step: Column, steps: Column) -> Column:
    return F.least(F.lit(85), 10 + F.floor(step / steps * 75 + 0.5)).cast("int")


def elapsed_seconds(start_ms: Column, end_ms: Column) -> Column:
    return F.floor((end_ms - start_ms) / 1000 + 0.5).cast("long")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def search_url(keywords: Column, location: Column, work_type: Column, base: str = "https://www.linkedin.com/jobs/search/?", marker: str = "_jm_scan=1") -> Column:
    """Address of a search, newest first; an empty field and ``any`` are left out."""
    code = F.when(work_type == "remote", "2").when(work_type == "onsite", "1").when(work_type == "hybrid", "3")  # fixed values
    field = lambda name, value: F.concat(F.lit(f"{name}="), F.url_encode(blank_to_null(value)))
    return F.concat(F.lit(base), F.concat_ws("&", field("keywords", keywords), field("location", location), field("f_WT", code), F.lit("sortBy=DD"), F.lit(marker)))


def new_id(ms: Column) -> Column:
    """A new identifier: time in base 36 and random characters."""
    return F.concat(F.lower(F.conv(ms.cast("string"), 10, 36)), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))


def model_ready(names: Column, wanted: str) -> Column:
    """Whether a model of that name, whatever its tag, is among the names."""
    return F.exists(names, lambda n: (n == wanted) | n.startswith(wanted.split(":")[0]))
