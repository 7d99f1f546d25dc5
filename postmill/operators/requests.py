"""JSON request bodies as Columns: their fields, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes of a body at most.
MOST_BYTES = 2 << 20
MATCH = "array<struct<job_title:string,company:string,url:string,score:double,platform:string,matched_skills:array<string>,missing_skills:array<string>,matched_at:string>>"


def _kind(body: Column, field: str) -> Column:
    """Type of a field's value, as STRING, OBJECT<...>, ARRAY<...>; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant"))


def _text(body: Column, field: str) -> Column:
    return F.when(_kind(body, field) == "STRING", F.get_json_object(body, f"$.{field}"))


def _filled(body: Column, field: str) -> Column:
    """Whether the field is an array that isn't empty."""
    size = F.size(F.try_variant_get(F.try_parse_json(body), f"$.{field}", "array<variant>"))
    return F.coalesce(F.startswith(_kind(body, field), F.lit("ARRAY<")) & (size > 0), F.lit(False))


def _first(body: Column, *tests: tuple[Column, str]) -> Column:
    """The message of the first test that fails, after those for size and form; null if all hold."""
    error = F.when(F.octet_length(body) > MOST_BYTES, "request entity too large").when(F.try_parse_json(body).isNull(), "invalid JSON")
    for test, message in tests:
        error = error.when(~F.coalesce(test, F.lit(False)), message)
    return error


def insert_error(body: Column) -> Column:
    """What is wrong with a request to insert matches."""
    return _first(body, (_filled(body, "matches"), "matches array is required"))


def score_error(body: Column) -> Column:
    """What is wrong with a request to score one job. An array counts as an object, as it does in JavaScript."""
    job = F.regexp_like(_kind(body, "job"), F.lit("^(OBJECT|ARRAY)<"))
    return _first(body, (F.length(_text(body, "resumeText")) > 0, "resumeText string is required"), (job, "job object is required"))


def score_batch_error(body: Column) -> Column:
    """What is wrong with a request to score several jobs."""
    return _first(body, (F.length(_text(body, "resumeText")) > 0, "resumeText string is required"), (_filled(body, "jobs"), "jobs array is required"))


def notify_error(body: Column) -> Column:
    """What is wrong with a request to notify somebody."""
    return _first(body, (F.contains(_text(body, "email"), F.lit("@")), "Valid email address is required"), (_filled(body, "matches"), "matches array is required"))


def matches_of(bodies: DataFrame, column: str = "body") -> DataFrame:
    """The matches of valid bodies, a row each, with the bodies' other columns; ``history.insert`` takes them."""
    own = [c for c in bodies.columns if c != column]
    got = F.from_json(column, f"struct<matches:{MATCH}>")["matches"]
    return bodies.filter(insert_error(F.col(column)).isNull()).select(*own, F.inline(got))
