"""Re-scoring by a language model: prompts, lenient replies, an injected scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import blank_to_null, r2, trim

# Characters of either text in a prompt, of a rationale, items of a list, jobs of a batch.
TEXT, RATIONALE, ITEMS, BATCH = 2000, 500, 5, 10
SYSTEM = "You compare resumes with job postings. Answer with one JSON object and nothing else."
RAW = "score string, rationale string, keyStrengths string, gaps string"


def prompt(profile: Column, title: Column, company: Column, location: Column, description: Column) -> Column:
    """The user message."""
    known = lambda c: F.coalesce(blank_to_null(c), F.lit("N/A"))
    return F.concat(
        F.lit("Rate from 0 to 100 how well the resume fits the job.\n\nRESUME:\n"),
        F.substring(F.coalesce(profile, F.lit("")), 1, TEXT),
        F.lit("\n\nJOB:\nTitle: "), known(title), F.lit("\nCompany: "), known(company), F.lit("\nLocation: "), known(location),
        F.lit("\nDescription:\n"), F.substring(F.coalesce(description, F.lit("")), 1, TEXT),
        F.lit('\n\nReply as {"score": 0-100, "rationale": "...", "keyStrengths": ["..."], "gaps": ["..."]}'),
    )


def parse_reply(content: Column) -> Column:
    """Struct (score, rationale, key_strengths, gaps), or null if no JSON object is found: the whole reply,
    else from the first brace to the first closing one (so an object within one fails). Scores are
    taken from numbers, numeric text and booleans, put into 0 to 100 and rounded; what else they may be
    is 0. Lists that aren't lists are empty."""
    text = trim(content)
    inner = F.regexp_extract(text, r"\{[\s\S]*?\}", 0)
    valid = lambda t: F.coalesce(F.get_json_object(t, "$").isNotNull() & F.startswith(t, F.lit("{")), F.lit(False))
    chosen = F.when(valid(text), text).when(valid(inner), inner)
    got = F.from_json(chosen, RAW)
    raw = trim(got["score"])
    number = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(F.coalesce(raw.try_cast("double"), F.lit(0.0)))
    score = r2(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(number, F.lit(0.0)))))
    items = lambda c: F.slice(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), 1, ITEMS)
    return F.when(chosen.isNotNull(), F.struct(score.alias("score"), F.substring(F.coalesce(got["rationale"], F.lit("")), 1, RATIONALE).alias("rationale"), items(got["keyStrengths"]).alias("key_strengths"), items(got["gaps"]).alias("gaps")))


def duration_ms(ns: Column) -> Column:
    return F.floor(ns / 1e6 + 0.5).cast("long")


def ask(rows: DataFrame, scorer: Callable[[str], str], prompt_column: str = "prompt") -> DataFrame:
    """Adds ``reply``: what the scorer answers to each prompt, or null if it fails. The scorer runs on the
    executors, one prompt at a time; it holds the address and time limit of its service."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", reply string"

    def answer(text: str) -> str | None:
        try:
            return scorer(text)
        except Exception:  # a service's failure is a missing score
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=[answer(p) for p in batch[prompt_column]])

    return rows.mapInPandas(run, schema)
