"""The text functions for SQL: temporary functions of a session, by the same patterns as the Columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .dialect import SPACE, bounded
from .text import literals, quoted
from .vocab import PHRASES, SKILLS, STOP_WORDS, TECH_TERMS


def _text(value: str) -> str:
    """A raw SQL literal; none of the lists holds a quote."""
    return f"r'{value}'"


def _found(parts: list[str], pattern: str) -> str:
    """Matches of a pattern in ``low``, if the text holds all of ``parts``."""
    guard = " AND ".join(f"contains(low, {_text(p)})" for p in parts)
    return f"CASE WHEN {guard} THEN regexp_extract_all(low, {_text(bounded(pattern))}, 0) ELSE array() END"


def _lowered(body: str) -> str:
    return f"element_at(transform(array(lower(coalesce(t, ''))), low -> {body}), 1)"


def bodies() -> dict[str, str]:
    """Name and expression over ``t`` of each function; all give arrays of strings."""
    groups = []
    for group in TECH_TERMS:
        guard = " OR ".join("(" + " AND ".join(f"contains(low, {_text(p)})" for p in literals(term)) + ")" for term in group)
        groups.append(f"CASE WHEN {guard} THEN regexp_extract_all(low, {_text('|'.join(map(bounded, group)))}, 0) ELSE array() END")
    terms = f"transform(concat({', '.join(groups)}), x -> regexp_replace(x, {_text(SPACE + '+')}, '-'))"
    stop = ", ".join(map(_text, STOP_WORDS))
    words = f"transform(filter(regexp_extract_all(low, r'[a-z0-9#+.\\-]{{2,}}', 0), w -> w NOT IN ({stop})), w -> trim(BOTH '.-' FROM w))"
    phrases = f"concat({', '.join(_found(parts, p) for p, parts in PHRASES.items())})"
    known = [f"CASE WHEN contains(low, {_text(s)}) AND low RLIKE {_text(bounded(quoted(s)))} THEN {_text(s)} END" for s in SKILLS]
    return {
        "tech_terms": _lowered(terms),
        "tokens": _lowered(f"filter(array_distinct(concat({words}, {terms})), w -> length(w) >= 2)"),
        "phrase_skills": _lowered(phrases),
        "skills": _lowered(f"array_distinct(concat(filter(array({', '.join(known)}), s -> s IS NOT NULL), {phrases}))"),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes ``tokens``, ``tech_terms``, ``skills`` and ``phrase_skills`` known to the session's SQL; gives their names."""
    for name, body in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS ARRAY<STRING> RETURN {body}")
    return [prefix + name for name in bodies()]
