"""The text semantics as DuckDB expressions, for comparison."""

from __future__ import annotations

import re

from ..functions.vocab import PHRASES, SKILLS, STOP_WORDS, TECH_TERMS

S = r"[ \t\n\x0B\f\r]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tech(x: str) -> str:
    groups = [f"regexp_extract_all(lower({x}), {q(r'\b(' + '|'.join(g) + r')\b')}, 1)" for g in TECH_TERMS]
    joined = groups[0]
    for g in groups[1:]:
        joined = f"list_concat({joined}, {g})"
    return f"list_transform({joined}, lambda t: regexp_replace(t, '\\s+', '-', 'g'))"


def distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position(({items}), x) = i)"


def words(x: str) -> str:
    stop = ", ".join(map(q, STOP_WORDS))
    split = f"regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9#+.\\-]', ' ', 'g'), ' +')"
    return f"list_transform(list_filter({split}, lambda w: length(w) >= 2 AND w NOT IN ({stop})), lambda w: regexp_replace(w, '^[.\\-]+|[.\\-]+$', '', 'g'))"


def token_cte(source: str, key: str, text: str, name: str = "tok") -> str:
    """CTE ``name`` (key, tokens)."""
    return f"{name}_0 AS (SELECT {key}, list_concat({words(text)}, {tech(text)}) AS l FROM {source}), {name} AS (SELECT {key}, list_filter(l, lambda x, i: length(x) >= 2 AND list_position(l, x) = i) AS tokens FROM {name}_0)"


def phrases(x: str) -> str:
    parts = [f"regexp_extract_all(lower({x}), {q(r'\b' + p + r'\b')})" for p in PHRASES]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def skill_cte(source: str, key: str, text: str, dictionary: list[str] | None = None, name: str = "sk") -> str:
    """CTE ``name`` (key, skills)."""
    tests = ", ".join(f"CASE WHEN regexp_matches(lower({text}), {q(r'\b' + re.sub(r'([.*+?^${}()|\[\]\\])', r'\\\1', s) + r'\b')}) THEN {q(s)} END" for s in (dictionary or SKILLS))
    return f"{name}_0 AS (SELECT {key}, list_concat(list_filter([{tests}], lambda s: s IS NOT NULL), {phrases(text)}) AS l FROM {source}), {name} AS (SELECT {key}, list_filter(l, lambda x, i: list_position(l, x) = i) AS skills FROM {name}_0)"
