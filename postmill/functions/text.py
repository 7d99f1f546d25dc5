"""Text as Columns: tokens, technical terms, skills, clean-up and escapes. Null is an empty text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE, blank_to_null, bounded, trim
from .vocab import PHRASES, SKILLS, STOP_WORDS, TECH_TERMS


def _lowered(text: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the lower-cased text. A lambda variable holds it: expressions with lambdas are interpreted,
    and a plain column would be lower-cased again wherever it stands."""
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), f), 1)


def _holds(lower: Column, parts: list[str]) -> Column:
    """Whether all parts stand somewhere in the text: a plain search, far cheaper than a pattern."""
    return reduce(and_, [F.contains(lower, F.lit(p)) for p in parts])


def literals(pattern: str) -> list[str]:
    """What every match of a term's pattern holds."""
    return [re.sub(r"\\(.)", r"\1", part) for part in pattern.split(r"\s*")]


def quoted(text: str) -> str:
    """A pattern that matches the text as it stands."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


_NONE = "array<string>"


def tech_terms(text: Column) -> Column:
    """All technical terms by group, white space within them as a hyphen; repeated as they occur. A group's
    pattern runs only over texts that hold the letters of one of its terms."""
    return _lowered(text, _tech_terms)


def _any_of(terms: list[str]) -> str:
    """A pattern for one of the terms. The class of their first characters stands before, so that other places
    of a text cost one test."""
    first = "".join(sorted({re.escape(literals(t)[0][0]) for t in terms}))
    return f"(?=[{first}])(?:" + "|".join(map(bounded, terms)) + ")"


def _tech_terms(lower: Column) -> Column:
    none = F.array().cast(_NONE)
    groups = [F.when(reduce(or_, [_holds(lower, literals(t)) for t in g]), F.regexp_extract_all(lower, F.lit(_any_of(g)), F.lit(0))).otherwise(none) for g in TECH_TERMS]
    return F.transform(F.concat(*groups), lambda t: F.regexp_replace(t, f"{SPACE}+", "-"))


def tokens(text: Column) -> Column:
    """Distinct tokens in order of first occurrence, then technical terms. Stop words and short words
    are dropped before hyphens and full stops are stripped, so that ``the.`` leaves ``the``."""

    def of(lower: Column) -> Column:
        # Runs of the characters kept: far cheaper than to split at those that are not.
        words = F.filter(F.regexp_extract_all(lower, F.lit(r"[a-z0-9#+.\-]{2,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
        words = F.transform(words, lambda w: F.btrim(w, F.lit(".-")))
        return F.filter(F.array_distinct(F.concat(words, _tech_terms(lower))), lambda w: F.length(w) >= 2)

    return _lowered(text, of)


def phrase_skills(text: Column) -> Column:
    """Phrases reported as skills, by pattern, each as it stands in the text."""
    return _lowered(text, _phrase_skills)


def _phrase_skills(lower: Column) -> Column:
    none = F.array().cast(_NONE)
    return F.concat(*[F.when(_holds(lower, parts), F.regexp_extract_all(lower, F.lit(bounded(p)), F.lit(0))).otherwise(none) for p, parts in PHRASES.items()])


def skills(text: Column, dictionary: list[str] | None = None) -> Column:
    """Skills of the dictionary found as whole words, in its order, then phrases; distinct. Those of word
    characters alone are looked up among the text's words; for others a plain search goes before the
    pattern."""
    wanted = SKILLS if dictionary is None else dictionary
    plain = {s for s in wanted if re.fullmatch("[0-9a-z_]+", s)}
    every = F.array(*map(F.lit, wanted)).cast(_NONE)

    def of(lower: Column) -> Column:
        marked = [F.when(F.contains(lower, F.lit(s)) & lower.rlike(bounded(quoted(s))), F.lit(s)) for s in wanted if s not in plain]
        words = F.regexp_extract_all(lower, F.lit("[0-9a-z_]+"), F.lit(0)) if plain else F.array().cast(_NONE)
        found = F.concat(words, F.array(*marked)) if marked else words
        return F.array_distinct(F.concat(F.array_intersect(every, found), _phrase_skills(lower)))

    return _lowered(text, of)


def job_text(title: Column, company: Column, description: Column, location: Column) -> Column:
    """The non-empty ones, in this order, joined by a space."""
    return F.concat_ws(" ", *map(blank_to_null, (title, company, description, location)))


def normalize(text: Column) -> Column:
    """Unix line ends, single spaces, at most one empty line in a row, no white space at the ends."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trim(out)


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_xml(xml: Column) -> Column:
    """Text of a word-processing XML. ``&amp;`` is decoded first, so what was escaped twice is decoded
    twice."""
    out = F.regexp_replace(F.replace(xml, F.lit("</w:p>"), F.lit("\n")), r"<w:br[^>]*/>", "\n")
    out = F.regexp_replace(F.replace(out, F.lit("<w:tab/>"), F.lit("\t")), r"<[^>]+>", "")
    return _replaced(out, [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")])


def escape_html(text: Column, quotes: bool = True) -> Column:
    """Escapes & < > and, for attributes, double quotes; null is empty."""
    return _replaced(F.coalesce(text, F.lit("")), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;")] * quotes)


def decode_pdf_string(text: Column) -> Column:
    """Backslash escapes of a PDF string, in the fixed order."""
    return _replaced(text, [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")).cast("long")
