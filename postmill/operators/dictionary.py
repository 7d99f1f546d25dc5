"""Skills of a dictionary that is a table, of any size.

A term matches as a whole word: at an edge with a word character none may stand beside it, at an edge with a symbol
one must. So every run of word characters in a match is a whole word of the text, and every run of symbols
between two words the whole of what stands there. A text is therefore a row of words and gaps, and a term of n
words matches if n words in a row, the gaps between them, and at a symbol edge the gap beside them, are the term. That
is an equality, so terms and texts meet by a join; the plan grows with the shapes of terms (words, symbols in front,
symbols behind), not with their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import small, written

WORD = "[0-9a-z_]+"


def shapes(dictionary: DataFrame) -> DataFrame:
    """Adds ``words``, ``lead`` and ``trail`` (whether the term begins and ends with symbols) to terms."""
    whole = F.col("term")
    words = F.regexp_count(whole, F.lit(WORD))
    edge = lambda pattern: (words > 0) & ~whole.rlike(pattern)
    return dictionary.select("*", words.alias("words"), edge("^[0-9a-z_]").alias("lead"), edge("[0-9a-z_]$").alias("trail"))


def grams(lower: Column, shape: tuple[int, bool, bool]) -> Column:
    """All stretches of a lower-cased text that a term of the shape could be, as they stand."""
    n, lead, trail = shape

    def of(cut: Column) -> Column:
        words, gaps = cut["words"], cut["gaps"]
        if n == 0:  # what stands between two words
            return F.when(F.size(words) > 1, F.slice(gaps, F.lit(2), F.size(words) - 1)).otherwise(F.array().cast("array<string>"))
        first, last = F.lit(2 if lead else 1), F.size(words) - n + (0 if trail else 1)

        def at(i: Column) -> Column:
            parts = [F.get(gaps, i - 1)] if lead else []
            for k in range(n):
                parts += [F.get(words, i - 1 + k), F.get(gaps, i + k)]
            return F.concat(*(parts if trail else parts[:-1]))

        return F.when(last >= first, F.transform(F.sequence(first, F.greatest(last, first)), at)).otherwise(F.array().cast("array<string>"))

    cut = F.struct(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"), F.split(lower, WORD, -1).alias("gaps"))
    return F.array_distinct(F.element_at(F.transform(F.array(cut), of), 1))


def skills_by_table(texts: DataFrame, dictionary: DataFrame, key: str, text: str = "text", phrases: bool = True) -> DataFrame:
    """Rows (key, skills): the terms of ``dictionary`` (pos, term: lower-case) that each text holds, by pos, then
    phrases, as ``text.skills`` gives them. Keys are unique. Null is an empty text. A text's distinct stretches meet the terms by
    an equi-join, broadcast or shuffled by the dictionary's size; it is written, so that this is known before any
    stretch moves. Only hits, and a row for each text, go on from there."""
    known = written(shapes(dictionary.select("pos", "term").filter("term <> ''")), "dictionary")
    # As many rows as there are shapes, of which each adds an expression to the plan.
    used = sorted(tuple(r) for r in known.select("words", "lead", "trail").distinct().collect())
    low = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(F.struct(low.alias("low")))).alias("x")).select("key", "x.low")
    own = T.phrase_skills(F.col("low")) if phrases else F.array().cast("array<string>")
    none = F.lit(None).cast("array<string>")
    # The shape's number tells apart equal stretches that stand in different places; -1 is the text itself.
    one = lambda i, term, own: F.struct(F.lit(i).alias("shape"), term.alias("term"), own.alias("own"))
    of_shape = lambda i, s: F.transform(grams(F.col("low"), s), lambda g: one(i, g, none))
    found = F.concat(F.array(one(-1, F.lit(None).cast("string"), own)), *[of_shape(i, s) for i, s in enumerate(used)])
    rows = rows.select("key", F.explode(found).alias("g")).select("key", "g.*")
    number = F.lit(None).cast("int")
    for i, (n, lead, trail) in enumerate(used):
        number = F.when((F.col("words") == n) & (F.col("lead") == lead) & (F.col("trail") == trail), F.lit(i)).otherwise(number)
    terms = small(known).select("pos", number.alias("shape"), "term")
    met = rows.join(terms, ["shape", "term"], "left").filter("shape = -1 or pos is not null")
    hit = F.when(F.col("pos").isNotNull(), F.struct("pos", "term"))
    out = met.groupBy("key").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list(hit)).alias("hits"))
    return out.select(F.col("key").alias(key), F.array_distinct(F.concat(F.transform("hits", lambda h: h["term"]), "own")).alias("skills"))
