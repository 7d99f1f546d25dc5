"""Regular expressions and numbers as the matching semantics define them.

Word boundaries are ASCII: Java's own would count letters such as é. With a known edge the one-sided
form is enough: a word character needs none before it, a symbol needs one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]"
#: White space including no-break and typographic spaces.
SPACE = r"[\s ﻿  -     　]"


def bounded(pattern: str) -> str:
    """A pattern between ASCII word boundaries. Its first and last characters are literal ones or \\d."""
    word = re.compile(r"[0-9A-Za-z_]")
    first = bool(re.match(r"\\d|[0-9A-Za-z_]", pattern))
    last = bool(word.match(pattern[-1])) and not pattern.endswith("\\s")
    return (f"(?<!{WORD})" if first else f"(?<={WORD})") + pattern.replace(r"\s", SPACE) + (f"(?!{WORD})" if last or pattern.endswith(")") else f"(?={WORD})")


def r2(x: Column) -> Column:
    """Rounded to two decimals, halves up; not ``round``, whose halves follow the decimal digits."""
    return F.floor(x * 100 + 0.5) / 100


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
