"""Personal data: exact base formats, and candidate gradient boosting for the rest.

High-recall generators propose spans, which may overlap. Boosted trees score each by its format
and the characters before and after it; a threshold per kind, calibrated on labelled candidates
held out of the fit, selects what is redacted. Trees become Column expressions over the array of
candidates, so a text is scanned and scored where it is read: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .trees import fit_boosted, scan, spans_of

# Each pattern starts where its leftmost match must start and never gives back what it took, so
# that runs of any length cost linear time; matches are those of the plain pattern beside it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+"  # [0-9]([ -]?[0-9])+ of 13 digits or more
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "id")
#: Generators of further candidates by the kind they propose.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]++){1,4}+",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{2,4}\)?[ ./-]?)(?:[0-9]{2,4}[ .-]){1,3}[0-9]{3,4}(?![0-9A-Za-z-])",
    "id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z-])",
}
FEATURES = ["length", "digits", "letters", "separators", "groups", "parens", "dashes", "dots", "at_word", "cue_phone", "cue_mail", "cue_id", "cue_other", "after_letter", "before_digit", "uniform"]
SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"
TRAINING_ROWS = 6000


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn checksum of 0 modulo 10."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + weight(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of base spans (kind, start, end, found), by kind as listed, then start. A match that
    fails its test is dropped and not retried."""

    def of(kind: str, pattern: str, test=None) -> Column:
        spans = spans_of(text, pattern)
        spans = F.filter(spans, test) if test else spans
        return _named(kind, spans)

    digits = lambda s: F.regexp_replace(s["found"], "[^0-9]", "")
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    card = lambda s: F.when(F.length(digits(s)).between(13, 19), luhn(digits(s))).otherwise(False)
    none = F.array().cast(SPAN)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), of("email", EMAIL)).otherwise(none),
        of("ip", IP, lambda s: s["found"].rlike(rf"^{byte}(?:\.{byte}){{3}}$")),
        of("card", CARD, card),
        F.when(F.contains(text, F.lit("+")), of("phone", PHONE, lambda s: F.length(digits(s)).between(9, 15))).otherwise(none),
    )


def candidates(text: Column) -> Column:
    """Array of proposed spans (kind, start, end, found) of all generators; they may overlap."""
    parts = []
    for kind, pattern in GENERATORS.items():
        found = _named(kind, spans_of(text, pattern))
        parts.append(F.when(text.rlike(r"@|[\[({]at[\])}]"), found).otherwise(F.array().cast(SPAN)) if kind == "email" else found)
    return F.concat(*parts)


def features(text: Column, c: Column) -> Column:
    """Format of a candidate, and the 32 characters before and 2 after it."""
    found, at = c["found"], c["start"]
    before = F.lower(text.substr(F.greatest(at - 31, F.lit(1)), F.least(at, F.lit(32))))
    after = text.substr(c["end"] + 1, F.lit(2))
    has = lambda words: before.rlike(words).cast("double")
    values = {
        "length": F.length(found),
        "digits": _count(found, "0-9"),
        "letters": _count(found, "A-Za-z"),
        "separators": _count(found, " ./-"),
        "groups": F.size(F.split(found, r"[^0-9A-Za-z]+")),
        "parens": _count(found, "()"),
        "dashes": _count(found, "-"),
        "dots": _count(found, "."),
        "at_word": found.rlike(r"[\[({]at[\])}]|@"),
        "cue_phone": has(r"\b(?:tel|phone|call|fax|mobile|cell|telefon|whatsapp|reach|ring)\b"),
        "cue_mail": has(r"\b(?:mail|e-mail|email|contact|write|address)\b"),
        "cue_id": has(r"\b(?:ssn|social|iban|account|passport|insurance|tax id|id no)\b"),
        "cue_other": has(r"\b(?:order|invoice|isbn|version|part|page|pages|ref|ticket|serial|model|date|item|tracking|pi)\b"),
        "after_letter": after.rlike(r"^[ .,;:]?[A-Za-z%$€°]"),
        "before_digit": before.rlike(r"[0-9][ ,./-]?$"),
        "uniform": F.length(F.regexp_replace(found, r"[^0-9A-Za-z]|(.)(?=.*\1)", "")),
    }
    return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])


def labelled_candidates(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Made-up labelled spans (text, label): personal numbers and addresses in their formats against
    order numbers, dates, versions, ISBNs and measures in the same formats. ``rows`` bounds the fit."""
    n = lambda k, digits: F.lpad((F.abs(F.xxhash64("id", F.lit(k))) % 10**digits).cast("string"), digits, "0")
    pick = lambda k, items: F.element_at(F.array(*map(F.lit, items)), (F.abs(F.xxhash64("id", F.lit(k))) % len(items) + 1).cast("int"))
    word = pick(1, ["lorem", "the", "und", "amet", "les", "que", "thing", "shere"])
    tail = pick(2, [" and so on", ".", ", please", " or later", "; then", ""])
    cue_p = pick(3, ["call ", "tel: ", "phone ", "reach me on ", "fax ", "mobile ", "", ""])
    cue_i = pick(4, ["SSN ", "social security ", "IBAN ", "account ", "tax id ", "", ""])
    cue_m = pick(5, ["mail ", "contact ", "write to ", "e-mail: ", "", ""])
    cue_o = pick(6, ["order ", "invoice ", "ISBN ", "version ", "part ", "pages ", "ref ", "ticket ", "serial ", "date ", "item ", "", ""])
    unit_ = pick(7, ["", " km", "%", " units", "", " EUR"])
    name = F.concat(pick(8, ["ann", "joe.b", "m_lee", "k.ito", "sam"]), n(8, 2))
    at, dot = pick(9, [" [at] ", " (at) ", "[at]", "{at}", " @ "]), pick(9, [" [dot] ", " (dot) ", ".", "{dot}", " . "])
    positive = [
        F.concat(cue_p, F.lit("("), n(10, 3), F.lit(") "), n(11, 3), F.lit("-"), n(12, 4)),
        F.concat(cue_p, n(10, 3), F.lit("-"), n(11, 3), F.lit("-"), n(12, 4)),
        F.concat(cue_p, n(10, 3), F.lit(" "), n(11, 3), F.lit(" "), n(12, 4)),
        F.concat(cue_i, n(10, 3), F.lit("-"), n(11, 2), F.lit("-"), n(12, 4)),
        F.concat(cue_i, pick(13, ["DE", "GB", "FR", "ES"]), n(14, 2), F.lit(" "), n(15, 4), F.lit(" "), n(16, 4), F.lit(" "), n(17, 4), F.lit(" "), n(18, 4)),
        F.concat(cue_m, name, at, F.lit("example"), dot, F.lit("org")),
    ]
    negative = [
        F.concat(cue_o, F.lit("20"), n(20, 2), F.lit("-"), n(21, 2), F.lit("-"), n(22, 4), unit_),
        F.concat(cue_o, n(20, 3), F.lit("."), n(21, 3), F.lit("."), n(22, 3), unit_),
        F.concat(cue_o, n(20, 2), F.lit(" "), n(21, 4), F.lit(" "), n(22, 4), unit_),
        F.concat(cue_o, F.lit("978-"), n(20, 1), F.lit("-"), n(21, 4), F.lit("-"), n(22, 4), F.lit("-"), n(23, 1)),
        F.concat(cue_o, n(20, 3), F.lit("-"), n(21, 3), F.lit("-"), n(22, 4), unit_),
        F.concat(cue_o, pick(24, ["AB", "PX", "ZZ", "QT"]), n(20, 2), n(21, 4), n(22, 4), F.lit("XK"), n(23, 2)),
        F.concat(F.lit("see fig"), n(20, 1), F.lit(" (at) page"), n(21, 2), F.lit(". Next")),
    ]
    both = positive + negative
    kind = (F.abs(F.xxhash64("id", F.lit(99))) % len(both)).cast("int")
    body = F.element_at(F.array(*both), kind + 1)
    return spark.range(0, rows, 1, 4).select("id", F.concat(word, F.lit(" "), body, tail).alias("text"), (kind < len(positive)).cast("int").alias("label"))


class PiiModel:
    """Boosted trees and calibrated thresholds. ``labelled``: id, text, label (all candidates of a
    text have its label). A quarter of it, by hash of the id, calibrates: per kind the lowest
    threshold of a grid whose selections are right ``precision`` of the time; none: nothing of that
    kind is selected."""

    def __init__(self, spark: SparkSession, labelled: DataFrame | None = None, precision: float = 0.97):
        rows = labelled_candidates(spark) if labelled is None else labelled
        rows = rows.select("id", "label", F.col("text").alias("t")).withColumn("c", F.explode(candidates(F.col("t"))))
        rows = rows.select("label", F.col("c.kind").alias("kind"), (F.abs(F.xxhash64("id")) % 4 == 0).alias("held"), features(F.col("t"), F.col("c")).alias("f")).select("label", "kind", "held", "f.*")
        rows = written(rows, "pii-train")
        self.score = fit_boosted(rows.filter("not held"), FEATURES)
        grid = [x / 20 for x in range(10, 20)]
        scored = rows.filter("held").withColumn("p", self.score(F.col))
        right = scored.groupBy("kind").agg(*[F.avg(F.when(F.col("p") >= g, F.col("label").cast("double"))).alias(f"g{i}") for i, g in enumerate(grid)])
        self.thresholds = {r["kind"]: next((g for i, g in enumerate(grid) if (r[f"g{i}"] or 0) >= precision), 2.0) for r in right.collect()}

    def select(self, text: Column, found: Column) -> Column:
        """The candidates that pass, of those that overlap the first by start, then the longest."""
        scored = F.filter(found, lambda c: self._passes(text, c))
        ordered = F.sort_array(F.transform(scored, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("minus_end"), c["kind"].alias("kind"))))

        def step(upto: Column, c: Column) -> tuple[Column, Column]:
            fits = c["start"] >= upto
            return F.when(fits, -c["minus_end"]).otherwise(upto), F.when(fits, F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["minus_end"]).alias("end")))

        return scan(ordered, F.lit(0), step, "struct<kind:string,start:int,end:int>")

    def _passes(self, text: Column, c: Column) -> Column:
        f = features(text, c)
        # One lambda binds the feature struct once for all trees.
        return F.exists(F.array(F.struct(f.alias("f"), c["kind"].alias("kind"))), lambda x: self.score(lambda name: x["f"][name]) >= F.coalesce(*[F.when(x["kind"] == k, F.lit(t)) for k, t in self.thresholds.items()], F.lit(2.0)))


def outside(spans: Column, others: Column) -> Column:
    """The spans (kind, start, end, found) that overlap none of ``others``: a pass by rising start, which sees
    those that begin before a span, and one by falling start, which sees those that begin within it."""
    mark = lambda items, own: F.transform(items, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))

    def rising(far: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["own"], far).otherwise(F.greatest(far, s["end"])), F.when(~s["own"] | (far <= s["start"]), s)

    def falling(near: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["own"], near).otherwise(s["start"]), F.when(s["own"] & (near >= s["end"]), F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    first = scan(F.sort_array(F.concat(mark(spans, True), mark(others, False))), F.lit(0), rising, "struct<start:int,own:boolean,end:int,kind:string,found:string>")
    return scan(F.reverse(first), F.lit(2**31 - 1), falling, "struct<kind:string,start:int,end:int,found:string>")


def find_pii(df: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive, by
    kind (email, ip, card, phone, id), then start. ``spans`` are the base spans and those the model
    selects outside them.

    Whole texts are scanned; null is an empty text, which has no spans. Rows are kept as they are,
    repeated ones too; columns named ``base`` or ``spans`` are replaced."""
    model = PiiModel(df.sparkSession, labelled)
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base", "spans")]
    rows = df.select(F.struct(*own).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    rows = rows.select("row", "t", base_spans(F.col("t")).alias("b"), candidates(F.col("t")).alias("c"))
    rows = rows.select("row", "t", "b", F.when((F.size("c") > 0) & (F.size("b") > 0), outside(F.col("c"), F.col("b"))).otherwise(F.col("c")).alias("c"))
    rows = rows.select("row", F.transform("b", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"), F.when(F.size("c") > 0, model.select(F.col("t"), F.col("c"))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("more"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    every = F.concat("base", "more")
    ordered = F.transform(F.sort_array(F.transform(every, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("row.*", "base", ordered.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping ones as one."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    last = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("kind"))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        label = F.when(s["kind"].isNull(), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        piece = F.concat(text.substr(at + 1, F.greatest(s["start"] - at, F.lit(0))), label)
        return F.greatest(at, s["end"]), F.when((s["start"] >= at) | s["kind"].isNull(), piece)

    return F.array_join(scan(F.concat(ordered, F.array(last)), F.lit(0), step, "string"), "")
