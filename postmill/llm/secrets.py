"""Secret scan: high-recall candidates, and a random forest that removes false positives.

The forest looks at a candidate's length, the transitions between kinds of characters in it, how much
of it a dictionary covers, the path it was found under and the words beside it. It is trained on
labelled findings and becomes a Column expression, so texts are scanned and judged where they are
read: no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .trees import fit_forest, scan, spans_of

_KEYS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|(?:api|access|private|secret|signing)[_-]?key)"
# Possessive and without an upper bound: a whole run in linear time, never a prefix of it.
RULES = {
    "prefixed": r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|[sr]k_live_[A-Za-z0-9]{16,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])",
    # Cheap assertions stand before the one that looks for a name; their order changes no match.
    "assigned": rf"(?<=[\s:=\"'])(?=[^\s\"'<>]{{6}})(?<=[:=]\s{{0,3}}[\"']{{0,1}})(?<=(?i:{_KEYS})[\"']{{0,1}}\s{{0,3}}[:=]{{1,2}}\s{{0,3}}[\"']{{0,1}})[^\s\"'<>]{{6,}}+",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: Words of code and settings, which belong to every dictionary, and the most words that texts add to it.
CODE_WORDS = ("example", "sample", "test", "demo", "dummy", "change", "your", "here", "insert", "placeholder", "password", "secret", "token", "key", "none", "null", "true", "false", "user", "admin", "config", "value", "string", "default", "name", "path", "file", "http", "https", "www", "com", "org", "src", "lib", "main", "index", "data", "the", "and", "ing", "tion", "version", "build", "class", "function", "return", "this", "self", "local", "host", "server", "client", "public", "private", "get", "set", "env", "process", "my")
LEARNED_WORDS = 400
FEATURES = ["length", "transitions", "distinct", "digits", "letters", "upper", "hexadecimal", "dictionary", "run", "placeholder", "prefixed", "assigned", "cue", "cue_other", "quoted", "path_test", "path_doc", "path_config"]
SPAN = "array<struct<rule:string,start:int,end:int,found:string>>"
TRAINING_ROWS = 6000


def candidates(text: Column) -> Column:
    """Array of proposed spans (rule, start, end, found); rules may propose one span twice."""
    parts = []
    for rule, pattern in RULES.items():
        spans = spans_of(text, pattern)
        if rule == "random":
            spans = F.filter(spans, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
        parts.append(_ruled(rule, spans))
    none = F.array().cast(SPAN)
    guards = (r"A[KS]IA|gh[pousr]_|xox|k_live_|AIza|eyJ", rf"(?i){_KEYS}[\"']?\s{{0,3}}[:=]", r"[A-Za-z0-9+/_-]{20}")
    return F.concat(*[F.when(text.rlike(g), p).otherwise(none) for g, p in zip(guards, parts)])


def _ruled(rule: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def learn_dictionary(texts: DataFrame, text: str = "text", most: int = LEARNED_WORDS) -> list[str]:
    """The words of code, and those of four letters or more that stand in most of all texts: ``most`` of them."""
    # Outer: a plain explode would have Spark work the words out once more for a filter.
    words = texts.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    top = words.filter("w is not null").groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "w").limit(most)
    return sorted({*CODE_WORDS, *(r["w"] for r in top.collect())}, key=lambda w: (-len(w), w))


def features(text: Column, path: Column, c: Column, dictionary: list[str] = list(CODE_WORDS)) -> Column:
    found = c["found"]
    size = F.greatest(F.length(found), F.lit(1))
    before = F.lower(text.substr(F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24))))
    near = text.substr(c["start"], F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "-")
    count = lambda chars: F.length(F.regexp_replace(found, f"[^{chars}]", ""))
    values = {
        "length": F.length(found),
        "transitions": F.length(kinds) / size,
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / size,
        "digits": count("0-9") / size,
        "letters": count("A-Za-z") / size,
        "upper": count("A-Z") / size,
        "hexadecimal": found.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "dictionary": (size - F.length(F.regexp_replace(F.lower(found), "|".join(dictionary), ""))) / size,
        "run": found.rlike(r"(.)\1{3}|0123|1234|abcd|(..)\2{2}"),
        "placeholder": found.rlike(r"(?i)example|changeme|your|xxx|\*\*\*|<|\$\{|%\(|insert|dummy"),
        "prefixed": c["rule"] == "prefixed",
        "assigned": c["rule"] == "assigned",
        "cue": before.rlike(rf"{_KEYS}[^a-z]*$"),
        "cue_other": before.rlike(r"\b(?:commit|sha|sha1|sha256|md5|hash|digest|checksum|integrity|uuid|guid|id|rev|revision|etag|build|version|blob|image|order)\b[^a-z]*$"),
        "quoted": near.rlike("[\"'`]"),
        "path_test": path.rlike(r"(?i)test|spec|fixture|mock|example|sample"),
        "path_doc": path.rlike(r"(?i)\.(?:md|rst|txt|html?|lock)$|doc|readme|package-lock"),
        "path_config": path.rlike(r"(?i)\.(?:env|ya?ml|json|ini|cfg|conf|properties|toml|pem|tfvars)$|config|settings"),
    }
    return F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()])


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Made-up labelled findings (path, text, label): random keys of known formats and random assigned
    values, against placeholders, checksums, identifiers, paths and words. ``rows`` bounds the fit."""
    raw = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    mixed = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(raw(k))), "[+/=]", "x"), 1, n)
    pick = lambda k, items: F.element_at(F.array(*map(F.lit, items)), (F.abs(F.xxhash64("id", F.lit(k))) % len(items) + 1).cast("int"))
    name = pick(1, ["password", "passwd", "token", "secret", "api_key", "access_key", "auth", "private_key"])
    join, quote = pick(2, ["=", " = ", ": ", ":"]), pick(3, ['"', "'", "", '"'])
    lead, tail = pick(4, ["the set of ", "und ", "lorem ", "les ", "", "que "]), pick(5, [" and then", "", " the", ".", "; so"])
    hexes = F.expr("substring(sha2(concat('h:', cast(id as string)), 256), 1, cast(16 + abs(xxhash64(id, 6)) % 3 * 12 as int))")
    assigned = lambda value: F.concat(lead, name, join, quote, value, quote, tail)
    positive = [
        F.concat(lead, F.lit("AKIA"), F.upper(F.substring(raw("k"), 1, 16)), tail),
        F.concat(lead, F.lit("ghp_"), mixed("g", 36), tail),
        assigned(hexes),
        assigned(mixed("a", 24)),
        assigned(F.concat(mixed("b", 9), pick(7, ["!", "#", "$", "%"]), mixed("c", 5))),
        F.concat(lead, name, join, quote, mixed("d", 40), quote, tail),
    ]
    digest = pick(8, ["sha256:", "commit ", "md5 ", "checksum: ", "integrity ", "uuid ", "etag ", "revision ", "image "])
    negative = [
        F.concat(lead, digest, raw("n"), tail),
        F.concat(lead, digest, F.substring(raw("m"), 1, 40), tail),
        assigned(pick(9, ["changeme", "your_password_here", "example_token", "xxxxxxxxxxxx", "placeholder", "INSERT_KEY_HERE", "process.env.TOKEN", "${SECRET_VALUE}", "none_of_this", "test1234test"])),
        F.concat(lead, F.lit("src/main/"), pick(10, ["index", "config", "server"]), F.lit("/file"), F.substring(raw("p"), 1, 2), F.lit("_version2_build"), tail),
        F.concat(lead, F.lit("A1KIA"), F.lit("EXAMPLEEXAMPLE2EXAMPLE"), tail),
        F.concat(lead, F.lit("donau-dampf-schiff-2fahrt-gesell-"), F.substring(raw("q"), 1, 2), F.lit("-kapitaen"), tail),
        F.concat(lead, F.lit("order 0000000000000000a"), F.substring(raw("o"), 1, 1), F.lit("00000"), tail),
    ]
    both = positive + negative
    kind = (F.abs(F.xxhash64("id", F.lit(99))) % len(both)).cast("int")
    good = F.when(kind < len(positive), pick(11, ["deploy/.env", "config/app.yml", "src/app.py", "notes", "src7", "infra/prod.tfvars"])).otherwise(pick(12, ["tests/test_app.py", "docs/readme.md", "package-lock.json", "src/app.py", "src3", "examples/demo.js"]))
    return spark.range(0, rows, 1, 4).select("id", good.alias("path"), F.element_at(F.array(*both), kind + 1).alias("text"), (kind < len(positive)).cast("int").alias("label"))


class SecretModel:
    """A forest fitted on ``labelled`` (id, path, text, label: all candidates of a text have its label). A quarter
    of it, by hash of the text, is held out: ``precision`` and ``recall`` are measured there, on candidates."""

    def __init__(self, spark: SparkSession, labelled: DataFrame | None = None, threshold: float = 0.5, dictionary: list[str] | None = None):
        rows = labelled_findings(spark) if labelled is None else labelled
        self.dictionary = dictionary or sorted(CODE_WORDS, key=lambda w: (-len(w), w))
        rows = rows.select("label", F.col("text").alias("t"), F.coalesce("path", F.lit("")).alias("p")).withColumn("c", F.explode(candidates(F.col("t"))))
        held = F.pmod(F.xxhash64("t", F.lit(4)), F.lit(4)) == 0
        rows = written(rows.select("label", held.alias("held"), features(F.col("t"), F.col("p"), F.col("c"), self.dictionary).alias("f")).select("label", "held", "f.*"), "secret-train")
        self.score, self.threshold = fit_forest(rows.filter("not held"), FEATURES), threshold
        found = F.col("p") >= threshold
        n = rows.filter("held").withColumn("p", self.score(F.col)).agg(F.count(F.when(found & (F.col("label") == 1), 1)).alias("hit"), F.count(F.when(found, 1)).alias("found"), F.count(F.when(F.col("label") == 1, 1)).alias("there")).first()
        self.precision, self.recall = n["hit"] / max(1, n["found"]), n["hit"] / max(1, n["there"])

    def judged(self, text: Column, path: Column, found: Column) -> Column:
        """Candidates with their scores: array of (rule, start, end, found, score)."""
        withed = F.transform(found, lambda c: F.struct(c.alias("c"), features(text, path, c, self.dictionary).alias("f")))
        return F.transform(withed, lambda x: F.struct(x["c"]["rule"].alias("rule"), x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), x["c"]["found"].alias("found"), self.score(lambda n: x["f"][n]).alias("score")))


KIND = "struct<start:int,end:int,rule:string,score:double,found:string,beaten:boolean>"
#: Rules that propose whole values: what lies within such a span is a piece of it.
WHOLE = ("prefixed", "assigned")


def _met(found: Column, meeting) -> Column:
    """A pass by rising start over spans (rule, start, end, found, score), of which those of one rule do not
    overlap: it holds the last of each rule, which leaves when the next of its rule comes. ``meeting(held,
    new, first)`` tells of two spans that overlap, ``first`` being whether the held one's rule stands first,
    whether the held one is beaten, whether the new one is, and what each one's score then is at least. Gives
    all spans with ``beaten``."""
    span = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rule"].alias("rule"), c["score"].alias("score"), c["found"].alias("found"), F.lit(False).alias("beaten")))
    rules = list(RULES)
    last = F.array(*[F.from_json(F.lit(f'{{"start": {2**31 - 1}, "end": {2**31 - 1}, "rule": "{rule}"}}'), KIND) for rule in rules])

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        slots, beaten, scores = [], x["beaten"], [x["score"]]
        for i, rule in enumerate(rules):
            s = state[rule]
            meets = F.coalesce((x["rule"] != rule) & (s["end"] > x["start"]), F.lit(False))
            s_loses, x_loses, s_least, x_least = meeting(s, x, x["rule"].isin(rules[i + 1 :]))
            met = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rule"].alias("rule"), F.greatest(s["score"], s_least).alias("score"), s["found"].alias("found"), (s["beaten"] | s_loses).alias("beaten"))
            slots.append(F.when(meets, met).otherwise(s))
            beaten, scores = beaten | (meets & x_loses), [*scores, F.when(meets, x_least)]
        new = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule"].alias("rule"), F.greatest(*scores).alias("score"), x["found"].alias("found"), beaten.alias("beaten"))
        out = F.coalesce(*[F.when(x["rule"] == rule, state[rule]) for rule in rules])
        return F.struct(*[F.when(x["rule"] == rule, new).otherwise(slot).alias(rule) for rule, slot in zip(rules, slots)]), out

    zero = F.struct(*[F.lit(None).cast(KIND).alias(rule) for rule in rules])
    return scan(F.concat(F.sort_array(span), last), zero, step, KIND)


def _kept(spans: Column) -> Column:
    kept = F.filter(spans, lambda c: ~c["beaten"])
    return F.transform(kept, lambda c: F.struct(c["rule"].alias("rule"), c["start"].alias("start"), c["end"].alias("end"), c["found"].alias("found"), c["score"].alias("score")))


def wholes(found: Column) -> Column:
    """The spans without those that lie within one of a ``WHOLE`` rule (of equal ones the first rule's stays),
    which takes the largest score of its pieces. Whether a value is found whole thus doesn't hang on how
    the forest scores its pieces."""

    def meeting(s: Column, x: Column, first: Column) -> tuple[Column, ...]:
        same = (s["start"] == x["start"]) & (s["end"] == x["end"])
        inside = lambda a, b, wins: b["rule"].isin(*WHOLE) & (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (~same | ~a["rule"].isin(*WHOLE) | wins)
        x_in, s_in = inside(x, s, first), inside(s, x, ~first)
        return s_in, x_in, F.when(x_in, x["score"]), F.when(s_in, s["score"])

    return _kept(_met(found, meeting))


def unbeaten(found: Column) -> Column:
    """The spans (rule, start, end, found, score) that no overlapping one beats: by a higher score, or an equal
    one of an earlier rule."""

    def meeting(s: Column, x: Column, first: Column) -> tuple[Column, ...]:
        wins, none = (s["score"] > x["score"]) | ((s["score"] == x["score"]) & first), F.lit(None).cast("double")
        return ~wins, wins, none, none

    return _kept(_met(found, meeting))


def scan_secrets(df: DataFrame, text: str = "text", path: str | None = None, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds ``secrets``: array of (start, end, rule, score, sha256) of the candidates that the forest
    holds for secrets, in code points, end exclusive, by start. A span of a known form or an assigned value stays whole: pieces within it
    only lend it their score. Of others that overlap, the one of the highest score stays (ties: the first
    rule). The secret itself is given by its hash.

    Whole texts are scanned; null is an empty text, which has none; a null path is an empty one. Rows
    are kept as they are; a column named ``secrets`` is replaced. The dictionary is learned from all texts."""
    model = SecretModel(df.sparkSession, labelled, threshold, learn_dictionary(df, text))
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() != "secrets"]
    place = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    rows = df.select(F.struct(*own).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), place.alias("p"))
    rows = rows.select("row", "t", "p", candidates(F.col("t")).alias("c"))
    rows = rows.select("row", F.when(F.size("c") > 0, model.judged(F.col("t"), F.col("p"), F.col("c"))).otherwise(F.array().cast("array<struct<rule:string,start:int,end:int,found:string,score:double>>")).alias("c"))
    rows = rows.select("row", F.when(F.size("c") > 1, wholes(F.col("c"))).otherwise(F.col("c")).alias("c"))
    rows = rows.select("row", F.filter("c", lambda c: c["score"] >= threshold).alias("c"))
    kept = F.when(F.size("c") > 1, unbeaten(F.col("c"))).otherwise(F.col("c"))
    out = F.sort_array(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rule"].alias("rule"), c["score"].alias("score"), F.sha2(c["found"].cast("binary"), 256).alias("sha256"))))
    return rows.select("row.*", out.alias("secrets"))
