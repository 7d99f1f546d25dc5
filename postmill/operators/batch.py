"""The steps of a match batch, each a DataFrame -> DataFrame function; nothing here acts or writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, text
from ..functions.dialect import blank_to_null
from ..sources.tables import numbered, written

# Caps of history, re-scored matches and notifications.
HISTORY_CAP, RESCORED, NOTIFIED = 200, 10, 5


def platform_gate(jobs: DataFrame, platforms: dict[str, bool], column: str = "platform") -> DataFrame:
    """Jobs of platforms that are switched on; unknown ones are off."""
    return jobs.filter(F.col(column).isin([p for p, on in platforms.items() if on]))


def content_filter(jobs: DataFrame) -> DataFrame:
    """Jobs with a description of more than 20 characters or a title of more than 2."""
    longer = lambda c, n: F.coalesce(F.length(c), F.lit(0)) > n
    return jobs.filter(longer("description", 20) | longer("title", 2))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by arrival. Aggregates before it moves rows, so a hot key is no burden."""
    own = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*own), F.col(order)).alias("first"))
    return best.select(*keys, "first.*").select(*rows.columns)


def select_new(matches: DataFrame, history: DataFrame, key: str = "url") -> DataFrame:
    """Matches whose URL is not in the history; a missing URL counts as seen if the history holds one
    without. Repeated URLs within the batch stay. Spark broadcasts the capped history by its size."""
    seen = history.select(F.col(key).alias("seen")).distinct()
    return matches.join(seen, matches[key].eqNullSafe(seen["seen"]), "left_anti")


def rank_matches(matches: DataFrame, order: str = "ord", partition: list[str] | None = None) -> DataFrame:
    """Adds ``rank``: position by score, ties in arrival order. Without ``partition`` all rows go through one
    task: for a few rows; ``ranked`` takes any number."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(*(partition or [F.lit(0)])).orderBy(F.desc("score"), F.asc(order))))


def ranked(matches: DataFrame, order: str = "ord") -> DataFrame:
    """Adds ``rank`` like ``rank_matches``, for any number of rows and any order: rows are cut into ranges of score and
    order by what they hold, and each range is numbered in a task of its own. Rows are written first, as the
    ranges come from a sample, for which they would be worked out once more."""
    return numbered(written(matches, "ranked"), [F.desc("score"), F.asc(order)], name="rank")


def blend(matches: DataFrame, replies: DataFrame, weight: float | None = None, order: str = "ord", top: int = RESCORED) -> DataFrame:
    """The best ``top`` matches blended with model scores by position (``replies``: rank, model_score, and what
    else the model says), then all by score again. A missing reply keeps the local score; what the model
    says of a match stays with it."""
    best = matches.orderBy(F.desc("score"), F.asc(order)).limit(top)
    ranked = rank_matches(best, order)  # at most ``top`` rows
    both = ranked.join(F.broadcast(replies.filter(F.col("rank") <= top)), "rank", "left")
    said = [c for c in replies.columns if c not in ("rank", "model_score")]
    mixed = both.select(*[c for c in matches.columns if c != "score"], *said, formats.hybrid_score(F.col("score"), F.col("model_score"), weight).alias("score"), F.when(F.col("model_score").isNotNull(), F.col("score")).alias("local_score"), "model_score")
    rest = matches.join(F.broadcast(best.select(order)), order, "left_anti")
    return mixed.unionByName(rest, allowMissingColumns=True).orderBy(F.desc("score"), F.asc(order))


def cap_history(new: DataFrame, old: DataFrame, order: str = "ord", cap: int = HISTORY_CAP) -> DataFrame:
    """New matches before old ones, each in their order, at most ``cap``; adds ``position`` from 1."""
    both = new.withColumn("generation", F.lit(0)).unionByName(old.withColumn("generation", F.lit(1)), allowMissingColumns=True)
    capped = both.orderBy("generation", order).limit(cap)
    return capped.withColumn("position", F.row_number().over(Window.orderBy("generation", order))).drop("generation")


def notifications(matches: DataFrame, batch: str, order: str = "ord", shown: int = NOTIFIED) -> DataFrame:
    """Rows (batch, n, title, message, priority): the first ``shown`` of each batch, then one for the others
    with the score of the last."""
    w = Window.partitionBy(batch)
    ranked = matches.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), F.asc(order)))).withColumn("total", F.count("*").over(w))
    kept = ranked.filter((F.col("n") <= shown) | (F.col("n") == F.col("total")))
    category = formats.score_category(F.col("score"))
    icon = F.when(category == "excellent", "🟢").when(category == "good", "🟡").otherwise("🔴")
    more = F.concat(F.lit("+"), (F.col("total") - shown).cast("string"), F.lit(" more matches found"))
    company = F.when(blank_to_null(F.col("company")).isNotNull(), F.concat(F.lit(" at "), "company")).otherwise("")
    return kept.select(
        batch,
        F.least(F.col("n"), F.lit(shown + 1)).cast("long").alias("n"),
        F.concat(icon, F.lit(" Job Match: "), formats.number_text(F.col("score")), F.lit("%")).alias("title"),
        F.when(F.col("n") <= shown, F.concat(F.coalesce("title", F.lit("undefined")), company)).otherwise(more).alias("message"),
        F.when(category == "excellent", 2).otherwise(1).cast("long").alias("priority"),
    )


def badge(matches: DataFrame, batch: str) -> DataFrame:
    """Rows (batch, text): the number of new matches, as a badge shows it."""
    return matches.groupBy(batch).agg(F.count("*").cast("string").alias("text"))


def digest_rows(matches: DataFrame) -> DataFrame:
    """What a digest shows of a match."""
    return matches.select("title", "company", "url", "score", "matched_skills", "missing_skills")


def _digest_line() -> Column:
    """A match as a row of a digest's table."""
    score = F.col("score")
    colour = F.when(score >= 80, "#10B981").when(score >= 60, "#F59E0B").otherwise("#EF4444")  # fixed values
    listed = lambda c: F.coalesce(blank_to_null(F.array_join(c, ", ")), F.lit("N/A"))
    cell = lambda c: F.concat(F.lit("<td>"), text.escape_html(c), F.lit("</td>"))
    link = F.concat(F.lit('<td><a href="'), text.escape_html(F.coalesce(blank_to_null(F.col("url")), F.lit("#"))), F.lit('">'), text.escape_html(F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled"))), F.lit("</a> "), text.escape_html(F.col("company")), F.lit("</td>"))
    badge = F.concat(F.lit('<td style="color:'), colour, F.lit('">'), formats.number_text(score), F.lit("%</td>"))
    return F.concat(F.lit("<tr>"), link, badge, cell(listed(F.col("matched_skills"))), cell(listed(F.col("missing_skills"))), F.lit("</tr>"))


def digest(matches: DataFrame, recipient: str, order: str = "ord") -> DataFrame:
    """Rows (recipient, n, top_score, subject, body). A recipient's matches make one message, as a mail
    does; the body lists them best first. ``digest_parts`` takes any number of matches."""
    lines = matches.select(recipient, "score", F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"), _digest_line().alias("row")).alias("line"))
    out = lines.groupBy(recipient).agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["row"]), "").alias("rows"))
    count = formats.plural(F.col("n"), "new match", "new matches")
    return out.select(recipient, "n", "top_score", F.concat(count, F.lit(" (top score: "), formats.number_text(F.col("top_score")), F.lit("%)")).alias("subject"), F.concat(F.lit("<p>"), count, F.lit(" found</p><table>"), "rows", F.lit("</table>")).alias("body"))


def digest_parts(matches: DataFrame, recipient: str, order: str = "ord", size: int = 1 << 20) -> DataFrame:
    """Rows (recipient, part, n, body): the table rows of ``digest`` in parts of about ``size`` bytes; a recipient's
    parts from 0 on, joined, are all its rows, best first. A part holds the lines that begin within its stretch
    of bytes, so it is longer by less than a line; a longer line leaves parts out.

    Lines are sorted over all recipients by ranges, so one recipient's lines lie in as many tasks as they need; a
    line begins at the bytes of the ranges before it and of the lines before it in its own."""
    lines = matches.select(recipient, (-F.col("score")).alias("_s"), F.col(order).alias("_o"), _digest_line().alias("_row"))
    by = [F.col(recipient).asc(), F.col("_s").asc(), F.col("_o").asc()]
    lines = lines.repartitionByRange(*by).select("*", F.octet_length("_row").cast("long").alias("_size"), F.spark_partition_id().alias("_range"))
    lines = written(lines, "digest-lines")
    before = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = lines.groupBy(F.col(recipient).alias("_r"), F.col("_range").alias("_k")).agg(F.sum("_size").alias("_size"))
    sums = sums.select("_r", "_k", before(Window.partitionBy("_r").orderBy("_k")).alias("_ahead"))  # a row a range
    within = lines.withColumn("_within", before(Window.partitionBy(recipient, "_range").orderBy("_s", "_o", "_row")))
    placed = within.join(sums, F.col(recipient).eqNullSafe(F.col("_r")) & (F.col("_range") == F.col("_k")))
    part = F.floor((F.col("_ahead") + F.col("_within")) / size).cast("long")
    met = placed.groupBy(recipient, part.alias("part")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_s", "_o", "_row"))).alias("_lines"))
    return met.select(recipient, "part", "n", F.array_join(F.transform("_lines", lambda x: x["_row"]), "").alias("body"))


def latest_status(updates: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The last status written for each key."""
    return updates.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def bump_profiles(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """Profiles (id, last_run, result_count) after runs (id, last_run, jobs_found); ids without a profile
    are ignored."""
    done = runs.groupBy("id").agg(F.max("last_run").alias("ran"), F.sum("jobs_found").alias("found"))
    return profiles.join(done, "id", "left").withColumns({"last_run": F.coalesce("ran", "last_run"), "result_count": F.coalesce("result_count", F.lit(0)) + F.coalesce("found", F.lit(0))}).drop("ran", "found")


def detail_and_cards(detail: DataFrame, cards: DataFrame, order: str = "ord") -> DataFrame:
    """A page's detail before its cards; adds ``place``."""
    both = detail.withColumn("part", F.lit(0)).unionByName(cards.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("place", F.struct("part", order)).drop("part")


def card_view(matches: DataFrame, now: Column, *keep: str) -> DataFrame:
    """What a result card shows, beside the columns of ``keep``; missing fields have stand-ins, lists are cut."""
    return matches.select(
        *keep,
        F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled")).alias("title"),
        F.coalesce(blank_to_null(F.col("company")), F.lit("Unknown Company")).alias("company"),
        F.concat(F.coalesce(blank_to_null(F.col("platform")), F.lit("unknown")), F.when(F.col("model_score").isNotNull(), " + LLM").otherwise("")).alias("platform"),
        formats.score_category(F.col("score")).alias("category"),
        F.slice("matched_skills", 1, 5).alias("matched"),
        F.slice("missing_skills", 1, 3).alias("missing"),
        formats.time_ago(F.col("matched_at"), now).alias("age"),
    )


def card_insight(matches: DataFrame) -> DataFrame:
    """What a result card shows of the model's opinion (columns model_score, local_score, rationale,
    key_strengths, gaps): both scores, the rationale, three strengths and three gaps; blank without one."""
    has, number = F.col("model_score").isNotNull(), formats.number_text
    scores = F.concat(F.lit("Local "), number(F.col("local_score")), F.lit("% + LLM "), number(F.col("model_score")), F.lit("%"))
    some = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 3)
    return matches.withColumns({"breakdown": F.when(has, scores).otherwise(""), "rationale": F.coalesce("rationale", F.lit("")), "strengths": some("key_strengths"), "gaps": some("gaps")}).drop("key_strengths")
