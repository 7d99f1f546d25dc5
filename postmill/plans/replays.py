"""Registered queries that drive streams over recorded tables, with the batch queries that they must equal.

Events stand in for messages, requests and page changes, with hours instead of seconds between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matcher as M
from ..sources.tables import work_folder
from ..streaming import digest as D
from ..streaming import match_stream as L
from ..streaming import pages as P
from ..streaming import scans as S
from ..streaming.replay import replay, replayed
from .catalog import CATALOG, DICTIONARY, PROFILE, SCORED, jobs, query, read

DAY = 86_400_000
#: Batches of twelve days.
SPELL = f"floor(`at` / {12 * DAY})"


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events)"


@query(CATALOG["rate_limit"][1])
def rate_limit_stream(spark, sf_dir):
    """``rate_limit`` as a stream with state, restarted after every batch."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("recipient"), "at", (F.col("event_id") % 5 != 0).alias("delivered"))
    kind = rows.schema["recipient"].dataType.simpleString()
    out = replayed(rows, F.expr(SPELL), lambda s: D.rate_limit_stream(s, 24 * 60, schema=f"recipient {kind}, at long, result string, retry_after long"))
    return out.withColumnRenamed("recipient", "user_id")


@query(CATALOG["digest_cooldown"][1])
def digest_cooldown_stream(spark, sf_dir):
    """``digest_cooldown`` as a stream, restarted after every batch."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("recipient"), "at", F.col("event_id").alias("item"))
    kind = rows.schema["recipient"].dataType.simpleString()
    out = replayed(rows, F.expr(SPELL), lambda s: D.cooldown_stream(s, 24 * 60, f"recipient {kind}, sent_at long, n long, items array<long>"))
    return out.select(F.col("recipient").alias("user_id"), "sent_at", "n")


MESSAGES = f"{EVENTS}, msg AS (SELECT max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS scan, user_id AS profile, ms, event_id AS ord, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'jobs' ELSE 'progress' END AS kind, event_id % 6 AS pass, event_id % 20 AS jobs FROM ev)"
STATUSES = f"WITH {MESSAGES}, st AS (SELECT scan, profile, ms AS began, ord AS o FROM msg WHERE kind = 'start'), an AS (SELECT scan, min({{'ms': msg.ms, 'ord': ord, 'jobs': jobs}}) AS a FROM msg JOIN st USING (scan) WHERE kind = 'jobs' AND msg.ms < began + {DAY} GROUP BY scan), sc AS (SELECT st.*, a, CASE WHEN a IS NOT NULL THEN a.ms WHEN began + {DAY} <= (SELECT max(ms) - 1000 FROM ev) THEN began + {DAY} END AS ended FROM st LEFT JOIN an USING (scan)) SELECT scan, profile, began AS \"at\", 'scanning' AS state, 'loading' AS step, 10::BIGINT AS progress, NULL::BIGINT AS jobs_found, NULL::BIGINT AS elapsed FROM sc UNION ALL SELECT scan, profile, ended, 'idle', NULL, 100, coalesce(a.jobs, 0), floor((ended - began) / 1000.0::DOUBLE + 0.5)::BIGINT FROM sc WHERE ended IS NOT NULL UNION ALL SELECT scan, sc.profile, msg.ms, 'scanning', 'extracting', least(85, 10 + floor(pass / 5.0::DOUBLE * 75 + 0.5))::BIGINT, NULL, NULL FROM msg JOIN sc USING (scan) WHERE kind = 'progress' AND msg.ms < began + {DAY} AND (a IS NULL OR ord < a.ord)"


def _messages(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "jobs").otherwise("progress")
    scan = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = _events(spark, sf_dir).select(scan.alias("scan"), F.col("user_id").cast("long").alias("profile"), "at", F.col("event_id").alias("ord"), kind.alias("kind"), F.lit("extracting").alias("step"), (F.col("event_id") % 6).alias("nth"), F.lit(5).cast("long").alias("max_passes"), (F.col("event_id") % 20).alias("jobs"))
    return rows.filter("scan is not null")


@query(STATUSES)
def scan_lifecycle(spark, sf_dir):
    until = _events(spark, sf_dir).agg(F.max("at").alias("m")).first()["m"]
    return S.scan_statuses(_messages(spark, sf_dir), (until or 0) - 1000, DAY)


@query(STATUSES)
def scan_lifecycle_stream(spark, sf_dir):
    """``scan_lifecycle`` as a stream whose timeouts are timers, restarted after every batch."""
    return replayed(_messages(spark, sf_dir), F.expr(SPELL), lambda s: S.scan_stream(s, DAY))


SPACE = "CASE event_type WHEN 'click' THEN 'url' WHEN 'signup' THEN 'url' WHEN 'view' THEN 'detail' ELSE 'enriched' END"
SEEN = f"WITH {EVENTS}, k AS (SELECT event_id, user_id, {SPACE} AS space, ms FROM ev)"


def _sightings(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(F.expr(SPACE).alias("space"), "user_id", "at", F.col("event_id").alias("ord"))


@query(f"{SEEN} SELECT space, user_id, min(ms)::BIGINT AS \"at\", min(event_id)::BIGINT AS ord FROM k GROUP BY ALL")
def first_seen_stream(spark, sf_dir):
    """Three key spaces, each key once, as a stream restarted after every batch."""
    return replayed(_sightings(spark, sf_dir), F.expr(SPELL), lambda s: P.first_seen_stream(s, ["space", "user_id"]))


WITHIN = f"{SEEN} SELECT space, user_id, ms AS \"at\", event_id AS ord FROM (SELECT *, lag(ms) OVER (PARTITION BY space, user_id ORDER BY ms, event_id) AS before FROM k) WHERE before IS NULL OR ms - before > {2 * DAY}"


@query(WITHIN)
def first_seen_within(spark, sf_dir):
    return P.first_seen_within(_sightings(spark, sf_dir), ["space", "user_id"], horizon_ms=2 * DAY)


@query(WITHIN)
def first_seen_within_stream(spark, sf_dir):
    """Keys unseen for two days are forgotten by a timer."""
    return replayed(_sightings(spark, sf_dir), F.expr(SPELL), lambda s: P.first_seen_stream(s, ["space", "user_id"], horizon_ms=2 * DAY))


BURSTS = f"WITH {EVENTS}, b AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= {DAY // 2} THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS island FROM b), r AS (SELECT user_id, island, max(ms) + {DAY // 2} AS read_at, count(*)::BIGINT AS n, max(event_id) AS ord FROM i GROUP BY ALL)"


def _changes(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "at", F.col("event_id").alias("ord"), F.concat(F.lit("Job "), (F.col("event_id") % 4).cast("string")).alias("title"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string"))).otherwise("").alias("url"), F.when(F.col("event_id") % 7 != 0, F.lit("text")).otherwise("").alias("description"))


@query(f"{BURSTS}, d AS (SELECT user_id, CASE WHEN ord % 3 = 0 THEN 'u' || ord % 5 ELSE 'Job ' || ord % 4 END AS key, min({{'read_at': read_at, 'ord': ord, 'n': n}}) AS x FROM r WHERE ord % 7 <> 0 GROUP BY ALL) SELECT user_id, key, x.read_at::BIGINT AS read_at, x.ord AS ord, x.n AS n FROM d")
def detail_bursts(spark, sf_dir):
    """One detail for each burst of changes, each key of a page once."""
    return P.enriched(_changes(spark, sf_dir), ["user_id"], gap_ms=DAY // 2).select("user_id", "key", "read_at", "ord", "n")


@query(f"{BURSTS} SELECT user_id, ord, read_at::BIGINT AS read_at, n FROM r WHERE read_at <= (SELECT max(ms) - 1000 FROM ev)")
def settled_stream(spark, sf_dir):
    """Bursts as a stream: given out when the watermark has passed them."""
    rows = _changes(spark, sf_dir)
    settle = lambda s: P.settled(s.withColumn("time", F.timestamp_millis("at")).withWatermark("time", "1 second"), ["user_id"], "time", gap_ms=DAY // 2)
    return replayed(rows, F.expr(SPELL), settle).select("user_id", "ord", "read_at", "n")


#: Postings whose addresses come again, in five batches, against a history of 20.
CAP, URLS, BATCHES = 20, 61, 5


def _replayed_matches(spark, sf_dir, mode: str) -> DataFrame:
    rows = jobs(spark, sf_dir).withColumn("url", F.when(F.col("ord") % URLS != 0, F.concat(F.lit("u"), (F.col("ord") % URLS).cast("string"))))
    folder = work_folder(spark, "matches")
    settings = L.Settings(cap=CAP, platforms={"src1": True, "src2": True, "src3": True, "src4": False})
    loop = L.MatchLoop(spark, M.Profile.of(spark, PROFILE, DICTIONARY), f"{folder}/history", settings, mode=mode, dictionary=DICTIONARY)
    replay(rows, F.col("ord") % BATCHES, lambda s: loop.start(s, f"{folder}/checkpoint"), folder)
    return loop.matches().select("batch_id", "ord", "score", F.coalesce("url", F.lit("-")).alias("url"))


def _matches_sql(mode: str) -> str:
    gate = "AND source IN ('src1', 'src2', 'src3') AND score >= 50" if mode == "interactive" else "AND score >= 0"
    ready = f"j AS (SELECT s.doc_id AS ord, s.doc_id % {BATCHES} AS b, CASE WHEN s.doc_id % {URLS} <> 0 THEN 'u' || s.doc_id % {URLS} ELSE '-' END AS url, score FROM scored s JOIN documents d USING (doc_id) WHERE length(coalesce(d.text, '')) > 20 {gate})"
    lists = f"l AS (SELECT b, list({{'s': -score, 'ord': ord, 'url': url}} ORDER BY score DESC, ord) AS found FROM j GROUP BY b)"
    fresh = "list_filter(coalesce(l.found, []), lambda x: NOT list_contains(h.urls, x.url))"
    run = f"h AS (SELECT -1::BIGINT AS b, []::VARCHAR[] AS urls, []::STRUCT(s DOUBLE, ord BIGINT, url VARCHAR)[] AS new UNION ALL SELECT b, list_concat(list_transform(new, lambda x: x.url), urls)[1:{CAP}], new FROM (SELECT h.b + 1 AS b, h.urls, {fresh} AS new FROM h LEFT JOIN l ON l.b = h.b + 1 WHERE h.b < {BATCHES - 1}))"
    return f"WITH RECURSIVE {SCORED}, {ready}, {lists}, {run} SELECT b AS batch_id, x.ord AS ord, -x.s AS score, x.url AS url FROM (SELECT b, unnest(new) AS x FROM h)"


@query(_matches_sql("interactive"))
def match_replay(spark, sf_dir):
    """The match loop over five batches: what is in the capped history doesn't match, what fell out does again."""
    return _replayed_matches(spark, sf_dir, "interactive")


@query(_matches_sql("scan"))
def scan_replay(spark, sf_dir):
    """The loop's scan mode: no platform gate, and every score counts."""
    return _replayed_matches(spark, sf_dir, "scan")
