"""Streams with state against the batch operators over the same rows, restarted after every batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.operators import batch
from postmill.streaming import digest, pages, scans
from postmill.streaming.replay import replay, replayed, state_on_disk

MESSAGES = "scan long, profile long, at long, ord long, kind string, step string, nth long, max_passes long, jobs long"
S = 1000
#: A stream takes times up to 1970 for late ones.
BASE = 1_000 * S


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(df):
    return Counter(map(str, df.select(*sorted(df.columns)).collect()))


def test_scans(spark, one_partition):
    """Answers in time, at the very end of it, too late and twice; progress before, during and after; no start; a
    scan that is open when the messages end."""
    m = [
        (1, 7, 0, 1, "start", None, None, None, None), (1, 7, 5 * S, 2, "progress", "extracting", 1, 5, None), (1, 7, 9 * S, 3, "jobs", None, None, None, 4), (1, 7, 10 * S, 4, "progress", "late", 2, 5, None), (1, 7, 11 * S, 5, "jobs", None, None, None, 9),
        (2, 7, 2 * S, 6, "start", None, None, None, None), (2, 7, 22 * S, 7, "jobs", None, None, None, 5),
        (3, None, 3 * S, 8, "progress", "early", 1, 5, None), (3, None, 4 * S, 9, "start", None, None, None, None), (3, None, 23_999, 10, "progress", "extracting", 5, 5, None), (3, None, 30 * S, 11, "jobs", None, None, None, 6),
        (4, 8, 5 * S, 12, "jobs", None, None, None, 1),
        (5, 8, 40 * S, 13, "start", None, None, None, None), (5, 8, 45 * S, 14, "progress", "scrolling", 2, 5, None),
        (6, 9, 21 * S, 15, "start", None, None, None, None), (6, 9, 21 * S, 16, "jobs", None, None, None, None),
    ]
    df = spark.createDataFrame(m, MESSAGES).withColumn("at", F.col("at") + BASE)
    want = scans.scan_statuses(df, BASE + 44 * S)
    ends = {(r["scan"], r["at"] - BASE, r["jobs_found"], r["elapsed"]) for r in want.filter("state = 'idle'").collect()}
    assert ends == {(1, 9 * S, 4, 9), (2, 22 * S, 0, 20), (3, 24 * S, 0, 20), (6, 21 * S, 0, 0)}
    assert {(r["scan"], r["at"] - BASE, r["progress"]) for r in want.filter("state = 'scanning' and step <> 'loading'").collect()} == {(1, 5 * S, 25), (3, 23_999, 85), (5, 45 * S, 40)}
    got, want = rows_of(replayed(df, F.floor(F.col("at") / (25 * S)), scans.scan_stream)), rows_of(want)
    assert (list(got - want), list(want - got)) == ([], [])
    assert scans.scan_statuses(df.limit(0), 0).count() == 0


def test_rate_limit_stream(spark, one_partition):
    rng = random.Random(5)
    rows = sorted(((f"r{rng.randrange(3)}", BASE + rng.randrange(400) * 60 * S, rng.choice([True, True, False, None])) for _ in range(120)), key=str)
    df = spark.createDataFrame(rows, "recipient string, at long, delivered boolean")
    schema = "recipient string, at long, result string, retry_after long"
    for size in (130,):
        got = replayed(df, F.floor(F.col("at") / (size * 60 * S)), lambda s: digest.rate_limit_stream(s, schema=schema))
        got, want = rows_of(got), rows_of(digest.rate_limited(df))
        assert (list(got - want), list(want - got)) == ([], [])


@pytest.mark.parametrize("horizon, cut", [(None, 31), (5 * S, 23)])
def test_first_seen_in_any_cut(spark, one_partition, horizon, cut):
    """Also with ties in time, a key with a third of all rows, and null keys."""
    rng = random.Random(cut)
    rows = [(rng.choice(["url", "detail"]), "hot" if i % 3 == 0 else rng.choice([None, *"abcdefgh"]), BASE + rng.randrange(60) * S, i) for i in range(200)]
    df = spark.createDataFrame(rows, "space string, key string, at long, ord long")
    # The order of arrival follows time, so that a cut by time is one of arrival.
    df = df.withColumn("ord", F.col("at") * 1000 + F.col("ord"))
    want = pages.first_seen_within(df, ["space", "key"], horizon_ms=horizon) if horizon else batch.first_seen(df, ["space", "key"], "ord")
    got = replayed(df, F.floor(F.col("at") / (cut * S)), lambda s: pages.first_seen_stream(s, ["space", "key"], horizon_ms=horizon))
    got, want = rows_of(got), rows_of(want)
    assert (list(got - want), list(want - got)) == ([], [])


@pytest.mark.parametrize("query", ["first", "scan", "limit", "cooldown"])
def test_state_is_held_by_buckets(spark, one_partition, tmp_path, query):
    """Many keys, null and large ones among them, in three rows of state, however many there are."""
    key = F.when(F.col("id") % 41 == 0, F.lit(None)).otherwise(F.col("id") % 200 + (1 << 60))
    df = spark.range(300).select(key.alias("k"), (BASE + F.col("id") * S).alias("at"), F.col("id").alias("ord"))
    mail = df.select(F.col("k").alias("recipient"), "at", F.col("ord").alias("item"), F.lit(True).alias("delivered"))
    scan = df.select(F.col("k").alias("scan"), F.col("k").alias("profile"), "at", "ord", F.lit("start").alias("kind"), F.lit("").alias("step"), *[F.lit(None).cast("long").alias(c) for c in ("nth", "max_passes", "jobs")])
    rows, run, want = {
        "first": (df, lambda s: pages.first_seen_stream(s, ["k"], buckets=3), batch.first_seen(df, ["k"], "ord")),
        "scan": (scan, lambda s: scans.scan_stream(s, 10_000 * S, buckets=3), scans.scan_statuses(scan.filter("scan is not null"), 0, 10_000 * S).unionByName(scans.scan_statuses(scan.filter("scan is null").withColumn("scan", F.lit(0)), 0, 10_000 * S).withColumn("scan", F.lit(None)))),
        "limit": (mail, lambda s: digest.rate_limit_stream(s, schema="recipient long, at long, result string, retry_after long", buckets=3), digest.rate_limited(mail)),
        "cooldown": (mail, lambda s: digest.cooldown_stream(s, schema="recipient long, sent_at long, n long, items array<long>", buckets=3).drop("items"), digest.cooldown_batch(mail)),
    }[query]
    state_on_disk(spark)
    queries = []

    def start(stream):
        queries.append(run(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        return queries[-1]

    replay(rows, F.floor(F.col("at") / (BASE * 2)), start, str(tmp_path / "in"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(want)
    state = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c"))
    assert 0 < state.count() <= 3


@pytest.mark.parametrize("query", ["first", "limit"])
def test_state_partitions_follow_cores(spark, tmp_path, monkeypatch, query):
    """However many shuffle partitions the session has; without timers no micro-batch comes without rows."""
    df = spark.range(60).select((F.col("id") % 9).alias("k"), (BASE + F.col("id") * S).alias("at"), F.col("id").alias("ord"))
    mail = df.select(F.col("k").alias("recipient"), "at", (F.col("ord") % 3 > 0).alias("delivered"))
    rows, run, want = {"first": (df, lambda s: pages.first_seen_stream(s, ["k"]), batch.first_seen(df, ["k"], "ord")), "limit": (mail, digest.rate_limit_stream, digest.rate_limited(mail))}[query]
    monkeypatch.setattr("postmill.streaming.replay.work_folder", lambda *_: f"file://{tmp_path}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = replayed(rows, F.floor(F.col("at") / (BASE + 30 * S)), run)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows_of(got) == rows_of(want)
    partitions = [p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert 0 < len(partitions) <= 2 * spark.sparkContext.defaultParallelism
    batches = [p for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit()]
    assert len(batches) == 2 or query == "limit"


def test_first_seen_keeps_late_rows(spark, one_partition):
    """A key without a horizon is seen once, also where its only row comes after later ones."""
    df = spark.createDataFrame([("a", BASE + 90 * S, 1, 0), ("b", BASE + 5 * S, 2, 1), ("a", BASE, 3, 1)], "k string, at long, ord long, n long")
    got = replayed(df, F.col("n"), lambda s: pages.first_seen_stream(s, ["k"]))
    assert sorted((r["k"], r["ord"]) for r in got.collect()) == [("a", 1), ("b", 2)]


def test_details_once_a_burst(spark):
    """Changes at most 500 ms apart are one; what stands last counts; a key of a page is reported once."""
    rows = [("p", 0, 1, "A", "u1", ""), ("p", 499, 2, "A", "u1", "text"), ("p", 499, 0, "Z", "u1", ""), ("p", 1000, 3, "B", "", "text"), ("p", 2000, 4, "A", "u1", "more"), ("p", 3000, 5, "B", None, "again"), ("q", 0, 6, "A", "u1", "text"), ("p", 4000, 7, "C", "u3", None)]
    df = spark.createDataFrame(rows, "page string, at long, ord long, title string, url string, description string")
    got = pages.enriched(df, ["page"]).select("page", "key", "read_at", "n", "description").collect()
    assert sorted(map(tuple, got)) == [("p", "B", 1500, 1, "text"), ("p", "u1", 999, 3, "text"), ("q", "u1", 500, 1, "text")]
