from pyspark.sql import functions as F

from postmill.operators import matcher
from postmill.streaming import digest
from postmill.streaming.match_stream import MatchLoop, Settings

JOBS = "ord long, title string, company string, location string, description string, url string, platform string"
MINUTES = [0, 10, 29, 31, 62]


def job(i, url, platform="indeed", title="Python dev"):
    return (i, title, "Co", "", "A python posting of some length", url, platform)


def test_match_loop(spark, tmp_path):
    source = str(tmp_path / "in")
    profile = matcher.Profile.of(spark, "python developer")
    seen = []
    loop = MatchLoop(spark, profile, str(tmp_path / "history"), Settings(cap=3), sinks=[lambda df, i: seen.append((i, df.count()))])
    batches = [[job(1, "a"), job(2, None), job(3, "off", "other")], [job(4, "a"), job(5, None), job(6, "b"), job(7, "b")], [job(8, "a"), job(9, "z", title="Cook")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, JOBS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(JOBS).parquet(source)
        loop.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    # The cap of three has pushed "a" out after the second batch, so it may match again.
    assert [r["ord"] for r in loop.history(2).orderBy("place").collect()] == [6, 7, 1]
    assert [r["ord"] for r in loop.history().orderBy("place").collect()][0] in (8, 9)
    assert seen[0] == (0, 2) and seen[1] == (1, 2)


def test_scan_mode_and_scorer(spark, tmp_path):
    profile = matcher.Profile.of(spark, "python developer")
    loop = MatchLoop(spark, profile, str(tmp_path / "h"), mode="scan", scorer=lambda p: '{"score": 0}')
    jobs = spark.createDataFrame([job(1, "a", "anything"), (2, "Cook", "", "", "Make soup every day", "b", "x")], JOBS)
    rows = {r["ord"]: r for r in loop.run_batch(jobs, 0).collect()}
    assert rows[1]["score"] == 70 and rows[1]["local_score"] == 100 and rows[2]["score"] == 0
    again = loop.run_batch(jobs, 0)  # a batch that is run again changes nothing
    assert {r["ord"] for r in again.collect()} == {1, 2}
    assert loop.run_batch(jobs, 1) is None


def test_more_matches_than_the_cap(spark, tmp_path):
    """Sinks get all new matches with what the model says of them; only the history is capped."""
    profile = matcher.Profile.of(spark, "python developer who led Python teams")
    asked, seen = [], []
    reply = '{"score": 50, "rationale": "fits", "keyStrengths": ["a"], "gaps": ["b"]}'
    loop = MatchLoop(spark, profile, str(tmp_path / "h"), Settings(cap=3), scorer=lambda p: reply if "who led Python teams" in p else None, sinks=[lambda df, i: seen.append((i, df.collect()))], model="m1")
    jobs = spark.createDataFrame([job(i, f"u{i}") for i in range(14)], JOBS)
    added = loop.run_batch(jobs, 0).collect()
    assert len(added) == 14 and len(seen[0][1]) == 14 and loop.history().count() == 3
    scored = [r for r in added if r["model_score"] is not None]
    assert len(scored) == 10 and all((r["rationale"], r["key_strengths"], r["gaps"], r["model"], r["local_score"], r["score"]) == ("fits", ["a"], ["b"], "m1", 100, 85) for r in scored)
    assert [r["ord"] for r in loop.history().orderBy("place").collect()] == [10, 11, 12]  # the four that the model did not lower come first
    assert loop.run_batch(spark.createDataFrame([job(10, "u10")], JOBS), 1) is None
    assert loop._versions() == [0]  # nothing new, no version
    for i in (2, 3, 4):
        loop.run_batch(spark.createDataFrame([job(100 + i, f"v{i}")], JOBS), i)
    assert loop._versions() == [3, 4] and not asked


def test_settings():
    assert Settings.of({"cap": 7, "weights": [0.5, 0.5], "threshold": None, "other": 1}) == Settings(cap=7, weights=(0.5, 0.5))


def test_refused_mail(spark):
    """Matches of refused requests are lost, or stay for the next request."""
    rows = spark.createDataFrame([("x", 0, False, 2), ("x", 60_000, True, 1), ("x", 120_000, True, 4), ("x", 2_000_000, True, 8)], "recipient string, at long, delivered boolean, matches long")
    run = lambda **k: [(r["result"], r["n"]) for r in digest.rate_limited(rows, matches="matches", **k).orderBy("at").collect()]
    assert run() == [("send_failed", 0), ("sent", 1), ("rate_limited", 0), ("sent", 8)]
    assert run(keep=True) == [("send_failed", 0), ("sent", 3), ("rate_limited", 0), ("sent", 12)]
    assert run(configured=False) == [("smtp_not_configured", 0)] * 4


def test_cooldown_batch_and_stream(spark, tmp_path):
    rows = [("x", m * 60_000, i) for i, m in enumerate(MINUTES)]
    events = spark.createDataFrame(rows, "recipient string, at long, item long")
    want = [(0, 1), (31 * 60_000, 3), (62 * 60_000, 1)]
    assert sorted((r["sent_at"], r["n"]) for r in digest.cooldown_batch(events).collect()) == want
    source = str(tmp_path / "in")
    for i in (0, 1):
        events.filter(F.col("item") < 3 if i == 0 else F.col("item") >= 3).coalesce(1).write.mode("append").parquet(source)
        stream = digest.cooldown_stream(spark.readStream.schema(events.schema).parquet(source))
        (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start().awaitTermination())
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["sent_at"], r["n"]) for r in got) == want
    assert sorted(sorted(r["items"]) for r in got) == [[0], [1, 2, 3], [4]]


def test_recipients_are_scanned_not_collected(spark):
    """Nothing gathers a recipient's rows, null ones are a recipient, and state passes from batch to batch."""
    events = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "x").alias("recipient"), (F.col("id") * 60_000).alias("at"), F.col("id").alias("item"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        for out in (digest.cooldown_batch(events), digest.rate_limited(events.withColumn("delivered", F.lit(True)))):
            assert "collect_list" not in out._jdf.queryExecution().toString()
        sent = {k: sorted((r["sent_at"] // 60_000, r["n"]) for r in digest.cooldown_batch(events).collect() if r["recipient"] == k) for k in (None, "x")}
        limited = digest.rate_limited(events.withColumn("delivered", F.lit(True))).filter("result = 'sent'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, rows in sent.items():
        last, n, want = None, 0, []
        for i in range(30_000):
            if (i % 3 > 0) == (key == "x"):
                n += 1
                if last is None or i - last >= 30:
                    want.append((i, n))
                    last, n = i, 0
        assert rows == want
        assert sorted(r["at"] // 60_000 for r in limited if r["recipient"] == key) == [i for i, _ in want]


def test_rate_limit(spark):
    rows = spark.createDataFrame([("x", 0, False), ("x", 60_000, True), ("x", 120_000, True)], "recipient string, at long, delivered boolean")
    out = [(r["result"], r["retry_after"]) for r in digest.rate_limited(rows).orderBy("at").collect()]
    assert out == [("send_failed", None), ("sent", None), ("rate_limited", 29 * 60)]
