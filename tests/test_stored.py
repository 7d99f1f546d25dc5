"""Dictionaries as tables, upserts, deep pages, gapless ids, digests in parts, alarms that change, pruned top lists."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import batch, dictionary, history, matcher, settings, tfidf
from postmill.sources.tables import KeyedTable
from postmill.streaming import digest

TERMS = ["r", "c++", "c#", ".net", "asp.net", "node.js", "ci/cd", "power-bi", "machine learning", "a b c", "++", ".", "x", "x_1", "é", "rest api", "f#", "-", "c"]
TEXTS = ["C++ dev", "c++17 and c#", "C#x f#_", "ASP.NET core", ".NET core", "x.net y", "node.js, Node.jsx", "power-bi/x", "machine learning a b c d", "machine  learning", "a++b ..", "x_1 x", "a.b", None, "", "é x", "ci/cd rest api r", "a-b -c", "++", "R", "c++ c", "xa b c", "x-a b c-y"]


def plainly(text, terms):
    """Whole-word tests one by one, with ASCII word boundaries on both sides."""
    low, w = (text or "").lower(), "[0-9A-Za-z_]"
    edge = f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))"
    return [t for t in terms if re.search(edge + re.escape(t) + edge, low)]


def test_terms_of_any_shape(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "pos int, term string")
    got = {r["id"]: r["skills"] for r in dictionary.skills_by_table(texts, terms, "id", phrases=False).collect()}
    # A term without an ASCII word character and symbols alone can only stand between two words.
    assert got == {i: plainly(t, TERMS) for i, t in enumerate(TEXTS)}
    assert dictionary.skills_by_table(texts, terms.limit(0), "id").count() == len(TEXTS)


def test_large_dictionary(spark):
    """100 000 terms: the plan is no larger than for 100, and the rows are those of the words."""
    texts = spark.range(50).select("id", F.concat_ws(" ", *[F.concat(F.lit("t"), ((F.col("id") * 977 + k * 31) % 200_000).cast("string")) for k in range(40)]).alias("text"))
    terms = lambda n: spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    size = [len(dictionary.skills_by_table(texts, terms(n), "id")._jdf.queryExecution().analyzed().toString()) for n in (100, 100_000)]
    assert abs(size[0] - size[1]) < 200
    for r in dictionary.skills_by_table(texts, terms(100_000), "id").collect():
        assert set(r["skills"]) == {f"t{n}" for k in range(40) if (n := (r["id"] * 977 + k * 31) % 200_000) < 100_000}


def test_only_hits_move(spark):
    """A dictionary that Spark can't estimate is written, so a small one is broadcast and the stretches stay where they are."""
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "pos int, term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dictionary.skills_by_table(texts, terms, "id")
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # Below the aggregate nothing but hits and a row for each text.
    assert out.count() == len(TEXTS) and re.search(r"Filter \(\(shape#\d+ = -1\) OR isnotnull\(pos#\d+\)\)", plan)


def test_terms_are_counted_in_their_rows(spark):
    """Repeated, null and no tokens; no exchange below the vectors but those of document frequencies."""
    docs = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, ["a", "c"]), (3, []), (4, None), (5, ["b"] * 5)], "d long, t array<string>")
    tf = tfidf.term_frequency(docs, "d", "t")
    assert sorted(map(tuple, tf.collect())) == [(1, "a", 0.25), (1, "b", 0.5), (2, "a", 0.5), (2, "c", 0.5), (5, "b", 1.0)]
    assert "Exchange" not in tf._jdf.queryExecution().sparkPlan().toString() + tf._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tfidf.tfidf_vectors(docs, "d", "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan


def test_only_rare_terms_move(spark, monkeypatch):
    """Of a table of terms too large to broadcast, the frequent ones are; unknown and very long terms weigh what they did."""
    docs = spark.createDataFrame([(i, ["all", "x" * 99] + [f"h{i % 2}", f"r{i}"]) for i in range(8)] + [(8, []), (9, None), (10, ["all", None])], "d long, t array<string>")
    tf, whole = tfidf.term_frequency(docs, "d", "t", once=True), tfidf.tfidf_vectors(docs, "d", "t")
    assert Counter(tf.collect()) == Counter(tfidf.term_frequency(docs, "d", "t").collect())
    idf = tfidf.written(tfidf.inverse_document_frequency(docs.filter("d <> 3"), "t"), "idf")
    known = tfidf.tfidf_vectors(docs, "d", "t", idf)
    assert Counter(whole.collect()) != Counter(known.collect())
    monkeypatch.setattr("postmill.sources.tables.SMALL_FILES", 0)
    for frequent in (0, 4, 100):
        monkeypatch.setattr(tfidf, "FREQUENT", frequent)
        parts = tfidf.tfidf_vectors(docs, "d", "t", tf=tf)
        assert Counter(parts.collect()) == Counter(whole.collect())
        assert Counter(tfidf.tfidf_vectors(docs, "d", "t", idf).collect()) == Counter(known.collect())
        if frequent:
            assert re.search(r"BroadcastHashJoin .*LeftAnti", parts._jdf.queryExecution().sparkPlan().toString())


def test_pruned_top_list(spark):
    """The exact best, ties by key, from less than a tenth of the pairs that share a term."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    docs = [(i, list(dict.fromkeys(rng.choices(vocabulary, weights, k=40)))) for i in range(1500)] + [(2000 + i, ["w1", "w2", "w1500"]) for i in range(4)]
    items = [(i, list(dict.fromkeys(rng.choices(vocabulary, weights, k=12) + rng.choices(vocabulary[500:], k=4)))) for i in range(30)] + [(90, ["w1", "w2"]), (91, ["unheard"]), (92, [])]
    a, b = spark.createDataFrame(docs, "d long, t array<string>"), spark.createDataFrame(items, "q long, t array<string>")
    idf = tfidf.inverse_document_frequency(a, "t")
    va, vb = tfidf.tfidf_vectors(a, "d", "t", idf), tfidf.tfidf_vectors(b, "q", "t", idf)
    top = tfidf.TopCosine(va, vb, "d", "q", 4)
    every = tfidf.cosine_sparse(va, vb, "d", "q").withColumn("cosine", top._cut(F.col("cosine"))).filter("cosine <> 0").collect()
    want = []
    for q in {r["q"] for r in every}:
        best = sorted((-r["cosine"], r["d"]) for r in every if r["q"] == q)[:4]
        want += [(q, d, -c, n + 1) for n, (c, d) in enumerate(best)]
    assert sorted(map(tuple, top.result.select("q", "d", "cosine", "rank").collect())) == sorted(want)
    # Queries of frequent words alone have no weak terms to leave out; of all others most pairs go.
    assert top.compared < len(every) / 2
    rare = spark.createDataFrame([(i, [f"w{500 + 3 * i}", f"w{900 + 7 * i}", "w0", "w1", "w2"]) for i in range(60)], "q long, t array<string>")
    vr = tfidf.tfidf_vectors(rare, "q", "t", idf)
    assert tfidf.TopCosine(va, vr, "d", "q", 1).compared < tfidf.cosine_sparse(va, vr, "d", "q").count() / 10


def test_shared_tokens_by_bitmaps(spark):
    docs = spark.createDataFrame([(i, ["hot"] + (["rare"] if i % 1000 == 0 else [])) for i in range(0, 90_000, 7)] + [(7, ["hot"]), (None, ["hot"]), (-5, ["odd"])], "id long, tokens array<string>")
    items = spark.createDataFrame([(1, ["hot", "rare"]), (2, ["rare", "rare"]), (3, ["none"]), (4, []), (5, ["odd"])], "p long, tokens array<string>")
    out = matcher.shared_token_counts(docs, items, "id", "p")
    n = len(range(0, 90_000, 7))
    assert {r["p"]: r["n"] for r in out.collect()} == {1: n, 2: sum(i % 1000 == 0 for i in range(0, 90_000, 7)), 5: 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and not re.search(r"hashpartitioning\(p#\d+L?, id#", plan)


def test_upserts_touch_their_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, v string, at bigint", buckets=8)
    rows = lambda *r: spark.createDataFrame(r, "k string, v string, at long")
    assert table.read().count() == 0
    assert len(table.merge(rows(*[(f"k{i}", "a", 1) for i in range(50)], (None, "n", 1)), 0, ["at"])) == 8
    before = table.manifest()["folders"]
    touched = table.merge(rows(("k3", "b", 3), ("k3", "c", 2), ("k4", "old", 0), (None, "m", 2)), 1, ["at"])
    after = table.manifest()["folders"]
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    assert table.merge(rows(("k3", "again", 9)), 1, ["at"]) == []  # a batch that was committed
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {f"k{i}": "a" for i in range(50)} | {"k3": "b", None: "m"}
    assert {r["v"] for r in table.lookup(rows(("k3", "", 0), (None, "", 0), ("k99", "", 0))).collect()} == {"b", "m"}
    # Of two writers that saw the same state one fails, and the table stays whole.
    state = table.manifest()
    with pytest.raises(RuntimeError):
        table._commit(state)
    table.clear()
    assert table.read().count() == 0 and table.merge(rows(("z", "1", 1)), 2, ["at"]) and table.read().count() == 1


def test_pages_read_their_range(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") + 1).alias("id"), (F.col("id") % 101).cast("double").alias("score"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("platform"), F.format_string("2024-%02d", F.col("id") % 12 + 1).alias("matched_at"))
    table = history.PagedTable.write(rows, str(tmp_path / "p"), 20)
    for args in [(20, 0), (50, 2500), (100, 4950), (10, 9000), (-1, 4990), (30, 700, 40, "a"), (30, 0, None, "b")]:
        page = table.page(*args)
        want = history.page(rows, *args).select("id").collect()
        assert [r["id"] for r in page.select("id").collect()] == [r["id"] for r in want]
        if args[1] < 9000 and len(args) == 2:
            assert len(page.inputFiles()) <= 20 and page.select(F.input_file_name().alias("f")).distinct().count() <= 2


def test_ids_without_gaps(spark, tmp_path):
    path = str(tmp_path / "h")
    for n, at in ((37, "a"), (1, "b"), (0, "c"), (23, "d")):
        items = spark.range(n).repartition(5).select(F.concat(F.lit(at), F.format_string("%03d", "id")).alias("job_title"), F.lit(1.0).alias("score"), F.col("id").alias("k"))
        history.insert(items, path, "now", ["k"])
    got = [(r["id"], r["job_title"]) for r in history.read(spark, path).orderBy("id").collect()]
    assert got == list(enumerate([f"{at}{i:03d}" for n, at in ((37, "a"), (1, "b"), (23, "d")) for i in range(n)], 1))


def test_digest_in_parts(spark):
    """Parts joined are the body; a line longer than a part leaves numbers out; null recipients are one."""
    rows = [("hot" if i % 3 else None if i % 2 else f"r{i % 5}", i, "t" * (700 if i == 11 else i % 13), "Co", float(i % 7 * 15)) for i in range(400)]
    df = spark.createDataFrame(rows, "who string, ord long, title string, company string, score double").select("*", F.lit("u").alias("url"), F.array(F.lit("s")).alias("matched_skills"), F.array().cast("array<string>").alias("missing_skills"))
    parts = {}
    for r in sorted(batch.digest_parts(df.repartition(7), "who", size=500).collect(), key=lambda r: r["part"]):
        parts.setdefault(r["who"], []).append(r)
    for r in batch.digest(df, "who").collect():
        mine = parts[r["who"]]
        body = re.sub(r"^<p>.*?</p><table>|</table>$", "", r["body"])
        assert "".join(p["body"] for p in mine) == body and sum(p["n"] for p in mine) == r["n"]
        assert all(len(p["body"].encode()) < 500 + 900 for p in mine)
    assert len(parts["hot"]) > 20


def test_alarms_of_changing_profiles(spark):
    """Any save sets all of an owner's alarms anew; pauses and deletions end them."""
    rows = [("o", "2024-01-01 00:00", "a", 60, True, False), ("o", "2024-01-01 02:30", "b", 0, True, False), ("o", "2024-01-01 04:30", "a", 60, False, False), ("o", "2024-01-01 06:00", "b", 60, True, True), ("o", "2024-01-01 06:30", "a", 5, True, None), ("x", "2024-01-01 06:20", "a", 15, True, False)]
    df = spark.createDataFrame(rows, "owner string, t string, id string, interval long, enabled boolean, deleted boolean").withColumn("at", F.to_timestamp("t", "yyyy-MM-dd HH:mm"))
    got = sorted((r["owner"], r["id"], str(r["runs_at"])[11:16]) for r in digest.alarm_history(df, "2024-01-01 07:00:00").collect())
    assert got == sorted([("o", "a", t) for t in ("01:00", "02:00", "03:30", "06:45", "07:00")] + [("o", "b", t) for t in ("03:30", "05:30")] + [("x", "a", t) for t in ("06:35", "06:50")])


def test_cleared_history(spark, tmp_path):
    """Ids go on after a clear, twice too, and after one of an empty table."""
    path = str(tmp_path / "c")
    items = spark.range(3).select(F.format_string("j%d", "id").alias("job_title"))
    for _ in range(2):
        history.insert(items, path, "now", ["job_title"])
        history.clear(spark, path)
    history.clear(spark, path)
    assert history.read(spark, path).count() == 0
    history.insert(items, path, "now", ["job_title"])
    assert [r["id"] for r in history.read(spark, path).orderBy("id").collect()] == [7, 8, 9]


def test_stored_settings(spark):
    rows = [("a", "settings", '{"platforms": {"x": true}, "emailEnabled": null}'), ("a", "threshold", "0"), ("a", "scanStatus", '{"p1": {"state": "idle"}}'), ("a", "searchProfiles", '[{"id": "p1", "interval": 30, "enabled": true}, {"id": "p2", "workType": "remote"}]'), ("b", "settings", None), ("b", "threshold", "high"), ("c", "other", "1")]
    stored = spark.createDataFrame(rows, "owner string, key string, value string")
    got = {r["owner"]: r for r in settings.read_settings(stored).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["threshold"] == 0 and got["b"]["threshold"] == got["c"]["threshold"] == 50
    assert got["a"]["platforms"] == {"x": True} and got["a"]["emailEnabled"] is False and got["c"]["platforms"] == {p: True for p in settings.PLATFORMS}
    assert got["a"]["scan_status"] == {"p1": '{"state":"idle"}'} and got["b"]["scan_status"] == {} and got["b"]["resume_text"] == ""
    assert [(r["place"], r["id"], r["interval"], r["workType"]) for r in settings.read_profiles(stored).orderBy("place").collect()] == [(0, "p1", 30, None), (1, "p2", None, "remote")]
