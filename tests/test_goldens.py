"""Hand-derived cases of the matching semantics."""

import pytest
from pyspark.sql import functions as F

from postmill.functions import formats, text
from postmill.operators import batch, history, matcher, rescoring, tfidf

JOB = "ord long, title string, company string, description string, location string"
RESUME = "Senior Python developer with AWS, Docker and SQL. 5+ years of experience. Full-stack."


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("I use C++ and C#. The .NET stack, ASP.NET; it.", "use c++ c# net stack asp.net it .net"),
        ("CI/CD, Node.js & REST API", "ci cd node.js rest api ci/cd rest-api"),
        ("machine learning -- a. of. x", "machine learning of machine-learning"),
        ("restapi", "restapi"),
        ("c#5 c++x", "c#5 c++x c# c++"),
        ("the. And. for-", "the and for"),
        ("", ""),
        ("the and of", ""),
        (None, ""),
    ],
)
def test_tokens(spark, given, want):
    assert value(spark, text.tokens(F.lit(given).cast("string"))) == want.split()


@pytest.mark.parametrize(
    "given,want",
    [
        ("C++ dev", []),
        ("c# dev", []),
        (".NET core", []),
        ("c++17 dev", ["c++"]),
        ("ASP.NET core", ["asp.net", ".net"]),
        ("react-native app", ["react", "react-native"]),
        ("JavaScript", ["javascript"]),
        ("machine learning vs machine-learning", ["machine-learning"]),
        ("5+ years of experience; Full-Stack, full stack, fullstack", ["5+ years of experience", "full-stack", "full stack", "fullstack"]),
        ("réel", ["r"]),
        ("go to the rest of express shell", ["go", "express", "rest", "shell"]),
    ],
)
def test_skills(spark, given, want):
    assert value(spark, text.skills(F.lit(given))) == want


def test_scores_and_order(spark):
    jobs = spark.createDataFrame(
        [
            (1, "Python Engineer", "Acme", "Python, SQL, Kubernetes and AWS required. 5+ years of experience.", "Remote"),
            (2, "Chef", "Bistro", "Prepare meals nightly", None),
            (3, "Docker dev", None, "", ""),
            (4, "Baker", "Oven", "Senior baker", ""),
            (5, None, None, None, None),
        ],
        JOB,
    )
    profile = matcher.Profile.of(spark, RESUME)
    assert len(profile.skills) == 6
    rows = {r["ord"]: r for r in matcher.score_jobs(jobs, profile).collect()}
    assert [(rows[i]["score"], rows[i]["tfidf_score"], rows[i]["skill_score"]) for i in range(1, 6)] == [(92, 100, 80), (0, 0, 0), (100, 100, 100), (60, 100, 0), (0, 0, 0)]
    assert rows[1]["matched_skills"] == ["python", "sql", "aws", "5+ years of experience"] and rows[1]["missing_skills"] == ["kubernetes"]
    assert [r["ord"] for r in matcher.match_jobs(jobs, profile).collect()] == [3, 1, 4]
    assert [r["ord"] for r in matcher.match_jobs(jobs, profile, 70).collect()] == [3, 1]


def test_poisoned_token(spark):
    jobs = spark.createDataFrame([(1, "a constructor job", None, None, None)], JOB)
    profile = matcher.Profile.of(spark, "job")
    assert matcher.score_jobs(jobs, profile, poisoned=True).first()["score"] is None
    assert matcher.score_jobs(jobs, profile).first()["score"] == 60


def test_pair_score_closed_form(spark):
    pairs = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], ["b"]), ([], ["b"]), (["x"] , ["x"])], "a array<string>, b array<string>")
    rows = pairs.select(tfidf.pair_score(F.col("a"), F.col("b")).alias("c"), tfidf.pair_score_generic(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r["c"] for r in rows] == [r["g"] for r in rows] == [100, 0, 0, 100]


def test_content_filter_and_null_urls(spark):
    rows = spark.createDataFrame([(1, None, "x" * 20), (2, None, "x" * 21), (3, "ab", None), (4, "abc", None)], "ord int, title string, description string")
    assert [r["ord"] for r in batch.content_filter(rows).orderBy("ord").collect()] == [2, 4]
    new = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "b")], "ord int, url string")
    old = spark.createDataFrame([(None,), ("a",)], "url string")
    assert [r["ord"] for r in batch.select_new(new, old).orderBy("ord").collect()] == [3, 4]


def test_history_cap(spark):
    new, old = spark.range(60).withColumnRenamed("id", "ord"), spark.range(1000, 1150).withColumnRenamed("id", "ord")
    rows = batch.cap_history(new, old).orderBy("position").collect()
    assert len(rows) == 200 and [r["ord"] for r in rows[:60]] == list(range(60))


def test_notifications(spark):
    rows = spark.createDataFrame([(0, i, f"J{i}", "Co", float(90 - i)) for i in range(7)], "b int, ord int, title string, company string, score double")
    out = batch.notifications(rows, "b").orderBy("n").collect()
    assert len(out) == 6 and out[0]["title"] == "🟢 Job Match: 90%" and out[0]["message"] == "J0 at Co"
    assert out[5]["message"] == "+2 more matches found" and out[5]["title"].endswith("84%")


@pytest.mark.parametrize("weight", [0.3, 0, None])
def test_hybrid(spark, weight):
    assert value(spark, formats.hybrid_score(F.lit(80.0), F.lit(40.0), weight)) == 68


def test_formats(spark):
    category = [value(spark, formats.score_category(F.lit(x))) for x in (80.0, 79.99, 60.0, 40.0, 39.99)]
    assert category == ["excellent", "good", "good", "fair", "low"]
    assert [value(spark, formats.scan_progress(F.lit(p), F.lit(5))) for p in (5, 1)] == [85, 25]
    assert [value(spark, formats.alarm_period(F.lit(i))) for i in (5, 0, 60)] == [15, 60, 60]
    assert [value(spark, formats.interval_label(F.lit(i))) for i in (15, 60, 90, 1440)] == ["Every 15m", "Every 1h", "Every 1.5h", "Daily"]
    assert value(spark, formats.model_ready(F.array(F.lit("llama:7b")), "llama:8b"))


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"score": 85, "rationale": "ok", "keyStrengths": ["a"], "gaps": []}', (85, "ok", ["a"], [])),
        ('{"score":"85"}', (85, "", [], [])),
        ('{"score":true}', (1, "", [], [])),
        ('{"score":null}', (0, "", [], [])),
        ('{"score":"x"}', (0, "", [], [])),
        ('{"score":150}', (100, "", [], [])),
        ('{"score":-5}', (0, "", [], [])),
        ('```json\n{"score": 7}\n```', (7, "", [], [])),
        ('a {"g":{"x":1}} b', None),
        ("no", None),
    ],
)
def test_replies(spark, reply, want):
    got = value(spark, rescoring.parse_reply(F.lit(reply)))
    assert (got and tuple(got)) == want


def test_failing_scorer(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string")

    def scorer(prompt):
        if prompt == "b":
            raise OSError
        return '{"score": 5}'

    assert [r["reply"] for r in rescoring.ask(rows, scorer).orderBy("prompt").collect()] == ['{"score": 5}', None]


def test_page_arguments():
    assert [history.page_arguments(x)[0] for x in (None, "0", "junk", "10abc", "900", "-1")] == [100, 100, 100, 10, 500, -1]


def test_history_table(spark, tmp_path):
    path = str(tmp_path / "h")
    items = spark.createDataFrame([("A", float("nan"), ["x"]), (None, 70.0, None)], "job_title string, score double, matched_skills array<string>")
    history.insert(items, path, "2024-01-01")
    history.insert(items, path, "2024-01-02")
    rows = history.decoded(history.read(spark, path)).collect()
    assert len({r["id"] for r in rows}) == 4 and {r["score"] for r in rows} == {0.0, 70.0}
    assert sorted(map(tuple, (r["matched_skills"] for r in rows))) == [(), (), ("x",), ("x",)]
    assert [r["matched_at"] for r in history.page(history.read(spark, path), "2").collect()] == ["2024-01-02"] * 2
    history.clear(spark, path)
    assert history.total(history.read(spark, path)).first()["total"] == 0


def test_text_clean_up(spark):
    assert value(spark, text.normalize(F.lit("a\r\n\n\n\nb \t c "))) == "a\n\nb c"
    assert value(spark, text.strip_xml(F.lit("<w:p>A&amp;lt;B</w:p>"))) == "A<B\n"


def test_sql_functions(spark, sf_dir):
    """The SQL functions give what the Columns give."""
    from pyspark.sql import functions as F

    from postmill.functions import sql
    from postmill.functions import text as T

    names = sql.register(spark, "pm_")
    assert names == ["pm_tech_terms", "pm_tokens", "pm_phrase_skills", "pm_skills"]
    cases = ["CI/CD, Node.js & REST  API", "c++17 and ASP.NET; full stack, 5+ years of experience", "the. And. for-", None, "", "machine learning c# f# .net react-native"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(30).union(spark.createDataFrame([(c,) for c in cases], "text string"))
    docs.createOrReplaceTempView("pm_docs")
    ours = docs.select(T.tech_terms(F.col("text")), T.tokens(F.col("text")), T.phrase_skills(F.col("text")), T.skills(F.col("text"))).collect()
    theirs = spark.sql("SELECT pm_tech_terms(text), pm_tokens(text), pm_phrase_skills(text), pm_skills(text) FROM pm_docs").collect()
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, map(tuple, theirs)))
