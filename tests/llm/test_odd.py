"""Empty tables, very long texts, repeated rows and columns with clashing names."""

from pyspark.sql import functions as F

from postmill.llm import decontam, lm, neardup, pii, secrets

LONG = " ".join(f"w{i % 97}x{i}" for i in range(60_000))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_personal_data(spark):
    text = f"{LONG} a@b.org {LONG} +12 345 678 901"
    docs = frame(spark, [(1, text)] * 3 + [(None, "x@y.zz"), (2, None)]).withColumns({"base": F.lit(1), "spans": F.lit("own"), "T": F.lit(2)})
    out = pii.find_pii(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "T", "base", "spans"])
    rows = out.collect()
    long = [r for r in rows if r["doc_id"] == 1]
    assert len(rows) == 5 and len(long) == 3 and all([text[s["start"] : s["end"]] for s in r["base"]] == ["a@b.org", "+12 345 678 901"] for r in long)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_secrets(spark):
    value = "Zk3" * 9 + "q7Lm2Xw9"
    text = f'{LONG} token = "{value}" {LONG}'
    docs = frame(spark, [(1, text)] * 2 + [(None, None)]).withColumn("row", F.lit(1))
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == 3 and all(value in [text[s["start"] : s["end"]] for s in r["secrets"]] for r in rows if r["doc_id"] == 1)


def test_near_duplicates(spark):
    docs = frame(spark, [(1, LONG), (2, LONG + " more"), (3, LONG[: len(LONG) // 2]), (4, None)]).withColumns({"class_id": F.lit(9), "kept": F.lit("own"), "id": F.lit(0)})
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination(spark):
    item = " ".join(f"item{i}word" for i in range(40))
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "")], "item_id long, text string").withColumn("leaks", F.lit(1))
    docs = frame(spark, [(1, f"{LONG} {item}")] * 3 + [(2, LONG), (3, None)]).withColumn("leaks", F.lit("own"))
    rows = decontam.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in rows) == [(1, [7, 7])] * 3 + [(2, []), (3, [])]
    assert decontam.find_leaks(docs.limit(0), items).count() == 0


def test_language_model(spark):
    docs = spark.createDataFrame([(1, "a b a", 5), (1, "a b a", 5), (2, LONG, 6), (None, None, 7)], "id long, text string, score int")
    model = lm.LanguageModel(docs)
    rows = model.score(docs.withColumn("row", F.lit("own"))).collect()
    assert len(rows) == 4 and sorted(r["n_tokens"] for r in rows) == [1, 4, 4, 60_001] and all(r["n_known"] == r["n_tokens"] for r in rows)
    assert model.score(docs.limit(0)).count() == 0
