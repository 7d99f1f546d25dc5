"""A corpus pipeline of five operators: toxic documents go, one of each group of near-duplicates
stays, contaminated ones go, sources are mixed to target weights, and the rest is sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontam, mixing, neardup, sharding, toxicity
from postmill.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The classifier learns from ``labels``."""
    model = toxicity.train_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of the smallest doc_id, however often its rows are repeated. Rows without a
    doc_id are documents by their text; one of them stays if no document with a doc_id is in its class."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Behind all usual ids, and the same for equal texts.
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)
    rows = docs.select(F.struct(*COLUMNS).alias("row"), F.coalesce("doc_id", stand_in).alias("doc_id"), text.alias("text"))
    classes = written(neardup.near_duplicates(rows.select("doc_id", "text")), "pipeline-classes")
    others = classes.filter("doc_id <> class_id").select("doc_id").distinct()
    rows = rows.join(others, "doc_id", "left_anti")
    repeated = classes.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    once = rows.join(repeated, "doc_id", "left_anti").select("row")
    first = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("row").alias("row")).select("row")
    return once.union(first).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontam.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0 to 3. Texts without words count no words and
    stay once."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), F.array("source"), [F.col("doc_id"), F.xxhash64("text")])
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("taken") / F.col("size")).cast("int"))
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.shuffle_into_shards(docs.select(*COLUMNS), SHARDS, [F.col("doc_id"), F.xxhash64("text")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
