"""Match history as a Parquet table: insert, page, count, clear."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered

SCHEMA = "id long, job_title string, company string, url string, score double, platform string, matched_skills string, missing_skills string, matched_at string, created_at string"
# Default and largest page.
PAGE, MOST = 100, 500


def with_defaults(items: DataFrame, now: str, order: list[str] = []) -> DataFrame:
    """Rows to insert with their defaults; a NaN score is 0, skills become JSON text. Columns of ``order`` are
    kept as _by0, _by1, ..."""
    have = set(items.columns)
    col = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    blank = lambda c: F.coalesce(col(c, "string"), F.lit("")).alias(c)
    skills = lambda c: F.coalesce(F.to_json(col(c, "array<string>")), F.lit("[]")).alias(c)
    score = F.nanvl(F.coalesce(col("score", "double"), F.lit(0.0)), F.lit(0.0)).alias("score")
    at = F.coalesce(F.nullif(col("matched_at", "string"), F.lit("")), F.lit(now)).alias("matched_at")
    return items.select(blank("job_title"), blank("company"), blank("url"), score, blank("platform"), skills("matched_skills"), skills("missing_skills"), at, F.lit(now).alias("created_at"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)])


def lossy_projection(matches: DataFrame) -> DataFrame:
    """The six fields that a client sends on; skills are not among them."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return matches.select(F.col("title").alias("job_title"), blank("company"), blank("url"), "score", blank("platform"), "matched_at")


def insert(items: DataFrame, path: str, now: str, order: list[str] | None = None) -> None:
    """Appends the rows with new ids: the next ones, without gaps, by ``order`` (columns of the items; without it by
    what the rows hold). The table's own commit makes the batch one transaction. One writer at a time: the ids
    follow the largest one ever committed, also after ``clear``."""
    before = _last_id(items.sparkSession, path)
    full = with_defaults(items, now, order or [])
    by = [f"_by{i}" for i in range(len(order))] if order else full.columns
    numbered(full, [F.col(c) for c in by], before + 1).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history; empty where nothing was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def _last_id(spark: SparkSession, path: str) -> int:
    """The largest id that the table has given, which ``clear`` leaves as the name of an empty folder."""
    largest = read(spark, path).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_last")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [int(f.getPath().getName()) for f in system.listStatus(place)] if system.exists(place) else []
    return max([largest, *left])


def clear(spark: SparkSession, path: str) -> None:
    """Deletes all rows; ids go on."""
    last = _last_id(spark, path)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_last/{last}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def decoded(rows: DataFrame) -> DataFrame:
    """Skills as arrays; empty text is an empty list."""
    parse = lambda c: F.from_json(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("[]")), "array<string>")
    return rows.withColumns({c: parse(c) for c in ("matched_skills", "missing_skills")})


def page_arguments(limit=None, offset=None, min_score=None) -> tuple[int, int, float]:
    """Leading numbers of the arguments; what isn't a number or is 0 falls back: limit 100 (500 at most;
    negative: no limit), offset 0, score 0."""

    def number(value, pattern: str, kind):
        m = re.match(rf"\s*({pattern})", str(value)) if value is not None else None
        return kind(m[1]) if m else 0

    whole, real = r"[+-]?\d+", r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    return min(number(limit, whole, int) or PAGE, MOST), number(offset, whole, int), float(number(min_score, real, float))


def page(rows: DataFrame, limit=None, offset=None, min_score=None, platform: str | None = None) -> DataFrame:
    """One page, newest first, ties by the larger id. Filters reach the scan; the sort keeps limit +
    offset rows per task."""
    limit, offset, least = page_arguments(limit, offset, min_score)
    out = rows.filter(F.col("score") >= least)
    if platform:
        out = out.filter(F.col("platform") == platform)
    out = out.orderBy(F.desc("matched_at"), F.desc("id"))
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit >= 0 else out


class PagedTable:
    """A history written in ranges of its order, newest first, ties by the larger id: a page far behind is read from the
    range that holds it, instead of sorting all rows before it. ``index``: rows (part, n, before) of the
    unfiltered table, a row a range. A filter's counts take one pass over its columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, rows: DataFrame, path: str, ranges: int | None = None) -> PagedTable:
        order = [F.desc("matched_at"), F.desc("id")]
        cut = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
        cut.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{path}/rows")
        table = cls(rows.sparkSession, path)
        table._counts(table.rows()).write.parquet(f"{path}/index")
        return table

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @staticmethod
    def _counts(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("part").agg(F.count("*").alias("n"))
        return counts.select("part", "n", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range

    def page(self, limit=None, offset=None, min_score=None, platform: str | None = None) -> DataFrame:
        """The rows of ``page``."""
        limit, offset, least = page_arguments(limit, offset, min_score)
        rows = self.rows()
        filtered = min_score is not None or platform
        if min_score is not None:
            rows = rows.filter(F.col("score") >= least)
        if platform:
            rows = rows.filter(F.col("platform") == platform)
        index = self._counts(rows) if filtered else self.spark.read.parquet(f"{self.path}/index")
        offset = max(offset, 0)
        wanted = index.filter(F.col("before") + F.col("n") > offset)
        wanted = wanted.filter(F.col("before") < offset + limit) if limit >= 0 else wanted
        parts = wanted.orderBy("part").collect()  # the ranges of one page
        out = rows.filter(F.col("part").isin([r["part"] for r in parts])).drop("part").orderBy(F.desc("matched_at"), F.desc("id"))
        skip = offset - parts[0]["before"] if parts else 0
        out = out.offset(skip) if skip > 0 else out
        return out.limit(limit) if limit >= 0 else out


def total(rows: DataFrame) -> DataFrame:
    """Number of all rows, whatever a page filters."""
    return rows.agg(F.count("*").alias("total"))
