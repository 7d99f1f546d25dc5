"""Tables in the shared folder: written ones that cut a plan, and keyed ones that take upserts."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all machines of a cluster share. Where that is
    unset, in a temporary folder, but only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="postmill-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: it is worked out once, and Spark knows its size."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a written table up to which ``small`` has joins broadcast it, whatever the session's threshold.
SMALL_FILES = 16 << 20


def small(table: DataFrame) -> DataFrame:
    """A written table, with the hint to broadcast it if its files are small: what it meets then stays where it is. A
    larger one is left to Spark's size checks."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(table) if size <= SMALL_FILES else table


def numbered(rows: DataFrame, order: list, start: int = 1, name: str = "id") -> DataFrame:
    """Rows with the numbers ``start``, ``start`` + 1, ... by ``order``, without gaps and without one task for all: rows
    are written in ranges of the order, each range's rows counted, and each row's place within its range is
    added to the rows before that range (a row a range)."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower bits of this id are the place within the task.
    place = F.monotonically_increasing_id()
    staged = written(sorted_.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")), "numbered")
    counts = staged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    return staged.join(F.broadcast(before), "_part").withColumn(name, F.lit(start) + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


class KeyedTable:
    """The last row of each key, in ``buckets`` by hash of the key. A merge reads and rewrites only the buckets that
    its updates touch, beside the old ones, and then writes one small manifest that names each bucket's
    folder; the manifest of the highest number is the table. Readers thus see a merge whole or not at all, and one
    that fails half-way leaves nothing but unnamed files. A batch that was committed is not merged again.

    The manifest is made under a name of its own and renamed, which takes place once: of two writers
    of one number the second fails."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _manifests(self) -> list[int]:
        folder = f"{self.path}/manifests"
        system = _system(self.spark, folder)
        if not system.exists(_path(self.spark, folder)):
            return []
        return sorted(int(s.getPath().getName()) for s in system.listStatus(_path(self.spark, folder)) if s.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """The table's state: number, last batch, and the folder of each bucket that holds rows."""
        known = self._manifests()
        if not known:
            return {"number": 0, "batch": -1, "folders": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{known[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        spark, folder = self.spark, f"{self.path}/manifests"
        system, mine = _system(spark, folder), f"{folder}/_{uuid.uuid4().hex}"
        system.mkdirs(_path(spark, folder))
        out = system.create(_path(spark, mine))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = _path(spark, f"{folder}/{state['number']}")
        if system.exists(target) or not system.rename(_path(spark, mine), target):
            raise RuntimeError(f"another writer has committed manifest {state['number']}")

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders.values())))

    def read(self) -> DataFrame:
        return self._rows(self.manifest()["folders"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        touched = {str(r["b"]) for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        held = {b: f for b, f in self.manifest()["folders"].items() if b in touched}
        same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"k.{k}")) for k in self.key])
        return self._rows(held).alias("t").join(keys.select(*self.key).distinct().alias("k"), same, "left_semi")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))

    def merge(self, updates: DataFrame, batch: int, order: list[str]) -> list[int]:
        """Takes the last update of each key, by ``order``, an older row giving way to a later one alone; gives the
        rewritten buckets. ``batch`` must rise."""
        state = self.manifest()
        if batch <= state["batch"]:
            return []
        columns = [f.split()[0] for f in self.schema.split(", ")]
        own = [c for c in columns if c not in self.key]
        best = lambda df: df.groupBy(*self.key).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("_row")).select(*self.key, "_row.*").select(*columns)
        new = written(best(updates).withColumn("_bucket", self._bucket()), "updates")
        touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if touched:
            held = {b: f for b, f in state["folders"].items() if int(b) in touched}
            merged = best(self._rows(held).unionByName(new.drop("_bucket"))).withColumn("_bucket", self._bucket())
            folder = f"data/{state['number'] + 1}-{uuid.uuid4().hex[:8]}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            state["folders"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._commit(state | {"number": state["number"] + 1, "batch": batch})
        return touched

    def clear(self) -> None:
        """Empties the table; later batches go on from the last one's number."""
        state = self.manifest()
        self._commit(state | {"number": state["number"] + 1, "folders": {}})
