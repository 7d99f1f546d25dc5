"""A recorded table as a stream: its batches arrive one after the other, each in a run of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import work_folder

def state_on_disk(spark: SparkSession) -> None:
    """Has this session's new streams keep their state in RocksDB, which timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Partitions of state for each core.
WAVES = 2


@contextmanager
def state_by_cores(spark: SparkSession) -> Iterator[None]:
    """Streams started within have at most ``WAVES`` partitions of state a core, which their checkpoints then keep.
    A partition costs each micro-batch a task with a new Python worker, about half a CPU second however few its rows
    are, and unlike those of a batch query they aren't merged. Their rows are sorted on disk if need be and a
    task holds a bucket at a time, so larger partitions need no more memory."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), WAVES * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replay(rows: DataFrame, batch: Column, start: Callable[[DataFrame], StreamingQuery], folder: str) -> None:
    """Gives the batches of ``rows`` (numbered by ``batch``, a long) to a stream in their order. Rows are written
    once, by batch; a batch's files then move to where the stream reads. ``start`` gets the stream and starts its
    query, with one checkpoint and a trigger that ends: every batch is a restart from that checkpoint."""
    spark = rows.sparkSession
    cut = rows.withColumn("batch", batch.cast("long"))
    cut.write.partitionBy("batch").parquet(f"{folder}/staged")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path(f"{folder}/staged"))]
    system.mkdirs(path(f"{folder}/in"))
    for name in sorted((n for n in names if n.startswith("batch=")), key=lambda n: int(n.split("=")[1])):
        system.rename(path(f"{folder}/staged/{name}"), path(f"{folder}/in/{name}"))
        start(spark.readStream.schema(cut.schema).parquet(f"{folder}/in").drop("batch")).awaitTermination()


def replayed(rows: DataFrame, batch: Column, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``transform`` appends over all batches."""
    spark = rows.sparkSession
    folder = work_folder(spark, "replay")
    state_on_disk(spark)
    schema = []

    def start(stream: DataFrame) -> StreamingQuery:
        out = transform(stream)
        schema[:] = [out.schema]
        with state_by_cores(spark):
            return out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    replay(rows, batch, start, folder)
    return spark.read.schema(schema[0]).parquet(f"{folder}/out") if schema else spark.createDataFrame([], transform(rows.limit(0)).schema)
