"""Starting streams and keeping their results as tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ROCKSDB, scratch, shared_dir


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB, off the heap. A query keeps the settings it was started with.

    A local session also gets one state partition per core; a cluster keeps its own number.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              # Sessions of a hot key are merged before they are shuffled.
              "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
    if spark.sparkContext.master.startswith("local"):
        wanted["spark.sql.shuffle.partitions"] = str(spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def drain(stream: DataFrame, name: str, target: str | None = None) -> DataFrame:
    """Append a stream's output to a Parquet table until its input is used up; return the table."""
    spark = stream.sparkSession
    target = target or scratch(spark, name)
    with state_settings(spark):
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/table")
             .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/table")


def each_batch(stream: DataFrame, target: str, mode: str, save: Callable[[DataFrame, int], None]) -> None:
    with state_settings(stream.sparkSession):
        q = (stream.writeStream.outputMode(mode).foreachBatch(save)
             .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()


def drain_updates(stream: DataFrame, keys: list[str], name: str, target: str | None = None) -> DataFrame:
    """Keep a changing aggregate as a log of updated rows; return the latest row of each key.

    A batch that is run again overwrites its own part of the log, so retries change nothing.
    """
    spark = stream.sparkSession
    target = target or scratch(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/log/batch={batch_id}")

    each_batch(stream, target, "update", save)
    log = spark.read.parquet(f"{target}/log")
    rest = [c for c in stream.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return latest.select(*keys, "r.*")


def drain_batches(stream: DataFrame, name: str, fold: Callable[[DataFrame], DataFrame], target: str | None = None) -> DataFrame:
    """Keep fold(batch) of every micro-batch as a log; return the log. A batch that is run again overwrites its own part."""
    spark = stream.sparkSession
    target = target or scratch(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{target}/log/batch={batch_id}")

    each_batch(stream, target, "append", save)
    return spark.read.parquet(f"{target}/log").drop("batch")


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, with the schema it has; the table is a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The stream source takes a single file only through a pattern; this one matches just `path`.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def staged(df: DataFrame, name: str, files: int | None = None, order: str | None = None) -> str:
    """Write derived rows to the shared folder, to be streamed from there."""
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch(spark, name)
    if files and order:
        df = df.repartitionByRange(files, order).sortWithinPartitions(order)
    df.write.parquet(path)
    return path
