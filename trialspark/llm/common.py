"""Shared small parts: session preparation, written tables in the shared folder, single-evaluation columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shared_dir, tune

#: Rows and bytes of one Arrow batch that a Python task holds at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: Words are runs of anything but these (space and U+0009 to U+000D).
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    shared_dir(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends here, and lost executors cost no more than a reread."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE), F.lit(0))


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns renamed by place, and the new name of each: an operator's own columns cannot meet names of its input."""
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), named


def restored(rows: DataFrame, named: dict[str, str], new: list[str]) -> DataFrame:
    """The columns that `aside` renamed under their old names, then those called `new`."""
    return rows.select(*[F.col(n).alias(c) for c, n in named.items()], *new)
