"""Readers for the files an evaluation leaves behind."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from .folders import folder

SCHEME = "^[a-z][a-z0-9+.-]*:/*"


def _plain_path(path):
    return F.regexp_replace(path, SCHEME, "/")


def _decoded(path):
    """File URIs arrive percent-encoded in `_metadata`; plain `path` of binary files does not."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def task_files(spark: SparkSession, root: str) -> DataFrame:
    """(task, relpath, content) of every file below `root`.

    Only the files that make a task are listed and read. A root that holds instruction.md is itself the one task;
    otherwise its direct children are.
    """
    base = re.sub(SCHEME, "/", root.rstrip("/"))
    names = tuple(sorted({f.rsplit("/", 1)[-1] for f in (*C.TASK_FILES, "task.json")}))
    rel = folder(spark, root, names, content=True).select(F.col("relpath").alias("rel"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    lone = folder(spark, root, ("instruction.md",), recursive=False).agg((F.count(F.lit(1)) > 0).alias("_lone"))
    inner = F.contains("rel", F.lit("/"))
    return (rel.join(F.broadcast(lone)).where(F.col("_lone") | inner)  # one row
            .select(F.when(F.col("_lone"), F.lit(base.rsplit("/", 1)[-1])).otherwise(F.regexp_extract("rel", "^([^/]+)/", 1)).alias("task"),
                    F.when(F.col("_lone"), F.col("rel")).otherwise(F.regexp_extract("rel", "^[^/]+/(.*)$", 1)).alias("relpath"), "content"))


def trial_records(spark: SparkSession, root: str, multiline: bool = True) -> DataFrame:
    """Saved trial files: their fields, plus run folder, task folder and number from the path.

    `multiline` reads one object per file named trial-*.json, indented or not, at any depth; an empty or broken file is a record of
    nulls. Without it, JSON lines of any name.
    """
    tail = "/([^/]+)/([^/]+)/trial-([0-9]+)\\.json$"
    if multiline:
        path = F.col("path")
        found = folder(spark, root, ("trial-*.json",), content=True, fan=2)  # runs, then tasks
        records = found.select(path, F.from_json(F.col("content").cast("string"), schemas.TRIAL_FILE).alias("r")).select("r.*", path)
    else:
        path = _decoded(F.col("_metadata.file_path"))
        records = spark.read.schema(schemas.TRIAL_FILE).option("recursiveFileLookup", "true").json(root).select("*", path.alias("path"))
        path = F.col("path")
    return records.select(
        *[c for c in records.columns if c != "path"], F.nullif(F.regexp_extract(path, tail, 1), F.lit("")).alias("run_dir"),
        F.nullif(F.regexp_extract(path, tail, 2), F.lit("")).alias("task_dir"),
        F.nullif(F.regexp_extract(path, tail, 3), F.lit("")).cast("int").alias("trial_no"))


def trial_steps(records: DataFrame) -> DataFrame:
    return (records.select("run_dir", "task", "trial_no", F.explode("trajectory.steps").alias("s"))
            .select("run_dir", "task", "trial_no", "s.*"))


def sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales CSV; the header is not data, a malformed line is an error."""
    return spark.read.schema(schemas.SALES).csv(path, header=True, mode="FAILFAST")


def matching_files(spark: SparkSession, where: str, pattern: str = "*.txt") -> DataFrame:
    """Files directly in a folder whose names match; none is an empty result, not an error."""
    found = folder(spark, where, (pattern,), recursive=False, content=True)
    return found.select(F.col("relpath").alias("name"), F.col("size").alias("length"), F.sha2("content", 256).alias("digest"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newlines per file; carriage returns do not end a line and an open last line is not counted.

    Files are read in splits and counted before the shuffle, so one huge file is no problem. An
    open last line shows in the bytes: every line counted with its newline is one more than the file.
    """
    text = spark.read.text(path, lineSep="\n", recursiveFileLookup=True)
    counted = (text.select(_decoded(F.col("_metadata.file_path")).alias("_uri"), F.col("_metadata.file_size").alias("size"),
                           F.octet_length("value").alias("bytes"))
               .groupBy(_plain_path(F.col("_uri")).alias("path"), "size")
               .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("bytes") + 1).alias("bytes")))
    # Files of no bytes are listed but not scanned; names that begin with a dot or an underscore are hidden from scans.
    listed = folder(spark, path).where(~F.col("path").rlike("/[._][^/]*$")).select("path")
    lines = F.col("rows") - (F.col("bytes") - F.col("size"))
    return listed.join(counted, "path", "left").select("path", F.coalesce(lines, F.lit(0).cast("bigint")).alias("lines"))


def changelog(spark: SparkSession, path: str) -> DataFrame:
    """Commit log as JSON lines; null content means deleted."""
    return spark.read.schema(schemas.CHANGELOG).json(path).withColumn("deleted", F.col("content").isNull())


def inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INVENTORY).json(path)


def shop_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A shop table over JDBC, read in `parts` ranges of its key. Needs the database's driver jar."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
            .option("numPartitions", parts).load())
