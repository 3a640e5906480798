"""The trial domain seen in the driver's tables: one Spark view and one SQL text per relation.

Everything covers whole tables. Times are whole microseconds (`us`), so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grading
from .ordered import chunked, numbered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(col) -> F.Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


SQL: dict[str, str] = {}


def with_views(names: str, query: str) -> str:
    """`query` preceded by the named SQL views, in the given order."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + query


# -- events ---------------------------------------------------------------------

def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """events with times in microseconds."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trial_id"), micros("ts").alias("us"), "event_id", "event_type", "value", "props")


SQL["clicks"] = "SELECT user_id AS trial_id, epoch_us(ts) AS us, event_id, event_type, value, props FROM events"


def raw_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded commands, before numbering. Every other command ends in a blank."""
    kind = F.col("event_type")
    return clicks(spark, sf).select(
        "trial_id", "us", "event_id",
        F.concat(kind, F.when(F.col("event_id") % 2 == 0, " ").otherwise("")).alias("command"),
        F.when(kind == "error", 1).when(kind != "signup", 0).cast("int").alias("exit_code"),
        F.col("value").alias("duration"), F.col("props").alias("output"))


def steps(spark: SparkSession, sf: str, cut: bool = False) -> DataFrame:
    """Numbered commands. `cut` keeps the chunk columns, for more ordered work without a shuffle."""
    raw = raw_steps(spark, sf)
    if cut:
        raw = chunked(raw, ["trial_id"], F.col("us"))
    return numbered(raw, ["trial_id"], ["us", "event_id"], F.col("us"), "idx")


SQL["steps"] = """
  SELECT user_id AS trial_id, epoch_us(ts) AS us, event_id,
         concat(event_type, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END) AS command,
         CASE WHEN event_type = 'error' THEN 1 WHEN event_type <> 'signup' THEN 0 END AS exit_code,
         value AS duration, props AS output,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx
  FROM events"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return clicks(spark, sf).select("trial_id", "us", F.col("value").alias("disk_mb"))


SQL["samples"] = "SELECT user_id AS trial_id, epoch_us(ts) AS us, value AS disk_mb FROM events"


def leases(spark: SparkSession, sf: str) -> DataFrame:
    return (clicks(spark, sf).where(F.col("event_type") == "error")
            .select(F.col("trial_id").alias("worker"), F.col("event_id").alias("trial_id"), F.col("us").alias("seq")))


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return (clicks(spark, sf).where(F.col("event_type") != "error")
            .select(F.col("trial_id").alias("worker"), "us"))


SQL["leases"] = "SELECT user_id AS worker, event_id AS trial_id, epoch_us(ts) AS seq FROM events WHERE event_type = 'error'"
SQL["heartbeats"] = "SELECT user_id AS worker, epoch_us(ts) AS us FROM events WHERE event_type <> 'error'"


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """One model reply per event, with the calls it holds and what happened; already cut into chunks."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    rows = chunked(clicks(spark, sf), ["trial_id"], F.col("us"))
    return numbered(rows, ["trial_id"], ["us", "event_id"], F.col("us"), "reply").select(
        "trial_id", "reply", "_hot", "_chunk", k.alias("k"), kind.alias("kind"), (F.col("event_id") * 7 % 400).alias("tokens"),
        ((kind == "error") & (F.col("value") > 150)).alias("failed"),
        (F.col("value") > 300).alias("violated"),
        F.when((kind == "signup") & (k < 25), 0).otherwise(1 + k % 2).alias("n_calls"))


SQL["replies"] = """
  SELECT user_id AS trial_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reply,
         CAST(props ->> '$.k' AS INT) AS k, event_type AS kind, event_id * 7 % 400 AS tokens,
         event_type = 'error' AND value > 150 AS failed, value > 300 AS violated,
         CASE WHEN event_type = 'signup' AND CAST(props ->> '$.k' AS INT) < 25 THEN 0
              ELSE 1 + CAST(props ->> '$.k' AS INT) % 2 END AS n_calls
  FROM events"""


def calls(replied: DataFrame) -> DataFrame:
    """Tool calls of `replies`: the first is the event's own command, a second lists files."""
    return (replied.where("n_calls > 0")
            .withColumn("call", F.explode(F.sequence(F.lit(1), F.col("n_calls"))))
            .select("trial_id", "reply", F.col("call").cast("bigint").alias("call"),
                    *[c for c in ("_hot", "_chunk") if c in replied.columns],
                    F.when((F.col("kind") == "purchase") & (F.col("k") < 15), "finish")
                    .when(F.col("k") == 50, "search").otherwise("run_shell").alias("name"),
                    F.when(F.col("call") == 2, "ls").when(F.col("k") == 60, " ").otherwise(F.col("kind")).alias("command"),
                    F.when(F.col("kind") == "error", 1).otherwise(0).alias("exit_code"), "violated"))


SQL["calls"] = """
  SELECT trial_id, reply, call,
         CASE WHEN kind = 'purchase' AND k < 15 THEN 'finish' WHEN k = 50 THEN 'search' ELSE 'run_shell' END AS name,
         CASE WHEN call = 2 THEN 'ls' WHEN k = 60 THEN ' ' ELSE kind END AS command,
         CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS exit_code, violated
  FROM (SELECT *, unnest(range(1, n_calls + 1)) AS call FROM replies WHERE n_calls > 0)"""


# -- orders ---------------------------------------------------------------------

def step_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id"))
            .agg(F.count(F.lit(1)).alias("steps")))


def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Trial results as recorded, one per order. Some runs have no trials, some have twice as many."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    state = F.col("o_orderstatus")
    marks = F.array(*[F.lit(p) for p in ("C /usr/bin/wget", "A /bin/x", "C /lib/y", "D /etc/ld.so.conf")])
    return table(spark, sf, "orders").select(
        key.alias("trial_id"),
        F.when(cust % 7 == 0, cust + 1).otherwise(cust).alias("run_id"),
        F.col("o_orderpriority").alias("task"),
        F.when(key % 4 == 0, "noop").otherwise("oracle").alias("mode"),
        (state == "F").alias("tests_passed"),
        F.when(key % 41 == 0, "sandbox failed").when(key % 41 == 1, "").alias("error"),
        F.when(key % 29 == 0, "disk usage reached 60 MB (limit 50 MB)").when(key % 29 == 1, "").alias("violation"),
        F.when(key % 23 == 0, F.slice(marks, F.lit(1), (key % 4 + 1).cast("int")))
         .otherwise(F.array().cast("array<string>")).alias("tampering"),
        F.when(key % 19 == 0, "cannot reach model").alias("model_error"),
        F.when(state == "F", "finished").when(state == "P", "max_steps").otherwise("").alias("stop_reason"),
        state.isin("F", "P").alias("finished"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint") / F.lit(100000.0)).alias("duration"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("millis"),
        F.col("o_orderdate").alias("started_at"),
        F.when(key % 13 == 0, "queued").when(key % 13 == 1, "running").when(key % 13 == 2, "cancelled").alias("pending"))


SQL["recorded"] = """
  SELECT o_orderkey AS trial_id,
         CASE WHEN o_custkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS run_id,
         o_orderpriority AS task, CASE WHEN o_orderkey % 4 = 0 THEN 'noop' ELSE 'oracle' END AS mode,
         o_orderstatus = 'F' AS tests_passed,
         CASE WHEN o_orderkey % 41 = 0 THEN 'sandbox failed' WHEN o_orderkey % 41 = 1 THEN '' END AS error,
         CASE WHEN o_orderkey % 29 = 0 THEN 'disk usage reached 60 MB (limit 50 MB)'
              WHEN o_orderkey % 29 = 1 THEN '' END AS violation,
         CASE WHEN o_orderkey % 23 = 0
              THEN list_slice(['C /usr/bin/wget', 'A /bin/x', 'C /lib/y', 'D /etc/ld.so.conf'], 1, o_orderkey % 4 + 1)
              ELSE CAST([] AS VARCHAR[]) END AS tampering,
         CASE WHEN o_orderkey % 19 = 0 THEN 'cannot reach model' END AS model_error,
         CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'max_steps' ELSE '' END AS stop_reason,
         o_orderstatus IN ('F', 'P') AS finished,
         CAST(round(o_totalprice * 100) AS BIGINT) / 100000.0::DOUBLE AS duration,
         CAST(round(o_totalprice * 100) AS BIGINT) AS millis,
         o_orderdate AS started_at,
         CASE o_orderkey % 13 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'cancelled' END AS pending
  FROM orders"""


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """recorded + passed + grade + stored status (pending ones have no grade yet)."""
    return grading.graded(recorded(spark, sf)).withColumn("status", F.coalesce("pending", "grade"))


SQL["graded"] = """
  SELECT *, coalesce(pending, grade) AS status FROM (
    SELECT *, tests_passed AND coalesce(len(tampering), 0) = 0 AND coalesce(violation, '') = '' AS passed,
      CASE WHEN error <> '' THEN 'ERROR' WHEN violation <> '' THEN 'LIMIT' WHEN len(tampering) > 0 THEN 'TAMPER'
           WHEN tests_passed THEN 'PASS' ELSE 'FAIL' END AS grade
    FROM recorded)"""


def with_numbers(trials: DataFrame) -> DataFrame:
    """trial_no: 1..n per (run, task)."""
    return numbered(trials, ["run_id", "task"], ["trial_id"], F.col("trial_id"), "trial_no")


SQL["numbered"] = "SELECT *, row_number() OVER (PARTITION BY run_id, task ORDER BY trial_id) AS trial_no FROM graded"


def trial_end() -> F.Column:
    """When a trial of `recorded` ended, in microseconds; null for pending ones."""
    return F.when(F.col("pending").isNull(), micros("started_at") + F.col("millis") * 10)


TRIAL_END_SQL = "CASE WHEN pending IS NULL THEN epoch_us(started_at) + millis * 10 END"


def with_steps(trials: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    counts = step_counts(spark, sf)
    return (trials.join(counts, "trial_id", "left")
            .withColumn("steps", F.coalesce("steps", F.lit(0).cast("bigint"))))


SQL["step_counts"] = "SELECT l_orderkey AS trial_id, count(*) AS steps FROM lineitem GROUP BY 1"
SQL["stepped"] = """
  SELECT g.*, coalesce(s.steps, 0) AS steps FROM {} g LEFT JOIN step_counts s ON g.trial_id = s.trial_id"""
SQL["graded_steps"] = SQL["stepped"].format("graded")
SQL["numbered_steps"] = SQL["stepped"].format("numbered")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("model"),
        F.when(bal < 2000, "queued").when(bal < 4000, "running").when(bal < 7000, "done")
         .otherwise("cancelled").alias("run_status"),
        (F.lit(1_704_067_200_000_000) + F.col("c_custkey") * 61_000_000).alias("created_at"),
        F.when(bal >= 4000, F.lit(1_704_067_200_000_000) + F.col("c_custkey") * 61_000_000 + (F.col("c_custkey") % 977 + 1) * 1_000_000).alias("finished_at"))


SQL["runs"] = """
  SELECT c_custkey AS run_id, c_mktsegment AS model,
         CASE WHEN c_acctbal < 2000 THEN 'queued' WHEN c_acctbal < 4000 THEN 'running'
              WHEN c_acctbal < 7000 THEN 'done' ELSE 'cancelled' END AS run_status,
         1704067200000000 + c_custkey * 61000000 AS created_at,
         CASE WHEN c_acctbal >= 4000 THEN 1704067200000000 + c_custkey * 61000000 + (c_custkey % 977 + 1) * 1000000 END AS finished_at
  FROM customer"""


def run_settings(spark: SparkSession, sf: str) -> DataFrame:
    """What each run was started with."""
    key = F.col("c_custkey")
    limits = F.create_map(F.lit("memory_mb"), (key % 8192 + 64).cast("string"), F.lit("max_file_mb"), key.cast("string"),
                          F.lit("network"), (key % 2 == 0).cast("string"))
    return table(spark, sf, "customer").select(key.alias("run_id"), F.concat(F.lit("http://model-"), F.col("c_nationkey"), F.lit(":8000/v1")).alias("base_url"),
                                               (key % 200 + 1).cast("int").alias("max_steps"), limits.alias("limits"))


SQL["run_settings"] = """
  SELECT c_custkey AS run_id, 'http://model-' || c_nationkey || ':8000/v1' AS base_url, CAST(c_custkey % 200 + 1 AS INT) AS max_steps,
         'memory_mb=' || (c_custkey % 8192 + 64) || ' network=' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS limits
  FROM customer"""


# -- pages ----------------------------------------------------------------------

def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """A changed file per page; its host is the trial."""
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("trial_id"), "page_id",
        F.when(F.col("url").contains("?"), "C").when(F.col("url").contains("#"), "D").otherwise("A").alias("kind"),
        F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"),
        F.col("url").startswith("http:").alias("plain"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """File changes in listing order: every file, and every directory above one, once, as changed."""
    pages = page_files(spark, sf)
    parts = F.split("path", "/")
    depth = F.size(parts)
    files = pages.select("trial_id", (F.col("page_id") * 100 + 99).alias("ord"), "kind", "path", "plain")
    above = F.transform(F.sequence(F.lit(2), depth - 1), lambda d: F.struct(
        F.array_join(F.slice(parts, F.lit(1), d), "/").alias("path"), d.alias("d")))
    dirs = (pages.where(depth > 2).select("trial_id", "page_id", "plain", F.explode(above).alias("a"))
            .groupBy("trial_id", F.col("a.path").alias("path"))
            .agg(F.min(F.col("page_id") * 100 + F.col("a.d")).alias("ord"), F.bool_and("plain").alias("plain")))
    return files.unionByName(dirs.withColumn("kind", F.lit("C")))


SQL["page_files"] = """
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS trial_id, page_id,
         CASE WHEN contains(url, '?') THEN 'C' WHEN contains(url, '#') THEN 'D' ELSE 'A' END AS kind,
         regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, starts_with(url, 'http:') AS plain
  FROM pages"""
SQL["changes"] = """
  SELECT trial_id, page_id * 100 + 99 AS ord, kind, path, plain FROM page_files
  UNION ALL
  SELECT trial_id, min(page_id * 100 + d) AS ord, 'C' AS kind, path, bool_and(plain) AS plain FROM (
    SELECT trial_id, page_id, plain, d, array_to_string(string_split(path, '/')[1:d], '/') AS path
    FROM (SELECT *, unnest(range(2, len(string_split(path, '/')))) AS d FROM page_files)) GROUP BY trial_id, path"""


# -- conversations --------------------------------------------------------------

def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns; every third one gets a native call, the one after it a call written as text."""
    turn, n = F.col("turn"), F.length("text")
    native = F.concat(
        F.lit('[{"id": "c'), turn, F.lit('", "type": "function", "function": {"name": "run_shell", "arguments": "{\\"command\\": \\"ls '),
        n, F.lit('\\"}"}}, {"function": {"name": "finish", "arguments": {"summary": "done"}}}]'))
    written = F.concat(
        F.lit("Plan: run { it }.\n```json\n"), F.lit('{"name": "run_shell", "arguments": {"command": "echo '), n,
        F.lit('"}}\n```\n{"hello": 1} {"name": "finish", "parameters": {"summary": "ok"}} '))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trial_id"), turn.alias("turn"), "role",
        F.when(turn % 3 == 2, F.concat(written, F.col("text"))).otherwise(F.col("text")).alias("content"),
        F.when(turn % 3 == 1, native).alias("tool_calls"), n.alias("n"))


SQL["messages"] = """
  SELECT conv_id AS trial_id, turn, role, text AS content, length(text) AS n FROM conversations"""
