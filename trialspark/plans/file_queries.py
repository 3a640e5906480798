"""Round trips through files: rows derived from the tables are written, then read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet, summaries
from ..session import scratch
from ..sources import files, sinks
from . import bindings as B
from .grading_queries import TASK_SQL
from .registry import query

W = B.with_views


@query("trial_json_scan", W("recorded graded", """
  SELECT task, mode, status, count(*) AS trials, count(*) FILTER (WHERE passed) AS passed,
    CAST(sum(len(tampering)) AS BIGINT) AS entries, CAST(sum(trial_id % 5) AS BIGINT) AS steps FROM graded GROUP BY ALL"""))
def trial_json_scan(spark, sf):
    """Whole trial records, trajectories included, as JSON."""
    step = lambda n: F.struct(n.cast("int").alias("index"), F.lit("ls").alias("command"), F.lit(0).alias("exit_code"))
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.col("trial_id") % 5), step), lambda s: s["index"] > 0)
    path = scratch(spark, "trials-json")
    B.graded(spark, sf).select(
        "task", "mode", "status", "passed", "tests_passed", "duration", "error", "violation", "tampering",
        F.struct(steps.alias("steps"), "finished", "stop_reason", F.col("model_error").alias("error")).alias("trajectory")).write.json(path)
    read = files.trial_records(spark, path, multiline=False)
    return read.groupBy("task", "mode", "status").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("passed").alias("passed"),
        F.sum(F.size("tampering").cast("bigint")).alias("entries"),
        F.sum(F.coalesce(F.size("trajectory.steps"), F.lit(0)).cast("bigint")).alias("steps"))


@query("run_summary_sink", W("recorded graded step_counts graded_steps runs", f"""
  SELECT g.run_id, r.model, task, {TASK_SQL} FROM graded_steps g JOIN runs r ON r.run_id = g.run_id GROUP BY g.run_id, r.model, task"""))
def run_summary_sink(spark, sf):
    per_task = summaries.task_summary(B.with_steps(B.graded(spark, sf), spark, sf), ("run_id", "task"))
    path = scratch(spark, "summaries")
    sinks.write_run_summaries(sinks.run_summaries(per_task, B.runs(spark, sf).select("run_id", "model")), path)
    entry = ("struct<trials bigint, passed bigint, tampered bigint, resource_limited bigint, avg_steps double, avg_seconds double>")
    read = spark.read.schema(f"run_id bigint, model string, tasks map<string, {entry}>").json(path)
    return read.select("run_id", "model", F.explode("tasks").alias("task", "v")).select("run_id", "model", "task", "v.*")


@query("runs_trials_store", W("recorded graded runs", """
  SELECT r.run_id, r.run_status, t.trial_id, t.status, t.violation AS told FROM graded t JOIN runs r ON r.run_id = t.run_id"""))
def runs_trials_store(spark, sf):
    """Runs and trials stored with the result as a variant, then read back and joined."""
    trials = B.graded(spark, sf)
    result = F.parse_json(F.to_json(F.struct("tests_passed", "error", "violation", "tampering")))
    path = scratch(spark, "store")
    sinks.write_store(B.runs(spark, sf), trials.select("trial_id", "run_id", "task", "status",
                                                       F.col("duration").cast("float").alias("duration"), result.alias("result")), path)
    runs, stored = sinks.read_store(spark, path)
    told = F.try_variant_get("result", "$.violation", "string")
    return (stored.join(runs.select("run_id", "run_status"), "run_id")
            .select("run_id", "run_status", "trial_id", "status", told.alias("told")))


@query("csv_header_scan", """
  SELECT region, CAST(revenue AS DOUBLE) AS revenue, region || ': ' || CAST(revenue AS VARCHAR) AS line FROM (
    SELECT r_name AS region, CAST(sum(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,6))) AS DECIMAL(30,2)) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")
def csv_header_scan(spark, sf):
    """Sales written as CSV with a header and read back strictly, then summed per region."""
    where = (B.table(spark, sf, "supplier").join(B.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
             .join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("region")))
    rows = (B.table(spark, sf, "lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("region", F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").alias("price")))
    path = scratch(spark, "sales")
    rows.write.csv(path, header=True)
    read = files.sales(spark, path).select("region", summaries.amount("quantity", "price").alias("amount"))
    return summaries.region_revenue(read).withColumn("revenue", F.col("revenue").cast("double"))


# -- folder trees: single files written by executors, then listed and read by the folder source -------------------

@query("task_folder_scan", """
  WITH t AS (SELECT s_suppkey AS k, 'task ' || s_suppkey AS task, concat_ws(', ', CASE WHEN s_suppkey % 5 = 1 THEN 'solution.sh' END,
      CASE WHEN s_suppkey % 7 = 2 THEN 'environment/Dockerfile' END, CASE WHEN s_suppkey % 11 = 3 THEN 'tests/run_tests.sh' END) AS missing
    FROM supplier WHERE s_suppkey % 4 <> 3)
  SELECT task, 'Serve ' || k AS instruction, CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN '/opt,/usr/local/bin' ELSE '' END AS allowed,
    CASE WHEN missing <> '' THEN 'task ''' || task || ''' is missing: ' || missing WHEN k % 9 = 0 THEN 'task ''' || task || ''' has invalid task.json' END AS problem
  FROM t""")
def task_folder_scan(spark, sf):
    """A task folder per supplier, some files missing or empty, some folders no task; catalogue and allowed paths from the files."""
    k = F.col("s_suppkey")

    def file(name, content, there=F.lit(True)):
        return F.when(there, F.struct(F.concat(F.lit("task "), k, F.lit("/" + name)).alias("relpath"), content.alias("content")))

    config = F.when(k % 9 == 0, F.lit("{oops")).otherwise(F.lit('{"allowed_paths": ["/opt", "/usr/local/bin"]}'))
    made = F.array_compact(F.array(
        file("instruction.md", F.concat(F.lit("Serve "), k), k % 4 != 3), file("solution.sh", F.lit(""), k % 5 != 1),
        file("environment/Dockerfile", F.lit("FROM scratch"), k % 7 != 2), file("tests/run_tests.sh", F.lit("exit 0"), k % 11 != 3),
        file("tests/data/instruction.md", F.lit("not the task's")), file("task.json", config, k % 3 == 0)))
    root = scratch(spark, "tasks")
    sinks.write_files(B.table(spark, sf, "supplier").select(F.inline(made)), root)
    found = fleet.task_catalogue(files.task_files(spark, root))
    return found.select("task", "instruction", F.array_join("allowed_paths", ",").alias("allowed"), "problem")


@query("trial_folder_scan", """
  WITH t AS (SELECT s_suppkey AS k, unnest(range(1, s_suppkey % 3 + 2)) AS n FROM supplier)
  SELECT 'run ' || k % 8 AS run_dir, 'task+' || k AS task_dir, CAST(n AS INT) AS trial_no, CASE WHEN k % 10 <> 9 THEN 'task+' || k END AS task,
    CASE WHEN k % 10 <> 9 THEN CASE WHEN (k + n) % 2 = 0 THEN 'PASS' ELSE 'FAIL' END END AS status, CASE WHEN k % 10 <> 9 THEN CAST(n AS INT) END AS steps FROM t""")
def trial_folder_scan(spark, sf):
    """Trial files in run and task folders, indented, some of them broken or empty; run, task and number from the path."""
    k, n = F.col("k"), F.col("n")
    trials = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(1), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("n"))
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("index"), F.lit("ls").alias("command")))
    record = F.to_json(F.struct(F.concat(F.lit("task+"), k).alias("task"), F.when((k + n) % 2 == 0, "PASS").otherwise("FAIL").alias("status"),
                                F.struct(steps.alias("steps")).alias("trajectory")), {"pretty": "true"})
    content = F.when(k % 20 == 9, F.lit("")).when(k % 10 == 9, F.lit('{"task": ')).otherwise(record)
    run = F.concat(F.lit("run "), k % 8)
    made = F.array(F.struct(F.concat(run, F.lit("/task+"), k, F.lit("/trial-"), n, F.lit(".json")).alias("relpath"), content.alias("content")),
                   F.struct(F.concat(run, F.lit("/summary-"), k, F.lit("-"), n, F.lit(".json")).alias("relpath"), F.lit("{}").alias("content")))
    root = scratch(spark, "trials")
    sinks.write_files(trials.select(F.inline(made)), root)
    return files.trial_records(spark, root).select("run_dir", "task_dir", "trial_no", "task", "status", F.size("trajectory.steps").alias("steps"))


@query("file_lines_scan", "SELECT s_nationkey || '/s' || s_suppkey || '.txt' AS file, s_suppkey % 6 AS lines FROM supplier")
def file_lines_scan(spark, sf):
    """Lines of text files, empty ones and ones with an open last line among them."""
    k = F.col("s_suppkey")
    relpath = F.concat(F.col("s_nationkey"), F.lit("/s"), k, F.lit(".txt"))
    content = F.concat(F.repeat(F.lit("a\rb\n"), (k % 6).cast("int")), F.when(k % 4 == 1, "open").otherwise(""))
    root = scratch(spark, "texts")
    sinks.write_files(B.table(spark, sf, "supplier").select(relpath.alias("relpath"), content.alias("content")), root)
    return files.file_lines(spark, root).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), "lines")


@query("glob_folder_scan", """
  SELECT 'note ' || s_suppkey || '.txt' AS name, CAST(s_suppkey % 3 * 3 AS BIGINT) AS length, sha256(repeat('xy' || chr(10), s_suppkey % 3)) AS digest
  FROM supplier WHERE s_suppkey % 5 = 0""")
def glob_folder_scan(spark, sf):
    """What `*.txt` finds directly in a folder: names, sizes and digests. Empty files are found; hidden ones and those in folders below are not."""
    k = F.col("s_suppkey")
    name = (F.when(k % 5 == 0, F.concat(F.lit("note "), k, F.lit(".txt"))).when(k % 5 == 1, F.concat(F.lit("note "), k, F.lit(".log")))
            .when(k % 5 == 2, F.concat(F.lit("sub/"), k, F.lit(".txt"))).when(k % 5 == 3, F.concat(F.lit("."), k, F.lit(".txt")))
            .otherwise(F.concat(F.lit("note "), k, F.lit(".TXT"))))
    root = scratch(spark, "notes")
    sinks.write_files(B.table(spark, sf, "supplier").select(name.alias("relpath"), F.repeat(F.lit("xy\n"), (k % 3).cast("int")).alias("content")), root)
    return files.matching_files(spark, root)
