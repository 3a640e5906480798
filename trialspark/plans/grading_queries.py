"""Queries over trial records: grades, details, checks, summaries, verdicts, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import fleet, grading, summaries
from ..session import scratch
from . import bindings as B
from .registry import query

W = B.with_views


@query("trial_passed", W("recorded graded", "SELECT trial_id, passed FROM graded"))
def trial_passed(spark, sf):
    return B.graded(spark, sf).select("trial_id", "passed")


@query("trial_status", W("recorded graded", "SELECT trial_id, grade AS status FROM graded"))
def trial_status(spark, sf):
    return B.graded(spark, sf).select("trial_id", F.col("grade").alias("status"))


DETAIL_SQL = """CASE WHEN len(tampering) > 0 THEN 'tampered: ' || array_to_string(list_slice(tampering, 1, 3), ', ')
  ELSE coalesce(nullif(error, ''), nullif(violation, ''), nullif(model_error, ''), nullif(stop_reason, ''), '') END"""


@query("trial_detail", W("recorded", f"SELECT trial_id, {DETAIL_SQL} AS detail FROM recorded"))
def trial_detail(spark, sf):
    return B.recorded(spark, sf).select("trial_id", grading.detail().alias("detail"))


@query("first3", W("recorded", """SELECT trial_id, array_to_string(list_slice(tampering, 1, 3), ', ') AS shown
  FROM recorded WHERE len(tampering) > 0"""))
def first3(spark, sf):
    return (B.recorded(spark, sf).where(grading.any_entry(F.col("tampering")))
            .select("trial_id", F.array_join(F.slice("tampering", 1, 3), ", ").alias("shown")))


@query("exec_outcome", W("steps", """
  SELECT trial_id, idx, CASE WHEN dead THEN 137 WHEN bytes > 1024 THEN 137 WHEN duration > 100 THEN 124
    WHEN violation <> '' THEN 137 ELSE exit_code END AS reported_code,
    CASE WHEN dead THEN 'sandbox stopped: ' || violation
      WHEN bytes > 1024 THEN output || chr(10) || 'output exceeded 1 KB; the command was killed'
      WHEN duration > 100 THEN output || chr(10) || 'command timed out after 100s; the command was killed'
      WHEN violation <> '' THEN output || chr(10) || 'sandbox stopped: ' || violation || '; the command was killed'
      ELSE output END AS reported_output
  FROM (SELECT *, CAST(output ->> '$.k' AS INT) * 12 AS bytes,
          CASE WHEN event_id % 31 < 2 THEN 'disk full' END AS violation, event_id % 31 = 0 AS dead FROM steps)"""))
def exec_outcome(spark, sf):
    key = F.col("event_id") % 31
    rows = (B.steps(spark, sf)
            .withColumn("output_bytes", F.get_json_object("output", "$.k").cast("int") * 12)
            .withColumn("elapsed", F.col("duration"))
            .withColumn("violation", F.when(key < 2, "disk full")).withColumn("dead", key == 0))
    return (grading.exec_outcome(rows, max_output_kb=1, timeout_seconds=100)
            .select("trial_id", "idx", "reported_code", "reported_output"))


@query("run_request_check", """
  SELECT p_partkey AS request, concat_ws(',',
      CASE WHEN p_size > 20 THEN 'trials' END,
      CASE WHEN p_size * 5 > 200 THEN 'max_steps' END,
      CASE WHEN p_size * 200 > 8192 THEN 'memory_mb' END,
      CASE WHEN p_size - 1 <= 0 OR p_size - 1 > 8 THEN 'cpus' END,
      CASE WHEN p_size < 10 THEN 'disk_mb' END,
      CASE WHEN p_size * 3 < 10 THEN 'trial_timeout' END,
      CASE WHEN p_type NOT IN ('oracle', 'noop', 'agent') THEN 'mode' END) AS problems
  FROM (SELECT p_partkey, p_size, CASE WHEN p_type = 'SMALL' THEN 'agent' WHEN p_type = 'LARGE' THEN 'noop'
                                       WHEN p_type = 'MEDIUM' THEN 'oracle' ELSE p_type END AS p_type FROM part)""")
def run_request_check(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    requests = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("request"), size.alias("trials"), (size * 5).alias("max_steps"),
        (size * 200).alias("memory_mb"), (size - 1).alias("cpus"), size.alias("disk_mb"),
        (size * 3).alias("trial_timeout"),
        F.when(kind == "SMALL", "agent").when(kind == "LARGE", "noop").when(kind == "MEDIUM", "oracle")
         .otherwise(kind).alias("mode"))
    return grading.request_problems(requests).select("request", F.array_join("problems", ",").alias("problems"))


@query("key_integrity", """
  WITH t AS (SELECT o_custkey + 3 AS run_id, o_orderpriority AS task, o_orderkey % 4 AS trial_no, count(*) AS n
             FROM orders GROUP BY 1, 2, 3)
  SELECT run_id, task, trial_no, n AS rows, 'duplicate' AS problem FROM t WHERE n > 1
  UNION ALL SELECT run_id, task, trial_no, n, 'orphan' FROM t
  WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = run_id)""")
def key_integrity(spark, sf):
    trials = B.table(spark, sf, "orders").select(
        (F.col("o_custkey") + 3).alias("run_id"), F.col("o_orderpriority").alias("task"),
        (F.col("o_orderkey") % 4).alias("trial_no"))
    return fleet.key_problems(B.runs(spark, sf), trials)


@query("terminal_filter", W("recorded graded", """
  SELECT run_id, count(*) FILTER (WHERE status IN ('PASS','FAIL','TAMPER','LIMIT','ERROR','cancelled')) AS finished,
    count(*) FILTER (WHERE status IN ('PASS','FAIL','TAMPER','LIMIT','ERROR')) AS graded,
    count(*) FILTER (WHERE status IN ('queued','running')) AS active
  FROM graded GROUP BY run_id"""))
def terminal_filter(spark, sf):
    s = F.col("status")
    return B.graded(spark, sf).groupBy("run_id").agg(
        F.count_if(s.isin(*C.GRADED, "cancelled")).alias("finished"),
        F.count_if(s.isin(*C.GRADED)).alias("graded"), F.count_if(s.isin(*C.OPEN)).alias("active"))


@query("limits_projection", """
  SELECT s_suppkey AS run_id, 'memory_mb=' || (s_suppkey % 8192) || ' cpus=' || s_nationkey || ' disk_mb=' || (s_nationkey * 10)
      || CASE WHEN s_acctbal > 5000 THEN ' network=true' ELSE ' network=false' END AS shown
  FROM supplier""")
def limits_projection(spark, sf):
    text = lambda c: c.cast("string")
    limits = F.create_map(
        F.lit("memory_mb"), text(F.col("s_suppkey") % 8192), F.lit("cpus"), text(F.col("s_nationkey")),
        F.lit("max_file_mb"), text(F.col("s_suppkey")), F.lit("disk_mb"), text(F.col("s_nationkey") * 10),
        F.lit("network"), text(F.col("s_acctbal") > 5000))
    return B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.array_join(grading.shown_limits(limits), " ").alias("shown"))


@query("answer_check", """
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'PASS' ELSE 'FAIL: expected en, got ''' || lang || '''' END AS result
  FROM documents""")
def answer_check(spark, sf):
    said = F.concat(F.lit(" "), F.col("lang"), F.lit("\n"))
    return B.table(spark, sf, "documents").select("doc_id", grading.answer_check(said, F.lit("en")).alias("result"))


# -- joins with runs --------------------------------------------------------------

@query("runs_left_trials", W("recorded graded runs", """
  SELECT r.run_id, r.model, r.run_status, t.trial_id, t.task, t.status
  FROM runs r LEFT JOIN graded t ON t.run_id = r.run_id"""))
def runs_left_trials(spark, sf):
    trials = B.graded(spark, sf).select("trial_id", "run_id", "task", "status")
    runs = B.runs(spark, sf).select("run_id", "model", "run_status")
    return summaries.runs_with_trials(runs, trials)


@query("trial_with_model", W("recorded graded runs", """
  SELECT t.trial_id, t.run_id, t.task, t.status, r.model FROM graded t JOIN runs r ON r.run_id = t.run_id"""))
def trial_with_model(spark, sf):
    return (B.graded(spark, sf).select("trial_id", "run_id", "task", "status")
            .join(B.runs(spark, sf).select("run_id", "model"), "run_id"))


@query("trial_instruction", """
  SELECT d.doc_id AS trial_id, d.source AS task, l.quality AS instruction
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def trial_instruction(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    notes = B.table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(notes, "doc_id", "left").select(
        F.col("doc_id").alias("trial_id"), F.col("source").alias("task"), F.col("quality").alias("instruction"))


@query("run_complete", W("recorded graded runs", """
  , waiting AS (SELECT run_id, sum(CASE status WHEN 'queued' THEN 1 WHEN 'running' THEN 1 ELSE 0 END) AS n FROM graded GROUP BY run_id)
  SELECT runs.run_id FROM runs LEFT JOIN waiting USING (run_id) WHERE coalesce(n, 0) = 0 AND NOT list_contains(['done', 'cancelled'], run_status)"""))
def run_complete(spark, sf):
    return fleet.completed_runs(B.runs(spark, sf), B.graded(spark, sf)).select("run_id")


@query("unknown_tasks", """
  SELECT o_orderkey AS run_id, l_linenumber AS ord, p_brand AS task
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE NOT EXISTS (SELECT 1 FROM part c WHERE c.p_brand = part.p_brand AND c.p_name LIKE 'red%' AND c.p_size > 47)""")
def unknown_tasks(spark, sf):
    part = B.table(spark, sf, "part")
    asked = (B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
             .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.col("p_brand").alias("task")))
    known = part.where(F.col("p_name").startswith("red") & (F.col("p_size") > 47)).select(F.col("p_brand").alias("task"))
    return fleet.unknown_tasks(asked, known)


@query("trial_plan", """
  SELECT run_id, task, unnest(range(1, 4)) AS trial_no, 'queued' AS status,
    substr(sha256(run_id || '/' || task || '/' || unnest(range(1, 4))), 1, 12) AS id
  FROM (SELECT DISTINCT o_custkey AS run_id, o_orderpriority AS task FROM orders WHERE o_custkey % 7 <> 0
    UNION ALL SELECT run_id, task FROM (SELECT DISTINCT o_custkey AS run_id FROM orders WHERE o_custkey % 7 = 0),
      (SELECT DISTINCT o_orderpriority AS task FROM orders))""")
def trial_plan(spark, sf):
    """Every seventh run names no task and so asks for all."""
    orders = B.table(spark, sf, "orders")
    task = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority"))
    asked = (orders.select(F.col("o_custkey").alias("run_id"), task.alias("task")).distinct()
             .withColumn("trials", F.lit(3).cast("bigint")))
    plan = fleet.trial_plan(fleet.named_tasks(asked, orders.select(F.col("o_orderpriority").alias("task"))))
    return plan.select("run_id", "task", F.col("trial_no").cast("bigint").alias("trial_no"), "status", "id")


@query("short_id", """
  SELECT o_orderkey AS trial_id, substr(sha256(o_custkey || '/' || o_orderpriority || '/' || o_orderkey), 1, 12) AS id
  FROM orders""")
def short_id(spark, sf):
    return B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial_id"),
        T.short_id(F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("id"))


# -- aggregates -------------------------------------------------------------------

COUNTS_SQL = """count(t.trial_id) AS total, count(*) FILTER (WHERE t.status = 'PASS') AS passed,
  count(*) FILTER (WHERE t.status IN ('FAIL', 'TAMPER', 'LIMIT', 'ERROR')) AS failed,
  count(*) FILTER (WHERE t.status = 'TAMPER') AS tampered, count(*) FILTER (WHERE t.status = 'running') AS running"""
# Counts per status first, then one column for each wanted one.
SUMMARY_SQL = """, per_status AS (SELECT run_id, map_from_entries(list((status, n))) AS of FROM (SELECT run_id, status, count(*) AS n FROM graded GROUP BY ALL) GROUP BY run_id),
  named AS (SELECT run_id, array_to_string(list_sort(list(DISTINCT task)), ', ') AS tasks FROM graded GROUP BY run_id)
  SELECT run_id, model, run_status, created_at, finished_at, CAST(coalesce(list_sum(map_values(of)), 0) AS BIGINT) AS total, coalesce(of['PASS'], 0) AS passed,
    coalesce(of['FAIL'], 0) + coalesce(of['TAMPER'], 0) + coalesce(of['LIMIT'], 0) + coalesce(of['ERROR'], 0) AS failed,
    coalesce(of['TAMPER'], 0) AS tampered, coalesce(of['running'], 0) AS running, coalesce(tasks, '') AS tasks
  FROM runs LEFT JOIN per_status USING (run_id) LEFT JOIN named USING (run_id)"""


def _summary(spark, sf):
    trials = B.graded(spark, sf).select("run_id", "task", "status")
    return (summaries.run_summary(B.runs(spark, sf), trials)
            .withColumn("tasks", F.array_join("tasks", ", ")))


@query("run_summary", W("recorded graded runs", SUMMARY_SQL))
def run_summary(spark, sf):
    return _summary(spark, sf)


@query("recent_runs", W("recorded graded runs", SUMMARY_SQL + " ORDER BY created_at DESC, run_id LIMIT 50"))
def recent_runs(spark, sf):
    # The limit is taken on runs alone; only their trials are then counted.
    newest = summaries.recent_runs(B.runs(spark, sf))
    trials = B.graded(spark, sf).select("run_id", "task", "status")
    theirs = trials.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")  # 50 rows
    return (summaries.run_summary(newest, theirs).withColumn("tasks", F.array_join("tasks", ", "))
            .orderBy(F.col("created_at").desc(), "run_id"))


@query("latest_done_run", W("runs", "SELECT run_id, model, created_at FROM runs WHERE run_status = 'done' "
                                    "ORDER BY created_at DESC, run_id LIMIT 1"))
def latest_done_run(spark, sf):
    return (summaries.recent_runs(B.runs(spark, sf).where("run_status = 'done'"), 1)
            .select("run_id", "model", "created_at"))


@query("run_trials", W("recorded graded numbered step_counts numbered_steps", f"""
  SELECT run_id, trial_id, task, trial_no, status, steps, duration, {DETAIL_SQL} AS detail, epoch_us(started_at) AS started, {B.TRIAL_END_SQL} AS finished_at
  FROM numbered_steps"""))
def run_trials(spark, sf):
    """The trial list of every run (no result column), to be filtered by run and shown by task and number."""
    trials = B.with_steps(B.with_numbers(B.graded(spark, sf)), spark, sf)
    return trials.select("run_id", "trial_id", "task", "trial_no", "status", "steps", "duration",
                         grading.detail().alias("detail"), B.micros("started_at").alias("started"), B.trial_end().alias("finished_at"))


PAGE_SQL = f""", latest AS (SELECT run_id FROM runs WHERE run_status = 'done' ORDER BY created_at DESC, run_id LIMIT 1),
  own AS (SELECT * FROM numbered_steps WHERE run_id IN (FROM latest)),
  total AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status IN ('FAIL', 'TAMPER', 'LIMIT', 'ERROR')) AS failed,
    count(*) FILTER (WHERE status = 'TAMPER') AS tampered, count(*) FILTER (WHERE status = 'running') AS running, array_to_string(list_sort(list(DISTINCT task)), ', ') AS tasks
    FROM own GROUP BY run_id)
  SELECT run_id, model, run_status, created_at, finished_at, base_url, max_steps, limits, coalesce(total, 0) AS total, coalesce(total.passed, 0) AS passed, coalesce(failed, 0) AS failed,
    coalesce(tampered, 0) AS tampered, coalesce(running, 0) AS running, coalesce(tasks, '') AS tasks, trial_id, task, trial_no, status AS trial_status, steps, duration,
    {DETAIL_SQL} AS detail, epoch_us(started_at) AS started, {B.TRIAL_END_SQL} AS ended
  FROM latest JOIN runs USING (run_id) JOIN run_settings USING (run_id) LEFT JOIN total USING (run_id) LEFT JOIN own USING (run_id)"""


@query("run_page", W("recorded graded numbered step_counts numbered_steps runs run_settings", PAGE_SQL))
def run_page(spark, sf):
    """The page of the latest done run: its record, settings and counts, and its trials by task and number."""
    runs = B.runs(spark, sf)
    latest = summaries.recent_runs(runs.where("run_status = 'done'"), 1).select("run_id").first()
    run_id = latest and latest.run_id
    # The run's trials alone are numbered, and steps are counted for them alone.
    own = B.with_numbers(B.graded(spark, sf).where(F.col("run_id") == F.lit(run_id)))
    steps = (B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trial_id")).join(own.select("trial_id"), "trial_id", "left_semi")
             .groupBy("trial_id").agg(F.count(F.lit(1)).alias("steps")))
    trials = own.join(steps, "trial_id", "left").select(
        "run_id", "trial_id", "task", "trial_no", "status", F.coalesce("steps", F.lit(0).cast("bigint")).alias("steps"), "duration",
        grading.detail().alias("detail"), B.micros("started_at").alias("started"), B.trial_end().alias("ended"))
    page = summaries.run_page(runs.join(B.run_settings(spark, sf), "run_id"), trials, run_id)
    return page.withColumn("tasks", F.array_join("tasks", ", ")).withColumn("limits", F.array_join(grading.shown_limits(F.col("limits")), " "))


TASK_SQL = """count(*) AS trials, count(*) FILTER (WHERE passed) AS passed,
    count(*) FILTER (WHERE len(tampering) > 0) AS tampered, count(*) FILTER (WHERE violation <> '') AS resource_limited,
    CAST(sum(steps) AS DOUBLE) / count(*) AS avg_steps,
    CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS avg_seconds"""


@query("task_summary", W("recorded graded step_counts graded_steps", f"SELECT task, {TASK_SQL} FROM graded_steps GROUP BY task"))
def task_summary(spark, sf):
    return summaries.task_summary(B.with_steps(B.graded(spark, sf), spark, sf))


@query("overall_pass", W("recorded graded", """
  SELECT count(*) FILTER (WHERE passed) AS passed, (SELECT count(*) FROM orders) AS planned,
    count(*) FILTER (WHERE passed) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS rate FROM graded"""))
def overall_pass(spark, sf):
    return summaries.overall(B.graded(spark, sf), B.table(spark, sf, "orders"))


@query("run_task_groups", W("recorded graded", """
  SELECT run_id, task, total, passed, done,
    CASE WHEN done > 0 THEN CAST(floor(100.0::DOUBLE * passed / done + 0.5) AS BIGINT) || '%' ELSE '—' END AS rate
  FROM (SELECT run_id, task, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
          count(*) FILTER (WHERE status IN ('PASS','FAIL','TAMPER','LIMIT','ERROR')) AS done
        FROM graded GROUP BY 1, 2)"""))
def run_task_groups(spark, sf):
    return (summaries.run_task_groups(B.graded(spark, sf))
            .withColumn("rate", T.percent_halfup(F.col("passed"), F.col("done"))))


@query("run_progress", W("recorded graded runs", f"""
  SELECT run_id, total, passed + failed AS finished, CASE WHEN total > 0 THEN 100.0::DOUBLE * passed / total END AS passed_width,
    CASE WHEN total > 0 THEN 100.0::DOUBLE * failed / total END AS failed_width,
    CASE WHEN passed + failed > 0 THEN CAST(floor(100.0::DOUBLE * passed / (passed + failed) + 0.5) AS BIGINT) || '%'
         ELSE '—' END AS pass_rate
  FROM (SELECT r.run_id, {COUNTS_SQL} FROM runs r LEFT JOIN graded t ON t.run_id = r.run_id GROUP BY r.run_id)"""))
def run_progress(spark, sf):
    return summaries.run_progress(_summary(spark, sf))


@query("run_task_rollup", W("recorded graded", """
  SELECT run_id, task, CAST(grouping(run_id, task) AS INT) AS level, count(*) AS total,
    count(*) FILTER (WHERE status = 'PASS') AS passed,
    count(*) FILTER (WHERE status IN ('FAIL', 'TAMPER', 'LIMIT', 'ERROR')) AS failed
  FROM graded GROUP BY ROLLUP (run_id, task)"""))
def run_task_rollup(spark, sf):
    return summaries.run_task_rollup(B.graded(spark, sf))


TRIED_SQL = """
  tagged AS (SELECT run_id || '/' || task AS unit, mode, trial_id AS attempt_no, tests_passed, error, violation, tampering, duration
             FROM recorded),
  tried AS (SELECT * FROM tagged WHERE mode = 'oracle' UNION ALL
            SELECT * FROM tagged WHERE mode = 'noop'
            QUALIFY row_number() OVER (PARTITION BY unit ORDER BY attempt_no) = 1)"""
REPORT_SQL = """
  SELECT unit AS task, passes, oracles, noop, avg_seconds,
    CASE WHEN errors > 0 THEN 'ERROR'
      WHEN lim IS NOT NULL THEN 'LIMIT: ' || lim.mode || ' hit a resource limit (' || lim.violation || ')'
      WHEN touched IS NOT NULL THEN 'INVASIVE: reference solution modifies protected paths (' || touched || ')'
      WHEN passes = 0 THEN 'BROKEN: reference solution fails the tests'
      WHEN passes < oracles THEN 'FLAKY: reference solution passed only ' || passes || '/' || oracles || ' times'
      WHEN noop = 'PASS' THEN 'WEAK: tests pass without any changes' ELSE 'OK' END AS verdict
  FROM (SELECT unit, count(*) FILTER (WHERE error <> '') AS errors,
      arg_min({'mode': mode, 'violation': violation}, {'m': CASE mode WHEN 'oracle' THEN 0 ELSE 1 END, 'n': attempt_no})
        FILTER (WHERE violation <> '') AS lim,
      arg_min(array_to_string(list_slice(tampering, 1, 3), ', '), attempt_no)
        FILTER (WHERE mode = 'oracle' AND len(tampering) > 0) AS touched,
      count(*) FILTER (WHERE mode = 'oracle') AS oracles, count(*) FILTER (WHERE mode = 'oracle' AND tests_passed) AS passes,
      max(CASE WHEN error <> '' THEN 'ERROR' WHEN violation <> '' THEN 'LIMIT' WHEN tests_passed THEN 'PASS' ELSE 'FAIL' END)
        FILTER (WHERE mode = 'noop') AS noop,
      CAST(sum(CAST(duration AS DECIMAL(20,6))) FILTER (WHERE mode = 'oracle') AS DOUBLE)
        / nullif(count(*) FILTER (WHERE mode = 'oracle'), 0) AS avg_seconds
    FROM tried GROUP BY unit)"""


def _attempts(spark, sf):
    rows = B.recorded(spark, sf).select(
        F.concat_ws("/", F.col("run_id").cast("string"), "task").alias("task"), "mode",
        F.col("trial_id").alias("attempt_no"), "tests_passed", "error", "violation", "tampering", "duration")
    return summaries.attempts(rows.where("mode = 'oracle'").drop("mode"), rows.where("mode = 'noop'").drop("mode"))


@query("attempts_union", B.with_views("recorded", "").rstrip() + "," + TRIED_SQL + """
  SELECT unit AS task, mode, attempt_no, tests_passed FROM tried""")
def attempts_union(spark, sf):
    return _attempts(spark, sf).select("task", "mode", "attempt_no", "tests_passed")


@query("verdict", B.with_views("recorded", "").rstrip() + "," + TRIED_SQL + f"SELECT task, verdict FROM ({REPORT_SQL})")
def verdict(spark, sf):
    return summaries.verdicts(_attempts(spark, sf)).select("task", "verdict")


@query("check_report", B.with_views("recorded", "").rstrip() + "," + TRIED_SQL + REPORT_SQL)
def check_report(spark, sf):
    return summaries.verdicts(_attempts(spark, sf))


@query("false_success", W("recorded graded", """
  SELECT task, count(*) FILTER (WHERE finished) AS finished, count(*) FILTER (WHERE finished AND NOT passed) AS not_solved,
    count(*) FILTER (WHERE finished AND NOT passed) / CAST(count(*) FILTER (WHERE finished) AS DOUBLE) AS share
  FROM graded GROUP BY task"""))
def false_success(spark, sf):
    return summaries.false_success(B.graded(spark, sf), "task")


@query("stop_reason_hist", W("recorded", "SELECT stop_reason, count(*) AS trials FROM recorded GROUP BY 1"))
def stop_reason_hist(spark, sf):
    return B.recorded(spark, sf).groupBy("stop_reason").agg(F.count(F.lit(1)).alias("trials"))


@query("token_totals", """
  SELECT conv_id AS trial_id, CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt_tokens,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS completion_tokens,
    count(*) FILTER (WHERE role = 'assistant') AS llm_calls
  FROM conversations GROUP BY 1""")
def token_totals(spark, sf):
    reply, size = F.col("role") == "assistant", F.length("text").cast("bigint")
    usage = B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trial_id"), F.when(~reply, size).alias("prompt"), F.when(reply, size).alias("completion"), reply.alias("call"))
    return summaries.token_totals(usage)


@query("distinct_tasks", W("recorded", """
  SELECT CAST(NULL AS BIGINT) AS run_id, count(DISTINCT task) AS tasks FROM recorded
  UNION ALL SELECT run_id, count(DISTINCT task) FROM recorded GROUP BY run_id"""))
def distinct_tasks(spark, sf):
    pairs = B.recorded(spark, sf).select("run_id", "task").distinct()
    per_run = pairs.groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"))
    overall = (pairs.select("task").distinct().agg(F.count(F.lit(1)).alias("tasks"))
               .select(F.lit(None).cast("bigint").alias("run_id"), "tasks"))
    return overall.unionByName(per_run)


@query("showcase_trial", W("recorded graded numbered step_counts numbered_steps", """
  SELECT run_id, trial_id, task, trial_no, steps, status FROM numbered_steps WHERE steps > 0
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY
    CASE WHEN status = 'PASS' AND steps BETWEEN 2 AND 8 THEN 0 ELSE 1 END, steps DESC, task, trial_no) = 1"""))
def showcase_trial(spark, sf):
    return summaries.showcase_trial(B.with_steps(B.with_numbers(B.graded(spark, sf)), spark, sf))


@query("trial_no", W("recorded graded numbered", "SELECT trial_id, run_id, task, trial_no FROM numbered"))
def trial_no(spark, sf):
    return B.with_numbers(B.recorded(spark, sf).select("trial_id", "run_id", "task"))


# -- formats ----------------------------------------------------------------------

@query("model_slug", """
  SELECT p_partkey AS run_id, regexp_replace(p_name || ':' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM part""")
def model_slug(spark, sf):
    return B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("run_id"), T.model_slug(F.concat_ws(":", "p_name", "p_brand")).alias("slug"))


@query("run_dir_name", """
  SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9._-]+', '_', 'g') AS dir
  FROM events""")
def run_dir_name(spark, sf):
    model = F.concat_ws(" ", "event_type", "props")
    return B.table(spark, sf, "events").select("event_id", T.run_dir_name(F.col("ts"), model).alias("dir"))


@query("percent_halfup", """
  SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber - 1 > 0
    THEN CAST(floor(100.0::DOUBLE * l_quantity / (l_linenumber - 1) + 0.5) AS BIGINT) || '%' ELSE '—' END AS pct FROM lineitem""")
def percent_halfup(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", T.percent_halfup(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("pct"))


@query("percent_cli", W("recorded graded", """
  SELECT run_id, format('{:.0f}%', (count(*) FILTER (WHERE passed)::DOUBLE / count(*)::DOUBLE) * 100.0::DOUBLE) AS rate FROM graded GROUP BY run_id"""))
def percent_cli(spark, sf):
    return B.graded(spark, sf).groupBy("run_id").agg(T.percent_half_even(F.count_if("passed") / F.count(F.lit(1))).alias("rate"))


@query("fixed_dp", """
  SELECT event_id, format('{:.1f}', value) AS one, format('{:.2f}', value / 8) AS two FROM events""")
def fixed_dp(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", T.fixed(F.col("value"), 1).alias("one"), T.fixed(F.col("value") / 8, 2).alias("two"))


@query("round_dp", """
  SELECT event_id, CAST(format('{:.1f}', value / 4) AS DOUBLE) AS one, CAST(format('{:.2f}', value / 8) AS DOUBLE) AS two FROM events""")
def round_dp(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", T.round_dp(F.col("value") / 4, 1).alias("one"), T.round_dp(F.col("value") / 8, 2).alias("two"))


@query("bytes_to_mb", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 1048576.0::DOUBLE AS mb FROM orders")
def bytes_to_mb(spark, sf):
    size = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return B.table(spark, sf, "orders").select("o_orderkey", T.bytes_to_mb(size).alias("mb"))


@query("seconds_text", """
  SELECT event_id, CASE WHEN secs IS NULL THEN '—'
    WHEN secs < 60 THEN CASE WHEN secs * 4 = floor(secs * 4) AND CAST(floor(secs * 4) AS BIGINT) % 2 = 1
                             THEN format('{:.1f}', floor(secs * 10 + 0.5) / 10) ELSE format('{:.1f}', secs) END || 's'
    ELSE CAST(floor(secs / 60) AS BIGINT) || 'm ' || CAST(floor(secs % 60 + 0.5) AS BIGINT) || 's' END AS shown
  FROM (SELECT event_id, CASE WHEN event_type <> 'signup' THEN value / 4 + 0.25 END AS secs FROM events)""")
def seconds_text(spark, sf):
    secs = F.when(F.col("event_type") != "signup", F.col("value") / 4 + 0.25)
    return B.table(spark, sf, "events").select("event_id", T.seconds_text(secs).alias("shown"))


@query("time_ago", """
  SELECT event_id, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN CAST(floor(age / 60.0) AS BIGINT) || 'm ago'
    WHEN age < 86400 THEN CAST(floor(age / 3600.0) AS BIGINT) || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END AS shown
  FROM (SELECT event_id, ts, floor((1706745600000000 - epoch_us(ts)) / 1000000.0::DOUBLE + 0.5) AS age FROM events)""")
def time_ago(spark, sf):
    # Seen from the end of January 2024.
    return B.table(spark, sf, "events").select(
        "event_id", T.time_ago(B.micros("ts"), F.lit(1706745600000000)).alias("shown"))


@query("iso_timestamps", """
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
    || '+00:00' AS at_iso FROM events""")
def iso_timestamps(spark, sf):
    return B.table(spark, sf, "events").select("event_id", T.iso_timestamp(B.micros("ts")).alias("at_iso"))


@query("truncate_middle", """
  SELECT doc_id, CASE WHEN length(text) > 100
    THEN left(text, 50) || chr(10) || '...[' || (length(text) - 100) || ' characters truncated]...' || chr(10) || right(text, 50)
    ELSE text END AS shown FROM documents""")
def truncate_middle(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.truncate_middle(F.col("text"), 100).alias("shown"))


@query("strip_text", r"""
  SELECT doc_id, regexp_replace(regexp_replace(chr(10) || ' ' || text || chr(9) || chr(10),
    '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
    '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS stripped
  FROM documents""")
def strip_text(spark, sf):
    padded = F.concat(F.lit("\n "), F.col("text"), F.lit("\t\n"))
    return B.table(spark, sf, "documents").select("doc_id", T.strip(padded).alias("stripped"))


@query("line_count", r"SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INT) AS lines FROM documents")
def line_count(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END || '+00:00'"


@query("iso_nested", f"""
  WITH e AS (SELECT event_id, event_type, user_id, ts, unnest([1, 2]) AS n FROM events)
  SELECT event_id, event_type AS kind, n, CASE WHEN n = 1 OR user_id % 3 > 0 THEN {_ISO.format("(ts + to_seconds(n))")} END AS at, n = 1 OR user_id % 3 > 0 AS there,
    strftime(ts, '%Y-%m-%d') AS day, 'x' || event_id AS note FROM e""")
def iso_nested(spark, sf):
    """Times in structs in an array in a map, beside others, some of them missing, as ISO text."""
    ts, later = F.col("ts").cast("timestamp"), lambda n: F.timestamp_micros(B.micros("ts") + n * 1_000_000)
    entry = lambda n: F.struct(F.lit(n).alias("n"), later(n).alias("at"), F.concat(F.lit("x"), "event_id").alias("note"))
    second = F.when(F.col("user_id") % 3 > 0, entry(2))
    rows = B.table(spark, sf, "events").select(
        "event_id", F.create_map(F.col("event_type"), F.array(entry(1), second)).alias("log"), F.to_date(ts).alias("day"))
    told = T.jsonable_rows(rows)
    each = told.select("event_id", "day", F.explode("log").alias("kind", "entries")).select("event_id", "day", "kind", F.posexplode("entries").alias("i", "entry"))
    return each.select("event_id", "kind", (F.col("i") + 1).alias("n"), "entry.at", F.col("entry").isNotNull().alias("there"), "day",
                       F.concat(F.lit("x"), "event_id").alias("note"))


@query("distinct_tasks_sketched", """
  WITH r AS (SELECT l_suppkey AS run_id, l_partkey AS task FROM lineitem)
  SELECT CAST(NULL AS BIGINT) AS run_id, count(DISTINCT task) AS tasks, true AS within_bound FROM r
  UNION ALL SELECT run_id, count(DISTINCT task), true FROM r GROUP BY run_id""")
def distinct_tasks_sketched(spark, sf):
    """Exact numbers beside estimates from sketches that are kept per run; the overall estimate is merged from the runs' sketches."""
    rows = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("task"))
    kept = scratch(spark, "sketches")
    summaries.task_sketches(rows).write.parquet(kept)
    told = summaries.sketched_tasks(spark.read.parquet(kept))
    pairs = rows.distinct()
    exact = (pairs.groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"))
             .unionByName(pairs.select("task").distinct().agg(F.count(F.lit(1)).alias("tasks")).select(F.lit(None).cast("bigint").alias("run_id"), "tasks")))
    within = F.abs(F.col("estimate") - F.col("tasks")) <= summaries.SKETCH_BOUND * F.col("tasks")
    return exact.join(told.withColumnRenamed("run_id", "_run"), F.col("run_id").eqNullSafe(F.col("_run"))).select("run_id", "tasks", within.alias("within_bound"))
