"""Streaming queries. Each runs a real stream over all events until its input is used up and
returns the table it wrote; the checking SQL says the same over the finished data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import replay
from ..session import scratch
from ..streaming import lifecycle as L
from ..streaming import live, stateful
from ..streaming.run import drain, drain_updates, staged, table_stream
from . import bindings as B
from .registry import query
from .replay_queries import LOOP_SQL

W = B.with_views


def _events(spark, sf) -> DataFrame:
    return table_stream(spark, f"{sf}/events.parquet")


def feed(events: DataFrame) -> DataFrame:
    """The live feed seen in `events`: a run per user with four trials; sign-ups are status changes."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind, mark = F.col("event_type"), k % 5
    is_trial = kind == "signup"
    status = F.when(mark <= 1, "running").when(mark == 2, "PASS").when(mark == 3, "FAIL").otherwise("cancelled")
    return events.select(
        F.col("event_id").alias("seq"), B.micros("ts").alias("us"), F.col("user_id").alias("run_id"),
        (F.col("user_id") * 4 + F.floor(k / 25)).alias("trial_id"),
        F.when(is_trial, "trial").otherwise("step").alias("type"), F.when(is_trial, status).alias("status"),
        F.when(is_trial & mark.isin(2, 3), k).alias("steps"), F.when(~is_trial, k % 25 + 1).alias("idx"),
        F.when(~is_trial, kind).alias("command"),
        F.when(~is_trial, F.when(kind == "error", 1).otherwise(0)).alias("exit_code"))


B.SQL["feed"] = """
  SELECT seq, us, run_id, run_id * 4 + k // 25 AS trial_id, CASE WHEN t THEN 'trial' ELSE 'step' END AS type,
    CASE WHEN t THEN CASE WHEN k % 5 <= 1 THEN 'running' WHEN k % 5 = 2 THEN 'PASS' WHEN k % 5 = 3 THEN 'FAIL' ELSE 'cancelled' END END AS status,
    CASE WHEN t AND k % 5 IN (2, 3) THEN k END AS steps, CASE WHEN NOT t THEN k % 25 + 1 END AS idx,
    CASE WHEN NOT t THEN kind END AS command, CASE WHEN NOT t THEN CASE WHEN kind = 'error' THEN 1 ELSE 0 END END AS exit_code
  FROM (SELECT event_id AS seq, epoch_us(ts) AS us, user_id AS run_id, CAST(props ->> '$.k' AS INT) AS k,
          event_type AS kind, event_type = 'signup' AS t FROM events)"""


@query("live_status", W("feed", """
  SELECT trial_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
    arg_max(steps, seq) FILTER (WHERE steps IS NOT NULL) AS steps,
    arg_max(command, seq) FILTER (WHERE command IS NOT NULL) AS command FROM feed GROUP BY trial_id"""))
def live_status(spark, sf):
    return drain_updates(live.live_status(feed(_events(spark, sf)), ("status", "steps", "command")), ["trial_id"], "live_status")


@query("live_progress", W("feed", "SELECT trial_id, arg_max(idx, seq) AS commands FROM feed WHERE type = 'step' GROUP BY trial_id"))
def live_progress(spark, sf):
    return drain_updates(live.live_progress(feed(_events(spark, sf))), ["trial_id"], "live_progress")


@query("live_steps", W("feed", """
  , cleared AS (SELECT trial_id, max(seq) AS c FROM feed WHERE type = 'trial' GROUP BY trial_id),
  shown AS (SELECT f.* FROM feed f LEFT JOIN cleared c ON f.trial_id = c.trial_id WHERE type = 'step' AND (c.c IS NULL OR f.seq > c.c)),
  kept AS (SELECT trial_id FROM shown GROUP BY trial_id
           HAVING max(us) // 1000 + 864000000 > (SELECT max(us) // 1000 FROM feed))
  SELECT trial_id, idx, min(seq) AS seq, arg_min(command, seq) AS command FROM shown
  WHERE trial_id IN (SELECT trial_id FROM kept) GROUP BY trial_id, idx"""))
def live_steps(spark, sf):
    target = scratch(spark, "live_steps")
    drain(stateful.shown_steps(feed(_events(spark, sf)), 864_000, late_by="1 day"), "live_steps", target)
    return stateful.shown_now(spark, f"{target}/checkpoint", 864_000)


@query("run_done_alert", W("feed", """
  SELECT run_id, count(*) AS trials, max(first_end) AS seq FROM (
    SELECT run_id, trial_id, min(seq) FILTER (WHERE status IN ('PASS', 'FAIL', 'cancelled')) AS first_end FROM feed GROUP BY 1, 2)
  GROUP BY run_id HAVING count(*) = count(first_end)"""))
def run_done_alert(spark, sf):
    plan = (feed(B.table(spark, sf, "events")).select("run_id", "trial_id").distinct()
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("planned")))
    records = spark.read.schema(plan.schema).parquet(staged(plan, "runs"))  # a run's record tells how many trials it has
    outbox = drain(stateful.run_done(feed(_events(spark, sf)), records), "run_done")
    return stateful.latest(outbox, "run_id").select("run_id", "trials", "seq")


@query("stream_loop_guard", W("steps", f"SELECT trial_id, idx, CAST(repeats AS INT) AS repeats FROM ({LOOP_SQL})"))
def stream_loop_guard(spark, sf):
    steps = B.steps(spark, sf).select("trial_id", "idx", "command", "exit_code")
    return drain(stateful.repeats(table_stream(spark, staged(steps, "steps"))), "loop_guard")


@query("stream_watchdog", W("samples", """
  SELECT trial_id, arg_min(reason, us) AS reason, min(us) AS us FROM (
    SELECT trial_id, us, CASE WHEN us - start >= 1000000000000 THEN 'trial exceeded the 1000000s time limit'
      ELSE 'disk usage reached ' || format('{:.0f}', disk_mb) || ' MB (limit 200 MB)' END AS reason
    FROM (SELECT *, min(us) OVER (PARTITION BY trial_id) AS start FROM samples)
    WHERE us - start >= 1000000000000 OR disk_mb > 200) GROUP BY trial_id"""))
def stream_watchdog(spark, sf):
    timed = replay.since_start(B.samples(spark, sf))
    stream = table_stream(spark, staged(timed, "samples"))
    return drain_updates(live.stream_watchdog(stream, 1_000_000, 200), ["trial_id"], "watchdog")


@query("stream_time_limit", W("samples", """
  , s AS (SELECT trial_id, min(us) + 1000000000000 AS deadline, min(us) FILTER (WHERE disk_mb > 200) AS full_us FROM samples GROUP BY trial_id),
  f AS (SELECT p.trial_id, min('disk usage reached ' || format('{:.0f}', disk_mb) || ' MB (limit 200 MB)') AS reason
        FROM samples p JOIN s ON p.trial_id = s.trial_id AND p.us = s.full_us AND p.disk_mb > 200 GROUP BY p.trial_id),
  b AS (SELECT s.trial_id, coalesce(full_us < deadline, false) AS disk, f.reason, least(deadline, coalesce(full_us, deadline)) AS us
        FROM s LEFT JOIN f ON f.trial_id = s.trial_id)
  SELECT trial_id, CASE WHEN disk THEN reason ELSE 'trial exceeded the 1000000s time limit' END AS reason, us, 0 AS corrections
  FROM b WHERE (us + 999) // 1000 <= (SELECT max(us) FROM samples) // 1000 - 3600000"""))
def stream_time_limit(spark, sf):
    """By the clock: a trial that falls silent is told on as well. One hour of lateness is waited for."""
    samples = _events(spark, sf).select(F.col("user_id").alias("trial_id"), B.micros("ts").alias("us"), F.col("value").alias("disk_mb"))
    outbox = drain(stateful.time_limits(samples, 1_000_000, 200, late_by="1 hour"), "time_limit")
    return stateful.latest(outbox, "trial_id")


@query("heartbeat_gap", """
  WITH beat AS (SELECT user_id AS worker, epoch_us(ts) AS us FROM events WHERE event_type <> 'error'),
  marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY worker ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM beat),
  sess AS (SELECT *, sum(fresh) OVER (PARTITION BY worker ORDER BY us) AS s FROM marked)
  SELECT worker, min(us) AS first_us, max(us) + 21600000000 AS dead_us, count(*) AS beats,
    max(us) + 21600000000 > (SELECT max(us) FROM beat) AS open FROM sess GROUP BY worker, s""")
def heartbeat_gap(spark, sf):
    beats = (_events(spark, sf).where("event_type <> 'error'")
             .select(F.col("user_id").alias("worker"), B.micros("ts").alias("us")))
    target = scratch(spark, "heartbeats")
    told = drain(stateful.silences(beats, 6 * 3600, late_by="1 hour"), "heartbeats", target)
    still = stateful.state_of(spark, f"{target}/checkpoint", "open").select("worker", F.inline("sessions"))
    return live.heartbeat_gaps(told.drop("kind").unionByName(still), 6 * 3600)


def _windows(slide: int) -> str:
    return f"""
  SELECT start_us, start_us + 3600000000 AS end_us, count(*) AS commands, count(*) FILTER (WHERE exit_code <> 0) AS failures
  FROM (SELECT unnest(range(us - us % {slide}, us - 3600000000, -{slide})) AS start_us, exit_code FROM feed)
  GROUP BY start_us"""


@query("tumbling_activity", W("feed", _windows(3_600_000_000)))
def tumbling_activity(spark, sf):
    return drain_updates(live.activity(feed(_events(spark, sf)), "1 hour"), ["start_us", "end_us"], "tumbling")


@query("sliding_activity", W("feed", _windows(900_000_000)))
def sliding_activity(spark, sf):
    return drain_updates(live.activity(feed(_events(spark, sf)), "1 hour", "15 minutes"), ["start_us", "end_us"], "sliding")


@query("event_feed", W("feed", """
  SELECT run_id, type, count(*) AS events, count(status) AS statuses, count(idx) AS steps, max(seq) AS last_seq
  FROM feed GROUP BY run_id, type"""))
def event_feed(spark, sf):
    """JSON lines written, then read as a stream of typed events and stored as a table."""
    rows = feed(B.table(spark, sf, "events"))
    step = F.when(F.col("type") == "step", F.struct(F.col("idx").alias("index"), "command", "exit_code"))
    path = scratch(spark, "feed")
    rows.select("seq", "us", "run_id", "type", "trial_id", "status", "steps", step.alias("step")).write.json(path)
    stream = spark.readStream.schema(schemas.EVENT).json(path).where(F.col("type").isin("trial", "step", "run"))
    stored = drain(stream, "feed_table")
    return stored.groupBy(F.col("run_id").cast("bigint").alias("run_id"), "type").agg(
        F.count(F.lit(1)).alias("events"), F.count("status").alias("statuses"), F.count("step.index").alias("steps"),
        F.max("seq").alias("last_seq"))


def actions(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    action = (F.when(kind.isin("view", "click"), "claim").when(kind == "purchase", "finish").when(kind == "error", "crash")
              .when((kind == "signup") & (k < 8), "cancel"))
    return (events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"),
        (F.col("user_id") * 4 + F.floor(k / 25)).alias("trial_id"), action.alias("action"),
        F.when(kind == "purchase", F.when(k % 2 == 0, "PASS").otherwise("FAIL")).alias("status"))
        .where(F.col("action").isNotNull()))


B.SQL["acts"] = """
  SELECT seq, run_id, run_id * 4 + k // 25 AS trial_id, CASE WHEN kind IN ('view', 'click') THEN 'claim' WHEN kind = 'purchase' THEN 'finish'
    WHEN kind = 'error' THEN 'crash' WHEN kind = 'signup' AND k < 8 THEN 'cancel' END AS action,
    CASE WHEN kind = 'error' THEN 'ERROR' WHEN kind = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END END AS status
  FROM (SELECT event_id AS seq, user_id AS run_id, CAST(props ->> '$.k' AS INT) AS k, event_type AS kind FROM events)"""
LIFE_SQL = """
  , plan AS (SELECT DISTINCT run_id, trial_id FROM acts),
  f AS (SELECT trial_id, min(seq) FILTER (WHERE action IN ('finish', 'crash')) AS e1, max(seq) FILTER (WHERE action IN ('finish', 'crash')) AS e2,
      arg_max(status, seq) FILTER (WHERE action IN ('finish', 'crash')) AS es, min(seq) FILTER (WHERE action = 'claim') AS c1
    FROM acts GROUP BY trial_id),
  x AS (SELECT run_id, min(seq) AS x1 FROM acts WHERE action = 'cancel' GROUP BY run_id),
  j AS (SELECT p.run_id, p.trial_id, f.e1, f.e2, f.es, x.x1, coalesce(x.x1 < least(coalesce(c1, 4611686018427387904), coalesce(e1, 4611686018427387904)), false) AS cut,
      (SELECT max(seq) FROM acts c WHERE c.trial_id = p.trial_id AND action = 'claim' AND (f.e1 IS NULL OR c.seq < f.e1)) AS c2
    FROM plan p JOIN f USING (trial_id) LEFT JOIN x ON x.run_id = p.run_id),
  trial AS (SELECT run_id, trial_id, CASE WHEN es IS NOT NULL THEN es WHEN cut THEN 'cancelled' WHEN c2 IS NOT NULL THEN 'running' ELSE 'queued' END AS status,
      CASE WHEN NOT cut THEN c2 END AS started_seq, coalesce(e2, CASE WHEN cut THEN x1 END) AS finished_seq, e1, x1, cut, c2 FROM j)"""


def _lifecycle(spark, sf):
    plan = actions(B.table(spark, sf, "events")).select("run_id", "trial_id").distinct()
    return L.lifecycle(actions(_events(spark, sf)), plan, scratch(spark, "lifecycle"))


@query("lifecycle_upsert", W("acts", LIFE_SQL + "SELECT run_id, trial_id, status, started_seq, finished_seq FROM trial"))
def lifecycle_upsert(spark, sf):
    return _lifecycle(spark, sf)[0]


@query("lifecycle_runs", W("acts", LIFE_SQL + """
  SELECT run_id, CASE WHEN x1 IS NOT NULL AND (done IS NULL OR x1 < done) THEN 'cancelled' WHEN done IS NOT NULL THEN 'done'
      WHEN started THEN 'running' ELSE 'queued' END AS run_status,
    CASE WHEN x1 IS NOT NULL AND (done IS NULL OR x1 < done) THEN x1 ELSE done END AS closed_seq
  FROM (SELECT run_id, max(x1) AS x1, CASE WHEN count(e1) = count(*) THEN max(e1) END AS done,
          bool_or(c2 IS NOT NULL AND NOT cut) AS started FROM trial GROUP BY run_id)"""))
def lifecycle_runs(spark, sf):
    return _lifecycle(spark, sf)[1]
