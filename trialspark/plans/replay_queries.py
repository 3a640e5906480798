"""Queries over steps, replies, calls and samples: the stop rules and the replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import calls as K
from ..operators import replay
from . import bindings as B
from . import ordered
from .registry import query

W = B.with_views
TRIAL, ORDER = ["trial_id"], ["us", "event_id"]


@query("step_index", W("steps", "SELECT trial_id, event_id, idx FROM steps"))
def step_index(spark, sf):
    return B.steps(spark, sf).select("trial_id", "event_id", "idx")


LOOP_SQL = """SELECT *, count(*) OVER (PARTITION BY trial_id, trim(command), exit_code ORDER BY idx
  RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS repeats FROM steps"""


def guarded(spark, sf):
    return replay.loop_guard(B.steps(spark, sf, cut=True), ORDER, F.col("us"))


@query("loop_guard", W("steps", f"""
  SELECT trial_id, idx, CAST(repeats AS INT) AS repeats, repeats BETWEEN 3 AND 4 AS warned, repeats >= 5 AS stuck
  FROM ({LOOP_SQL})"""))
def loop_guard(spark, sf):
    return guarded(spark, sf).select("trial_id", "idx", "repeats", "warned", "stuck")


@query("stuck_trials", W("steps", f"""
  SELECT trial_id, min(idx) AS stuck_idx, arg_min(trim(command), idx) AS command FROM ({LOOP_SQL})
  WHERE repeats >= 5 GROUP BY trial_id"""))
def stuck_trials(spark, sf):
    return replay.stuck_at(guarded(spark, sf))


def _replies(spark, sf):
    # The step cap also ends the replies, so what is left of each trial is small.
    rows = B.replies(spark, sf).where(F.col("reply") <= C.MAX_STEPS).drop("_hot", "_chunk")
    before = ordered.running(rows, TRIAL, ["reply"], F.col("reply"), {"_v": ("sum", F.col("violated").cast("bigint"))},
                             through_current=False, hot_rows=ordered.BOUNDED)
    return before.withColumn("violated_before", F.col("_v") > 0).drop("_v")


@query("prose_nudge", W("replies", """
  SELECT trial_id, reply, prose, talk AND prose = 1 AS nudged, talk AND prose >= 2 AS gave_up
  FROM (SELECT *, CAST(sum(CASE WHEN talk THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY reply) AS BIGINT) AS prose
        FROM (SELECT *, n_calls = 0 AND NOT failed AS talk FROM replies))"""))
def prose_nudge(spark, sf):
    return replay.nudges(B.replies(spark, sf)).select("trial_id", "reply", "prose", "nudged", "gave_up")


@query("token_budget", W("replies", """
  SELECT trial_id, reply, used, used >= 4000 AS over_budget FROM (
    SELECT trial_id, reply, CAST(coalesce(sum(tokens) OVER (PARTITION BY trial_id ORDER BY reply
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM replies)"""))
def token_budget(spark, sf):
    return replay.token_use(B.replies(spark, sf), budget=4000).select("trial_id", "reply", "used", "over_budget")


RUN_SQL = "(name = 'run_shell' AND trim(command) <> '')"


@query("step_cap", W("replies calls", f"""
  SELECT trial_id, reply, call, run_before, run_before >= 30 AS capped FROM (
    SELECT trial_id, reply, call, CAST(coalesce(sum(CASE WHEN {RUN_SQL} THEN 1 ELSE 0 END) OVER (
      PARTITION BY trial_id ORDER BY reply, call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run_before
    FROM calls)"""))
def step_cap(spark, sf):
    calls = B.calls(B.replies(spark, sf))
    return replay.step_cap(calls, 30).select("trial_id", "reply", "call", "run_before", "capped")


@query("call_validity", W("replies calls", f"""
  SELECT trial_id, reply, call, CASE WHEN name = 'finish' THEN 'finish' WHEN {RUN_SQL} THEN 'run'
    ELSE 'error: call run_shell with a non-empty ''command'' string, or call finish.' END AS outcome FROM calls"""))
def call_validity(spark, sf):
    calls = B.calls(B.replies(spark, sf))
    return replay.call_result(calls).select("trial_id", "reply", "call", "outcome")


@query("stop_reason", W("replies calls", f"""
  , told AS (SELECT *, n_calls = 0 AND NOT failed AS talk,
      coalesce(sum(tokens) OVER earlier, 0) AS used, coalesce(sum(CASE WHEN violated THEN 1 ELSE 0 END) OVER earlier, 0) AS hits
    FROM replies WINDOW earlier AS (PARTITION BY trial_id ORDER BY reply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  talked AS (SELECT *, sum(CASE WHEN talk THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY reply) AS prose FROM told),
  capped AS (SELECT *, coalesce(sum(CASE WHEN {RUN_SQL} THEN 1 ELSE 0 END) OVER (
      PARTITION BY trial_id ORDER BY reply, call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM calls),
  looped AS (SELECT *, count(*) OVER (PARTITION BY trial_id, trim(command), exit_code ORDER BY before
      RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS repeats FROM capped WHERE {RUN_SQL}),
  fired AS (
    SELECT trial_id, reply, 0 AS phase, 0 AS call, 0 AS rnk, 'resource_limit' AS reason FROM talked WHERE hits > 0
    UNION ALL SELECT trial_id, reply, 0, 0, 1, 'token_budget' FROM talked WHERE used >= 4000
    UNION ALL SELECT trial_id, reply, 1, 0, 0, 'llm_error' FROM talked WHERE failed
    UNION ALL SELECT trial_id, reply, 2, 0, 0, 'no_tool_call' FROM talked WHERE talk AND prose >= 2
    UNION ALL SELECT trial_id, reply, 3, call, 0, 'max_steps' FROM capped WHERE before >= 30
    UNION ALL SELECT trial_id, reply, 3, call, 1, 'finished' FROM capped WHERE name = 'finish'
    UNION ALL SELECT trial_id, reply, 3, call, 2, 'resource_limit' FROM capped WHERE {RUN_SQL} AND violated
    UNION ALL SELECT trial_id, reply, 3, call, 3, 'stuck' FROM looped WHERE repeats >= 5
    UNION ALL SELECT trial_id, reply, 9, 0, 0, 'max_steps' FROM talked WHERE reply = 30)
  SELECT trial_id, reason AS stop_reason, reply, CAST(call AS BIGINT) AS call FROM fired
  QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY reply, phase, call, rnk) = 1"""))
def stop_reason(spark, sf):
    replies = _replies(spark, sf)
    return replay.stop_reasons(replies, B.calls(replies), max_steps=30, budget=4000)


@query("thought_first", W("replies calls", f"""
  SELECT trial_id, reply, call, CASE WHEN row_number() OVER (PARTITION BY trial_id, reply ORDER BY call) = 1
    THEN 'because ' || reply ELSE '' END AS thought FROM calls WHERE {RUN_SQL}"""))
def thought_first(spark, sf):
    calls = (B.calls(B.replies(spark, sf))
             .withColumn("thought", F.concat(F.lit("because "), F.col("reply"))))
    return replay.first_thoughts(calls).select("trial_id", "reply", "call", F.col("shown_thought").alias("thought"))


# -- samples ----------------------------------------------------------------------

WATCH_SQL = """
  SELECT trial_id, min(us) AS us, arg_min(reason, us) AS reason FROM (
    SELECT trial_id, us, CASE WHEN us - start >= 1000000000000 THEN 'trial exceeded the 1000000s time limit'
      ELSE 'disk usage reached ' || format('{:.0f}', disk_mb) || ' MB (limit 200 MB)' END AS reason
    FROM (SELECT *, min(us) OVER (PARTITION BY trial_id) AS start FROM samples)
    WHERE us - start >= 1000000000000 OR disk_mb > 200) GROUP BY trial_id"""


@query("watchdog", W("samples", WATCH_SQL))
def watchdog(spark, sf):
    return replay.watchdog(B.samples(spark, sf), trial_timeout=1_000_000, disk_limit_mb=200)


@query("peak_disk", W("samples", "SELECT trial_id, max(disk_mb) AS peak_mb, "
                                 "CAST(format('{:.1f}', max(disk_mb)) AS DOUBLE) AS shown_mb FROM samples GROUP BY 1"))
def peak_disk(spark, sf):
    from ..functions.text import round_dp
    peak = B.samples(spark, sf).groupBy("trial_id").agg(F.max("disk_mb").alias("peak_mb"))
    return peak.withColumn("shown_mb", round_dp(F.col("peak_mb"), 1))


@query("running_peak", W("samples", "SELECT trial_id, us, max(disk_mb) OVER (PARTITION BY trial_id ORDER BY us "
                                    "ROWS UNBOUNDED PRECEDING) AS peak_mb FROM samples"))
def running_peak(spark, sf):
    return replay.running_peak(B.samples(spark, sf)).select("trial_id", "us", "peak_mb")


@query("replay_timeline", W("steps", """
  SELECT trial_id, idx, idx * 1.2::DOUBLE / 2 AS shown_at,
    coalesce((lead(us) OVER (PARTITION BY trial_id ORDER BY idx) - us) / 1000000.0::DOUBLE, 2.5::DOUBLE) AS hold FROM steps"""))
def replay_timeline(spark, sf):
    cut = B.steps(spark, sf, cut=True)
    return replay.timeline(cut, speed=2, order=ORDER, position=F.col("us")).select("trial_id", "idx", "shown_at", "hold")


@query("dedupe_steps", W("clicks", """
  SELECT trial_id, CAST(props ->> '$.k' AS INT) AS idx, event_type AS command FROM clicks
  QUALIFY row_number() OVER (PARTITION BY trial_id, CAST(props ->> '$.k' AS INT) ORDER BY us, event_id) = 1"""))
def dedupe_steps(spark, sf):
    arrivals = B.clicks(spark, sf).select("trial_id", F.get_json_object("props", "$.k").cast("int").alias("idx"),
                                          "us", "event_id", F.col("event_type").alias("command"))
    return replay.dedupe_steps(arrivals).select("trial_id", "idx", "command")


# -- tool calls -------------------------------------------------------------------

@query("native_tool_calls", W("messages", """
  SELECT trial_id, turn, 0 AS call, 'c' || turn AS call_id, 'run_shell' AS name, 'ls ' || n AS command FROM messages WHERE turn % 3 = 1
  UNION ALL SELECT trial_id, turn, 1, 'call_1', 'finish', NULL FROM messages WHERE turn % 3 = 1"""))
def native_tool_calls(spark, sf):
    found = K.native_calls(B.messages(spark, sf))
    return found.select("trial_id", "turn", "call", "call_id", "name", K.command_of(F.col("args")).alias("command"))


@query("text_tool_calls", W("messages", """
  SELECT trial_id, turn, 0 AS call, 'text_call_0' AS call_id, 'run_shell' AS name, 'echo ' || n AS command FROM messages WHERE turn % 3 = 2
  UNION ALL SELECT trial_id, turn, 1, 'text_call_1', 'finish', NULL FROM messages WHERE turn % 3 = 2"""))
def text_tool_calls(spark, sf):
    found = K.text_calls(B.messages(spark, sf))
    return found.select("trial_id", "turn", "call", "call_id", "name", K.command_of(F.col("args")).alias("command"))


@query("tool_calls", W("messages", """
  SELECT trial_id, turn, turn % 3 = 1 AS native, 2::BIGINT AS calls FROM messages WHERE turn % 3 <> 0"""))
def tool_calls(spark, sf):
    return (K.tool_calls(B.messages(spark, sf)).groupBy("trial_id", "turn", "native")
            .agg(F.count(F.lit(1)).alias("calls")))
