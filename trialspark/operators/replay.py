"""Stop rules of a trial replayed over its recorded replies, calls, commands and samples.

Each rule is a running value over the whole record; the earliest rule to fire ends the trial,
so a rule need not know of the others. Running values come from `plans.ordered`, which keeps
a hot trial parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import fixed, strip
from ..plans import ordered

KEY = ["trial_id"]


def loop_guard(steps: DataFrame, order: list[str], position: Column,
               window: int = C.REPEAT_WINDOW, warn: int = C.REPEAT_WARN, stop: int = C.REPEAT_STOP,
               hot_rows: int | None = None) -> DataFrame:
    """Add `repeats` (same command and exit code among the last ten) and `warned`, `stuck`."""
    attempt = F.struct(strip(F.col("command")).alias("c"), F.col("exit_code").alias("x"))
    seen = ordered.recent(steps.withColumn("_attempt", attempt), KEY, order, position, "_recent",
                          F.col("_attempt"), window, hot_rows)
    # A struct equals another when null exit codes match too.
    repeats = F.size(F.filter("_recent", lambda a: a.eqNullSafe(F.col("_attempt"))))
    return (seen.withColumn("repeats", repeats).drop("_recent", "_attempt")
            .withColumn("warned", F.col("repeats").between(warn, stop - 1))
            .withColumn("stuck", F.col("repeats") >= stop))


def stuck_at(guarded: DataFrame) -> DataFrame:
    """First stuck step per trial, with its command."""
    return (guarded.where("stuck").groupBy(*KEY)
            .agg(F.min("idx").alias("stuck_idx"), F.min_by(strip(F.col("command")), "idx").alias("command")))


def nudges(replies: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Prose replies so far: the first is nudged, the second ends the trial."""
    talk = (F.col("n_calls") == 0) & ~F.col("failed")
    counted = ordered.running(replies, KEY, ["reply"], F.col("reply"),
                              {"prose": ("sum", talk.cast("bigint"))}, hot_rows=hot_rows)
    return (counted.withColumn("nudged", talk & (F.col("prose") == 1))
            .withColumn("gave_up", talk & (F.col("prose") >= C.PROSE_STOP)))


def token_use(replies: DataFrame, budget: int = C.TOKEN_BUDGET, hot_rows: int | None = None) -> DataFrame:
    """Tokens used before each reply; the reply is never asked for once the budget is gone."""
    used = ordered.running(replies, KEY, ["reply"], F.col("reply"),
                           {"used": ("sum", F.coalesce("tokens", F.lit(0)).cast("bigint"))},
                           through_current=False, hot_rows=hot_rows)
    return used.withColumn("over_budget", F.col("used") >= budget)


def runnable(name: Column, command: Column) -> Column:
    return (name == "run_shell") & F.coalesce(strip(command) != "", F.lit(False))


def call_result(calls: DataFrame) -> DataFrame:
    """Whether a call is run, ends the trial, or is answered with an error text."""
    ok = runnable(F.col("name"), F.col("command"))
    return calls.withColumn("outcome", F.when(F.col("name") == "finish", "finish").when(ok, "run")
                            .otherwise(C.BAD_CALL_TEXT))


def step_cap(calls: DataFrame, max_steps: int, hot_rows: int | None = None) -> DataFrame:
    """Commands run before each call, and whether the call is refused because of the cap."""
    is_run = runnable(F.col("name"), F.col("command")).cast("bigint")
    counted = ordered.running(calls, KEY, ["reply", "call"], F.col("reply"),
                              {"run_before": ("sum", is_run)}, through_current=False, hot_rows=hot_rows)
    return counted.withColumn("capped", F.col("run_before") >= max_steps)


def stop_reasons(replies: DataFrame, calls: DataFrame, max_steps: int = C.MAX_STEPS,
                 budget: int = C.TOKEN_BUDGET) -> DataFrame:
    """Where and why each trial stops: the earliest rule wins.

    replies(trial_id, reply, tokens, failed, violated_before, n_calls),
    calls(trial_id, reply, call, name, command, exit_code, violated). No trial goes beyond
    `max_steps` replies, so later ones are cut before anything is shuffled, which bounds
    every group: plain windows do.
    """
    hot_rows = ordered.BOUNDED
    replies = replies.where(F.col("reply") <= max_steps)
    calls = calls.where(F.col("reply") <= max_steps)

    none, at, nth = F.lit(0), F.col("reply"), F.col("call")
    # One pass over the replies yields every reply rule at once, and likewise for calls.
    told = nudges(token_use(replies, budget, hot_rows), hot_rows)
    by_reply = F.array(
        _rule(F.col("violated_before"), 0, none, 0, "resource_limit"),
        _rule(F.col("over_budget"), 0, none, 1, "token_budget"),
        _rule(F.col("failed"), 1, none, 0, "llm_error"),
        _rule(F.col("gave_up"), 2, none, 0, "no_tool_call"),
        _rule(at == max_steps, 9, none, 0, "max_steps"))
    capped = step_cap(calls, max_steps, hot_rows)
    is_run = runnable(F.col("name"), F.col("command"))
    done = (capped.where(is_run)
            .withColumn("idx", F.col("run_before") + 1)
            .select("trial_id", "reply", "call", "idx", "command", "exit_code"))
    guarded = loop_guard(done, ["idx"], F.col("idx"), hot_rows=hot_rows)
    stuck = _fired(guarded, F.array(_rule(F.col("stuck"), 3, nth, 3, "stuck")))
    by_call = F.array(
        _rule(F.col("capped"), 3, nth, 0, "max_steps"),
        _rule(F.col("name") == "finish", 3, nth, 1, "finished"),
        _rule(is_run & F.col("violated"), 3, nth, 2, "resource_limit"))
    fired = (_fired(told, by_reply).unionByName(_fired(capped, by_call)).unionByName(stuck))
    first = F.struct("reply", "phase", "call", "rank")
    ends = (fired.groupBy("trial_id")
            .agg(F.min_by(F.struct("reason", "reply", "call"), first).alias("s")).select("trial_id", "s.*"))
    return ends.withColumnRenamed("reason", "stop_reason")


def _rule(when: Column, phase: int, call: Column, rank: int, reason: str) -> Column:
    return F.when(when, F.struct(F.lit(phase).alias("phase"), call.cast("bigint").alias("call"),
                                 F.lit(rank).alias("rank"), F.lit(reason).alias("reason")))


def _fired(rows: DataFrame, rules: Column) -> DataFrame:
    return (rows.select("trial_id", F.col("reply").cast("bigint").alias("reply"),
                        F.explode(F.array_compact(rules)).alias("r"))
            .select("trial_id", "reply", "r.*"))


def first_thoughts(calls: DataFrame) -> DataFrame:
    """The reply's text belongs to its first command only. One aggregate per reply, no sort."""
    run = calls.where(runnable(F.col("name"), F.col("command")))
    first = run.groupBy("trial_id", "reply").agg(F.min("call").alias("call"))
    return (run.join(first.withColumn("_first", F.lit(True)), ["trial_id", "reply", "call"], "left")
            .withColumn("shown_thought", F.when(F.col("_first"), F.col("thought")).otherwise(""))
            .drop("_first"))


def since_start(samples: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Add `elapsed_us` since the trial's first sample: its running minimum, so no join is needed."""
    begun = ordered.running(samples, KEY, ["us"], F.col("us"), {"_start": ("min", F.col("us"))}, hot_rows=hot_rows)
    return begun.withColumn("elapsed_us", F.col("us") - F.col("_start")).drop("_start")


def watchdog(samples: DataFrame, trial_timeout: int, disk_limit_mb: int, hot_rows: int | None = None) -> DataFrame:
    """First breach per trial from (trial_id, us, disk_mb); the start is the first sample."""
    return breaches(since_start(samples, hot_rows), trial_timeout, disk_limit_mb)


def breaches(samples: DataFrame, trial_timeout: int, disk_limit_mb: int) -> DataFrame:
    """First breach per trial from (trial_id, us, elapsed_us, disk_mb); time is checked before disk.

    A filter and a minimum, on tables and streams alike: a hot trial is reduced before the shuffle.
    """
    late, full = F.col("elapsed_us") >= trial_timeout * 1_000_000, F.col("disk_mb") > disk_limit_mb
    reason = (F.when(late, F.lit(f"trial exceeded the {trial_timeout}s time limit"))
              .otherwise(F.concat(F.lit("disk usage reached "), fixed(F.col("disk_mb"), 0),
                                  F.lit(f" MB (limit {disk_limit_mb} MB)"))))
    return (samples.where(late | full).groupBy("trial_id")
            .agg(F.min_by(reason, F.struct(F.col("us"), reason)).alias("reason"), F.min("us").alias("us")))


def running_peak(samples: DataFrame, hot_rows: int | None = None) -> DataFrame:
    return ordered.running(samples, KEY, ["us"], F.col("us"), {"peak_mb": ("max", F.col("disk_mb"))},
                           hot_rows=hot_rows)


def timeline(steps: DataFrame, order: list[str], position: Column, speed: int = 1,
             hot_rows: int | None = None) -> DataFrame:
    """When each step appears in a replay, and how long its recorded frame is held."""
    nxt = ordered.neighbour(steps, KEY, order, position, "_next", F.col("us"), following=True,
                            hot_rows=hot_rows)
    hold = (F.col("_next") - F.col("us")) / F.lit(1_000_000.0)
    return (nxt.withColumn("shown_at", F.col("idx") * F.lit(C.REPLAY_SECONDS) / F.lit(speed))
            .withColumn("hold", F.coalesce(hold, F.lit(C.LAST_FRAME_SECONDS))).drop("_next"))


def dedupe_steps(arrivals: DataFrame) -> DataFrame:
    """The first arrival of each step index."""
    rest = [c for c in arrivals.columns if c not in ("trial_id", "idx")]
    return (arrivals.groupBy("trial_id", "idx").agg(F.min_by(F.struct(*rest), F.struct("us", "event_id")).alias("r"))
            .select("trial_id", "idx", "r.*"))


def content_before_delete(log: DataFrame, position: Column, hot_rows: int | None = None) -> DataFrame:
    """For each deletion (null content) of (path, seq, content): the content just before it."""
    seen = F.when(F.col("content").isNotNull(), F.struct("seq", "content"))
    past = ordered.running(log.withColumn("_seen", seen), ["path"], ["seq"], position,
                           {"_last": ("max", F.col("_seen"))}, through_current=False, hot_rows=hot_rows)
    return (past.where(F.col("content").isNull())
            .select("path", "seq", F.col("_last.seq").alias("restored_seq"), F.col("_last.content").alias("restored")))


def latest_content(log: DataFrame) -> DataFrame:
    """Content of every path that still exists at the end of the log."""
    last = log.groupBy("path").agg(F.max_by(F.struct("seq", "content"), "seq").alias("r"))
    return last.select("path", "r.*").where(F.col("content").isNotNull())
