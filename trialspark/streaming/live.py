"""Live views of running evaluations, on a feed of trial, step and run events.

Feed columns: seq (order of the feed), us (time in microseconds), run_id, trial_id, type,
status, idx, command, exit_code. Nothing depends on the order rows arrive in, within a
micro-batch or across them, or on how rows fall into batches, and no row is dropped for being late.

Where a plain aggregate does not say it all, each batch leaves its part in a log (`run.drain_batches`)
and the view merges the parts when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.replay import breaches, loop_guard
from ..plans import ordered
from ..plans.joins import join_one


def live_status(feed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Latest known value of each field per trial; an event overwrites only what it carries."""
    return feed.groupBy("trial_id").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def live_progress(feed: DataFrame) -> DataFrame:
    """Commands so far per trial: the index of its last step."""
    return feed.where("type = 'step'").groupBy("trial_id").agg(F.max_by("idx", "seq").alias("commands"))


def stream_watchdog(samples: DataFrame, trial_timeout: int, disk_limit_mb: int) -> DataFrame:
    """First breach per trial so far. Samples carry the time since their trial began, as the sampler knows it."""
    return breaches(samples, trial_timeout, disk_limit_mb)


def beat_sessions(beats: DataFrame, ttl: str) -> DataFrame:
    """One batch of beats (worker, us) as its sessions: runs of beats of a worker no further apart than `ttl`."""
    return (beats.groupBy(F.session_window(F.timestamp_micros("us"), ttl), "worker")
            .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("beats"))
            .select("worker", "first_us", "last_us", "beats"))


def heartbeat_gaps(sessions: DataFrame, ttl_seconds: int, hot_rows: int | None = None) -> DataFrame:
    """Times a worker falls silent, from the sessions of all batches; `open` where that time is yet to come.

    Sessions of different batches that overlap, or are no further apart than the time to live, are one.
    """
    ttl = ttl_seconds * 1_000_000
    parts = sessions.groupBy("worker", "first_us", "last_us").agg(F.sum("beats").alias("beats"))
    order, at = ["first_us", "last_us"], F.col("first_us")
    seen = ordered.running(parts, ["worker"], order, at, {"_before": ("max", F.col("last_us"))}, through_current=False, hot_rows=hot_rows)
    fresh = F.coalesce(F.col("first_us") - F.col("_before") > ttl, F.lit(True)).cast("int")
    numbered = ordered.running(seen.withColumn("_fresh", fresh), ["worker"], order, at, {"_session": ("sum", F.col("_fresh"))}, hot_rows=hot_rows)
    now = sessions.agg(F.max("last_us").alias("_now"))
    return (numbered.groupBy("worker", "_session").agg(F.min("first_us").alias("first_us"), (F.max("last_us") + ttl).alias("dead_us"), F.sum("beats").alias("beats"))
            .join(F.broadcast(now))  # one row
            .select("worker", "first_us", "dead_us", "beats", (F.col("dead_us") > F.col("_now")).alias("open")))


def activity(feed: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Commands and failed commands per time window so far. State is one row per window; none is closed."""
    ts = F.timestamp_micros("us")
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (feed.groupBy(span).agg(F.count(F.lit(1)).alias("commands"), F.count_if(F.col("exit_code") != 0).alias("failures"))
            .select(F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"),
                    "commands", "failures"))


def first_ends(feed: DataFrame) -> DataFrame:
    """The seq at which each trial first ended."""
    final = tuple(C.GRADED) + ("cancelled",)
    return (feed.where((F.col("type") == "trial") & F.col("status").isin(*final))
            .groupBy("run_id", "trial_id").agg(F.min("seq").alias("seq")))


def run_done_alerts(ends: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per run all of whose `planned` trials have ended, with the seq that completed it; plan: (run_id, planned)."""
    ended = ends.groupBy("run_id").agg(F.count(F.lit(1)).alias("trials"), F.max("seq").alias("seq"))
    return ended.join(plan, "run_id").where("trials = planned").select("run_id", "trials", "seq")


def attempts(steps: DataFrame) -> DataFrame:
    """What the loop guard needs of a step, as a stream leaves it in its table."""
    return steps.select("trial_id", F.col("idx").cast("bigint").alias("idx"), "command", "exit_code")


def stream_loop_guard(stored: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """`repeats` of each step so far among the last commands of its trial: the batch rule over the stored steps.

    A step that came early waits for those before it: only steps numbered without a gap are judged. A step that was
    delivered again counts once; should its deliveries differ, the same one is taken whatever their order.
    """
    at = F.col("idx")
    once = stored.groupBy("trial_id", "idx").agg(F.min(F.struct("command", "exit_code")).alias("_step")).select("trial_id", "idx", "_step.*")
    numbered = ordered.numbered(once, ["trial_id"], ["idx"], at, "_n", hot_rows=hot_rows)
    return loop_guard(numbered.where(at == F.col("_n")), ["idx"], at, hot_rows=hot_rows).select("trial_id", "idx", F.col("repeats").cast("int").alias("repeats"))


def step_changes(feed: DataFrame) -> DataFrame:
    """One batch's changes of the steps shown for running trials: `show` a step, or `clear` all up to a seq.

    A trial event (start or end) clears. `us` carries the time of a step, or the last time a trial was heard of.
    """
    shows = feed.where("type = 'step'").select("trial_id", F.lit("show").alias("op"), "seq", "idx", "command", "us")
    clears = (feed.where("type <> 'step'").groupBy("trial_id").agg(F.max("seq").alias("seq"), F.max("us").alias("us"))
              .select("trial_id", F.lit("clear").alias("op"), "seq", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("command"), "us"))
    return shows.unionByName(clears)


def shown_now(changes: DataFrame, ttl_seconds: int = C.LIVE_STEPS_SECONDS) -> DataFrame:
    """The steps shown at the end of a log of changes: per index the first since the last clearing.

    A trial without a new step for `ttl_seconds` of feed time shows none.
    """
    cleared = changes.where("op = 'clear'").groupBy("trial_id").agg(F.max("seq").alias("_cleared"))
    shows = join_one(changes.where("op = 'show'"), cleared, ["trial_id"], "left")
    live = shows.where(F.coalesce(F.col("seq") > F.col("_cleared"), F.lit(True)))
    steps = (live.groupBy("trial_id", "idx").agg(F.min("seq").alias("seq"), F.min_by("command", "seq").alias("command"), F.max("us").alias("_us")))
    clock = changes.agg(F.max("us").alias("_clock"))
    fresh = (steps.groupBy("trial_id").agg(F.max("_us").alias("_last")).join(F.broadcast(clock))  # one row
             .where(F.floor(F.col("_last") / 1000) + ttl_seconds * 1000 > F.floor(F.col("_clock") / 1000)).select("trial_id"))
    return steps.join(fresh, "trial_id", "left_semi").select("trial_id", "idx", "seq", "command")
