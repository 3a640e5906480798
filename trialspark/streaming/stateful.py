"""Streams that keep state of their own per key: start times with timers, waiting lists, open sessions, open sets.

What is emitted is emitted once: a result goes out when its timer or its set says so, and is only followed by a correction
(a higher `version`, or a row of kind `late`) where rows came later than `late_by` allows. Event time drives the timers alone:
no row is refused for being late. Rows are reduced within each Arrow batch before they are shuffled to their key, so a
key that holds much of the feed sends one row per batch of it; where a key's own work grows with its rows, it is split.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as C
from ..functions.text import fixed, strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = np.iinfo(np.int64).max
#: A trial that has been told on is forgotten after this long without a sample.
KEEP_SECONDS = 24 * 3600
#: Steps of one trial that are judged under one key of state.
CHUNK = 1000
#: Keys over which the ended trials of one run are spread.
SHARDS = 16


def clocked(stream: DataFrame, late_by: str) -> DataFrame:
    """`stream` with event time `us` behind its timers. The time column itself is not passed on, so late rows are not refused."""
    return stream.withColumn("_clock", F.timestamp_micros("us")).withWatermark("_clock", late_by).select(*stream.columns)


def reduced(stream: DataFrame, keys: list[str], sums: dict[str, tuple[str, str]], order: list[str] | None = None) -> DataFrame:
    """One row per key and Arrow batch. `sums`: new column -> (column, pyarrow aggregate); `first` takes the first non-null in `order`."""
    schema = ", ".join([f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys] +
                       [f"`{new}` {'long' if how == 'count' else stream.schema[old].dataType.simpleString()}" for new, (old, how) in sums.items()])

    def reduce(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if order:
                rows = rows.sort_by([(c, "ascending") for c in order])
            found = rows.group_by(keys, use_threads=False).aggregate(list(sums.values()))
            found = pa.table([found[c] for c in keys] + [found[f"{old}_{how}"] for old, how in sums.values()], names=[*keys, *sums])
            yield from found.to_batches()

    return stream.mapInArrow(reduce, schema)


def ceil_ms(us: int) -> int:
    return -(-us // 1000)


def rows_of(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [r for f in frames for r in zip(*(f[c].tolist() for c in columns))]


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stream as it stands: its key's columns and its value's."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    return found.select("key.*", "value.*")


# -- time and disk limits by the clock ------------------------------------------------

class Limits(StatefulProcessor):
    """Per trial: when it began, its first sample over the disk limit, and whether it has been told on."""

    def __init__(self, timeout_us: int, late_reason: str, keep_ms: int):
        self.timeout_us, self.late_reason, self.keep_ms = timeout_us, late_reason, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "start long, full_us long, reason string, last long, version int, timer long")

    def breach(self, start: int, full_us: int, reason: str | None) -> tuple[int, str]:
        """Time is checked first, as long as both are due."""
        return (full_us, reason) if full_us < start + self.timeout_us else (start + self.timeout_us, self.late_reason)

    def row(self, key, version: int, told: tuple[int, str]) -> pd.DataFrame:
        return pd.DataFrame({"trial_id": [key[0]], "version": [version], "reason": [told[1]], "us": [told[0]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        start, full_us, reason, last, version, timer = known or (NEVER, NEVER, None, -1, 0, None)
        for begun, full, why, latest in rows_of(rows, ["start", "full_us", "reason", "last"]):
            start, last = min(start, int(begun)), max(last, int(latest))
            if (int(full), why or "") < (full_us, reason or ""):
                full_us, reason = int(full), why
        told = self.breach(start, full_us, reason)
        if version and told != self.breach(*known[:3]):
            version += 1
            yield self.row(key, version, told)
        elif not version and timer != ceil_ms(told[0]):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = ceil_ms(told[0])
            self.handle.registerTimer(timer)
        self.state.update((start, full_us, reason, last, version, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, full_us, reason, last, version, timer = self.state.get()
        told = self.breach(start, full_us, reason)
        if not version:
            yield self.row(key, 1, told)
        forget = ceil_ms(max(last, told[0])) + self.keep_ms
        if forget <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        else:
            self.handle.registerTimer(forget)
            self.state.update((start, full_us, reason, last, max(1, version), forget))

    def close(self) -> None:
        pass


def time_limits(samples: DataFrame, trial_timeout: int, disk_limit_mb: int, late_by: str = "0 seconds", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """(trial_id, version, reason, us): the first breach of each trial, by the clock, from samples (trial_id, us, disk_mb).

    A trial ends `trial_timeout` seconds after its first sample, whether it sends another one or none; or at its first sample
    over the disk limit, if that comes before. It is told on once the feed's time, less `late_by`, has come to that moment.
    Samples later than that may change what was told: then a row of a higher version follows. After `keep_seconds`
    of silence a trial is forgotten. Its state is one row, and its samples are reduced before they are shuffled.
    """
    full = F.col("disk_mb") > disk_limit_mb
    reason = F.when(full, F.concat(F.lit("disk usage reached "), fixed(F.col("disk_mb"), 0), F.lit(f" MB (limit {disk_limit_mb} MB)")))
    marked = clocked(samples, late_by).select("trial_id", "us", F.when(full, F.col("us")).otherwise(F.lit(NEVER)).alias("full_us"), reason.alias("reason"))
    parts = reduced(marked, ["trial_id"], {"start": ("us", "min"), "last": ("us", "max"), "full_us": ("full_us", "min"), "reason": ("reason", "first")}, ["full_us", "reason"])
    kind = samples.schema["trial_id"].dataType.simpleString()
    return parts.groupBy("trial_id").transformWithStateInPandas(
        Limits(trial_timeout * 1_000_000, f"trial exceeded the {trial_timeout}s time limit", keep_seconds * 1000),
        f"trial_id {kind}, version int, reason string, us long", "append", "EventTime")


def latest(outbox: DataFrame, key: str) -> DataFrame:
    """The highest version of each key; `corrections` counts those before it."""
    rest = [c for c in outbox.columns if c not in (key, "version")]
    return outbox.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r"), (F.max("version") - 1).alias("corrections")).select(key, "r.*", "corrections")


# -- repeated commands ----------------------------------------------------------------

class Repeats(StatefulProcessor):
    """Per chunk of a trial's steps: the number of the next step, the attempts just before it, and steps that came early."""

    def __init__(self, window: int, chunk: int):
        self.window, self.chunk = window, chunk

    def init(self, handle) -> None:
        self.state = handle.getValueState("steps", "next long, recent array<string>, early array<struct<idx long, attempt string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = int(key[1]) * self.chunk + 1
        following, recent, early = self.state.get() or (max(1, first - self.window + 1), [], [])
        found: dict[int, str] = {}
        for idx, attempt in [*early, *rows_of(rows, ["idx", "attempt"])]:
            if idx >= following and (idx not in found or attempt < found[idx]):
                found[int(idx)] = attempt
        order = np.array(sorted(found), np.int64)
        run = order[:int((order == following + np.arange(len(order))).sum())]
        if len(run):
            line = [*recent, *(found[i] for i in run.tolist())]
            code = pd.factorize(np.array(line, object))[0]
            repeats = np.ones(len(code), np.int32)
            for back in range(1, min(self.window, len(code))):
                repeats[back:] += code[back:] == code[:-back]
            own = run >= first
            if own.any():
                yield pd.DataFrame({"trial_id": key[0], "idx": run[own], "repeats": repeats[len(recent):][own]})
            following, recent = int(run[-1]) + 1, line[-(self.window - 1):] if self.window > 1 else []
        self.state.update((following, recent, [(i, found[i]) for i in order[len(run):].tolist()]))

    def close(self) -> None:
        pass


def repeats(steps: DataFrame, window: int = C.REPEAT_WINDOW, chunk: int = CHUNK) -> DataFrame:
    """(trial_id, idx, repeats) of every step of a stream (trial_id, idx, command, exit_code), once: attempts like it among the last `window`.

    A step that comes early waits for those before it. A step that was delivered again counts once; should deliveries differ, the
    one that was judged stands (of those of one batch, the smaller). The steps of a trial are judged in chunks, each with the
    last steps of the one before, so that a long trial is not one key; a missing step holds up its chunk, and the next one
    where that looks back to it. Work and memory go with the batch: of the past only `window` - 1 attempts are read.
    """
    at = F.col("idx").cast("bigint")
    attempt = F.to_json(F.struct(strip(F.col("command")).alias("c"), F.col("exit_code").alias("x")))
    chunks = F.sequence(F.floor((at - 1) / chunk), F.floor((at + window - 2) / chunk))
    dealt = (steps.where(F.col("trial_id").isNotNull() & (at >= 1))
             .select("trial_id", at.alias("idx"), attempt.alias("attempt"), F.explode(chunks).alias("chunk")))
    kind = steps.schema["trial_id"].dataType.simpleString()
    return dealt.groupBy("trial_id", "chunk").transformWithStateInPandas(
        Repeats(window, chunk), f"trial_id {kind}, idx long, repeats int", "append", "None")


# -- steps shown for running trials -----------------------------------------------------

class Shown(StatefulProcessor):
    """Per trial: the steps since it was last cleared, when it was last heard of, and a timer that ends both."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shown", "cleared long, heard long, timer long, steps array<struct<idx int, seq long, command string, us long>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cleared, heard, timer, known = self.state.get() or (-1, -1, None, [])
        steps = set(map(tuple, known))
        for idx, seq, command, us in rows_of(rows, ["idx", "seq", "command", "us"]):
            heard = max(heard, int(us))
            if idx is None or idx != idx:
                cleared = max(cleared, int(seq))
            else:
                steps.add((int(idx), int(seq), command, int(us)))
        if timer is None:  # one that is set is moved on when it comes
            timer = heard // 1000 + self.ttl_ms
            self.handle.registerTimer(timer)
        self.state.update((cleared, heard, timer, sorted((s for s in steps if s[1] > cleared), key=lambda s: s[:2])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cleared, heard, timer, steps = self.state.get()
        due = heard // 1000 + self.ttl_ms
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
            self.state.update((cleared, heard, due, [tuple(s) for s in steps]))
            return
        self.state.clear()
        if steps:
            yield pd.DataFrame({"trial_id": [key[0]], "steps": [len(steps)], "us": [heard]})

    def close(self) -> None:
        pass


def shown_steps(feed: DataFrame, ttl_seconds: int = C.LIVE_STEPS_SECONDS, late_by: str = "0 seconds") -> DataFrame:
    """A stream that keeps the steps shown for running trials in its state; it emits (trial_id, steps, us) for lists that expire.

    A trial event (start or end) clears what came before it. A trial unheard of for `ttl_seconds` of the feed's time, less
    `late_by`, leaves no state. A trial's steps are few (its step cap), those delivered again are one.
    """
    marked = clocked(feed.select("trial_id", "type", "seq", "us", F.col("idx").cast("int").alias("idx"), "command"), late_by)
    rows = marked.select("trial_id", F.when(F.col("type") == "step", F.col("idx")).alias("idx"), "seq", "command", "us")
    parts = reduced(rows, ["trial_id", "idx", "seq", "command"], {"us": ("us", "max")})
    kind = feed.schema["trial_id"].dataType.simpleString()
    return parts.groupBy("trial_id").transformWithStateInPandas(Shown(ttl_seconds * 1000), f"trial_id {kind}, steps int, us long", "append", "EventTime")


def shown_now(spark: SparkSession, checkpoint: str, ttl_seconds: int = C.LIVE_STEPS_SECONDS) -> DataFrame:
    """The steps shown at the end of the feed, read from the stream's state: per index the first since the last clearing.

    A trial without a new step for `ttl_seconds` of feed time shows none. The feed's time is the last thing heard of any trial.
    """
    state = state_of(spark, checkpoint, "shown")
    steps = state.select("trial_id", F.inline("steps"))
    clock = state.agg(F.max("heard").alias("_clock"))
    fresh = (steps.groupBy("trial_id").agg(F.max("us").alias("_last")).join(F.broadcast(clock))  # one row
             .where(F.floor(F.col("_last") / 1000) + ttl_seconds * 1000 > F.floor(F.col("_clock") / 1000)).select("trial_id"))
    first = steps.groupBy("trial_id", "idx").agg(F.min("seq").alias("seq"), F.min_by("command", "seq").alias("command"))
    return first.join(fresh, "trial_id", "left_semi").select("trial_id", "idx", "seq", "command")


# -- workers that fall silent -----------------------------------------------------------

class Sessions(StatefulProcessor):
    """Per worker: sessions of beats that are not over, and a timer for the first of them to end."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "timer long, sessions array<struct<first_us long, last_us long, beats long>>")

    def due(self, session: tuple) -> int:
        return ceil_ms(session[1] + self.ttl_us)

    def keep(self, sessions: list[tuple], timer: int | None) -> None:
        if not sessions:
            self.state.clear()
            return
        ms = min(map(self.due, sessions))
        if timer is None or ms < timer:  # one that is set too early is moved on when it comes
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)
            timer = ms
        self.state.update((timer, sessions))

    def rows(self, key, kind: str, sessions: list[tuple]) -> pd.DataFrame:
        first, last, beats = (np.array(c, np.int64) for c in zip(*sessions))
        return pd.DataFrame({"worker": key[0], "kind": kind, "first_us": first, "last_us": last, "beats": beats})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, known = self.state.get() or (None, [])
        merged: list[list[int]] = []
        for first, last, beats, was_open in sorted([(*s, True) for s in known] + [(*map(int, r), False) for r in rows_of(rows, ["first_us", "last_us", "beats"])]):
            if merged and first - merged[-1][1] <= self.ttl_us:
                merged[-1] = [merged[-1][0], max(merged[-1][1], last), merged[-1][2] + beats, merged[-1][3] or was_open]
            else:
                merged.append([first, last, beats, was_open])
        # What was over before it was heard of belongs to a time that has been told already.
        late = [tuple(s[:3]) for s in merged if not s[3] and self.due(s) <= now]
        if late:
            yield self.rows(key, "late", late)
        self.keep([tuple(s[:3]) for s in merged if s[3] or self.due(s) > now], timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = [tuple(s) for s in self.state.get()[1]]
        over = [s for s in known if self.due(s) <= now]
        self.keep([s for s in known if self.due(s) > now], None)
        if over:
            yield self.rows(key, "dead", over)

    def close(self) -> None:
        pass


def silences(beats: DataFrame, ttl_seconds: int, late_by: str = "0 seconds") -> DataFrame:
    """(worker, kind, first_us, last_us, beats): a row of kind `dead`, once, for every session of beats (worker, us) that has ended.

    A session ends `ttl_seconds` after its last beat; it is told once the feed's time, less `late_by`, has come to that. Beats that
    come for a time already told are a row of kind `late` each run of them: `live.heartbeat_gaps` merges both. A silent worker has
    no state. Beats become sessions within each Arrow batch before they are shuffled.
    """
    ttl_us = ttl_seconds * 1_000_000
    kind = beats.schema["worker"].dataType.simpleString()

    def runs(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by([("worker", "ascending"), ("us", "ascending")])
            code, us = rows["worker"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False), rows["us"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (us[1:] - us[:-1] > ttl_us)]))[:len(us)]
            stop = np.append(start[1:], len(us))
            yield from pa.table({"worker": rows["worker"].take(pa.array(start)), "first_us": us[start], "last_us": us[stop - 1] if len(us) else us, "beats": stop - start}).to_batches()

    parts = clocked(beats.select("worker", "us"), late_by).mapInArrow(runs, f"worker {kind}, first_us long, last_us long, beats long")
    return parts.groupBy("worker").transformWithStateInPandas(
        Sessions(ttl_us), f"worker {kind}, kind string, first_us long, last_us long, beats long", "append", "EventTime")


# -- runs that are done -----------------------------------------------------------------

class Ended(StatefulProcessor):
    """Per run and shard of its trials: the seq at which each of them first ended."""

    def init(self, handle) -> None:
        self.trials = handle.getMapState("trials", "trial_id string", "seq long")
        self.total = handle.getValueState("total", "ended long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended, top = self.total.get() or (0, -1)
        first: dict[str, int] = {}
        planned = 0
        for trial, seq, plan in rows_of(rows, ["trial", "seq", "planned"]):
            first[trial], planned = min(int(seq), first.get(trial, NEVER)), int(plan)
        moved = False
        for trial, seq in first.items():
            known = self.trials.getValue((trial,))
            if known is None or seq < known[0]:
                self.trials.updateValue((trial,), (seq,))
                moved, ended = True, ended + (known is None)
                if known is not None and known[0] == top:  # the last one ended earlier than was known
                    top = max(v[0] for v in self.trials.values())
                top = max(top, seq)
        if moved:
            self.total.update((ended, top))
            yield pd.DataFrame({"run_id": [key[0]], "shard": [int(key[1])], "planned": [planned], "ended": [ended], "seq": [top]})

    def close(self) -> None:
        pass


class Done(StatefulProcessor):
    """Per run: what its shards have counted, and what was told."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "shards array<struct<shard int, ended long, seq long>>, version int, told long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shards, version, told = self.state.get() or ([], 0, -1)
        known = {int(s[0]): (int(s[1]), int(s[2])) for s in shards}
        planned = 0
        for shard, ended, seq, plan in sorted(rows_of(rows, ["shard", "ended", "seq", "planned"])):
            known[int(shard)], planned = (int(ended), int(seq)), int(plan)
        trials, seq = sum(e for e, _ in known.values()), max(s for _, s in known.values())
        if trials == planned and seq != told:
            version, told = version + 1, seq
            yield pd.DataFrame({"run_id": [key[0]], "version": [version], "trials": [trials], "seq": [seq]})
        self.state.update(([(s, e, q) for s, (e, q) in sorted(known.items())], version, told))

    def close(self) -> None:
        pass


def run_done(feed: DataFrame, plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(run_id, version, trials, seq): once for every run all of whose `planned` trials have ended, with the seq that completed it.

    plan: (run_id, planned), the run records, a table. An end event that precedes one already counted may move `seq`: then a row of a
    higher version follows. A run's trials are spread over `shards` keys, so that a large run is not one key.
    """
    final = [*C.GRADED, "cancelled"]
    ends = feed.where((F.col("type") == "trial") & F.col("status").isin(*final) & F.col("trial_id").isNotNull()).select("run_id", F.col("trial_id").cast("string").alias("trial"), "seq")
    parts = reduced(ends, ["run_id", "trial"], {"seq": ("seq", "min")})
    known = parts.join(plan.select("run_id", F.col("planned").cast("bigint").alias("planned")), "run_id")
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("trial"), F.lit(shards)).cast("int"))
    kind = feed.schema["run_id"].dataType.simpleString()
    counted = dealt.groupBy("run_id", "shard").transformWithStateInPandas(
        Ended(), f"run_id {kind}, shard int, planned long, ended long, seq long", "append", "None")
    return counted.groupBy("run_id").transformWithStateInPandas(Done(), f"run_id {kind}, version int, trials long, seq long", "append", "None")
