"""Streams with state of their own: one batch and several, in and out of order, begun again, against the finished data."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialspark.operators import replay
from trialspark.session import scratch
from trialspark.streaming import live, stateful
from trialspark.streaming.run import drain, table_stream

from test_streaming import FEED, SEC, feed_rows, shown, streamed, table  # noqa: F401

STEPS = "trial_id bigint, idx bigint, command string, exit_code int"
SAMPLES = "trial_id bigint, us bigint, disk_mb double"
BEATS = "worker string, us bigint"
DAYS = "40 days"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


# -- repeated commands

def steps_of(trials=5, n=60, seed=4):
    rng = random.Random(seed)
    return [(t, i, rng.choice("ab") + rng.choice(["", " "]), rng.choice([0, 1, None])) for t in range(trials) for i in range(1, n + 1)]


@pytest.mark.parametrize("batches,shuffle,chunk", [(1, False, 1000), (4, False, 7), (4, True, 23)])
def test_repeats_equal_the_batch_rule(spark, batches, shuffle, chunk):
    rows = steps_of()
    got = drain(stateful.repeats(streamed(spark, rows, STEPS, batches, shuffle), chunk=chunk), "t")
    want = replay.loop_guard(spark.createDataFrame(rows, STEPS), ["idx"], F.col("idx")).select("trial_id", "idx", "repeats")
    assert table(got) == table(want)


def test_repeats_wait_for_missing_steps_and_count_deliveries_once(spark):
    path, target = scratch(spark, "in"), scratch(spark, "t")
    put(spark, path, [(1, 1, "a", 0), (1, 2, "a", 0), (1, 4, "a", 0), (1, 4, "a", 0), (None, 1, "a", 0), (2, None, "a", 0)], STEPS)
    stream = lambda: stateful.repeats(table_stream(spark, path, 1), chunk=3)
    # Step 4 opens the next chunk, which looks back to all steps before it.
    assert table(drain(stream(), "t", target)) == [(1, 1, 1), (1, 2, 2)]
    put(spark, path, [(1, 2, "a", 0), (1, 3, "b", 0), (1, 5, "a", 0)], STEPS)
    assert table(drain(stream(), "t", target)) == [(1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 3), (1, 5, 4)]
    # Nothing new: nothing is read or told again.
    assert len(table(drain(stream(), "t", target))) == 5


def test_repeats_work_grows_with_the_batch(spark):
    """Of the past a batch reads the last attempts only, however long the trial is."""
    rows = [(1, i, "a", 0) for i in range(1, 401)]
    path, target = scratch(spark, "in"), scratch(spark, "t")
    for k in range(4):
        put(spark, path, rows[100 * k:100 * k + 100], STEPS)
    stream = stateful.repeats(table_stream(spark, path, 1))
    from trialspark.streaming.run import state_settings
    with state_settings(spark):
        q = (stream.writeStream.format("parquet").option("path", f"{target}/table").option("checkpointLocation", f"{target}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [100] * 4
    state = stateful.state_of(spark, f"{target}/checkpoint", "steps").collect()
    assert [(r.trial_id, r.next, len(r.recent), r.early) for r in state] == [(1, 401, 9, [])]
    assert spark.read.parquet(f"{target}/table").where("repeats = 10").count() == 391


# -- limits by the clock

def limited(rows, timeout, disk, now):
    out = {}
    for t in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == t)
        end = (mine[0][0] + timeout * SEC, f"trial exceeded the {timeout}s time limit")
        full = [(us, f"disk usage reached {mb:.0f} MB (limit {disk} MB)") for us, mb in mine if mb > disk]
        us, reason = min(full)[:2] if full and min(full)[0] < end[0] else end[::1]
        if us <= now:
            out[t] = (reason, us)
    return out


@pytest.mark.parametrize("batches,shuffle", [(1, False), (4, False), (4, True)])
def test_time_limits_by_the_clock(spark, batches, shuffle):
    rows = sorted([(t, t * SEC + i * SEC, float(40 + (i * t) % 23)) for t in range(6) for i in range(3 + 2 * t)] + [(9, 2 * SEC, 1.0)], key=lambda r: r[1])
    rows.append((10, 60 * SEC, 1.0))  # moves the feed's time on; trial 9 sent one sample and fell silent
    got = drain(stateful.time_limits(streamed(spark, rows, SAMPLES, batches, shuffle), 8, 55, keep_seconds=1000), "t")
    final = {r.trial_id: (r.reason, r.us) for r in stateful.latest(got, "trial_id").collect()}
    assert final == limited(rows, 8, 55, 60 * SEC) and final[9] == ("trial exceeded the 8s time limit", 10 * SEC)
    if not shuffle:  # in order every trial is told on once
        assert got.count() == len(final) and got.where("version > 1").count() == 0


def test_time_limits_wait_for_late_samples_and_correct(spark):
    path, target = scratch(spark, "in"), scratch(spark, "t")
    stream = lambda late: stateful.time_limits(table_stream(spark, path, 1), 10, 50, late_by=late, keep_seconds=100)
    put(spark, path, [(1, 5 * SEC, 1.0), (2, 0, 1.0), (3, 30 * SEC, 1.0)], SAMPLES)
    got = drain(stream("10 seconds"), "t", target)
    assert table(got) == [(1, 1, "trial exceeded the 10s time limit", 15 * SEC), (2, 1, "trial exceeded the 10s time limit", 10 * SEC)]
    put(spark, path, [(2, 4 * SEC, 60.0), (1, 6 * SEC, 2.0)], SAMPLES)  # later than waited for
    got = drain(stream("10 seconds"), "t", target)
    assert {(r.trial_id, r.reason, r.corrections) for r in stateful.latest(got, "trial_id").collect()} == {
        (1, "trial exceeded the 10s time limit", 0), (2, "disk usage reached 60 MB (limit 50 MB)", 1)}
    put(spark, path, [(4, 500 * SEC, 1.0)], SAMPLES)
    assert drain(stream("10 seconds"), "t", target).count() == 4  # trial 3
    # What was told on and silent since is forgotten.
    assert {r.trial_id for r in stateful.state_of(spark, f"{target}/checkpoint", "watch").collect()} == {4}


# -- steps shown

def shown_after(spark, rows, batches, shuffle, ttl, late_by):
    target = scratch(spark, "t")
    gone = drain(stateful.shown_steps(streamed(spark, rows, FEED, batches, shuffle), ttl, late_by), "t", target)
    return stateful.shown_now(spark, f"{target}/checkpoint", ttl), gone, stateful.state_of(spark, f"{target}/checkpoint", "shown")


@pytest.mark.parametrize("batches,shuffle", [(1, False), (4, False), (4, True)])
def test_shown_steps(spark, feed_rows, batches, shuffle):  # noqa: F811
    got, gone, _ = shown_after(spark, feed_rows + feed_rows[:50], batches, shuffle, 30 * 86_400, DAYS)
    assert table(got) == shown(feed_rows) and gone.count() == 0


@pytest.mark.parametrize("batches,shuffle,late_by", [(1, False, "0 seconds"), (4, False, "0 seconds"), (4, True, DAYS)])
def test_shown_steps_expire(spark, batches, shuffle, late_by):
    def step(seq, us, trial, idx):
        return (seq, us, 0, trial, "step", None, None, idx, "c", 0, 1)
    rows = [step(0, 0, 1, 1), step(1, 10 * SEC, 2, 1), step(2, 100 * SEC, 2, 2), step(3, 130 * SEC, 3, 1)]
    got, gone, state = shown_after(spark, rows, batches, shuffle, 95, late_by)
    assert [(r[0], r[1]) for r in table(got)] == [(2, 1), (2, 2), (3, 1)]
    if late_by != DAYS:  # the list of the silent trial is gone from the state
        assert table(gone) == [(1, 1, 0)] and {r.trial_id for r in state.collect()} == {2, 3}


def test_shown_steps_leave_no_state_after_a_silent_day(spark):
    path, target = scratch(spark, "in"), scratch(spark, "t")
    day = 86_400
    put(spark, path, [(i, i * SEC, 0, i % 50, "step", None, None, 1, "c", 0, 1) for i in range(500)], FEED)
    put(spark, path, [(900, 2 * day * SEC, 0, 99, "trial", "running", None, None, None, None, 1)], FEED)
    drain(stateful.shown_steps(table_stream(spark, path, 1)), "t", target)
    assert {r.trial_id for r in stateful.state_of(spark, f"{target}/checkpoint", "shown").collect()} == {99}
    assert stateful.shown_now(spark, f"{target}/checkpoint").count() == 0


# -- silent workers

def beats_of():
    return [("w", t * SEC) for t in (0, 10, 20, 60, 70)] + [("x", t * SEC) for t in range(0, 200, 10)] + [(None, 5 * SEC)]


@pytest.mark.parametrize("batches,shuffle", [(1, False), (5, False), (5, True)])
def test_silences(spark, batches, shuffle):
    target = scratch(spark, "t")
    beats = sorted(beats_of(), key=lambda b: b[1])
    told = drain(stateful.silences(streamed(spark, beats, BEATS, batches, shuffle), 30), "t", target)
    still = stateful.state_of(spark, f"{target}/checkpoint", "open").select("worker", F.inline("sessions"))
    got = live.heartbeat_gaps(told.drop("kind").unionByName(still), 30).select("worker", "first_us", "dead_us", "beats", "open").collect()
    assert Counter(map(tuple, got)) == Counter([("w", 0, 50 * SEC, 3, False), ("w", 60 * SEC, 100 * SEC, 2, False), ("x", 0, 220 * SEC, 20, True), (None, 5 * SEC, 35 * SEC, 1, False)])
    if not shuffle:
        assert told.where("kind = 'dead'").count() == 3 and told.count() == 3
        assert {r.worker for r in still.collect()} == {"x"}  # silent workers have no state
    assert told.count() == told.distinct().count()


def test_silences_are_told_once_and_late_beats_apart(spark):
    path, target = scratch(spark, "in"), scratch(spark, "t")
    stream = lambda: stateful.silences(table_stream(spark, path, 1), 30)
    put(spark, path, [("w", 0), ("w", 10 * SEC), ("x", 100 * SEC)], BEATS)
    assert table(drain(stream(), "t", target)) == [("w", "dead", 0, 10 * SEC, 2)]
    put(spark, path, [("w", 5 * SEC), ("w", 300 * SEC), ("x", 120 * SEC)], BEATS)
    got = drain(stream(), "t", target)
    assert table(got) == [("w", "dead", 0, 10 * SEC, 2), ("w", "late", 5 * SEC, 5 * SEC, 1), ("x", "dead", 100 * SEC, 120 * SEC, 2)]
    assert drain(stream(), "t", target).count() == 3  # begun again without new beats
    merged = live.heartbeat_gaps(got.drop("kind"), 30).where("worker = 'w'").collect()
    assert [(r.first_us, r.dead_us, r.beats) for r in merged] == [(0, 40 * SEC, 3)]


# -- runs that are done

def ends_of(rows):
    first = {}
    for r in sorted(rows):
        if r[4] == "trial" and r[5] != "running":
            first.setdefault(r[2], {}).setdefault(r[3], r[0])
    return {run: (3, max(t.values())) for run, t in first.items() if len(t) == 3}


@pytest.mark.parametrize("batches,shuffle,shards", [(1, False, 16), (4, True, 2)])
def test_run_done(spark, feed_rows, batches, shuffle, shards):  # noqa: F811
    plan = spark.createDataFrame([(r, 3) for r in range(6)], "run_id bigint, planned bigint")
    got = drain(stateful.run_done(streamed(spark, feed_rows, FEED, batches, shuffle), plan, shards), "t")
    final = stateful.latest(got, "run_id").collect()
    assert {r.run_id: (r.trials, r.seq) for r in final} == ends_of(feed_rows) and len(ends_of(feed_rows)) > 2
    assert got.count() == got.select("run_id", "version").distinct().count()
    if batches == 1:
        assert got.where("version > 1").count() == 0


def test_run_done_is_told_once(spark):
    def end(seq, trial, status="PASS"):
        return (seq, seq * SEC, 1, trial, "trial", status, 5, None, None, None, 2)
    path, target = scratch(spark, "in"), scratch(spark, "t")
    plan = spark.createDataFrame([(1, 2)], "run_id bigint, planned bigint")
    stream = lambda: stateful.run_done(table_stream(spark, path, 1), plan)
    put(spark, path, [end(3, 7), end(4, 7), end(5, 8, "running"), end(6, None)], FEED)
    assert drain(stream(), "t", target).count() == 0
    put(spark, path, [end(9, 8), end(10, 8)], FEED)
    assert table(drain(stream(), "t", target)) == [(1, 1, 2, 9)]
    put(spark, path, [end(9, 8), end(12, 7)], FEED)  # delivered again, and an end after the end
    assert table(drain(stream(), "t", target)) == [(1, 1, 2, 9)]
    put(spark, path, [end(8, 8, "FAIL")], FEED)  # it had ended before
    assert table(drain(stream(), "t", target)) == [(1, 1, 2, 9), (1, 2, 2, 8)]
