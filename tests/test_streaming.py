"""Streams over several micro-batches, in and out of order, against the finished data."""

import random

import pytest
from pyspark.sql import functions as F

from trialspark.operators import replay
from trialspark.session import scratch
from trialspark.streaming import lifecycle as L
from trialspark.streaming import live
from trialspark.streaming.run import drain, drain_batches, drain_updates, table_stream

FEED = ("seq bigint, us bigint, run_id bigint, trial_id bigint, type string, status string, steps int, idx int, command string, "
        "exit_code int, planned bigint")
SEC = 1_000_000


def streamed(spark, rows, schema, batches, shuffle=False):
    """Rows in `batches` files, one file per micro-batch."""
    rows = list(rows)
    if shuffle:
        random.Random(2).shuffle(rows)
    path = scratch(spark, "in")
    size = -(-len(rows) // batches)
    for b in range(batches):
        part = rows[b * size:(b + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return table_stream(spark, path, files_per_batch=1)


@pytest.fixture(scope="module")
def feed_rows():
    rng = random.Random(11)
    rows, us = [], 0
    for seq in range(400):
        us += rng.randint(1, 90) * SEC
        run = rng.randrange(6)
        trial = run * 3 + rng.randrange(3)
        if rng.random() < 0.2:
            status = rng.choice(["running", "PASS", "FAIL"])
            rows.append((seq, us, run, trial, "trial", status, 5 if status != "running" else None, None, None, None, 3))
        else:
            rows.append((seq, us, run, trial, "step", None, None, rng.randint(1, 8), rng.choice("abc"), rng.choice([0, 1]), 3))
    return rows


def table(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shuffle", [False, True])
def test_live_status_and_progress(spark, feed_rows, shuffle):
    fields = ("status", "steps", "command")
    whole = spark.createDataFrame(feed_rows, FEED)
    got = drain_updates(live.live_status(streamed(spark, feed_rows, FEED, 4, shuffle), fields), ["trial_id"], "t")
    assert table(got) == table(live.live_status(whole, fields))
    got = drain_updates(live.live_progress(streamed(spark, feed_rows, FEED, 4, shuffle)), ["trial_id"], "t")
    assert table(got) == table(live.live_progress(whole))


def shown(rows):
    lists = {}
    for r in sorted(rows):
        if r[4] == "trial":
            lists[r[3]] = {}
        else:
            lists.setdefault(r[3], {}).setdefault(r[7], (r[0], r[8]))
    return sorted((t, i, s, c) for t, steps in lists.items() for i, (s, c) in steps.items())


@pytest.mark.parametrize("shuffle", [False, True])
def test_live_steps(spark, feed_rows, shuffle):
    log = drain_batches(streamed(spark, feed_rows, FEED, 3, shuffle), "t", live.step_changes)
    assert table(live.shown_now(log, 30 * 86_400)) == shown(feed_rows)


@pytest.mark.parametrize("shuffle", [False, True])
def test_live_steps_expire(spark, shuffle):
    def step(seq, us, trial, idx):
        return (seq, us, 0, trial, "step", None, None, idx, "c", 0, 1)
    rows = [step(0, 0, 1, 1), step(1, 10 * SEC, 2, 1), step(2, 100 * SEC, 2, 2), step(3, 130 * SEC, 3, 1)]
    log = drain_batches(streamed(spark, rows, FEED, 4, shuffle), "t", live.step_changes)
    # Trial 1 was silent for 95 s; trial 2 was refreshed in time.
    assert [(r[0], r[1]) for r in table(live.shown_now(log, 95))] == [(2, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("shuffle", [False, True])
def test_run_done_alert(spark, feed_rows, shuffle):
    ends = drain_updates(live.first_ends(streamed(spark, feed_rows, FEED, 4, shuffle)), ["run_id", "trial_id"], "t")
    plan = spark.createDataFrame(feed_rows, FEED).groupBy("run_id").agg(F.max("planned").alias("planned"))
    got = live.run_done_alerts(ends, plan).collect()
    first = {}
    for r in sorted(feed_rows):
        if r[4] == "trial" and r[5] != "running":
            first.setdefault(r[2], {}).setdefault(r[3], r[0])
    assert {r.run_id: r.seq for r in got} == {run: max(t.values()) for run, t in first.items() if len(t) == 3}
    assert len(got) == len({r.run_id for r in got})


@pytest.mark.parametrize("shuffle,hot", [(False, None), (True, None), (True, 10)])
def test_stream_loop_guard(spark, shuffle, hot):
    rng = random.Random(4)
    rows = [(t, i, rng.choice("ab") + rng.choice(["", " "]), rng.choice([0, 1, None])) for t in range(5) for i in range(1, 61)]
    schema = "trial_id bigint, idx bigint, command string, exit_code int"
    got = live.stream_loop_guard(drain(live.attempts(streamed(spark, rows, schema, 3, shuffle)), "t"), hot)
    want = replay.loop_guard(spark.createDataFrame(rows, schema), ["idx"], F.col("idx")).select("trial_id", "idx", "repeats")
    assert table(got) == table(want)


def test_stream_loop_guard_waits_for_missing_steps(spark):
    rows = [(1, 1, "a", 0), (1, 2, "a", 0), (1, 4, "a", 0)]
    stored = spark.createDataFrame(rows, "trial_id bigint, idx bigint, command string, exit_code int")
    assert table(live.stream_loop_guard(stored)) == [(1, 1, 1), (1, 2, 2)]


@pytest.mark.parametrize("hot", [None, 10])
def test_stream_loop_guard_counts_repeated_steps_once(spark, hot):
    """Two batches, the second of which brings steps of the first again."""
    rows = [(t, i, "ab"[i % 7 == 0], i % 2) for t in range(3) for i in range(1, 41)]
    schema = "trial_id bigint, idx bigint, command string, exit_code int"
    again = rows[:25] + rows[15:] + [r for r in rows if r[1] in (3, 4)]
    got = live.stream_loop_guard(drain(live.attempts(streamed(spark, again, schema, 2, False)), "t"), hot)
    want = replay.loop_guard(spark.createDataFrame(rows, schema), ["idx"], F.col("idx")).select("trial_id", "idx", "repeats")
    assert table(got) == table(want)


def test_stream_watchdog(spark):
    rows = [(t, i * SEC, i * SEC, float(40 + (i * t) % 23)) for t in range(5) for i in range(12)]
    schema = "trial_id bigint, us bigint, elapsed_us bigint, disk_mb double"
    got = drain_updates(live.stream_watchdog(streamed(spark, rows, schema, 3, True), 8, 55), ["trial_id"], "t")
    want = replay.watchdog(spark.createDataFrame(rows, schema), 8, 55).select("trial_id", "reason", "us")
    assert table(got) == table(want)


@pytest.mark.parametrize("shuffle,hot", [(False, None), (True, None), (True, 2)])
def test_heartbeat_gaps(spark, shuffle, hot):
    """Late beats join sessions of earlier batches; sessions that are still open are shown as such."""
    beats = [("w", t * SEC) for t in (0, 10, 20, 60, 70)] + [("x", t * SEC) for t in range(0, 200, 10)]
    stream = streamed(spark, sorted(beats, key=lambda b: b[1]), "worker string, us bigint", 5, shuffle)
    log = drain_batches(stream, "t", lambda batch: live.beat_sessions(batch, "30 seconds"))
    got = live.heartbeat_gaps(log, 30, hot).select("worker", "first_us", "dead_us", "beats", "open")
    assert table(got) == [("w", 0, 50 * SEC, 3, False), ("w", 60 * SEC, 100 * SEC, 2, False), ("x", 0, 220 * SEC, 20, True)]


@pytest.mark.parametrize("shuffle", [False, True])
def test_windows_keep_late_rows_and_the_tail(spark, shuffle):
    rows = [(0, 5 * SEC, 0), (1, 65 * SEC, 1), (2, 500 * SEC, 0), (3, 501 * SEC, 0), (4, 50 * SEC, 1), (5, 505 * SEC, 0), (6, 900 * SEC, 0)]
    schema, keys = "seq bigint, us bigint, exit_code int", ["start_us", "end_us"]
    got = drain_updates(live.activity(streamed(spark, rows, schema, 7, shuffle), "1 minute"), keys, "t")
    assert table(got.select("start_us", "commands", "failures")) == [(0, 2, 1), (60 * SEC, 1, 1), (480 * SEC, 3, 0), (900 * SEC, 1, 0)]
    slid = drain_updates(live.activity(streamed(spark, rows[:3], schema, 3), "1 minute", "30 seconds"), keys, "t")
    assert (30 * SEC, 90 * SEC, 1, 1) in table(slid) and (480 * SEC, 540 * SEC, 1, 0) in table(slid)


ACTION = "seq bigint, run_id bigint, trial_id bigint, action string, status string"


def walk(plan, actions):
    """The rules applied one action at a time."""
    trials = {t: [r, "queued", None, None] for r, t in plan}
    runs = {r: ["queued", None] for r, _ in plan}
    for seq, run, trial, action, status in sorted(actions):
        row = trials.get(trial)
        if action == "claim" and row[1] in ("queued", "running"):
            row[1], row[2] = "running", seq
            if runs[run][0] == "queued":
                runs[run][0] = "running"
        elif action in ("finish", "crash"):
            row[1], row[3] = ("ERROR" if action == "crash" else status), seq
            open_left = any(t[0] == run and t[1] in ("queued", "running") for t in trials.values())
            if runs[run][0] in ("queued", "running") and not open_left:
                runs[run] = ["done", seq]
        elif action == "cancel":
            for t in trials.values():
                if t[0] == run and t[1] == "queued":
                    t[1], t[3] = "cancelled", seq
            if runs[run][0] in ("queued", "running"):
                runs[run] = ["cancelled", seq]
    return (sorted((t, r, s, a, b) for t, (r, s, a, b) in trials.items()), sorted((r, s, c) for r, (s, c) in runs.items()))


def folded(spark, plan, actions, batches, compact_every=20):
    p = spark.createDataFrame(plan, "run_id bigint, trial_id bigint")
    t, r = L.lifecycle(streamed(spark, actions, ACTION, batches), p, scratch(spark, "life"), compact_every)
    key = lambda row: tuple(-1 if v is None else v for v in row)
    return (sorted(map(tuple, t.select("trial_id", "run_id", "status", "started_seq", "finished_seq").collect()), key=key),
            sorted(map(tuple, r.select("run_id", "run_status", "closed_seq").collect()), key=key))


def test_lifecycle_goldens(spark):
    t, r = folded(spark, [(1, 10), (1, 11), (1, 12)], [(0, 1, None, "cancel", None)], 1)
    assert {x[2] for x in t} == {"cancelled"} and r == [(1, "cancelled", 0)]
    t, r = folded(spark, [(1, 10)], [(0, 1, 10, "claim", None), (1, 1, 10, "finish", "PASS")], 2)
    assert t == [(10, 1, "PASS", 0, 1)] and r == [(1, "done", 1)]
    # A cancel after the end changes nothing; a crash is an error.
    t, r = folded(spark, [(1, 10)], [(0, 1, 10, "claim", None), (1, 1, 10, "crash", None), (2, 1, None, "cancel", None)], 3)
    assert t == [(10, 1, "ERROR", 0, 1)] and r == [(1, "done", 1)]


@pytest.mark.parametrize("batches,compact", [(1, 20), (4, 2)])
def test_lifecycle_equals_a_walk(spark, batches, compact):
    rng = random.Random(9)
    plan = [(r, r * 4 + i) for r in range(25) for i in range(rng.randint(1, 4))]
    actions = []
    for seq in range(260):
        run, trial = rng.choice(plan)
        kind = rng.choices(["claim", "finish", "crash", "cancel"], [5, 3, 1, 1])[0]
        actions.append((seq, run, None if kind == "cancel" else trial, kind, rng.choice(["PASS", "FAIL"]) if kind == "finish" else None))
    assert folded(spark, plan, actions, batches, compact) == walk(plan, actions)


def test_state_table_batches_can_be_repeated(spark):
    s = L.StateTable(spark, scratch(spark, "state"), "k", 3)
    def rows(*r):
        return spark.createDataFrame(r, "k int, v int")
    s.create(rows((1, 0), (2, 0)))
    for _ in range(2):  # the batch is run again after a failure
        s.save(0, rows((1, 1)))
    for b in range(1, 5):
        s.save(b, rows((2, b)))
    assert table(s.as_of(0)) == [(1, 1), (2, 0)] and table(s.as_of(4)) == [(1, 1), (2, 4)] and s.last() == 4
