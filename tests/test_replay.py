from pyspark.sql import functions as F

from trialspark.operators import changes as X
from trialspark.operators import replay

REPLY = "trial_id int, reply int, tokens int, failed boolean, violated_before boolean, n_calls int"
CALL = "trial_id int, reply int, call int, name string, command string, exit_code int, violated boolean"


def stop(spark, replies, max_steps=30, budget=500_000):
    """replies: lists of calls (name, command, exit_code[, violated]) or 'error' / 'violated'."""
    rs, cs = [], []
    for n, r in enumerate(replies, 1):
        tokens, calls = 15, r if isinstance(r, list) else []
        rs.append((1, n, tokens, r == "error", r == "violated", len(calls)))
        cs += [(1, n, i, *c, *([False] if len(c) == 3 else [])) for i, c in enumerate(calls, 1)]
    got = replay.stop_reasons(spark.createDataFrame(rs, REPLY), spark.createDataFrame(cs, CALL), max_steps, budget).collect()
    return (got[0].stop_reason, got[0].reply, got[0].call) if got else None


def run(cmd, code=0, *rest):
    return ("run_shell", cmd, code, *rest)


def test_stop_reasons(spark):
    fin = ("finish", None, None)
    assert stop(spark, [[run("ls /app")], [fin]]) == ("finished", 2, 1)
    assert stop(spark, [[run(f"x{i}")] for i in range(5)], max_steps=3)[0] == "max_steps"
    assert stop(spark, [[run(f"echo {i}") for i in range(5)]], max_steps=3) == ("max_steps", 1, 4)
    assert stop(spark, [[run("probe --all", 7)]] * 8) == ("stuck", 5, 1)
    assert stop(spark, [[run("one")], [run("two")], [run("one", 3)]] * 9) is None
    assert stop(spark, [[run("one")], [run("two")]] * 7) == ("stuck", 9, 1)
    assert stop(spark, [[], []]) == ("no_tool_call", 2, 0)
    assert stop(spark, [[], [run("a")], []]) == ("no_tool_call", 3, 0)  # a nudge is never forgiven
    assert stop(spark, ["error"]) == ("llm_error", 1, 0)
    assert stop(spark, [[run("a")], "violated"]) == ("resource_limit", 2, 0)
    assert stop(spark, [[run("a", 0, True), fin]]) == ("resource_limit", 1, 1)
    assert stop(spark, [[run(str(i))] for i in range(9)], budget=30) == ("token_budget", 3, 0)
    # The cap is tested before a finish in the same reply.
    assert stop(spark, [[run("a"), run("b"), fin]], max_steps=2) == ("max_steps", 1, 3)
    # Bad calls are answered, not run: they do not count as steps.
    assert stop(spark, [[("run_shell", " ", None), ("search", "q", None), fin]], max_steps=1) == ("finished", 1, 3)
    assert stop(spark, [[run("a")]]) is None


def test_call_result_and_first_thought(spark):
    rows = [(1, 1, 1, "run_shell", None, None, False, "t"), (1, 1, 2, "run_shell", "ls", 0, False, "t"), (1, 1, 3, "run_shell", "pwd", 0, False, "t"),
            (1, 2, 1, "finish", None, None, False, "u")]
    df = spark.createDataFrame(rows, CALL + ", thought string")
    got = [r.outcome for r in replay.call_result(df).orderBy("reply", "call").collect()]
    assert got[0].startswith("error: call run_shell") and got[1:] == ["run", "run", "finish"]
    assert [r.shown_thought for r in replay.first_thoughts(df).orderBy("reply", "call").collect()] == ["t", ""]


def test_watchdog(spark):
    sec = 1_000_000
    rows = [("full", i * sec, d) for i, d in enumerate((40.0, 50.0, 60.4))] + [("late", i * sec, d) for i, d in enumerate((1.0, 1.0, 1.0, 99.0))]
    got = {r.trial_id: (r.us, r.reason) for r in
           replay.watchdog(spark.createDataFrame(rows, "trial_id string, us bigint, disk_mb double"), 3, 50).collect()}
    assert got == {"full": (2 * sec, "disk usage reached 60 MB (limit 50 MB)"), "late": (3 * sec, "trial exceeded the 3s time limit")}


def test_timeline(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 500_000)], "trial_id int, idx int, us bigint")
    got = replay.timeline(df, ["idx"], F.col("idx"), speed=2).orderBy("idx").collect()
    assert [(r.shown_at, r.hold) for r in got] == [(0.6, 0.5), (1.2, 2.5)]


def test_restore_before_delete(spark):
    plan = ["stage one\n", "stage one\nstage two\n"]
    log = [(1, "notes.txt", "first"), (2, "plan.txt", plan[0]), (3, "plan.txt", plan[1]), (4, "plan.txt", None),
           (4, "notes.txt", "second"), (5, "log.txt", "more")]
    df = spark.createDataFrame(log, "seq bigint, path string, content string")
    for hot in (None, 0):
        got = replay.content_before_delete(df, F.col("seq"), hot).collect()
        assert [(r.path, r.restored, r.restored_seq) for r in got] == [("plan.txt", plan[1], 3)]
    assert {r.path: r.content for r in replay.latest_content(df).collect()} == {"notes.txt": "second", "log.txt": "more"}


CHANGES = "trial_id int, ord int, kind string, path string"
MARK = "/tmp/.harness_"


def leaves(spark, rows):
    df = spark.createDataFrame([(1, i, k, p) for i, (k, p) in enumerate(rows)], CHANGES)
    return [(r.kind, r.path) for r in X.leaf_changes(df, MARK).orderBy("ord").collect()]


def test_leaf_changes(spark):
    assert leaves(spark, [("C", "/w"), ("A", "/w/result"), ("C", "/tmp"), ("A", MARK + "x7"), ("C", "/opt/tool")]) == [
        ("A", "/w/result"), ("C", "/opt/tool")]
    assert leaves(spark, [("C", "/"), ("C", "/a"), ("A", "/ab"), ("D", "/c"), ("A", "/c/d")]) == [
        ("C", "/a"), ("A", "/ab"), ("D", "/c"), ("A", "/c/d")]


def test_leaf_changes_random(spark):
    import random
    rng = random.Random(3)
    rows, want = [], set()
    for t in range(40):
        paths = ["/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(15)]
        mine = [(rng.choice("ACCD"), p) for p in paths]
        for i, (k, p) in enumerate(mine):
            rows.append((t, i, k, p))
            if not (k == "C" and any(q.startswith(p.rstrip("/") + "/") for _, q in mine)) and not p.startswith("/b/a"):
                want.add((t, i))
    got = X.leaf_changes(spark.createDataFrame(rows, CHANGES), "/b/a")
    assert {(r.trial_id, r.ord) for r in got.collect()} == want


def test_tampering(spark):
    rows = [("C", "/usr"), ("C", "/usr/bin"), ("C", "/usr/bin/wget"), ("A", "/app/out.txt"),
            ("A", "/usr/local/lib/python3.12/__pycache__/x.pyc"), ("A", "/usr/binary"), ("D", "/etc/ld.so.preload")]
    df = spark.createDataFrame([(1, i, k, p) for i, (k, p) in enumerate(rows)], CHANGES)
    assert [r.entry for r in X.tampering(df, MARK).orderBy("ord").collect()] == ["C /usr/bin/wget", "D /etc/ld.so.preload"]
    allowed = spark.createDataFrame([(1, "/usr/bin/"), (2, "/etc")], "trial_id int, prefix string")
    assert [r.entry for r in X.tampering(df, MARK, allowed=allowed).collect()] == ["D /etc/ld.so.preload"]


def test_baseline_and_lines(spark):
    df = spark.createDataFrame([(1, 1, "A", "/x"), (1, 2, "A", "/x"), (1, 3, "C", "/x"), (1, 4, "A", "/y")], CHANGES)
    base = spark.createDataFrame([(1, "A", "/y"), (2, "A", "/x")], "trial_id int, kind string, path string")
    assert [r.ord for r in X.minus_baseline(df, base).orderBy("ord").collect()] == [1, 2, 3]
    lines = spark.createDataFrame([("A /a b",), ("X /a",), ("C ",), ("C",), ("D  /q",)], "value string").coalesce(1)
    assert [(r.kind, r.path) for r in X.parse_lines(lines).collect()] == [("A", "/a b"), ("D", " /q")]
