from pyspark.sql import functions as F

from trialspark.operators import fleet, grading, summaries

TRIAL = ("task string, mode string, tests_passed boolean, error string, violation string, tampering array<string>, "
         "model_error string, stop_reason string, attempt_no int, duration double")


def trial(passed=True, error=None, violation=None, tampering=(), task="t", mode="oracle", no=1, model_error=None, stop="finished"):
    return (task, mode, passed, error, violation, list(tampering), model_error, stop, no, 2.0)


def test_status_precedence_and_truthiness(spark):
    cases = [(trial(error="x", violation="v", tampering=["C /a"]), "ERROR"), (trial(violation="v", tampering=["C /a"]), "LIMIT"),
             (trial(tampering=["C /usr/bin/wget"]), "TAMPER"), (trial(), "PASS"), (trial(False), "FAIL"),
             (trial(error="", violation=""), "PASS")]
    got = grading.graded(spark.createDataFrame([c for c, _ in cases], TRIAL).coalesce(1)).collect()
    assert [r.grade for r in got] == [s for _, s in cases]
    assert [r.passed for r in got] == [False, False, False, True, False, True]


def test_detail_names_tampering_first(spark):
    cases = [(trial(violation="disk", tampering=list("abcd")), "tampered: a, b, c"), (trial(error="", violation="disk"), "disk"),
             (trial(model_error="cannot reach"), "cannot reach"), (trial(stop=""), ""), (trial(stop=None), "")]
    got = spark.createDataFrame([c for c, _ in cases], TRIAL).coalesce(1).select(grading.detail().alias("d")).collect()
    assert [r.d for r in got] == [d for _, d in cases]


def verdict_of(spark, oracles, noop):
    rows = [o[:1] + ("oracle",) + o[2:8] + (i, 2.0) for i, o in enumerate(oracles)] + [noop[:1] + ("noop",) + noop[2:8] + (0, 9.0)]
    df = spark.createDataFrame(rows, TRIAL)
    tried = summaries.attempts(df.where("mode = 'oracle'").drop("mode"), df.where("mode = 'noop'").drop("mode"))
    return summaries.verdicts(tried).first()


def test_verdicts(spark):
    good, bad = trial(), trial(False)
    assert verdict_of(spark, [good] * 3, bad).verdict == "OK"
    assert verdict_of(spark, [good, bad, good], bad).verdict == "FLAKY: reference solution passed only 2/3 times"
    assert verdict_of(spark, [bad] * 3, bad).verdict == "BROKEN: reference solution fails the tests"
    assert verdict_of(spark, [good] * 3, good).verdict == "WEAK: tests pass without any changes"
    assert verdict_of(spark, [good, trial(error="x")], bad).verdict == "ERROR"
    assert verdict_of(spark, [good, good], trial(violation="late")).verdict == "LIMIT: noop hit a resource limit (late)"
    v = verdict_of(spark, [good, trial(tampering=list("abcd"))], bad)
    assert v.verdict == "INVASIVE: reference solution modifies protected paths (a, b, c)"
    assert (v.passes, v.oracles, v.noop, v.avg_seconds) == (2, 2, "FAIL", 2.0)


def test_exec_outcome(spark):
    rows = spark.createDataFrame(
        [("o", 3000, 5.0, 0, None, False), ("o", 10, 99.0, 0, "disk", False), ("o", 10, 5.0, 0, "disk", False),
         ("", 0, 0.0, None, "disk", True), ("o", 10, 5.0, 3, None, False)],
        "output string, output_bytes int, elapsed double, exit_code int, violation string, dead boolean").coalesce(1)
    got = grading.exec_outcome(rows, 1, 60, "[x] ").collect()
    assert [r.reported_code for r in got] == [137, 124, 137, 137, 3]
    assert got[0].reported_output == "o\n[x] output exceeded 1 KB; the command was killed"
    assert got[1].reported_output == "o\n[x] command timed out after 60s; the command was killed"
    assert got[3].reported_output == "[x] sandbox stopped: disk" and got[4].reported_output == "o"


def test_request_check(spark):
    ok = dict(trials=1, max_steps=30, memory_mb=512, cpus=1.0, disk_mb=1024, trial_timeout=900, mode="agent")
    rows = [ok, {**ok, "trials": 0}, {**ok, "memory_mb": 10, "cpus": 0.0}, {**ok, "mode": "x"}, {**ok, "cpus": 8.0}]
    schema = "trials int, max_steps int, memory_mb int, cpus double, disk_mb int, trial_timeout int, mode string"
    got = grading.request_problems(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert [r.problems for r in got] == [[], ["trials"], ["memory_mb", "cpus"], ["mode"], []]
    lost = fleet.unknown_tasks(spark.createDataFrame([("r", 1, "nope"), ("r", 2, "a")], "run_id string, ord int, task string"),
                               spark.createDataFrame([("a",)], "task string"))
    assert [r.task for r in lost.collect()] == ["nope"]


# The published evaluation: trials passed of three, per task.
PUBLISHED = {"write-greeting": 3, "count-lines": 2, "free-port-9000": 2, "git-restore-file": 1, "stop-log-flood": 1,
             "user-permissions": 1, "fix-csv-report": 0, "fix-backup-script": 0, "json-config-merge": 0,
             "nginx-serve-8080": 0, "sqlite-top-customer": 0}


def test_published_evaluation(spark):
    rows = [(t, i < n, [], None, 2, 11.8, "PASS" if i < n else "FAIL") for t, n in PUBLISHED.items() for i in range(3)]
    df = spark.createDataFrame(rows, "task string, passed boolean, tampering array<string>, violation string, steps int, duration double, status string")
    got = {r.task: r for r in summaries.task_summary(df).collect()}
    assert {t: r.passed for t, r in got.items()} == PUBLISHED
    assert all(r.trials == 3 and r.avg_steps == 2.0 and abs(r.avg_seconds - 11.8) < 1e-9 and r.tampered == r.resource_limited == 0 for r in got.values())
    total = summaries.overall(df, df).first()
    assert (total.passed, total.planned) == (10, 33)
    # 25 trials called finish: the ten that passed and fifteen that did not.
    claims = spark.createDataFrame([(i < 10, i < 25) for i in range(33)], "passed boolean, finished boolean")
    said = summaries.false_success(claims).first()
    assert (said.finished, said.not_solved, said.share) == (25, 15, 0.6)


def test_run_summary_keeps_empty_runs(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    trials = spark.createDataFrame([("a", "t2", s) for s in ("PASS", "TAMPER", "running", "cancelled")] + [("a", "t1", "FAIL")],
                                   "run_id string, task string, status string")
    got = {r.run_id: r for r in summaries.run_summary(runs, trials).collect()}
    a, b = got["a"], got["b"]
    assert (a.total, a.passed, a.failed, a.tampered, a.running, a.tasks) == (5, 1, 2, 1, 1, ["t1", "t2"])
    assert (b.total, b.tasks) == (0, [])
    pairs = summaries.runs_with_trials(runs, trials).collect()
    assert len(pairs) == 6 and [r.status for r in pairs if r.run_id == "b"] == [None]


def test_run_page_of_one_run(spark):
    """Header and counts beside trials by task and number; one row without trials, none for an unknown run."""
    runs = spark.createDataFrame([("a", "m", 9), ("b", "m", None)], "run_id string, model string, finished_at long")
    trials = spark.createDataFrame([("a", 3, "t2", 1, "PASS"), ("a", 2, "t1", 2, "FAIL"), ("a", 1, "t1", 1, "running"), ("c", 4, "t1", 1, "PASS")],
                                   "run_id string, trial_id int, task string, trial_no int, status string")
    page = summaries.run_page(runs, trials, "a").collect()
    assert [(r.trial_id, r.task, r.trial_no, r.trial_status) for r in page] == [(1, "t1", 1, "running"), (2, "t1", 2, "FAIL"), (3, "t2", 1, "PASS")]
    assert {(r.model, r.finished_at, r.total, r.passed, r.failed, r.running, tuple(r.tasks)) for r in page} == {("m", 9, 3, 1, 1, 1, ("t1", "t2"))}
    [lone] = summaries.run_page(runs, trials, "b").collect()
    assert (lone.run_id, lone.total, lone.tasks, lone.trial_id, lone.finished_at) == ("b", 0, [], None, None)
    assert summaries.run_page(runs, trials, "c").collect() == summaries.run_page(runs, trials, None).collect() == []


def test_showcase_prefers_short_passes(spark):
    rows = [("r", 1, "t", 1, 30, "FAIL"), ("r", 2, "t", 2, 5, "PASS"), ("r", 3, "t", 3, 5, "PASS"), ("r", 4, "t", 4, 9, "PASS"),
            ("q", 5, "t", 1, 9, "FAIL"), ("q", 6, "t", 2, 12, "ERROR"), ("z", 7, "t", 1, 0, "PASS")]
    df = spark.createDataFrame(rows, "run_id string, trial_id int, task string, trial_no int, steps int, status string")
    assert {r.run_id: r.trial_id for r in summaries.showcase_trial(df).collect()} == {"r": 2, "q": 6}


def test_dead_workers_and_rerun_order(spark):
    sec = 1_000_000
    leases = spark.createDataFrame([("w", "a", 1), ("w", "b", 2), ("x", "d", 3), ("y", "e", 4)], "worker string, trial_id string, seq bigint")
    beats = spark.createDataFrame([("w", 10 * sec), ("x", 31 * sec), ("idle", 0)], "worker string, us bigint")
    dead = fleet.dead_workers(leases, beats, F.lit(40 * sec))
    assert sorted(r.worker for r in dead.collect()) == ["w", "y"]
    held = leases.where("worker = 'w'")
    queue = spark.createDataFrame([("c", 5)], "trial_id string, seq bigint")
    order = fleet.rerun_order(held, queue).orderBy("position").collect()
    assert [r.trial_id for r in order] == ["b", "a", "c"]


def test_trial_plan_is_repeatable(spark):
    asked = spark.createDataFrame([("r", "a", 2), ("r", "b", 2)], "run_id string, task string, trials int")
    first, again = (sorted(fleet.trial_plan(asked).collect()) for _ in range(2))
    assert first == again and len(first) == 4 and len({r.id for r in first}) == 4
    assert {r.status for r in first} == {"queued"} and all(len(r.id) == 12 for r in first)


SHOP = {
    "customers": [(10, "Uma"), (20, "Nils"), (30, "Odile"), (40, "Pau"), (50, "Quin")],
    "orders": [(100, 10, "2025-01-01 00:00:00", "paid"), (101, 20, "2025-12-31 23:59:59", "paid"), (102, 20, "2024-06-01 08:00:00", "paid"),
               (103, 30, "2025-04-09 10:10:00", "refunded"), (104, 30, "2025-04-10 10:10:00", "paid"), (105, 40, "2026-01-01 00:00:00", "paid"),
               (106, 50, "2025-09-09 09:09:09", "cancelled"), (107, 10, "2025-02-02 02:02:02", "paid")],
    # Uma: two orders, one of several pieces; the dearest single piece, order and year belong to others.
    "items": [(100, 700, 5), (107, 450, 1), (101, 3900, 1), (102, 9999, 3), (103, 8000, 2), (104, 1250, 2), (105, 7777, 4), (106, 60000, 1)]}


def test_top_spender_of_2025(spark):
    c = spark.createDataFrame(SHOP["customers"], "id int, name string")
    o = spark.createDataFrame(SHOP["orders"], "id int, customer_id int, placed_at string, status string")
    i = spark.createDataFrame(SHOP["items"], "order_id int, price_cents int, quantity int")
    top = summaries.top_spender(c, o, i).collect()
    assert [(r.name, r.total) for r in top] == [("Uma", 3950)]


def test_report_percent_is_of_the_share(spark):
    """23 of 40 is a share just below 0.575 as a double; 100 * 23 / 40 would be a half, rounded up."""
    from trialspark.functions import text as T
    rows = spark.createDataFrame([(23, 40), (46, 80), (1, 2), (1, 3), (0, 9), (5, 5)], "a bigint, b bigint")
    assert [r.p for r in rows.coalesce(1).select(T.percent_half_even(F.col("a") / F.col("b")).alias("p")).collect()] == ["57%", "57%", "50%", "33%", "0%", "100%"]


def test_permission_audit(spark):
    root = "/srv/app"
    dirs = [root, f"{root}/bin", f"{root}/config", f"{root}/static", f"{root}/static/css", f"{root}/data"]
    names = ["bin/start.sh", "config/app.ini", "static/index.html", "static/css/site.css", "data/.keep"]
    exc = spark.createDataFrame([(f"{root}/bin/start.sh", 750)], "path string, expected_mode int")
    schema = "path string, is_dir boolean, owner string, group string, mode int"

    def audit(file_mode, start_mode):
        rows = [(d, True, "deploy", "web", 750) for d in dirs]
        rows += [(f"{root}/{n}", False, "deploy", "web", start_mode if n == "bin/start.sh" else file_mode) for n in names]
        return fleet.permission_audit(spark.createDataFrame(rows, schema), exc, "deploy", "web", 750, 640).collect()
    assert audit(640, 750) == []
    wrong = audit(750, 750)  # 750 everywhere
    assert len(wrong) == 4 and wrong[0].expected == "deploy:web 640"


def test_sets_and_history(spark):
    def items(rows):
        return spark.createDataFrame(rows, "owner string, item string")
    before = items([("a", "1"), ("a", "2"), ("b", "1")])
    after = items([("a", "1"), ("a", "2"), ("a", "3"), ("b", "9")])
    diff = {(r.owner, r.item): r.only_in for r in fleet.set_difference(before, after, ["owner", "item"]).collect()}
    assert diff == {("a", "3"): "right", ("b", "1"): "left", ("b", "9"): "right"}
    assert {r.owner: r.kept for r in fleet.history_kept(before, after, "owner", "item").collect()} == {"a": True, "b": False}


def test_answer_check(spark):
    df = spark.createDataFrame([(" en\n",), ("fr",), (None,)], "a string").coalesce(1)
    got = [r.r for r in df.select(grading.answer_check(F.col("a"), F.lit("en")).alias("r")).collect()]
    assert got == ["PASS", "FAIL: expected en, got 'fr'", "FAIL: expected en, got ''"]


def test_sketches_of_runs_merge(spark, tmp_path):
    """Sketches kept per run estimate within the bound, and new runs are added to old ones without their trials."""
    rows = spark.range(60_000).select((F.col("id") % 5).alias("run_id"), (F.col("id") % 17_000).alias("task"))
    old, new = (summaries.task_sketches(rows.where(c)) for c in ("run_id < 3", "run_id >= 3"))
    old.write.parquet(str(tmp_path / "old"))
    both = spark.read.parquet(str(tmp_path / "old")).unionByName(new)
    got = {r.run_id: r.estimate for r in summaries.sketched_tasks(both).collect()}
    exact = {r.run_id: r.n for r in rows.groupBy("run_id").agg(F.count_distinct("task").alias("n")).collect()} | {None: 17_000}
    assert set(got) == set(exact) and all(abs(got[k] - exact[k]) <= summaries.SKETCH_BOUND * exact[k] for k in exact)
    empty = summaries.sketched_tasks(summaries.task_sketches(rows.limit(0))).collect()
    assert [(r.run_id, r.estimate) for r in empty] == [(None, 0)]
