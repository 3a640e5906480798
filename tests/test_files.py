import json

from pyspark.sql import functions as F

from trialspark.functions.text import fixed
from trialspark.operators import fleet, summaries
from trialspark.sources import files, sinks
from trialspark.sources.folders import folder


def make_task(root, name, skip=(), config=None):
    for rel in ("instruction.md", "solution.sh", "environment/Dockerfile", "tests/run_tests.sh"):
        if rel not in skip:
            path = root / name / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"{rel} of {name}")
    if config is not None:
        (root / name / "task.json").write_text(config)


def test_task_folders(spark, tmp_path):
    make_task(tmp_path, "good one", config='{"allowed_paths": ["/usr/local/bin"]}')
    make_task(tmp_path, "no-solution", skip=("solution.sh", "tests/run_tests.sh"))
    make_task(tmp_path, "bad", config="{oops")
    make_task(tmp_path, "not-a-task", skip=("instruction.md",))
    (tmp_path / "instruction.txt").write_text("not a task either")
    (tmp_path / "good one" / "solution.sh").write_text("")  # empty, but there
    got = {r.task: r for r in fleet.task_catalogue(files.task_files(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["bad", "good one", "no-solution"]
    assert got["good one"].allowed_paths == ["/usr/local/bin"] and got["good one"].problem is None
    assert got["good one"].instruction == "instruction.md of good one"
    assert got["no-solution"].problem == "task 'no-solution' is missing: solution.sh, tests/run_tests.sh"
    assert got["bad"].problem == "task 'bad' has invalid task.json" and got["bad"].allowed_paths == []
    lone = fleet.task_catalogue(files.task_files(spark, str(tmp_path / "good one"))).collect()
    assert [r.task for r in lone] == ["good one"]


def record(task, status):
    step = {"index": 1, "thought": "t", "command": "ls", "exit_code": None, "output": "o", "duration": 0.5}
    return {"model": "m", "instruction": "i", "status": status, "task": task, "mode": "agent", "passed": status == "PASS",
            "tests_passed": True, "test_output": "", "duration": 1.5, "error": None, "violation": None, "tampering": [], "changed_files": ["A /x"],
            "peak_disk_mb": 1.0, "solution_output": "",
            "trajectory": {"steps": [step], "finished": True, "stop_reason": "finished", "summary": "s", "llm_calls": 2, "prompt_tokens": 20,
                           "completion_tokens": 10, "error": None, "messages": [{"role": "assistant", "content": "", "tool_calls": [{"id": "a"}]}]}}


def test_trial_files(spark, tmp_path):
    for n in (1, 2):
        path = tmp_path / "20250101-000000-m x+1" / "count lines" / f"trial-{n}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(record("count lines", "PASS"), indent=2))
    (tmp_path / "20250101-000000-m x+1" / "summary.json").write_text("{}")
    df = files.trial_records(spark, str(tmp_path))
    rows = sorted(df.select("run_dir", "task_dir", "trial_no", "status", "trajectory.llm_calls").collect())
    assert [tuple(r) for r in rows] == [("20250101-000000-m x+1", "count lines", n, "PASS", 2) for n in (1, 2)]
    steps = files.trial_steps(df).collect()
    assert len(steps) == 2 and steps[0].command == "ls" and steps[0].exit_code is None


def test_sales_csv(spark, tmp_path):
    def report(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        sales = files.sales(spark, str(path)).select("region", summaries.amount("quantity", "price").alias("amount"))
        return [r.line for r in summaries.region_revenue(sales).collect()]
    assert report("region,quantity,price\nNorth,3,19.99\nSouth,1,5.50\nNorth,2,10.00\nEast,4,2.25\n") == ["East: 9.00", "North: 79.97", "South: 5.50"]
    assert report("region,quantity,price\nWest,2,1.25\nCentral,10,0.10\nWest,1,3.00\n") == ["Central: 1.00", "West: 5.50"]


def test_matching_files(spark, tmp_path):
    folder = tmp_path / "my notes"
    (folder / "sub dir").mkdir(parents=True)
    empty = tmp_path / "empty"
    empty.mkdir()
    for name in ("a.txt", "meeting notes.txt", "b.log", "sub dir/c.txt"):
        (folder / name).write_text(name)
    assert sorted(r.name for r in files.matching_files(spark, str(folder)).collect()) == ["a.txt", "meeting notes.txt"]
    assert files.matching_files(spark, str(empty)).count() == 0
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("a.txt", "meeting notes.txt"):
        (copy / name).write_text(name)
    same = fleet.set_difference(files.matching_files(spark, str(folder)), files.matching_files(spark, str(copy)), ["name", "digest"])
    assert same.count() == 0


def test_file_lines(spark, tmp_path):
    for name, text in {"full": "x\n" * 37, "open": "a\nb", "cr": "a\rb\r\nc\n", "empty": ""}.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    got = {r.path.rsplit("/", 1)[-1]: r.lines for r in files.file_lines(spark, str(tmp_path)).collect()}
    assert got == {"full.txt": 37, "open.txt": 1, "cr.txt": 2, "empty.txt": 0}


def test_changelog_and_inventory(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "subject": "s", "path": "p", "content": "c"}\n{"seq": 2, "subject": "s", "path": "p"}\n')
    assert [r.deleted for r in files.changelog(spark, str(tmp_path / "log.json")).orderBy("seq").collect()] == [False, True]
    (tmp_path / "inv.json").write_text('{"path": "/a", "is_dir": true, "owner": "o", "group": "g", "mode": 750}\n')
    assert files.inventory(spark, str(tmp_path / "inv.json")).first().mode == 750


def test_store_and_summaries(spark, tmp_path):
    runs = spark.createDataFrame([("r", "m")], "run_id string, model string")
    trials = spark.createDataFrame([("t1", "r", "a", True, [], None, 2, 1.0), ("t2", "r", "b", False, ["C /x"], None, 4, 3.0)],
                                   "trial_id string, run_id string, task string, passed boolean, tampering array<string>, violation string, steps int, duration double")
    sinks.write_store(runs, trials, str(tmp_path / "store"))
    _, stored = sinks.read_store(spark, str(tmp_path / "store"))
    assert stored.where("run_id = 'r'").count() == 2
    per_task = summaries.task_summary(stored, ("run_id", "task"))
    sinks.write_run_summaries(sinks.run_summaries(per_task, runs), str(tmp_path / "out"))
    told = spark.read.json(str(tmp_path / "out")).first()
    assert told.model == "m" and told.tasks.a.passed == 1 and told.tasks.b.tampered == 1
    assert spark.range(1).select(fixed(F.lit(told.tasks.b.avg_seconds), 1).alias("x")).first().x == "3.0"


def test_folders_are_listed_once_whatever_their_shape(spark, tmp_path):
    """Every file is found by one task, at every depth, and whatever `fan` and `parts` say."""
    names = ["a.txt", "b b.txt", "x/a.txt", "x/y/a.txt", "x/y/z/empty.log", "ü/é+%41.txt", "x/.hidden.txt", "_u.txt"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else name.encode())
    (tmp_path / "no files" / "here").mkdir(parents=True)
    for fan, parts in ((1, 1), (1, 5), (2, 3), (9, 4)):
        got = folder(spark, f"file://{tmp_path}", content=True, fan=fan, parts=parts).collect()
        assert sorted(r.relpath for r in got) == sorted(names)
        assert all(r.size == len(r.content) and r.path == f"{tmp_path}/{r.relpath}" and (r.size == 0 or r.content.decode() == r.relpath) for r in got)
    assert sorted(r.relpath for r in folder(spark, str(tmp_path), ("*.txt", ".h*"), fan=2).collect()) == sorted(n for n in names if n.endswith(".txt"))
    assert sorted(r.relpath for r in folder(spark, str(tmp_path), ("*.txt",), recursive=False).collect()) == ["_u.txt", "a.txt", "b b.txt"]
    assert folder(spark, str(tmp_path / "no files")).count() == 0


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(f"d{i % 3}/f {i}.txt", "x" * i) for i in range(10)] + [("top", None)]
    for _ in range(2):  # a task that runs again
        sinks.write_files(spark.createDataFrame(rows, "relpath string, content string").repartition(3), str(tmp_path / "out"))
    got = {r.relpath: r.content.decode() for r in folder(spark, str(tmp_path / "out"), content=True).collect()}
    assert got == {name: text or "" for name, text in rows}
