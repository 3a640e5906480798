import json
import random

from pyspark.sql import functions as F

from trialspark.functions import calls as K
from trialspark.functions import text as T
from trialspark.operators import grading, layers


def values(spark, rows, schema, expr):
    return [r.x for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr.alias("x")).collect()]


def test_truncate_middle(spark):
    texts = ["A" * 3000 + "B" * 3000, "A" * 100, "é" * 60 + "漢" * 60, ""]
    got = values(spark, [(t,) for t in texts], "t string", T.truncate_middle(F.col("t"), 100))
    assert got[0] == "A" * 50 + "\n...[5900 characters truncated]...\n" + "B" * 50
    assert got[1] == texts[1] and got[3] == ""
    assert got[2] == "é" * 50 + "\n...[20 characters truncated]...\n" + "漢" * 50


def test_strip_equals_python(spark):
    odd = [" a ", "\n\ta b\r\n", " x ", "\x1c\x1d q \x1f", "​z", "", " \n", "　a\u0085", "a\n\n", "\x0b\x0cv"]
    assert values(spark, [(t,) for t in odd], "t string", T.strip(F.col("t"))) == [t.strip() for t in odd]


def test_number_formats_equal_python(spark):
    rng = random.Random(1)
    xs = [0.125, 2.675, 0.25, 0.5, 1.5, 2.5, 119.7, 0.0, 1e6] + [rng.uniform(0, 500) for _ in range(200)]
    rows = [(x,) for x in xs]
    assert values(spark, rows, "v double", T.fixed(F.col("v"), 2)) == [f"{x:.2f}" for x in xs]
    assert values(spark, rows, "v double", T.fixed(F.col("v"), 1)) == [f"{x:.1f}" for x in xs]
    assert values(spark, rows, "v double", T.round_dp(F.col("v"), 2)) == [round(x, 2) for x in xs]
    assert values(spark, rows, "v double", T.percent_half_even(F.col("v"))) == [f"{x:.0%}" for x in xs]


def test_dashboard_texts(spark):
    xs = [None, 0.25, 0.75, 59.94, 60.0, 119.7, 125.0]
    got = values(spark, [(x,) for x in xs], "v double", T.seconds_text(F.col("v")))
    assert got == ["—", "0.3s", "0.8s", "59.9s", "1m 0s", "1m 60s", "2m 5s"]
    got = values(spark, [(1, 8), (1, 3), (0, 0)], "p int, t int", T.percent_halfup(F.col("p"), F.col("t")))
    assert got == ["13%", "33%", "—"]
    now = 1_700_000_000_000_000
    ages = [59.4, 59.6, 3599, 3600, 86399.4, 90000]
    got = values(spark, [(now - int(a * 1_000_000),) for a in ages], "us bigint", T.time_ago(F.col("us"), F.lit(now)))
    assert got == ["just now", "1m ago", "59m ago", "1h ago", "23h ago", "2023-11-13"]
    got = values(spark, [(0,), (1_500_000,)], "us bigint", T.iso_timestamp(F.col("us")))
    assert got == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00"]
    assert values(spark, [("a/b c:7",)], "m string", T.model_slug(F.col("m"))) == ["a_b_c_7"]


def test_shown_limits(spark):
    got = values(spark, [({"memory_mb": "512", "open_files": "9", "network": "false"},)], "l map<string,string>",
                 F.array_sort(grading.shown_limits(F.col("l"))))
    assert got == [["memory_mb=512", "network=false"]]


def found(spark, content=None, tool_calls=None):
    df = spark.createDataFrame([(content, tool_calls)], "content string, tool_calls string")
    rows = K.tool_calls(df).select("call", "call_id", "name", "args", "native").orderBy("call").collect()
    return [(r.call_id, r.name, json.loads(r.args)) for r in rows], [r.native for r in rows]


def test_written_calls(spark):
    ls = '{"name": "run_shell", "arguments": {"command": "ls"}}'
    assert found(spark, f"Let's start.\n\n```json\n{ls}\n```")[0] == [("text_call_0", "run_shell", {"command": "ls"})]
    two, native = found(spark, ls + "\n" + ls.replace('"ls"', '"pwd"'))
    assert [c[2]["command"] for c in two] == ["ls", "pwd"] and native == [False, False]
    for text in ('{"hello": "world"}', '{"outer": ' + ls + "}", '{"name": ["run_shell"]}', "no brace", None):
        assert found(spark, text)[0] == []
    assert found(spark, '{"broken": ' + ls)[0] == [("text_call_0", "run_shell", {"command": "ls"})]
    assert found(spark, '{"name": "finish", "arguments": "x"}')[0] == [("text_call_0", "finish", {})]
    assert found(spark, '{"name": "finish", "arguments": {}, "parameters": {"summary": "s"}}')[0] == [("text_call_0", "finish", {"summary": "s"})]


def written(text):
    """Every stretch from a brace to a brace is tried; the first that is an object counts, and none that begins in it."""
    opens, ends = ([i for i, c in enumerate(text) if c == b] for b in "{}")
    out, after = [], 0
    for a in opens:
        for b in ends if a >= after else ():
            try:
                value = json.loads(text[a:b + 1])
            except ValueError:
                continue
            after = b + 1
            args = [value[k] for k in ("arguments", "parameters") if value.get(k)] + [{}]
            if value.get("name") in ("run_shell", "finish"):
                out.append((value["name"], args[0] if isinstance(args[0], dict) else {}))
            break
    return out


def test_written_calls_equal_brute_force(spark):
    """Random texts of fragments: stray braces and quotes, escapes, nested, broken and repeated objects."""
    rng = random.Random(12)
    parts = ['{"name": "run_shell", "arguments": {"command": "ls {a} \\"q\\" \\\\"}}', '{"name": "finish"', "}", "{", '"', "\\", " it's {here} ", '{"a": [{"name": "finish"}]}',
             '{"name": "finish", "arguments": [], "parameters": {"ü": 1.5, "n": null}}', '{"name": "finish", "arguments": 0.0}', ', "x": 1}', "\n", '{"name": "other"}', '{"name": 5}',
             '{"name": "finish", "name": "run_shell"}', '{"name": "finish", "arguments": {"k": {"j": [{}, "}"]}}}', "{}", '{"name": "finish\\u0020"}', "[", "```json"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["{" * 300, '{"' * 150 + "}", '{"name": "finish", "arguments": {"x": NaN, "y": "NaN"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(4)
    got = {}
    for r in K.text_calls(df).orderBy("id", "call").collect():
        assert r.call_id == f"text_call_{len(got.setdefault(r.id, []))}"
        got[r.id].append((r.name, json.loads(r.args)))
    for i, text in enumerate(texts[:-1]):
        assert got.get(i, []) == written(text), text
    assert got[len(texts) - 1] == [("finish", {"x": None, "y": "NaN"})]
    assert sum(map(len, got.values())) > 200
    plan = K.text_calls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_native_calls_hide_written_ones(spark):
    native = [{"id": "i", "function": {"name": "run_shell", "arguments": '{"command": "ls"}'}}, {"function": {"name": "f", "arguments": "  "}},
              {"id": "", "function": {"arguments": {"k": [1]}}}, {"function": {"name": "g", "arguments": "[1]"}}, {"function": {"name": "h", "arguments": "{oops"}}, {}]
    got, kinds = found(spark, '{"name": "finish"}', json.dumps(native))
    assert got == [("i", "run_shell", {"command": "ls"}), ("call_1", "f", {}), ("call_2", "", {"k": [1]}), ("call_3", "g", {}), ("call_4", "h", {}), ("call_5", "", {})]
    assert all(kinds)
    assert found(spark, '{"name": "finish"}', "[]")[0] == [("text_call_0", "finish", {})]


BASE = {"queue": {"kind": "disk", "slots": 3, "verbose": None, "zones": ["n", "s"]}, "limits": {"cpu": {"soft": 2, "hard": 4}, "note": "x"}, "flags": {}}
OVER = {"queue": {"slots": 12, "zones": []}, "limits": {"cpu": {"hard": 9}, "note": {"text": "y"}}, "extra": [1, {"z": 0}]}


def deep(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: deep(a[k], v) if k in a else v for k, v in b.items()}}
    return b


def random_doc(rng, depth=0):
    pick = rng.random()
    if depth < 3 and pick < 0.6:
        return {rng.choice(["a", "b", "c/d", ""]): random_doc(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([1, 2.5, None, True, "x", [1, {"a": 2}], []])


def test_config_merge(spark):
    rng = random.Random(5)
    configs = [[BASE, OVER], [{"a": {"b": 1}}, {"a": 5}, {"a": {}}], [{"a": 1}, {"a": {"b": 2}}], [{"a": {"b": 1}}, {"a": {}}], [{}], [1, {"a": 1}], [{"a": 1}, 7]]
    configs += [[random_doc(rng) for _ in range(rng.randint(1, 4))] for _ in range(200)]
    rows = [(i, n, json.dumps(d)) for i, c in enumerate(configs) for n, d in enumerate(c)]
    df = spark.createDataFrame(rows, "config_id int, layer int, doc string").repartition(4)
    got = {r.config_id: json.loads(r.doc) for r in layers.merged_documents(df).collect()}
    for i, c in enumerate(configs):
        want = c[0]
        for d in c[1:]:
            want = deep(want, d)
        assert got[i] == want, (c, got[i], want)
    flat = layers.config_merge(df.where("config_id = 0"))
    assert flat.count() == 9


def test_config_merge_in_the_jvm(spark):
    """Deep documents, duplicate keys, strings that look like structure, and documents that are no JSON."""
    deep_doc = '{"d": ' * 40 + "1" + "}" * 40
    tricky = {"a,b": ["x, \"y\": {z}", ":", {"k:": [1, 2.5, None, True]}], "e": "{[,", "ü": "\n"}
    docs = [(1, 0, deep_doc), (1, 1, '{"x": {"y": 1, "y": 2}}'), (2, 0, json.dumps(tricky)), (3, 0, "{oops"), (3, 1, '{"ok": 1}'),
            (3, 2, None), (3, 3, ""), (4, 0, "5"), (5, 0, "[1]"), (5, 1, "{}"), (6, 0, "null"), (7, 0, deep_doc), (7, 1, '{"d": {"d": {"d": {"d": {}}}}}')]
    df = spark.createDataFrame(docs, "config_id int, layer int, doc string")
    got = layers.config_merge(df)
    rows = {(r.config_id, "|".join(r.path)): r.value for r in got.collect()}
    assert rows == {(1, "|".join("d" * 40)): "1", (1, "x|y"): "2", (2, "a,b"): json.dumps(tricky["a,b"], ensure_ascii=False), (2, "e"): json.dumps(tricky["e"]),
                    (2, "ü"): json.dumps(tricky["ü"]), (3, "ok"): "1", (4, ""): "5", (5, ""): "{}", (6, ""): "null", (7, "|".join("d" * 40)): "1"}
    assert sorted((r.config_id, r.layer) for r in layers.unreadable(df).collect()) == [(3, 0), (3, 3)]
    for plan in (got, layers.opened(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text


def test_jsonable_rows_walk_any_schema(spark):
    row = ("1, timestamp'2024-01-02 03:04:05.678901', named_struct('at', timestamp'2024-01-02 00:00:00', 'n', 7, 'deep', array(map('x', named_struct('day', date'2024-02-29', "
           "'local', timestamp_ntz'2024-05-06 07:08:09.5', 'note', 'keep 2024')), null, map('y', null))), map(date'2024-01-01', array(date'2023-12-31', null)), "
           "named_struct('a', 1, 'b', array('z')), array(null, timestamp'1969-12-31 23:59:59')")
    df = spark.sql(f"SELECT * FROM VALUES ({row}), (2, null, null, null, null, null) AS t(id, at, `odd name`, days, plain, none)")
    told = T.jsonable_rows(df)
    first, second = (r.asDict(recursive=True) for r in told.orderBy("id").collect())
    assert first["at"] == "2024-01-02T03:04:05.678901+00:00" and first["odd name"]["at"] == "2024-01-02T00:00:00+00:00" and first["odd name"]["n"] == 7
    assert first["odd name"]["deep"] == [{"x": {"day": "2024-02-29", "local": "2024-05-06T07:08:09.500000", "note": "keep 2024"}}, None, {"y": None}]
    assert list(first["days"].values()) == [["2023-12-31", None]] and first["plain"] == {"a": 1, "b": ["z"]}
    assert first["none"] == [None, "1969-12-31T23:59:59+00:00"]
    assert all(v is None for k, v in second.items() if k != "id")
    changed = lambda kind: kind.replace("timestamp_ntz", "string").replace("timestamp", "string").replace("day:date", "day:string").replace("array<date>", "array<string>")
    assert told.schema.simpleString() == changed(df.schema.simpleString())
    same = df.select("id", "plain")
    assert T.jsonable_rows(same).schema == same.schema
