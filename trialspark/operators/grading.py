"""Grading rules of one trial record, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def present(text: Column) -> Column:
    """An empty text counts as absent."""
    return F.coalesce(text, F.lit("")) != ""


def any_entry(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def passed() -> Column:
    return F.col("tests_passed") & ~any_entry(F.col("tampering")) & ~present(F.col("violation"))


def grade(ok: Column) -> Column:
    return (F.when(present(F.col("error")), "ERROR").when(present(F.col("violation")), "LIMIT")
            .when(any_entry(F.col("tampering")), "TAMPER").when(ok, "PASS").otherwise("FAIL"))


def graded(trials: DataFrame) -> DataFrame:
    """Add `passed` and `grade`."""
    return trials.withColumn("passed", passed()).withColumn("grade", grade(F.col("passed")))


def detail() -> Column:
    """What the trial list shows. Tampering is named first here, unlike in the grade."""
    fallbacks = [F.nullif(F.col(c), F.lit("")) for c in ("error", "violation", "model_error", "stop_reason")]
    first_three = F.array_join(F.slice("tampering", 1, 3), ", ")
    return (F.when(any_entry(F.col("tampering")), F.concat(F.lit("tampered: "), first_three))
            .otherwise(F.coalesce(*fallbacks, F.lit(""))))


def exec_outcome(steps: DataFrame, max_output_kb: int, timeout_seconds: float, tag: str = "") -> DataFrame:
    """Why a command was stopped, the exit code reported and the note added to its output.

    Input columns: output, output_bytes, elapsed, exit_code, `violation` of the sandbox and
    `dead`, true where the sandbox had stopped before the command was even started.
    `tag` precedes the note.
    """
    stopped = F.concat(F.lit("sandbox stopped: "), F.col("violation"))
    why = (F.when(F.col("dead"), stopped)
           .when(F.col("output_bytes") > max_output_kb * 1024, f"output exceeded {max_output_kb} KB")
           .when(F.col("elapsed") > timeout_seconds, f"command timed out after {timeout_seconds:.0f}s")
           .when(present(F.col("violation")), stopped))
    told = steps.withColumn("stopped_because", why)
    reason = F.col("stopped_because")
    code = F.when(reason.isNull(), F.col("exit_code")).when(reason.startswith("command timed out"), 124).otherwise(137)
    text = (F.when(reason.isNull(), F.col("output"))
            .when(F.col("dead"), F.concat(F.lit(tag), reason))
            .otherwise(F.concat(F.col("output"), F.lit("\n" + tag), reason, F.lit("; the command was killed"))))
    return told.withColumn("reported_code", code.cast("int")).withColumn("reported_output", text)


def request_problems(requests: DataFrame) -> DataFrame:
    """Add `problems`: names of the fields outside their accepted range, in field order."""
    def bad(field: str) -> Column:
        low, high = C.REQUEST_RANGES[field]
        below = F.col(field) <= low if field == "cpus" else F.col(field) < low
        return F.when(below | (F.col(field) > high) | F.col(field).isNull(), F.lit(field))
    checks = [bad(f) for f in C.REQUEST_RANGES]
    checks.append(F.when(~F.coalesce(F.col("mode").isin(*C.MODES), F.lit(False)), F.lit("mode")))
    return requests.withColumn("problems", F.array_compact(F.array(*checks)))


def shown_limits(limits: Column) -> Column:
    """The limits worth showing, as `key=value` texts in map order."""
    kept = F.map_filter(limits, lambda k, _: k.isin(*C.SHOWN_LIMITS))
    return F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))


def answer_check(found: Column, expected: Column) -> Column:
    """'PASS', or what was expected and found once white space around it is removed."""
    from ..functions.text import strip
    said = strip(F.coalesce(found, F.lit("")))
    return (F.when(said == expected, "PASS")
            .otherwise(F.concat(F.lit("FAIL: expected "), expected, F.lit(", got '"), said, F.lit("'"))))
