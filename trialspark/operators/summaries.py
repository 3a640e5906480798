"""Pass rates, verdicts and totals over graded trials. Every total is pre-aggregated per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .grading import any_entry, present


def mean(column: str) -> Column:
    """Average by an exact sum, so it does not depend on the order rows arrive in."""
    return F.try_divide(F.sum(F.col(column).cast("decimal(20,6)")).cast("double"), F.count(column))


def mean_where(column: str, kept: Column) -> Column:
    value = F.when(kept, F.col(column))
    return F.try_divide(F.sum(value.cast("decimal(20,6)")).cast("double"), F.count(value))


def _counts(status: str = "status") -> list[Column]:
    s = F.col(status)
    return [F.count(F.lit(1)).alias("total"), F.count_if(s == "PASS").alias("passed"),
            F.count_if(s.isin(*C.FAILED)).alias("failed"), F.count_if(s == "TAMPER").alias("tampered"),
            F.count_if(s == "running").alias("running")]


def run_summary(runs: DataFrame, trials: DataFrame) -> DataFrame:
    """Counts per run, runs without trials included. Trials are counted before they meet their run."""
    counts = trials.groupBy("run_id").agg(*_counts(), F.sort_array(F.collect_set("task")).alias("tasks"))
    zero = F.lit(0).cast("bigint")
    return (runs.join(counts, "run_id", "left")
            .select(*[runs[c] for c in runs.columns],
                    *[F.coalesce(c, zero).alias(c) for c in ("total", "passed", "failed", "tampered", "running")],
                    F.coalesce("tasks", F.array().cast("array<string>")).alias("tasks")))


def run_page(runs: DataFrame, trials: DataFrame, run_id) -> DataFrame:
    """One run's record and counts beside each of its trials, by task and number.

    `runs` has one row per run_id, `trials` its columns apart from those of `runs`. Both are cut to the run before anything else,
    so with tables laid out by run this reads one run. A run without trials has one row, an unknown run none.
    """
    own = trials.where(F.col("run_id") == F.lit(run_id))
    header = run_summary(runs.where(F.col("run_id") == F.lit(run_id)), own)
    listed = own.withColumnRenamed("status", "trial_status")
    matched = listed.join(F.broadcast(header), "run_id")  # one row
    empty = header.where(F.col("total") == 0)
    return matched.unionByName(empty, allowMissingColumns=True).orderBy("task", "trial_no")


def runs_with_trials(runs: DataFrame, trials: DataFrame) -> DataFrame:
    """Left join kept parallel for a hot run: matched pairs, then the runs that have none.

    A left join cannot split a hot right side; an inner join can.
    """
    matched = trials.join(runs, "run_id")
    started = trials.select("run_id").distinct()
    empty = runs.join(started, "run_id", "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def task_summary(trials: DataFrame, by: tuple[str, ...] = ("task",)) -> DataFrame:
    """Trials, outcomes and averages per task; a trial without steps counts as zero steps."""
    n = F.count(F.lit(1))
    return trials.groupBy(*by).agg(
        n.alias("trials"), F.count_if("passed").alias("passed"),
        F.count_if(any_entry(F.col("tampering"))).alias("tampered"),
        F.count_if(present(F.col("violation"))).alias("resource_limited"),
        (F.sum(F.coalesce("steps", F.lit(0)).cast("bigint")).cast("double") / n).alias("avg_steps"),
        mean("duration").alias("avg_seconds"))


def overall(trials: DataFrame, planned: DataFrame) -> DataFrame:
    """Passed trials against all planned ones, whether recorded or not."""
    marks = (trials.select(F.col("passed").cast("int").alias("p"), F.lit(0).alias("j"))
             .unionByName(planned.select(F.lit(0).alias("p"), F.lit(1).alias("j"))))
    return (marks.agg(F.sum("p").alias("passed"), F.sum("j").alias("planned"))
            .withColumn("rate", F.try_divide("passed", "planned")))


def run_task_groups(trials: DataFrame) -> DataFrame:
    s = F.col("status")
    return (trials.groupBy("run_id", "task")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "PASS").alias("passed"),
                 F.count_if(s.isin(*C.GRADED)).alias("done")))


def run_progress(summary: DataFrame) -> DataFrame:
    from ..functions.text import percent_halfup
    finished = F.col("passed") + F.col("failed")
    return summary.select(
        "run_id", "total", finished.alias("finished"),
        F.try_divide(F.lit(100.0) * F.col("passed"), F.col("total")).alias("passed_width"),
        F.try_divide(F.lit(100.0) * F.col("failed"), F.col("total")).alias("failed_width"),
        percent_halfup(F.col("passed"), finished).alias("pass_rate"))


def run_task_rollup(trials: DataFrame) -> DataFrame:
    s = F.col("status")
    return (trials.rollup("run_id", "task")
            .agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("total"),
                 F.count_if(s == "PASS").alias("passed"), F.count_if(s.isin(*C.FAILED)).alias("failed")))


def attempts(oracles: DataFrame, noops: DataFrame) -> DataFrame:
    """Reference-solution attempts, plus the first no-op of each task, marked with their mode."""
    first = noops.groupBy("task").agg(F.min_by(F.struct(*[c for c in noops.columns if c != "task"]),
                                               "attempt_no").alias("r"))
    one = first.select("task", "r.*")
    return (oracles.withColumn("mode", F.lit("oracle"))
            .unionByName(one.withColumn("mode", F.lit("noop"))))


def verdicts(tried: DataFrame) -> DataFrame:
    """One verdict per task from its attempts (`attempts`), and the report line beside it.

    The first offender is the earliest attempt, reference attempts before the no-op.
    """
    oracle = F.col("mode") == "oracle"
    rank = F.struct(F.when(oracle, 0).otherwise(1), F.col("attempt_no"))
    bad_limit, bad_touch = present(F.col("violation")), oracle & any_entry(F.col("tampering"))
    ok = F.col("tests_passed")
    facts = tried.groupBy("task").agg(
        F.count_if(present(F.col("error"))).alias("errors"),
        F.min_by(F.when(bad_limit, F.struct("mode", "violation")), F.when(bad_limit, rank)).alias("limit"),
        F.min_by(F.when(bad_touch, F.slice("tampering", 1, 3)), F.when(bad_touch, rank)).alias("touched"),
        F.count_if(oracle).alias("oracles"), F.count_if(oracle & ok).alias("passes"),
        F.count_if(~oracle & ok).alias("noop_passes"),
        F.max(F.when(~oracle, F.when(present(F.col("error")), "ERROR").when(bad_limit, "LIMIT")
                     .when(ok, "PASS").otherwise("FAIL"))).alias("noop"),
        mean_where("duration", oracle).alias("avg_seconds"))
    n, k = F.col("oracles"), F.col("passes")
    verdict = (
        F.when(F.col("errors") > 0, "ERROR")
        .when(F.col("limit").isNotNull(), F.concat(F.lit("LIMIT: "), F.col("limit.mode"), F.lit(" hit a resource limit ("),
                                                   F.col("limit.violation"), F.lit(")")))
        .when(F.col("touched").isNotNull(), F.concat(F.lit("INVASIVE: reference solution modifies protected paths ("),
                                                     F.array_join("touched", ", "), F.lit(")")))
        .when(k == 0, "BROKEN: reference solution fails the tests")
        .when(k < n, F.concat(F.lit("FLAKY: reference solution passed only "), k, F.lit("/"), n, F.lit(" times")))
        .when(F.col("noop_passes") > 0, "WEAK: tests pass without any changes")
        .otherwise("OK"))
    return facts.select("task", "passes", "oracles", "noop", "avg_seconds", verdict.alias("verdict"))


def false_success(trials: DataFrame, *by: str) -> DataFrame:
    """Trials that called finish, and those of them that were not solved."""
    claimed = F.count_if("finished")
    wrong = F.count_if(F.col("finished") & ~F.col("passed"))
    return trials.groupBy(*by).agg(claimed.alias("finished"), wrong.alias("not_solved"),
                                   F.try_divide(wrong, claimed).alias("share"))


def token_totals(usage: DataFrame) -> DataFrame:
    """Tokens and model calls per trial; a missing count is zero."""
    zero = F.lit(0).cast("bigint")
    return usage.groupBy("trial_id").agg(
        F.sum(F.coalesce("prompt", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion", zero)).alias("completion_tokens"),
        F.count_if("call").alias("llm_calls"))


def showcase_trial(trials: DataFrame) -> DataFrame:
    """The trial of each run that replays best: passing with 2-8 steps, then most steps.

    Ties go to the first in (task, trial_no) order. One aggregate per run; its buffer holds text, so rows are sorted by run before it.
    """
    preferred = (F.col("status") == "PASS") & F.col("steps").between(2, 8)
    rank = F.struct((~preferred).cast("int"), -F.col("steps"), F.col("task"), F.col("trial_no"))
    return (trials.where("steps > 0").groupBy("run_id")
            .agg(F.min_by(F.struct("trial_id", "task", "trial_no", "steps", "status"), rank).alias("t"))
            .select("run_id", "t.*"))


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), "run_id").limit(limit)


def top_spender(customers: DataFrame, orders: DataFrame, items: DataFrame, year: int = 2025) -> DataFrame:
    """Largest total of the year's paid orders, by customer id (names repeat).

    customers(id, name), orders(id, customer_id, placed_at, status), items(order_id, price_cents, quantity).
    """
    in_year = (F.col("placed_at") >= f"{year}-01-01") & (F.col("placed_at") < f"{year + 1}-01-01")
    paid = orders.where((F.col("status") == "paid") & in_year)
    return spend(customers, paid, items).orderBy(F.col("total").desc(), "id").limit(1)


def spend(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Total per customer. Totals shrink to one row per customer before names are joined."""
    # Summing per order first needs no more shuffles than joining items, and no order is hot after it.
    per_order = (items.groupBy(F.col("order_id").alias("oid"))
                 .agg(F.sum(F.col("price_cents") * F.col("quantity")).alias("cents")))
    totals = (orders.join(per_order, orders["id"] == per_order["oid"])
              .groupBy(F.col("customer_id").alias("cid")).agg(F.sum("cents").alias("total")))
    return customers.join(totals, customers["id"] == totals["cid"]).select("id", "name", "total")


def amount(quantity: str, price: str) -> Column:
    return F.col(quantity).cast("decimal(18,4)") * F.col(price).cast("decimal(18,6)")


def region_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per region, from (region, amount), sorted by name; the sum is exact."""
    from ..functions.text import fixed
    return (sales.groupBy("region").agg(F.sum("amount").cast("decimal(30,2)").alias("revenue"))
            .withColumn("line", F.concat("region", F.lit(": "), fixed(F.col("revenue"), 2)))
            .orderBy("region"))


def file_growth(sizes: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Bytes added per source and restarts seen as gaps above one second, from (source, us, seq, size)."""
    from ..plans.ordered import neighbour
    pairs = neighbour(sizes, ["source"], ["us", "seq"], F.col("us"), "_before",
                      F.struct("size", "us"), hot_rows=hot_rows)
    delta = F.col("size") - F.col("_before.size")
    gap = F.col("us") - F.col("_before.us")
    return pairs.groupBy("source").agg(
        F.coalesce(F.sum(F.when(delta > 0, delta)), F.lit(0)).alias("grown"),
        F.count_if(gap > 1_000_000).alias("restarts"), F.count(F.lit(1)).alias("samples"))


#: Bits of a sketch's registers, and the share by which its estimate may be off (three standard errors).
SKETCH_BITS = 12
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def task_sketches(trials: DataFrame, keys: tuple[str, ...] = ("run_id",), task: str = "task") -> DataFrame:
    """A sketch of the distinct tasks of each run, some kilobytes at most, however many trials it has.

    Sketches can be kept and merged: those of new runs are added to old ones without going back to the trials.
    """
    return trials.groupBy(*keys).agg(F.hll_sketch_agg(task, SKETCH_BITS).alias("sketch"))


def sketched_tasks(sketches: DataFrame) -> DataFrame:
    """(run_id, estimate) of every run, and of all runs together (null run_id), by merging the runs' sketches."""
    each = sketches.select("run_id", F.hll_sketch_estimate("sketch").alias("estimate"))
    whole = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return each.unionByName(whole.select(F.lit(None).cast(sketches.schema["run_id"].dataType).alias("run_id"), "estimate"))
