"""Ordered computations per group that stay parallel when one group holds much of the data.

A plain window over a hot key sorts that key's rows in one task. Here a group above
`hot_rows` is cut into chunks of its ordering column; each chunk is a window of its own, and
what earlier chunks pass on (a count, a sum, a maximum, the last rows) is computed from one
row per chunk and joined back. Ordinary groups are a single chunk, so they cost one shuffle
like a plain window. The join reuses the window's partitioning: no second shuffle of the rows.

The list of hot groups is found first, by one job when the plan is built, kept in the shared folder and
broadcast. It cannot exceed rows / hot_rows entries.
Groups with a null key are never cut; results are the same, only less parallel.

Rows cut once with `chunked` can pass through several of these functions without another
shuffle. Pass hot_rows=BOUNDED where every group is known to be small: that is a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import shared_dir

HOT_ROWS = 5_000_000
BOUNDED = -1

_FOLD = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "max": (F.max, F.max),
    "min": (F.min, F.min),
}


def _matches(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in pairs))


def chunked(df: DataFrame, keys: Sequence[str], position: Column, hot_rows: int | None = None) -> DataFrame:
    """Add `_hot` and `_chunk`. `position` is a whole number that grows with the ordering.

    A hot group's span of positions is cut evenly, four times finer than its row count asks
    for, so that uneven stretches still fit a task. Rows of one position stay together.
    """
    if "_chunk" in df.columns:
        return df
    if hot_rows == BOUNDED:
        return df.select("*", F.lit(False).alias("_hot"), F.lit(0).cast("bigint").alias("_chunk"))
    limit = HOT_ROWS if hot_rows is None else hot_rows
    at = position.cast("bigint")
    pieces = F.ceil(F.col("_rows") / max(limit, 1)) * 4
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(at).alias("_low"), F.max(at).alias("_high"))
           .where(F.col("_rows") > limit)
           .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_low",
                   F.ceil((F.col("_high") - F.col("_low") + 1) / pieces).cast("bigint").alias("_width")))
    # The list is settled first: without a hot group the rest of the plan is a plain window.
    shared_dir(df.sparkSession)
    hot = hot.checkpoint()
    if hot.isEmpty():
        return df.select("*", F.lit(False).alias("_hot"), F.lit(0).cast("bigint").alias("_chunk"))
    joined = df.join(F.broadcast(hot), _matches(df, hot, [(k, f"_hot_{k}") for k in keys]), "left")
    past = at - F.col("_low")
    chunk = F.coalesce(past - F.pmod(past, F.col("_width")), F.lit(0).cast("bigint"))
    return joined.select(*[df[c] for c in df.columns], F.col("_width").isNotNull().alias("_hot"), chunk.alias("_chunk"))


def _window(keys: Sequence[str], hot_rows: int | None) -> WindowSpec:
    return Window.partitionBy(*keys) if hot_rows == BOUNDED else Window.partitionBy(*keys, "_chunk")


def _with_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str], hot_rows: int | None) -> DataFrame:
    if hot_rows == BOUNDED:
        passed_on = [c for c in carry.columns if c not in (*keys, "_chunk")]
        return local.select("*", *[F.lit(None).cast(carry.schema[c].dataType).alias(c) for c in passed_on])
    names = [*keys, "_chunk"]
    other = carry.select(*[F.col(k).alias(f"_c_{k}") for k in names],
                         *[F.col(c) for c in carry.columns if c not in names])
    return local.join(other, _matches(local, other, [(k, f"_c_{k}") for k in names]), "left")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column,
            folds: dict[str, tuple[str, Column]], through_current: bool = True,
            hot_rows: int | None = None) -> DataFrame:
    """Running count / sum / max / min per group. `folds`: new column -> (kind, column)."""
    rows = chunked(df, keys, position, hot_rows)
    upto = 0 if through_current else -1
    frame = (_window(keys, hot_rows).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, upto))
    local = rows.select("*", *[_FOLD[kind][0](col).over(frame).alias(f"_l_{name}")
                               for name, (kind, col) in folds.items()])
    totals = (rows.where("_hot").groupBy(*keys, "_chunk")
              .agg(*[_FOLD[kind][0](col).alias(f"_t_{name}") for name, (kind, col) in folds.items()]))
    earlier = (Window.partitionBy(*keys).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*keys, "_chunk", *[_FOLD[kind][1](f"_t_{name}").over(earlier).alias(f"_b_{name}")
                                             for name, (kind, _) in folds.items()])
    joined = _with_carry(local, carry, keys, hot_rows)

    def combine(name: str, kind: str) -> Column:
        here, before = F.col(f"_l_{name}"), F.col(f"_b_{name}")
        if kind in ("max", "min"):
            return (F.greatest if kind == "max" else F.least)(here, before)
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))

    return joined.select(*df.columns, *[combine(n, kind).alias(n) for n, (kind, _) in folds.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column,
             name: str, hot_rows: int | None = None) -> DataFrame:
    """1-based row number per group."""
    return running(df, keys, order, position, {name: ("count", F.lit(1))}, hot_rows=hot_rows)


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column,
              name: str, value: Column, following: bool = False, hot_rows: int | None = None) -> DataFrame:
    """`value` of the row before (or after) in its group; null where there is none.

    `value` itself must not be null: wrap it in a struct where it may be.
    """
    rows = chunked(df, keys, position, hot_rows)
    frame = _window(keys, hot_rows).orderBy(*order)
    shift, edge = (F.lead, F.min_by) if following else (F.lag, F.max_by)
    local = rows.select("*", shift(value).over(frame).alias("_near"))
    edges = (rows.where("_hot").groupBy(*keys, "_chunk")
             .agg(edge(value, F.struct(*order)).alias("_edge")))
    carry = edges.select(*keys, "_chunk",
                         shift("_edge").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_far"))
    return (_with_carry(local, carry, keys, hot_rows)
            .select(*df.columns, F.coalesce("_near", "_far").alias(name)))


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column,
           name: str, value: Column, count: int, hot_rows: int | None = None) -> DataFrame:
    """Array of the last `count` values of the group, the current one last. `value` is not null."""
    rows = chunked(df, keys, position, hot_rows)
    frame = _window(keys, hot_rows).orderBy(*order)
    local = rows.select("*", F.collect_list(value).over(frame.rowsBetween(1 - count, 0)).alias("_here"))
    # Only the last rows of each chunk reach the next one; the rank filter is applied before the shuffle.
    last_first = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    tails = (rows.where("_hot").withColumn("_rank", F.row_number().over(last_first))
             .where(F.col("_rank") < count)
             .groupBy(*keys, "_chunk")
             .agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_rank", value.alias("_v"))))),
                              lambda x: x["_v"]).alias("_tail")))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1 - count, -1)
    carry = tails.select(*keys, "_chunk", F.flatten(F.collect_list("_tail").over(earlier)).alias("_before"))
    both = F.when(F.col("_before").isNull(), F.col("_here")).otherwise(F.concat("_before", "_here"))
    last = F.when(F.size(both) > count, F.slice(both, -count, count)).otherwise(both)
    return _with_carry(local, carry, keys, hot_rows).select(*df.columns, last.alias(name))


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Dense 1-based number over the whole table in `order`, without one task seeing it all.

    The sorted rows are checkpointed in the shared folder, so that numbering and counting
    see the same partitions; then one count per partition gives every partition its start.
    """
    shared_dir(df.sparkSession)
    fixed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    starts = (fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
              .select("_part", F.coalesce(F.sum("_rows").over(
                  Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start")))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions.
    return (fixed.join(F.broadcast(starts), part == F.col("_part"))
            .select(*df.columns, (F.col("_start") + within + 1).alias(name)))
