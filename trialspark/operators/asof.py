"""Backward as-of join: each row with the last row of another table at or before its own position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ordered


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], strict: bool = False,
          matched_at: str = "matched_at", hot_rows: int | None = None) -> DataFrame:
    """`left` with `values` of the last row of `right` of the same keys whose `at` is at most its own (`strict`: below it).

    Both tables have the columns `keys` and `at`, a whole number. `matched_at` is the position of the row found; it and the values
    are null where there is none. Of several rows at one position the greatest in `values` counts, so those must have an order.
    A null key or position meets nothing. Left rows are kept as often as they occur.

    The tables are laid over each other and what was last seen is carried along (`ordered.running`): one shuffle of both, no pairs
    of rows, and a hot key is cut into chunks of its positions.
    """
    keys = list(keys)
    # Rows of the right table come before left ones of the same position, or after them.
    mine, theirs = (0, 1) if strict else (1, 0)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, at]])
    row = F.struct(*left.columns).alias("_row")
    asked = left.select(*keys, F.col(at).alias("_at"), F.lit(mine).alias("_side"), row, F.lit(None).cast("boolean").alias("_is_right"))
    seen = F.struct(F.col(at).cast("bigint").alias("at"), F.struct(*values).alias("v"))
    offered = right.where(known).select(*keys, F.col(at).alias("_at"), F.lit(theirs).alias("_side"), seen.alias("_offer"), F.lit(True).alias("_is_right"))
    both = asked.unionByName(offered, allowMissingColumns=True)
    position = F.coalesce(F.col("_at").cast("bigint"), F.lit(0))
    last = ordered.running(both, keys, ["_at", "_side"], position, {"_last": ("max", F.col("_offer"))}, hot_rows=hot_rows)
    met = reduce(lambda a, b: a & b, [F.col(f"_row.`{k}`").isNotNull() for k in [*keys, at]])
    found = last.where(F.col("_is_right").isNull()).withColumn("_last", F.when(met, F.col("_last")))
    return found.select("_row.*", F.col("_last.at").alias(matched_at), *[F.col(f"_last.v.`{v}`").alias(v) for v in values])
