"""Join of many rows with at most one row per key, kept parallel when one key is hot.

Adaptive execution splits a hot partition only where both sides of the join come straight from a
shuffle. Where the one-row side was just aggregated on the same key it does not; this join does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def join_one(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """`many` joined with `one` (unique in `keys`); how: inner, left, left_semi or left_anti.

    Rows of hot keys meet their single partner by broadcast: there are at most
    rows / hot_rows such keys. All other rows are joined by shuffle.
    """
    limit = ordered.HOT_ROWS if hot_rows is None else hot_rows
    keys = list(keys)
    hot = (many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).select(*keys))
    added = [c for c in one.columns if c not in keys] if how in ("inner", "left") else []
    partner = (one.join(F.broadcast(hot), keys, "left_semi")
               .select(*keys, *[F.col(c).alias(f"_p_{c}") for c in added], F.lit(True).alias("_met")))
    looked = hot.join(partner, keys, "left").withColumn("_hot", F.lit(True))
    tagged = many.join(F.broadcast(looked), keys, "left")
    cold = (tagged.where(F.col("_hot").isNull()).select(*many.columns)
            .join(one.select(*keys, *added), keys, how).select(*many.columns, *added))
    warm = tagged.where(F.col("_hot"))
    if how in ("inner", "left_semi"):
        warm = warm.where(F.col("_met"))
    elif how == "left_anti":
        warm = warm.where(F.col("_met").isNull())
    return cold.unionByName(warm.select(*many.columns, *[F.col(f"_p_{c}").alias(c) for c in added]))
