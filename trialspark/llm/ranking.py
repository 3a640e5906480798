"""The best rows of each key, by a tree of partial rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Partial lists of a key that one task ranks together.
FAN_IN = 64


def best(rows: DataFrame, key: list[str], order: list[Column], k: int, part: str, parts: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key in `order`, numbered from 1 in `rank`.

    `part` (0 to `parts` - 1) tells which partial list a row comes from. Lists of neighbouring parts are merged FAN_IN at a
    time, level by level, so that no task ever ranks more than FAN_IN * k rows of one key. Each level keeps k rows per list.
    """
    width = FAN_IN
    while width < parts:
        level = Window.partitionBy(*key, "_level").orderBy(*order)
        rows = (rows.withColumn("_level", F.floor(F.col(part) / width)).withColumn("_rank", F.row_number().over(level))
                .where(F.col("_rank") <= k).drop("_level", "_rank"))
        width *= FAN_IN
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)
