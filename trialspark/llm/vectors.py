"""Shared small parts for tables of vectors."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def doubles(vector: Column) -> Column:
    """The vector as doubles; null where it is null or an entry is null or not finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, v)


def matrix(column, size: int) -> np.ndarray:
    """An Arrow column of lists of `size` doubles as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def whole(x: np.ndarray, scale: float, most: float) -> np.ndarray:
    """floor(scale * x), held to `most` either way; whole numbers as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -most, most) + 0.0
