"""Right-closed bins, as pandas cuts them, and means that keep empty bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.operators.stats import bounds


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """1-based bin with ``edges[i-1] < value <= edges[i]``, NULL outside all."""
    index = F.when(value <= edges[0], F.lit(None).cast("int"))
    for place, edge in enumerate(edges[1:], start=1):
        index = index.when(value <= edge, place)
    return index


def equal_width_edges(df: DataFrame, value_col: str, bins: int = 3) -> list[float]:
    """Edges of ``bins`` equal steps over the column's range, found at once.

    The first edge lies 0.1% of the range lower, so the minimum is inside; a
    constant column is widened by 0.1% of its value on both sides.
    """
    low, high = bounds(df, value_col)[value_col]
    if low is None:
        raise ValueError(f"{value_col} holds no values to bin")
    if low == high:
        margin = abs(low) * 0.001 or 0.001
        return np.linspace(low - margin, high + margin, bins + 1).tolist()
    _, *rest = np.linspace(low, high, bins + 1).tolist()
    return [low - (high - low) * 0.001, *rest]


def mean_per_bin(
    df: DataFrame, value_col: str, target_col: str, edges: Sequence[float]
) -> DataFrame:
    """(bin_idx, lo, hi, rows, mean_value) for every bin, empty ones included."""
    placed = df.select(
        bin_index(F.col(value_col), edges).alias("_bin"),
        F.col(target_col).alias("_target"),
    )
    entries = [
        F.struct(
            F.lit(i).alias("bin_idx"),
            F.lit(float(edges[i - 1])).alias("lo"),
            F.lit(float(edges[i])).alias("hi"),
            F.count(F.when(F.col("_bin") == i, 1)).alias("rows"),
            F.avg(F.when(F.col("_bin") == i, F.col("_target"))).alias("mean_value"),
        )
        for i in range(1, len(edges))
    ]
    one_row = placed.agg(F.array(*entries).alias("bins"))
    return one_row.select(F.inline("bins"))
