"""Group statistics, rescaling, correlation, trims and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.constants import BAND_LEVEL, SIGNIFICANCE, TRIM_QUANTILES
from reelgauge.functions.tails import t_two_sided
from reelgauge.operators.ordering import null_safe_join, quantiles
from reelgauge.shipping import ship_package


def bounds(df: DataFrame, *columns: str) -> dict[str, tuple[float | None, float | None]]:
    """(min, max) of each column, worked out at once.

    Like fitting a scaler: one row comes back, and as literals the bounds keep
    later plans small and reach the scan's pushed filters.
    """
    found = {name: (low, high) for name, low, high in min_max(df, *columns).collect()}
    return {name: found[name] for name in columns}


def min_max(df: DataFrame, *columns: str) -> DataFrame:
    """(column_name, min_value, max_value) for each column, in one pass."""
    ends = df.agg(*[
        F.struct(
            F.lit(name).alias("column_name"),
            F.min(name).cast("double").alias("min_value"),
            F.max(name).cast("double").alias("max_value"),
        ).alias(name)
        for name in columns
    ])
    return ends.select(F.inline(F.array(*columns)))


def group_gap(df: DataFrame, flag_col: str, *value_cols: str) -> DataFrame:
    """(column_name, flagged_mean, other_mean, gap) in one pass."""
    flagged = F.col(flag_col)
    means = df.agg(*[
        F.struct(
            F.lit(name).alias("column_name"),
            F.avg(F.when(flagged, F.col(name))).alias("flagged_mean"),
            F.avg(F.when(~flagged, F.col(name))).alias("other_mean"),
        ).alias(name)
        for name in value_cols
    ])
    return means.select(F.inline(F.array(*value_cols))).withColumn(
        "gap", F.col("flagged_mean") - F.col("other_mean")
    )


def trim_outliers(
    df: DataFrame,
    value_col: str,
    shares: tuple[float, float] = TRIM_QUANTILES,
    rank_error: float | None = None,
) -> DataFrame:
    """Rows whose value lies between two quantiles, both included.

    The two limits are worked out at once; with a ``rank_error`` from sketches.
    """
    limits = quantiles(df, value_col, {"low": shares[0], "high": shares[1]}, (), rank_error).first()
    return df.where(F.col(value_col).between(F.lit(limits.low), F.lit(limits.high)))


def min_max_scaled(value: Column, low: float | None, high: float | None) -> Column:
    """Value on [0, 1]; NULL when the column is constant."""
    if low is None or low == high:
        return F.lit(None).cast("double")
    return (value - F.lit(low)) / F.lit(high - low)


def min_max_scaler(value: Column, low: float | None, high: float | None) -> Column:
    """Value on [0, 1]; 0 when the column is constant."""
    return value * 0 if low == high else min_max_scaled(value, low, high)


def rescale_residual(
    value: Column, low: float | None, high: float | None, passes: int = 2
) -> Column:
    """``2 (value - low) / (high - low) - 1``, repeated; 0 when constant.

    Every pass uses the first pass's bounds, and verdict thresholds rest on
    two passes.
    """
    if low is None or low == high:
        return value * 0
    for _ in range(passes):
        value = 2 * (value - F.lit(low)) / F.lit(high - low) - 1
    return value


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r) over pairwise complete rows, all pairs in one aggregate."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]

    def pearson(x: str, y: str) -> Column:
        # Not corr(): with ANSI arithmetic it fails on a constant column.
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
        varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        return F.when(varied, F.lit(1.0) if x == y else r)

    one_row = df.agg(*[pearson(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    place = {pair: f"r{i}" for i, pair in enumerate(pairs)}
    entries = [
        F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            F.col(place.get((x, y)) or place[y, x]).alias("r"),
        )
        for x in columns
        for y in columns
    ]
    return one_row.select(F.inline(F.array(*entries)))


def welch_statistic(
    df: DataFrame, flag_col: str, value_col: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Per group: two-sample t statistic and its degrees of freedom, unequal variances."""
    sides = {"flagged": F.col(flag_col), "other": ~F.col(flag_col)}
    moments = [
        moment(F.when(side, F.col(value_col))).alias(f"{name}_{suffix}")
        for name, side in sides.items()
        for moment, suffix in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))
    ]
    share = {name: F.col(f"{name}_var") / F.nullif(f"{name}_n", F.lit(0)) for name in sides}
    a, b = share["flagged"], share["other"]
    freedom = F.try_divide(
        (a + b) * (a + b),
        F.try_divide(a * a, F.col("flagged_n") - 1) + F.try_divide(b * b, F.col("other_n") - 1),
    )
    gap = F.col("flagged_mean") - F.col("other_mean")
    return df.groupBy(*keys).agg(*moments).select(
        *keys,
        "flagged_n",
        "other_n",
        "flagged_mean",
        "other_mean",
        F.try_divide(gap, F.sqrt(a + b)).alias("t_statistic"),
        freedom.alias("degrees_of_freedom"),
    )


def welch_test(
    df: DataFrame,
    flag_col: str,
    value_col: str,
    level: float = SIGNIFICANCE,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per group: ``welch_statistic`` with its two-sided p-value and verdict.

    One aggregate; the tail is worked out in columns of its rows.
    """
    tested = welch_statistic(df, flag_col, value_col, keys)
    p_value = t_two_sided(F.col("t_statistic"), F.col("degrees_of_freedom"))
    return tested.withColumn("p_value", p_value).withColumn(
        "significant", F.coalesce(F.col("p_value") < level, F.lit(False))
    )


def box_summary(
    df: DataFrame, key_col: str, value_col: str, rank_error: float | None = None
) -> DataFrame:
    """Per group: quartiles, whisker ends inside 1.5 IQR fences, outlier count.

    With a ``rank_error`` the quartiles come from sketches; what they fence is exact.
    """
    quarters = quantiles(
        df, value_col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [key_col], rank_error
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = null_safe_join(
        df.where(F.col(value_col).isNotNull()).select(key_col, value_col), quarters, [key_col]
    )
    inside = F.col(value_col).between(F.col("q1") - reach, F.col("q3") + reach)
    kept = F.when(inside, F.col(value_col))
    return fenced.groupBy(key_col, "q1", "median", "q3").agg(
        F.min(kept).alias("whisker_low"),
        F.max(kept).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R² and row count of y on x."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("rows"),
    )


#: Weights drawn from one digest, each from 16 of its 128 bits.
_DRAWS = 8
_MOMENTS = ("rows", "sum_x", "sum_y", "sum_xx", "sum_xy", "sum_yy")


def poisson_limits() -> list[int]:
    """Upper ends of the 16-bit draws that give weights 0, 1, 2, ... of a Poisson(1)."""
    limits, share, total = [], math.exp(-1), 0.0
    for weight in range(1, 10):
        total += share
        limits.append(round(total * 65_536))
        share /= weight
    return limits


def bootstrap_moments(
    df: DataFrame, x: str, y: str, key_cols: Sequence[str], replicates: int = 200
) -> DataFrame:
    """(replicate, rows, sum_x, ...): moments of Poisson bootstrap samples, in one pass.

    A row's key alone decides how often it is in each sample, so reruns and other
    partitionings agree. A task sends one row a replicate. Rows that miss x, y or a part
    of the key are in no sample.
    """
    ship_package(df.sparkSession)
    blocks = -(-replicates // _DRAWS)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols])
    digests = [F.unhex(F.md5(F.concat_ws("/", key, F.lit(str(i)))).cast("string")) for i in range(blocks)]
    limits = np.array(poisson_limits())
    drawn = df.na.drop(subset=[x, y, *key_cols]).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.concat(*digests).alias("draws")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks * _DRAWS, len(_MOMENTS)))
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(len(a), -1)
            weight = np.searchsorted(limits, bits.ravel(), "right").reshape(bits.shape).astype(np.float64)
            total += weight.T @ np.column_stack([np.ones(len(a)), a, b, a * a, a * b, b * b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(replicates), pa.int32()), *(pa.array(column) for column in total[:replicates].T)],
            ["replicate", *_MOMENTS],
        )

    kinds = ", ".join(f"{name} double" for name in _MOMENTS)
    found = drawn.mapInArrow(run, f"replicate int, {kinds}")
    return found.groupBy("replicate").agg(*[F.sum(name).alias(name) for name in _MOMENTS])


def bootstrap_lines(
    df: DataFrame, x: str, y: str, key_cols: Sequence[str], replicates: int = 200
) -> DataFrame:
    """(replicate, slope, intercept) of y on x; NULL where a sample's x does not vary."""
    moments = bootstrap_moments(df, x, y, key_cols, replicates)
    spread = F.col("sum_xx") - F.try_divide(F.col("sum_x") * F.col("sum_x"), "rows")
    joint = F.col("sum_xy") - F.try_divide(F.col("sum_x") * F.col("sum_y"), "rows")
    # Sums of equal x leave rounding, not spread.
    varied = spread > 1e-12 * F.col("sum_xx")
    return moments.withColumn("slope", F.when(varied, F.try_divide(joint, spread))).select(
        "replicate",
        "slope",
        F.try_divide(F.col("sum_y") - F.col("slope") * F.col("sum_x"), "rows").alias("intercept"),
    )


def regression_band(
    df: DataFrame,
    x: str,
    y: str,
    key_cols: Sequence[str],
    points: int = 100,
    replicates: int = 200,
    level: float = BAND_LEVEL,
) -> DataFrame:
    """(x, fitted, low, high): the line of y on x and its bootstrap band on a grid.

    The grid spans the x of rows that have y too. Lines times points, both parameters,
    bound what is ranked.
    """
    complete = df.na.drop(subset=[x, y])
    low, high = bounds(complete, x)[x]
    line = regression_line(complete, x, y).first()
    lines = bootstrap_lines(df, x, y, key_cols, replicates)
    if low is None:
        return lines.select(*[F.lit(None).cast("double").alias(c) for c in ("x", "fitted", "low", "high")]).limit(0)
    step = (high - low) / (points - 1) if points > 1 else 0.0
    at = F.lit(low) + F.col("point") * F.lit(step)
    spread = lines.select("slope", "intercept", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    edges = F.percentile(
        F.col("slope") * at + F.col("intercept"), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    )
    ranked = spread.groupBy("point").agg(edges.alias("_edges"))
    fitted = F.lit(line.slope).cast("double") * F.col("x") + F.lit(line.intercept).cast("double")
    return ranked.select(
        at.alias("x"), F.get("_edges", F.lit(0)).alias("low"), F.get("_edges", F.lit(1)).alias("high")
    ).select("x", fitted.alias("fitted"), "low", "high")
