"""Order within groups, for groups too large for one task.

A plain window sorts each group in one task. Here a group is first cut into
slices along its order, at splits taken from the whole table, so that no slice
holds much more than ``SLICE_ROWS`` rows even when one group holds most of the
table (``buckets`` sets the number of slices instead). Slices are summarised, the few summaries of a group are put in
order, and only then are rows touched again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a slice is aimed at, and slices at most; beyond that they grow with the table.
SLICE_ROWS, MAX_SLICES = 1 << 16, 1 << 14
_BUCKET = "_slice"
_DIGESTS = 256


def slices_for(df: DataFrame) -> int:
    """Slices of about ``SLICE_ROWS`` rows; a pass that reads no column of a stored table."""
    return max(1, min(-(-df.count() // SLICE_ROWS), MAX_SLICES))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that matches NULL keys, keeping the left keys."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    matched = [left[key].eqNullSafe(renamed[f"_right_{key}"]) for key in keys]
    return left.join(renamed, matched, how).drop(*[f"_right_{key}" for key in keys])


def _filler(kind: T.DataType) -> Column | None:
    """Some value of a type, to stand for a missing key."""
    if isinstance(kind, T.NumericType | T.BooleanType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.lit("").cast(kind)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.lit("1970-01-01").cast(kind)
    return None


def _plain_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns without NULLs that tell groups apart like ``keys``.

    Rows shuffled by them meet other tables by plain equality, so a null-safe join needs
    no shuffle of its own.
    """
    named = {}
    for i, key in enumerate(keys):
        filler = _filler(df.schema[key].dataType)
        plain = F.to_json(F.struct(key)) if filler is None else F.coalesce(key, filler)
        named |= {f"_none{i}": F.col(key).isNull(), f"_key{i}": plain}
    return df.withColumns(named), list(named)


def add_order_bucket(df: DataFrame, order_col: str, buckets: int | None = None) -> DataFrame:
    """Add ``_slice``: rising with ``order_col``, near-equal shares of the table."""
    buckets = slices_for(df) if buckets is None else buckets
    if buckets == 1:
        return df.withColumn(_BUCKET, F.lit(0))
    levels = max(1, (buckets - 1).bit_length())
    # One JSON literal: a thousand separate ones would weigh on every plan step.
    shares = F.from_json(
        F.lit(json.dumps([i / 2**levels for i in range(1, 2**levels)])), "array<double>"
    )
    # The splits only even out the work, so a rough digest of each group of input
    # parts will do, and one task sees no more than _DIGESTS small lists of splits.
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(_DIGESTS))).agg(
        F.percentile_approx(order_col, shares, 2 * 2**levels).alias("_splits")
    )
    listed = parts.select(F.explode("_splits").alias("_split"))
    splits = listed.select(F.percentile_approx("_split", shares, 2 * 2**levels)).scalar()
    steps = F.array(*[F.lit(2**level) for level in reversed(range(levels))])

    def search(below: Column, step: Column) -> Column:
        passed = F.get("_splits", below + step - 1) < F.col(order_col)
        return F.when(passed, below + step).otherwise(below)

    return (
        df.withColumn("_splits", splits)
        .withColumn(_BUCKET, F.aggregate(steps, F.lit(0), search))
        .drop("_splits")
    )


def rank_error_k(rank_error: float) -> int:
    """Size parameter of a KLL sketch with this error of a rank, as a share of all rows.

    By the sketch's published fit of its error with 99 % confidence.
    """
    return min(max(math.ceil((2.296 / rank_error) ** (1 / 0.9723)), 8), 65_535)


def sketched_quantiles(
    df: DataFrame,
    value_col: str,
    shares: Mapping[str, float],
    keys: Sequence[str] = (),
    rank_error: float = 0.001,
) -> DataFrame:
    """Per group, a value of the group near each named share: its rank is within ``rank_error``.

    One pass: each task keeps a KLL sketch a group, of a size set by the error alone, and
    only sketches are shuffled and merged. Missing values are skipped; a group without
    values has no row, a table without groups and values one of NULLs.
    """
    value = F.col(value_col).cast("double")
    sketch = F.kll_sketch_agg_double(value, rank_error_k(rank_error))
    found = df.where(value.isNotNull()).groupBy(*keys).agg(sketch.alias("_sketch"))
    asked = F.array(*[F.lit(float(share)) for share in shares.values()])
    full = F.kll_sketch_get_n_double("_sketch") > 0
    values = F.when(full, F.kll_sketch_get_quantile_double("_sketch", asked))
    return found.select(*keys, values.alias("_values")).select(
        *keys, *[F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(shares)]
    )


def quantiles(
    df: DataFrame,
    value_col: str,
    shares: Mapping[str, float],
    keys: Sequence[str] = (),
    rank_error: float | None = None,
) -> DataFrame:
    """Exact and interpolated, or with a ``rank_error`` sketched in one pass."""
    if rank_error is None:
        return exact_quantiles(df, value_col, shares, keys)
    return sketched_quantiles(df, value_col, shares, keys, rank_error)


def _rows_before(keys: Sequence[str]) -> Window:
    ordered = Window.partitionBy(*keys).orderBy(_BUCKET)
    return ordered.rowsBetween(Window.unboundedPreceding, -1)


def add_position(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    position: str = "position",
    size: str = "group_size",
    buckets: int | None = None,
) -> DataFrame:
    """Add each row's 0-based place in its group, and the group's row count.

    Rows are shuffled once, by group and slice; what is joined to them is one row a slice.
    """
    cut, group = _plain_keys(add_order_bucket(df, order_col, buckets), keys)
    offsets = (
        cut.groupBy(*group, _BUCKET)
        .agg(F.count("*").alias("_rows"))
        .select(
            *group,
            _BUCKET,
            F.coalesce(F.sum("_rows").over(_rows_before(group)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*group)).alias(size),
        )
    )
    in_slice = Window.partitionBy(*group, _BUCKET).orderBy(order_col)
    return (
        cut.withColumn("_place", F.row_number().over(in_slice) - 1)
        .join(offsets, [*group, _BUCKET])
        .withColumn(position, F.col("_place") + F.col("_before"))
        .select(*df.columns, size, position)
    )


def successive_differences(
    df: DataFrame, keys: Sequence[str], order_col: str, value_col: str, buckets: int | None = None
) -> DataFrame:
    """Per group: row count, and sums of |step| and step² between neighbours."""
    cut = add_order_bucket(df, order_col, buckets)
    in_slice = Window.partitionBy(*keys, _BUCKET).orderBy(order_col)
    slices = (
        cut.withColumn("_step", F.col(value_col) - F.lag(value_col).over(in_slice))
        .groupBy(*keys, _BUCKET)
        .agg(
            F.count("*").alias("_rows"),
            F.coalesce(F.sum(F.abs("_step")), F.lit(0.0)).alias("_abs"),
            F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0.0)).alias("_square"),
            F.min_by(value_col, order_col).alias("_first"),
            F.max_by(value_col, order_col).alias("_last"),
        )
    )
    seam = F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy(_BUCKET))
    seam_size = F.coalesce(F.abs("_seam"), F.lit(0.0))
    return (
        slices.withColumn("_seam", seam)
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("rows"),
            F.sum(F.col("_abs") + seam_size).alias("abs_sum"),
            F.sum(F.col("_square") + seam_size * seam_size).alias("square_sum"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    shares: Mapping[str, float],
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Per group, linearly interpolated quantiles, one column per named share.

    Exact like ``percentile``, but no task holds all values of a group: slices are
    counted first, and only rows of those that hold a wanted rank are shuffled, equal
    values as one. Missing values are skipped; a group without values has no row, a table
    without groups and values one of NULLs.
    """
    present = df.where(F.col(value_col).isNotNull()).select(*keys, value_col)
    cut, group = _plain_keys(add_order_bucket(present, value_col, buckets), keys)
    before = F.coalesce(F.sum("_rows").over(_rows_before(group)), F.lit(0))
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            ((F.col("_total") - 1) * F.lit(float(share))).alias("rank"),
        )
        for name, share in shares.items()
    ])
    targets = (
        cut.groupBy(*group, _BUCKET)
        .agg(F.count("*").alias("_rows"))
        .select(
            *group,
            _BUCKET,
            "_rows",
            before.alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*group)).alias("_total"),
        )
        .select(*group, _BUCKET, "_rows", "_before", F.explode(wanted).alias("_want"))
        .where(
            (F.ceil("_want.rank") >= F.col("_before"))
            & (F.floor("_want.rank") < F.col("_before") + F.col("_rows"))
        )
        .groupBy(*group, _BUCKET)
        .agg(F.max("_before").alias("_before"), F.collect_list("_want").alias("_wants"))
    )
    held = cut.join(targets.select(*group, _BUCKET), [*group, _BUCKET], "left_semi")
    counts = held.groupBy(*group, *keys, _BUCKET, value_col).agg(F.count("*").alias("_rows"))
    up_to = Window.partitionBy(*group, _BUCKET).orderBy(value_col)
    ranked = (
        counts.join(targets, [*group, _BUCKET])
        .withColumn("_end", F.col("_before") + F.sum("_rows").over(up_to))
        .withColumn("_want", F.explode("_wants"))
    )

    def at(rank: Column) -> Column:
        held = (rank >= F.col("_end") - F.col("_rows")) & (rank < F.col("_end"))
        return F.max(F.when(held, F.col(value_col).cast("double")))

    rank = F.col("_want.rank")
    found = ranked.groupBy(*keys, "_want.name").agg(
        at(F.floor(rank)).alias("_low"),
        at(F.ceil(rank)).alias("_high"),
        F.max(rank - F.floor(rank)).alias("_part"),
    )
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares]
    )
