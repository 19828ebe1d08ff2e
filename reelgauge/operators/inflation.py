"""Price-index multipliers by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.constants import INDEX_BASE_YEAR


def yearly_multipliers(
    series: DataFrame,
    base_year: int = INDEX_BASE_YEAR,
    date_col: str = "date",
    value_col: str = "value",
) -> DataFrame:
    """(year, multiplier): base-year mean over the year's mean, 4 digits."""
    yearly = (
        series.where(F.col(date_col).isNotNull())
        .groupBy(F.year(date_col).alias("year"))
        .agg(F.avg(value_col).alias("mean_value"))
    )
    base = yearly.where(F.col("year") == base_year).select("mean_value").scalar()
    return yearly.select(
        "year",
        F.round(F.try_divide(base, F.nullif("mean_value", F.lit(0.0))), 4).alias("multiplier"),
    )


def add_multiplier(
    df: DataFrame, multipliers: DataFrame, year_col: str = "release_year"
) -> DataFrame:
    """Add ``multiplier``, 1.0 where the year or its mean is missing."""
    # One row per calendar year, and a DATE holds fewer than 10,000 years.
    lookup = F.broadcast(multipliers.withColumnsRenamed({"year": "_year", "multiplier": "_found"}))
    return (
        df.join(lookup, F.col(year_col) == F.col("_year"), "left")
        .withColumn("multiplier", F.coalesce("_found", F.lit(1.0)))
        .drop("_year", "_found")
    )
