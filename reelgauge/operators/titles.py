"""Title lists: distinct, known titles, award flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.constants import AWARD_TITLES
from reelgauge.functions.scores import normal_title


def distinct_titles(df: DataFrame, title_col: str = "title") -> DataFrame:
    return df.select(title_col).distinct()


def new_titles(
    candidates: DataFrame, known: DataFrame, title_col: str = "title", known_col: str = "title"
) -> DataFrame:
    """Candidates whose title the sink does not hold, ignoring case and outer space."""
    stored = known.select(normal_title(F.col(known_col)).alias("_stored")).distinct()
    return candidates.join(
        stored, normal_title(F.col(title_col)) == F.col("_stored"), "left_anti"
    )


def is_award_title(title: Column, awards: Iterable[str] = AWARD_TITLES) -> Column:
    """Membership in a fixed list of award titles."""
    keys = [award.lower() for award in awards]
    return F.coalesce(normal_title(title).isin(keys), F.lit(False))


def flag_awards(
    df: DataFrame,
    awards: DataFrame,
    title_col: str = "title",
    award_col: str = "title",
    flag: str = "award_winner",
) -> DataFrame:
    """Membership in an award table of any size."""
    # Only the title's case is ignored for stored awards, their space is kept.
    keys = awards.select(F.lower(award_col).alias("_award")).distinct()
    joined = df.join(keys, normal_title(F.col(title_col)) == F.col("_award"), "left")
    return joined.withColumn(flag, F.col("_award").isNotNull()).drop("_award")
