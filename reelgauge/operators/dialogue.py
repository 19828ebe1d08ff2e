"""Dialogue tables: (title, seq, character, line, score) and what they yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgauge.functions.text import dialogue_pairs, words
from reelgauge.operators.ordering import (
    add_position,
    null_safe_join,
    successive_differences,
)


def extract_dialogue(
    scripts: DataFrame, title_col: str = "title", text_col: str = "text"
) -> DataFrame:
    """(title, seq, line_count, character, line), ``seq`` counting from 0."""
    pairs = scripts.select(
        F.col(title_col).alias("title"), dialogue_pairs(F.col(text_col)).alias("pairs")
    )
    # Counted before the explode, so the array is not carried along with each of
    # its rows; an outer one, as the plain one would add a filter that runs the
    # patterns a second time.
    counted = pairs.select("title", F.size("pairs").alias("line_count"), "pairs")
    exploded = counted.select(
        "title", "line_count", F.posexplode_outer("pairs").alias("seq", "pair")
    ).where(F.col("pair").isNotNull())
    return exploded.select("title", "seq", "line_count", "pair.character", "pair.line")


def third_of(position: Column, count: Column) -> Column:
    """1, 2 or 3 for a 0-based position; the last third takes the remainder."""
    third = F.floor(count / 3)
    return F.when(position < third, 1).when(position < 2 * third, 2).otherwise(3)


def add_thirds(df: DataFrame, title_col: str = "title", seq_col: str = "seq") -> DataFrame:
    """Add ``third`` to rows whose place in the title is not yet known."""
    placed = add_position(df, [title_col], seq_col, "_place", "_count")
    return placed.withColumn("third", third_of(F.col("_place"), F.col("_count"))).drop(
        "_place", "_count"
    )


def sentiment_shift(
    df: DataFrame, title_col: str = "title", third_col: str = "third", score_col: str = "score"
) -> DataFrame:
    """Per title: mean score of each third, and |m1 - m2| + |m2 - m3|."""
    means = [
        F.coalesce(F.avg(F.when(F.col(third_col) == i, F.col(score_col))), F.lit(0.0)).alias(
            f"third{i}_mean"
        )
        for i in (1, 2, 3)
    ]
    shift = F.abs(F.col("third1_mean") - F.col("third2_mean")) + F.abs(
        F.col("third2_mean") - F.col("third3_mean")
    )
    return df.groupBy(title_col).agg(*means).withColumn("sentiment_shift", shift)


def arc_complexity(
    df: DataFrame,
    title_col: str = "title",
    character_col: str = "character",
    seq_col: str = "seq",
    score_col: str = "score",
) -> DataFrame:
    """Per character: mean absolute step between successive scores, 0 for one."""
    steps = successive_differences(df, [title_col, character_col], seq_col, score_col)
    mean_step = F.coalesce(F.try_divide("abs_sum", F.col("rows") - 1), F.lit(0.0))
    return steps.select(
        title_col,
        character_col,
        F.col("rows").alias("line_count"),
        mean_step.alias("arc_complexity"),
    )


def character_profile(
    df: DataFrame,
    title_col: str = "title",
    character_col: str = "character",
    seq_col: str = "seq",
    score_col: str = "score",
) -> DataFrame:
    """Per character: line count, first line, and spread of the scores."""
    return df.groupBy(title_col, character_col).agg(
        F.count("*").alias("line_count"),
        F.min(seq_col).alias("first_seq"),
        F.coalesce(F.stddev_pop(score_col), F.lit(0.0)).alias("score_std"),
    )


def top_characters(
    profile: DataFrame, title_col: str = "title", count: int = 3
) -> DataFrame:
    """The characters with most lines; the first to appear wins a tie."""
    order = Window.partitionBy(title_col).orderBy(
        F.desc("line_count"), F.asc("first_seq")
    )
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def top_character_series(
    df: DataFrame,
    top: DataFrame,
    title_col: str = "title",
    character_col: str = "character",
    seq_col: str = "seq",
    score_col: str = "score",
) -> DataFrame:
    """Score series of the top characters, one row per point in order."""
    keys = [title_col, character_col]
    chosen = null_safe_join(
        df.select(*keys, seq_col, score_col), top.select(*keys), keys, "left_semi"
    )
    return add_position(chosen, keys, seq_col, "point", "points")


def padded_arcs(top: DataFrame, title_col: str = "title", slots: int = 3) -> DataFrame:
    """One row per title with "NAME: 0.1234" per rank, NULL where none."""
    text = F.concat_ws(": ", "character", F.round("score_std", 4).cast("string"))
    return top.groupBy(title_col).agg(*[
        F.max(F.when(F.col("rank") == i, text)).alias(f"arc{i}_raw") for i in range(1, slots + 1)
    ])


def lexical_diversity_by_title(
    df: DataFrame, title_col: str = "title", line_col: str = "line"
) -> DataFrame:
    """Distinct over all words of a title's lines, 4 digits, 0 without words."""
    counted = (
        df.select(title_col, F.explode_outer(words(F.lower(line_col))).alias("word"))
        .groupBy(title_col, "word")
        .agg(F.count("word").alias("uses"))
    )
    share = F.try_divide(F.count("word"), F.sum("uses"))
    return counted.groupBy(title_col).agg(
        F.round(F.coalesce(share, F.lit(0.0)), 4).alias("lexical_diversity")
    )


def mean_score(df: DataFrame, title_col: str = "title", score_col: str = "score") -> DataFrame:
    return df.groupBy(title_col).agg(
        F.coalesce(F.avg(score_col), F.lit(0.0)).alias("mean_score")
    )
