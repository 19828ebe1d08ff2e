"""Shared steps of the corpus operators: reading, settling, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a broadcast table at most; larger ones are joined by key.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its ``rows`` are few; else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def settled_with_count(df: DataFrame) -> tuple[DataFrame, int]:
    from reelgauge.session import settle

    out = settle(df)
    return out, out.count()
