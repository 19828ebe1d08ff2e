"""Queries over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# White space as Python splits on it, for the checking engine's RE2 patterns.
SQL_SPACE = (
    r"[\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so both engines agree whatever the order of sums."""
    return df.select(*[
        (F.round(name, digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SQL_SPACE}+'), lambda x: x <> '')"
