"""Run a query and its SQL side by side, and report the first difference."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

_SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, sf_dir: str, query, sql: str) -> str | None:
    found = query(spark, sf_dir)
    kinds = {name: _SAME.get(kind, kind) for name, kind in found.dtypes}
    ours = _rows(found.columns, [tuple(row) for row in found.collect()])
    con = connect(sf_dir)
    cursor = con.execute(sql)
    their_kinds = {column[0]: str(column[1]) for column in cursor.description}
    theirs = _rows(list(their_kinds), cursor.fetchall())
    if kinds != their_kinds:
        return f"schema: {kinds} / {their_kinds}"
    if len(ours) != len(theirs):
        extra = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{len(ours)} rows / {len(theirs)}: {[list(e)[:2] for e in extra]}"
    for left, right in zip(ours, theirs, strict=True):
        if left != right:
            return f"{left} / {right}"
    return None
