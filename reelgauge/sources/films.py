"""The film table: CSV in and out, declared types, one film a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgauge import schemas
from reelgauge.constants import MISSING_TEXT, NA_TOKENS
from reelgauge.functions.scores import currency, normal_title, number, percent
from reelgauge.sources.quoted_csv import read_quoted_csv


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(list(NA_TOKENS)), text)


def coerce_films(raw: DataFrame) -> DataFrame:
    """Text columns to the declared types; unreadable values and absent columns NULL."""
    texts = {name: missing_to_null(F.col(name)) for name in raw.columns}

    def column(field: T.StructField) -> Column:
        if field.name not in texts:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.DoubleType):
            value = number(texts[field.name])
        elif isinstance(field.dataType, T.MapType):
            value = F.from_json(texts[field.name], field.dataType)
        else:
            value = texts[field.name]
        return value.alias(field.name)

    return raw.select(*[column(field) for field in schemas.FILM.fields])


def read_film_csv(spark: SparkSession, path: str) -> DataFrame:
    """Films from CSV files with the header row; a large file is read in many tasks."""
    raw = read_quoted_csv(spark, path, schemas.FILM_CSV)
    return coerce_films(raw.withColumnsRenamed(schemas.FILM_COLUMN_OF_HEADER))


def one_film_per_title(films: DataFrame) -> DataFrame:
    """Of films with one title, whatever its case and outer space, the first by spelling.

    Ties go to the row whose JSON text sorts first. Films without a title all stay.
    """
    key = normal_title(F.col("title"))
    turn = F.row_number().over(
        Window.partitionBy(key).orderBy("title", F.to_json(F.struct(*films.columns)))
    )
    first = films.where(key.isNotNull()).withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    return first.unionByName(films.where(key.isNull()))


def export_film_csv(films: DataFrame, path: str) -> None:
    """CSV with the original header, "N/A" for missing values."""

    def cell(field: T.StructField, header: str) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.MapType):
            value = F.to_json(value)
        return F.coalesce(value.cast("string"), F.lit(MISSING_TEXT)).alias(header)

    cells = [
        cell(field, header)
        for field, header in zip(
            schemas.FILM.fields, schemas.FILM_CSV.fieldNames(), strict=True
        )
    ]
    films.select(*cells).write.mode("append").csv(path, header=True, escape='"')


def clean_films(films: DataFrame) -> DataFrame:
    """Add the amounts that the text columns hold."""
    return films.withColumns({
        "box_office": currency(F.col("box_office_raw")),
        "rt_pct": percent(F.col("rt_score_raw")),
    })


def schema_report(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type) of a table."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string"
    )
