"""Large quoted CSV files, read in parallel and by Spark's reader of whole files."""

import csv
import random

import pytest
from pyspark.sql import types as T

from reelgauge import constants as C
from reelgauge.sources import films as S
from reelgauge.sources import quoted_csv as Q

SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("id", "weird, name", "c")])
CELLS = ["plain", 'a "q"\nb', "line\r\none\n\n", '"', ",", "", "é\n" * 30, "x" * 300, " padded ", '""', "\n", "'", "long " * 200 + "\n end"]


@pytest.fixture
def small_blocks(spark):
    """Blocks of some 700 bytes, so that many rows and cells span several."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, rows, end="\r\n"):
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(SCHEMA.fieldNames())
        writer.writerows(rows)


@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_many_tasks_read_what_one_reads(spark, small_blocks, tmp_path, end):
    rng = random.Random(8)
    made = [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(1_500)]
    write(tmp_path / "a.csv", made[:1_200], end)
    write(tmp_path / "b.csv", made[1_200:], end)
    write(tmp_path / "header.csv", [], end)
    found = Q.read_quoted_csv(spark, str(tmp_path), SCHEMA)
    assert Q.quoted_rows(spark, str(tmp_path)).select("file", "start").distinct().count() > 100
    whole = spark.read.schema(SCHEMA).csv(str(tmp_path), header=True, escape='"', multiLine=True)
    assert found.schema == whole.schema
    rows = sorted(map(tuple, found.collect()), key=lambda row: int(row[0]))
    assert rows == [tuple(cell or None for cell in row) for row in made]

    def one_break(row):
        """Spark's reader makes one character of a line break where rows end in two."""
        return tuple(cell and cell.replace("\r\n", "\n") for cell in row)

    theirs = sorted(map(tuple, whole.collect()), key=lambda row: int(row[0]))
    assert list(map(one_break, rows)) == list(map(one_break, theirs))


def test_a_cell_may_span_many_blocks_and_the_header_too(spark, small_blocks, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('"id","weird\n' + "name\n" * 400 + '","c"\n1,"' + "deep\n" * 3_000 + '",x\n2,y,z')
    found = sorted(map(tuple, Q.read_quoted_csv(spark, str(path), SCHEMA).collect()))
    assert found == [("1", "deep\n" * 3_000, "x"), ("2", "y", "z")]


def test_films_of_many_blocks(spark, small_blocks, tmp_path):
    path = tmp_path / "films.csv"
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(C.FILM_CSV_HEADER)
        writer.writerows([f'Film "{i}"\nin lines', *["N/A"] * 7, str(i), *["N/A"] * 10] for i in range(300))
    found = {row.title: row.budget for row in S.read_film_csv(spark, str(path)).collect()}
    assert found == {f'Film "{i}"\nin lines': float(i) for i in range(300)}
