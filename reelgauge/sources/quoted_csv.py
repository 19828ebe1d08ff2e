"""Large CSV files with quoted line breaks, read in parallel.

A line of the file is not yet a row: a quoted cell may hold line breaks. Whether a line
begins inside quotes is decided by the number of quotes before it, odd or even, so one
small pass counts the quotes of each block of a file, their running sum tells how each
block begins, and then every block is cut into rows by its own task. Only the pieces
around the ends of blocks, two a block at most, are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgauge.shipping import ship_package

_BLOCK = ["file", "start"]
_HEAD, _TAIL, _MIDDLE, _ROW = "head", "tail", "middle", "row"
#: Start of a file's first row, its header.
_HEADER = -1


def _rows_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows of each block, and the pieces at its ends, from lines that know how the block begins.

    The lines of a block come together and in order.
    """
    block, held, kind, out, first = None, [], _ROW, [], False

    def put(place: str) -> None:
        nonlocal first
        out.append((block[0], _HEADER if first else block[1], place, "\n".join(held)))
        held.clear()
        first = False

    def close() -> None:
        # Lines that are left over belong to a row that goes on in the next block.
        if held:
            put(_MIDDLE if kind == _HEAD else _TAIL)

    def taken() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
            ["file", "start", "place", "text"],
        )

    inside = False
    for batch in batches:
        for file, start, odd, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != (file, start):
                if block is not None:
                    close()
                block, inside, kind, first = (file, start), odd, _HEAD if odd else _ROW, start == 0
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                put(kind)
                kind = _ROW
        yield taken()
    if block is not None:
        close()
        yield taken()


def quoted_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, place, text): the rows of CSV files as text, quoted line breaks inside.

    ``start`` is where the block that holds a row's beginning starts in its file, -1 for the
    first row. Files are
    cut into blocks as Spark cuts text (``spark.sql.files.maxPartitionBytes``). Cells that
    hold quotes must be quoted, with quotes in them doubled, as CSV writers do.
    """
    ship_package(spark)
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")
    )
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    # One row a block of the input from here to the join.
    counted = lines.groupBy(*_BLOCK).agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select(
        *_BLOCK, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd")
    )
    # Broadcast, so that lines stay in their blocks: some 100 bytes for 128 MB of input.
    known = lines.join(F.broadcast(begins), _BLOCK).select(*_BLOCK, "odd", "line")
    found = known.mapInArrow(_rows_of_blocks, "file string, start long, place string, text string")
    pieces = found.where(F.col("place") != _ROW)
    # A row's pieces: a tail, blocks that lie inside it, and a head, in that order.
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("place") == _TAIL, 1).otherwise(0))
    begun = F.sum(F.when(F.col("place") == _TAIL, 1).otherwise(0)).over(order)
    joined = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda part: part["text"]), "\n")
    whole = found.where(F.col("place") == _ROW)
    return whole.unionByName(joined.select("file", "start", F.lit(_TAIL).alias("place"), text.alias("text")))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files with a header each, like a ``multiLine`` read, in many tasks a file.

    Line breaks inside cells stay as the file has them.
    """
    rows = quoted_rows(spark, path)
    # Blank lines are no rows; a line may still carry the first half of its line end.
    text = F.regexp_replace("text", r"\r\z", "")
    held = rows.where(F.col("start") != _HEADER).select(text.alias("text")).where(F.trim("text") != "")
    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    cells = F.from_csv("text", fields, {"escape": '"', "multiLine": "true"})
    return held.select(cells.alias("cells")).select("cells.*")
