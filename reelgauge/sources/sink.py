"""The film sink: parquet by bucket of titles, in batches that a log commits.

A batch is a folder of files by bucket of the normalised title; it counts once the log
holds its entry, so a load that fails half-way leaves nothing to be read. A load reads
stored titles from the buckets of its own titles only. Of loads at one time each takes the
next number of the log, which only one can create; the others look at what was committed
meanwhile, leave out those titles and try the number after it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgauge import schemas
from reelgauge.functions.scores import normal_title
from reelgauge.operators.titles import new_titles
from reelgauge.sources.films import one_film_per_title

#: Buckets of titles; a fixed part of the layout.
BUCKETS = 64
_BUCKET, _BATCH = "bucket", "batch"
_STORED = T.StructType([
    *schemas.FILM.fields, T.StructField(_BUCKET, T.IntegerType()), T.StructField(_BATCH, T.StringType()),
])
_ENTRY = "version long, batch string, rows long"


def title_bucket(title: Column) -> Column:
    return F.pmod(F.xxhash64(normal_title(title)), F.lit(BUCKETS)).cast("int")


def committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, batch) of every committed batch, in order."""
    try:
        entries = spark.read.schema(_ENTRY).json(f"{path}/log").select("version", "batch").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(tuple(entry) for entry in entries)


def _stored(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    """Films of committed batches, with their bucket and batch, by which reads are pruned."""
    if not batches:
        return spark.createDataFrame([], _STORED)
    films = spark.read.schema(_STORED).option("basePath", f"{path}/films").parquet(f"{path}/films")
    return films.where(F.col(_BATCH).isin(batches))


def read_film_sink(spark: SparkSession, path: str) -> DataFrame:
    """Stored films; an absent sink is an empty table."""
    batches = [batch for _, batch in committed(spark, path)]
    return _stored(spark, path, batches).select(*schemas.FILM_COLUMNS)


def _unstored(rows: DataFrame, path: str, batches: list[str], title_col: str) -> DataFrame:
    """Rows whose title no batch holds; only buckets of the rows' own titles are read."""
    spark = rows.sparkSession
    if not batches:
        return rows
    # At most as many numbers as there are buckets.
    touched = [row[0] for row in rows.select(title_bucket(F.col(title_col))).distinct().collect()]
    known = _stored(spark, path, batches).where(F.col(_BUCKET).isin(touched)).select("title")
    return new_titles(rows, known, title_col)


def unstored_titles(rows: DataFrame, path: str, title_col: str = "title") -> DataFrame:
    """Rows whose title the sink does not hold, ignoring case and outer space."""
    batches = [batch for _, batch in committed(rows.sparkSession, path)]
    return _unstored(rows, path, batches, title_col)


def _create(spark: SparkSession, file: str, text: str) -> bool:
    """Write a small new file through Spark's file system; False if it is there already."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(file)
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    try:
        stream = system.create(target, False)
    except Py4JJavaError as error:
        if system.exists(target):
            return False
        raise error
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True


def _write_batch(films: DataFrame, path: str) -> tuple[str, int]:
    """Store films as a batch that is not yet committed: its name and rows."""
    spark, batch = films.sparkSession, uuid.uuid4().hex
    bucketed = films.select(*schemas.FILM_COLUMNS, title_bucket(F.col("title")).alias(_BUCKET))
    # Brings a bucket's films together, yet splits one that is much larger than the others.
    even = bucketed.hint("rebalance", F.col(_BUCKET))
    # A folder for each batch: writers at one time would clear each other's work.
    even.write.partitionBy(_BUCKET).parquet(f"{path}/films/{_BATCH}={batch}")
    return batch, _stored(spark, path, [batch]).count()


def append_films(films: DataFrame, path: str) -> None:
    """Commit the films whose titles the sink does not hold yet, each title once."""
    spark = films.sparkSession
    before = committed(spark, path)
    fresh = _unstored(films.select(*schemas.FILM_COLUMNS), path, [b for _, b in before], "title")
    batch, rows = _write_batch(one_film_per_title(fresh), path)
    version = before[-1][0] + 1 if before else 0
    while rows:
        entry = json.dumps({"version": version, "batch": batch, "rows": rows})
        if _create(spark, f"{path}/log/{version:012d}.json", entry):
            return
        # Another load was first: leave out what it stored and take the next number.
        meanwhile = [b for v, b in committed(spark, path) if v >= version]
        version = max(v for v, _ in committed(spark, path)) + 1
        mine = _stored(spark, path, [batch]).select(*schemas.FILM_COLUMNS)
        rest = _unstored(mine, path, meanwhile, "title")
        if rest.count() < rows:
            batch, rows = _write_batch(rest, path)
