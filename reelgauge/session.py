"""Session set-up for local runs, and cutting long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "reelgauge") -> SparkSession:
    """Session for tests and benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


@cache
def _single_machine_folder() -> str:
    folder = tempfile.mkdtemp(prefix="reelgauge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder stands in only on a single machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _single_machine_folder()


class Settled:
    """Folders settled while a scope was open, and the scope around it."""

    def __init__(self, spark: SparkSession, outer: Settled | None):
        self.spark, self.outer = spark, outer
        self.folders: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Settle a result that outlives the scope."""
        token = _scope.set(self.outer)
        try:
            return settle(df)
        finally:
            _scope.reset(token)

    def clear(self) -> None:
        """Remove the folders; no DataFrame may read them any more."""
        context = self.spark.sparkContext
        for folder in self.folders:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self.folders.clear()


_scope: ContextVar[Settled | None] = ContextVar("settled", default=None)


@contextmanager
def settling(spark: SparkSession, clear: bool = True) -> Iterator[Settled]:
    """Inside, settled folders are noted; they are removed at the end, unless ``clear`` is off.

    For steps that end in a settled result: ``keep`` it, and what it was made from goes.
    """
    scope = Settled(spark, _scope.get())
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        if clear:
            scope.clear()


def settle(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result that several later jobs read: the work is done once, and a
    lost executor costs a re-read, not a recomputation. Within ``settling`` the folder
    goes when the scope ends. ``row_group`` bounds the bytes of a row group.
    """
    spark, scope = df.sparkSession, _scope.get()
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    if scope is not None:
        scope.folders.append(path)
    writer = df.write
    if row_group:
        # Else sizes are looked at after a hundred rows, which may be large ones.
        looks = {f"parquet.{part}.size.row.check.min": 1 for part in ("block", "page")}
        writer = writer.options(**{"parquet.block.size": row_group, **looks})
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
