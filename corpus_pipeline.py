"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of the documents.

A stage decides by row, not by doc_id: rows of one doc_id, or without one, each have a key
of their own while the stage lasts. Keys rise with the place in the table, and are written
down, as a place may change when executors are lost.

Folders that a stage settles are removed when the next one begins, for by then its output
is written; ``run`` leaves its result only.

Defined results: the classifier may reject null and empty texts, line dedup and the join
keep them, and mixing takes none of them, as they have no words; of repeated rows and near
copies the join keeps the first row of the table; an empty table gives an empty result at
every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.llm import jaccard_join, line_dedup, mixing, packing, quality
from reelgauge.llm.queries import QUALITY_BAR, word_tokenizer
from reelgauge.llm.shipping import ship
from reelgauge.llm.tables import read
from reelgauge.session import Settled, settle, settling

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Edits within which a line counts as a copy of an earlier one.
LINE_EDITS = 2


#: What the last stage settled, until the next one begins.
_left: list[Settled] = []


def _release(spark: SparkSession) -> None:
    while _left:
        scope = _left.pop()
        if scope.spark is spark:
            scope.clear()


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark)
        ship(spark)
        with settling(spark, clear=False) as scope:
            _left.append(scope)
            return function(spark, docs, sf_dir)

    return begun


def _by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a key ``_key``, and the same with the key in place of doc_id."""
    keyed = settle(docs.withColumn("_key", F.monotonically_increasing_id()))
    return keyed, keyed.withColumn("doc_id", F.col("_key")).drop("_key")


@_stage
def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, learnt from the labels outside its held-out part, accepts."""
    keyed, rows = _by_row(docs)
    measured = settle(quality.document_statistics(rows))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~quality.held_out(F.col("doc_id")))
    labelled = keyed.select("_key", "doc_id").join(labels, "doc_id").select(F.col("_key").alias("doc_id"), "quality")
    known = quality.labelled_statistics(measured, labelled, lambda doc: F.lit(True))
    scored = quality.score_statistics(measured, quality.fit_discriminant(known))
    rejected = scored.filter(F.col("score") < QUALITY_BAR).select(F.col("doc_id").alias("_key"))
    return keyed.join(rejected, "_key", "left_anti").select(*docs.columns)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came earlier, up to two edits; a document left blank by that goes."""
    keyed, _ = _by_row(docs)
    others = [c for c in docs.columns if c != "text"]
    carried = keyed.select(F.col("_key").alias("doc_id"), "text", F.struct(*others).alias("_row"))
    deduped = line_dedup.dedup_lines(carried, max_edits=LINE_EDITS)
    blank = (F.col("n_removed") > 0) & F.col("text").rlike(r"^[\x20\x09-\x0D]*$")
    kept = deduped.filter(~F.coalesce(blank, F.lit(False)))
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the first row."""
    keyed, rows = _by_row(docs)
    classes = jaccard_join.ngram_classes(rows)
    rest = classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_key"))
    return keyed.join(rest, "_key", "left_anti").select(*docs.columns)


@_stage
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    keyed, rows = _by_row(docs)
    taken = mixing.mix_sources(mixing.word_sizes(rows)).filter("copies > 0")
    copies = taken.select(F.col("doc_id").alias("_row_key"), F.col("copies").alias("_copies"))
    carried = keyed.select("_key", F.struct(*docs.columns).alias("_row"))
    joined = carried.join(copies, F.col("_key") == F.col("_row_key"))
    repeated = joined.select("_row", F.explode(F.sequence(F.lit(1), "_copies")))
    return repeated.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every copy in sequences of at most 4096 tokens."""
    pieces = packing.token_pieces(docs, word_tokenizer())
    return packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the tokenizer and the packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs, written = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with settling(spark, clear=False) as scope:
            docs = settle(stage(spark, docs, sf_dir))
        if written is not None:
            written.clear()
        written = scope
    _release(spark)
    return docs
