"""The incremental film load as a stream over newly stored payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reelgauge.operators.sentiment import score_by_lexicon
from reelgauge.plans.ingest import load_new_films
from reelgauge.plans.script_features import Scorer

PAYLOAD_FILES = "title string, body string"


def stream_new_films(
    spark: SparkSession,
    payload_folder: str,
    pages: DataFrame,
    index_series: DataFrame,
    sink: str,
    progress: str,
    scorer: Scorer = score_by_lexicon,
    themes: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> StreamingQuery:
    """Load every payload file not seen before, then stop.

    ``progress`` is the stream's checkpoint folder. A batch that is run again
    after a failure adds nothing twice, as stored titles are skipped.
    """

    def load(batch: DataFrame, _batch_id: int) -> None:
        load_new_films(batch, pages, index_series, sink, scorer, themes, vectors=vectors)

    payloads = spark.readStream.schema(PAYLOAD_FILES).json(payload_folder)
    return (
        payloads.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
