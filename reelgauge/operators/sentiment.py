"""Sentiment of lines: by lexicon, by a trained model, or by a caller's scorer.

Every scorer adds ``label`` ("POSITIVE" or "NEGATIVE"), ``confidence`` and the
signed ``score``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgauge.constants import DEFAULT_LEXICON, SCORER_BATCH_SIZE
from reelgauge.functions.scores import signed_score
from reelgauge.functions.text import truncate_words, words
from reelgauge.session import settle

# A larger lexicon is matched as a table.
MAX_INLINE_LEXICON = 10_000


def _labelled(df: DataFrame, good: Column, bad: Column) -> DataFrame:
    """Label by majority of hits; confidence is their smoothed share."""
    label = F.when(good >= bad, "POSITIVE").otherwise("NEGATIVE")
    confidence = (F.greatest(good, bad) + 1) / (good + bad + 2)
    return df.withColumns({"label": label, "confidence": confidence}).withColumn(
        "score", signed_score(F.col("label"), F.col("confidence"))
    )


def score_by_lexicon(
    lines: DataFrame,
    lexicon: Mapping[str, int] = DEFAULT_LEXICON,
    line_col: str = "line",
    max_words: int | None = None,
) -> DataFrame:
    """Count hits of positive and negative words inside each row: no shuffle.

    A lexicon beyond ``MAX_INLINE_LEXICON`` words is joined by word instead, with the
    same scores.
    """
    text = F.col(line_col)
    scored = text if max_words is None else truncate_words(text, max_words)
    if len(lexicon) > MAX_INLINE_LEXICON:
        polarity = lines.sparkSession.createDataFrame(list(lexicon.items()), "word string, polarity int")
        rows = lines.withColumns({"_row": F.monotonically_increasing_id(), "_text": scored})
        # Settled, so that a row keeps its number.
        found = score_by_lexicon_table(settle(rows.withColumn("_all", F.lit(0))), polarity, "_all", "_row", "_text")
        # A missing line has no hits to count, as in the form below.
        spoken = F.col("_text").isNotNull()
        return found.withColumns({
            "label": F.when(spoken, F.col("label")).otherwise("NEGATIVE"),
            "confidence": F.when(spoken, F.col("confidence")), "score": F.when(spoken, F.col("score")),
        }).drop("_all", "_row", "_text")
    tokens = words(F.lower(scored))

    def hits(sign: int) -> Column:
        chosen = [word for word, polarity in lexicon.items() if polarity * sign > 0]
        return F.size(F.filter("_tokens", lambda word: word.isin(chosen)))

    counted = lines.withColumn("_tokens", tokens).withColumns(
        {"_good": hits(1), "_bad": hits(-1)}
    )
    return _labelled(counted, F.col("_good"), F.col("_bad")).drop("_tokens", "_good", "_bad")


def score_by_lexicon_table(
    lines: DataFrame,
    lexicon: DataFrame,
    title_col: str = "title",
    seq_col: str = "seq",
    line_col: str = "line",
) -> DataFrame:
    """Same scores from a (word, polarity) table of any size."""
    keys = [title_col, seq_col]
    used = (
        lines.select(*keys, F.explode(words(F.lower(line_col))).alias("word"))
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("uses"))
    )
    hits = (
        used.join(lexicon, "word")
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("polarity") > 0, F.col("uses"))).alias("_good"),
            F.sum(F.when(F.col("polarity") < 0, F.col("uses"))).alias("_bad"),
        )
    )
    joined = lines.join(hits, keys, "left").fillna(0, ["_good", "_bad"])
    return _labelled(joined, F.col("_good"), F.col("_bad")).drop("_good", "_bad")


def train_scorer(
    examples: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 16
) -> PipelineModel:
    """Fit a bag-of-words classifier on 0/1 labelled texts."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_class", regParam=0.01, maxIter=20,
        ),
    ]
    labelled = examples.select(text_col, F.col(label_col).cast("double").alias("_label"))
    return Pipeline(stages=stages).fit(labelled)


def score_by_model(lines: DataFrame, model: PipelineModel) -> DataFrame:
    """Apply a trained scorer; confidence is the winning class's probability."""
    chance = F.array_max(vector_to_array(F.col("_probability")))
    label = F.when(F.col("_class") == 1.0, "POSITIVE").otherwise("NEGATIVE")
    scored = model.transform(lines).withColumns({"label": label, "confidence": chance})
    return scored.select(
        *lines.columns,
        "label",
        "confidence",
        signed_score(F.col("label"), F.col("confidence")).alias("score"),
    )


def score_by_function(
    lines: DataFrame,
    scorer: Callable[[list[str]], list[tuple[str, float]]],
    line_col: str = "line",
    batch_size: int = SCORER_BATCH_SIZE,
) -> DataFrame:
    """Score with a caller's model, ``batch_size`` lines per call."""
    scored = T.StructType([
        *lines.schema.fields,
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[line_col].tolist()
            results = [
                result
                for start in range(0, len(texts), batch_size)
                for result in scorer(texts[start : start + batch_size])
            ]
            labels, confidence = zip(*results, strict=True) if results else ((), ())
            yield batch.assign(label=list(labels), confidence=list(confidence))

    return lines.mapInPandas(run, scored).withColumn(
        "score", signed_score(F.col("label"), F.col("confidence"))
    )


def sentiment_log(scored: DataFrame) -> DataFrame:
    """The per-line log: who said what, its label and signed score."""
    return scored.select("title", "seq", "character", "line", "label", "score")
