"""Scripts to per-title scores: dialogue, sentiment, arcs, diversity, themes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.functions.text import clean_script
from reelgauge.operators import dialogue as D
from reelgauge.operators import topics as T
from reelgauge.operators.sentiment import score_by_lexicon
from reelgauge.operators.title_topics import themes_by_own_topics, topics_by_title
from reelgauge.session import settle

Scorer = Callable[[DataFrame], DataFrame]


def scored_dialogue(
    scripts: DataFrame, scorer: Scorer = score_by_lexicon, max_chars: int | None = None
) -> DataFrame:
    """Clean (title, text) scripts, split them into lines, score each line once."""
    cleaned = scripts.where(F.col("text").isNotNull()).select(
        "title", clean_script(F.col("text"), max_chars).alias("text")
    )
    return scorer(D.extract_dialogue(cleaned))


def script_scores(titles: DataFrame, scored: DataFrame) -> DataFrame:
    """Shift, top-3 arcs and diversity per title; titles without lines score 0."""
    placed = scored.withColumn("third", D.third_of(F.col("seq"), F.col("line_count")))
    shift = D.sentiment_shift(placed).select("title", "sentiment_shift")
    arcs = D.padded_arcs(D.top_characters(D.character_profile(scored)))
    diversity = D.lexical_diversity_by_title(scored)
    joined = titles.select("title")
    for part in (shift, arcs, diversity):
        joined = joined.join(part, "title", "left")
    return joined.fillna(0.0, ["sentiment_shift", "lexical_diversity"])


def grown_themes(
    scored: DataFrame, themes: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """The theme table, the fixed one by default, grown by words whose vectors are close."""
    if themes is None:
        themes = T.theme_table(scored.sparkSession)
    return themes if vectors is None else settle(T.expand_themes(themes, vectors))


def script_themes(
    scored: DataFrame, themes: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame:
    """(title, named_themes, dominant_topics) by a topic model of each title's own.

    A title without vocabulary has no row. ``vectors`` is (word, vector, log_prob).
    """
    words = settle(topics_by_title(scored))
    names = T.name_topics(words, grown_themes(scored, themes, vectors), ["title", "topic"])
    return themes_by_own_topics(words, names)


def shared_themes(
    scored: DataFrame, themes: DataFrame | None = None, vectors: DataFrame | None = None
) -> DataFrame | None:
    """The same columns by one model over all titles, None when no vocabulary is left."""
    fit = T.fit_topics(scored)
    if fit is None:
        return None
    words = settle(fit.words())
    names = T.name_topics(words, grown_themes(scored, themes, vectors), ["topic"])
    return T.themes_by_title(fit.title_topics(), words, names)


def script_features(
    scripts: DataFrame,
    scorer: Scorer = score_by_lexicon,
    themes: DataFrame | None = None,
    max_chars: int | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """All script columns of the film table, one row per title with a script."""
    scored = settle(scored_dialogue(scripts, scorer, max_chars))
    scores = script_scores(scripts.where(F.col("text").isNotNull()), scored)
    return scores.join(script_themes(scored, themes, vectors), "title", "left")
