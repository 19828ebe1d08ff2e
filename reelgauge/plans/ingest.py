"""Stored payloads, pages and index series to rows of the film table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge import schemas
from reelgauge.functions import scores
from reelgauge.operators.cast import star_power_map, total_star_power
from reelgauge.operators.inflation import add_multiplier, yearly_multipliers
from reelgauge.operators.sentiment import score_by_lexicon
from reelgauge.plans.script_features import Scorer, script_features
from reelgauge.session import settle
from reelgauge.sources.payloads import film_metadata, page_values, usable
from reelgauge.sources.sink import append_films, unstored_titles


def one_payload_per_title(payloads: DataFrame) -> DataFrame:
    """Keep one usable response where a title came more than once."""
    key = scores.normal_title(F.col("title")).alias("_key")
    kept = payloads.where(usable(F.col("body"))).groupBy(key).agg(F.min(F.struct("title", "body")).alias("_kept"))
    return kept.select("_kept.*")


def film_rows(
    payloads: DataFrame,
    pages: DataFrame,
    index_series: DataFrame,
    scorer: Scorer = score_by_lexicon,
    themes: DataFrame | None = None,
    max_chars: int | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """One film row per title that has both metadata and a script."""
    metadata = film_metadata(one_payload_per_title(payloads))
    # Pages may be stored under another spelling of the requested title.
    asked = metadata.select("request", scores.normal_title(F.col("request")).alias("_key"))
    found = page_values(pages).withColumnRenamed("title", "_stored")
    values = settle(
        found.join(asked, scores.normal_title(F.col("_stored")) == F.col("_key"))
        .drop("_stored", "_key").withColumnRenamed("request", "title")
    )
    scripts = values.select("title", F.col("script").alias("text"))
    features = script_features(scripts, scorer, themes, max_chars, vectors)
    script_columns = features.join(values.select("title", "budget"), "title").withColumnRenamed(
        "title", "request"
    )
    joined = metadata.join(script_columns, "request")
    power = star_power_map(F.col("imdb_rating"), F.col("rt_0_10"), F.col("cast"))
    priced = add_multiplier(joined, yearly_multipliers(index_series)).withColumns({
        "box_office_adj": scores.adjusted_amount(
            scores.dollar_amount(F.col("box_office_raw")), F.col("multiplier")
        ),
        "star_power": power,
        "indie_quality_score": scores.quality_per_budget(
            F.col("sentiment_shift"), F.col("lexical_diversity"), F.col("budget")
        ),
    })
    finished = priced.withColumns({
        "total_star_power": total_star_power(F.col("star_power")),
        "budget": F.nullif("budget", F.lit(0.0)),
    })
    return finished.select(*schemas.FILM_COLUMNS)


def load_new_films(
    payloads: DataFrame,
    pages: DataFrame,
    index_series: DataFrame,
    sink: str,
    scorer: Scorer = score_by_lexicon,
    themes: DataFrame | None = None,
    max_chars: int | None = None,
    vectors: DataFrame | None = None,
) -> None:
    """Work out and append only the films the sink does not hold yet.

    ``vectors`` (word, vector, log_prob) grows the themes by words close to theirs.
    """
    fresh = unstored_titles(payloads, sink)
    append_films(film_rows(fresh, pages, index_series, scorer, themes, max_chars, vectors), sink)
