"""The film table to bins, tests, regressions and the undervaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge import constants as C
from reelgauge.functions import scores
from reelgauge.operators import binning, stats
from reelgauge.operators.regression import OlsFit, fit_ols
from reelgauge.operators.titles import is_award_title
from reelgauge.session import settle
from reelgauge.sources.films import clean_films

REQUIRED = (
    "box_office_adj", "rt_pct", "sentiment_shift", "lexical_diversity", "avg_arc",
    "total_star_power", "budget",
)
ADJUSTED_FEATURES = (
    "sentiment_adjusted", "lexical_adjusted", "avg_arc", "total_star_power", "log_budget",
)
RAW_FEATURES = (
    "sentiment_shift", "lexical_diversity", "avg_arc", "total_star_power", "log_budget",
)
RATING_FEATURES = ("sentiment_adjusted", "lexical_adjusted")
REPORT_COLUMNS = (
    "title", "actual_box_office_2025", "predicted_box_office_2025", "monetary_undervaluation",
    "creative_undervaluation", "weighted_iq", "verdict",
)


def adjusted_scores(films: DataFrame) -> DataFrame:
    """Cleaned films with arc mean and the shaped sentiment and lexical scores."""
    arcs = [scores.arc_value(F.col(f"arc{i}_raw")) for i in (1, 2, 3)]
    return clean_films(films).withColumns({
        "avg_arc": scores.row_mean(*arcs),
        "sentiment_adjusted": scores.tent(F.col("sentiment_shift")),
        "lexical_adjusted": scores.logistic(F.col("lexical_diversity")),
    })


def lexical_bins(adjusted: DataFrame) -> DataFrame:
    """Mean rating per fixed bin of the lexical score, before any trim."""
    return binning.mean_per_bin(adjusted, "lexical_adjusted", "rt_pct", C.LEXICAL_EDGES)


def middle_bin_titles(trimmed: DataFrame) -> DataFrame:
    """Titles and ratings in the middle lexical bin."""
    _, low, high, _ = C.LEXICAL_EDGES
    score = F.col("lexical_adjusted")
    return trimmed.where((score > low) & (score <= high)).select("title", "rt_pct")


def film_features(trimmed: DataFrame, award: Column | None = None) -> DataFrame:
    """Complete films with award flag, logs, norms and the weighted score."""
    complete = trimmed.na.drop(subset=list(REQUIRED)).withColumns({
        "award_winner": is_award_title(F.col("title")) if award is None else award,
        "log_budget": F.log1p("budget"),
        "log_box_office": F.log1p("box_office_adj"),
        "rt_norm": F.col("rt_pct") / 100,
        "weighted_iq": scores.weighted_iq(
            F.col("sentiment_adjusted"), F.col("lexical_adjusted"), F.col("avg_arc")
        ),
    })
    ends = stats.bounds(complete, "log_box_office", "weighted_iq")

    def scaled(name: str) -> Column:
        return stats.min_max_scaled(F.col(name), *ends[name])

    return complete.withColumns({
        "box_office_norm": scaled("log_box_office"),
        "indie_score_normalized": scaled("weighted_iq"),
    })


def undervaluation(features: DataFrame, fit: OlsFit, passes: int = 2) -> DataFrame:
    """Predictions, both undervaluation scores and the verdict for every film."""
    residual = fit.predict(features, "predicted_log_box_office").withColumn(
        "_residual", F.col("predicted_log_box_office") - F.col("log_box_office")
    )
    low, high = stats.bounds(residual, "_residual")["_residual"]
    money = stats.rescale_residual(F.col("_residual"), low, high, passes)
    return residual.withColumns({
        "monetary_undervaluation": money,
        "creative_undervaluation": F.col("weighted_iq") - F.col("rt_norm"),
        "predicted_box_office_2025": F.expm1("predicted_log_box_office") * C.PRICE_FACTOR,
        "actual_box_office_2025": F.expm1("log_box_office") * C.PRICE_FACTOR,
    }).withColumn(
        "verdict",
        scores.verdict(F.col("monetary_undervaluation"), F.col("creative_undervaluation")),
    ).drop("_residual")


def ranked_films(valued: DataFrame) -> DataFrame:
    """Every film, most undervalued first."""
    return valued.orderBy(F.desc_nulls_last("monetary_undervaluation"), "title")


def top_report(valued: DataFrame, count: int = C.REPORT_SIZE) -> DataFrame:
    """The most undervalued films with dollar texts."""
    top = ranked_films(valued).limit(count)
    return top.select(*[
        scores.dollars(F.col(name)).alias(name) if name.endswith("_2025") else F.col(name)
        for name in REPORT_COLUMNS
    ])


def scaled_scores(valued: DataFrame) -> DataFrame:
    """Both undervaluation scores on [0, 1], most undervalued first."""
    names = ("monetary_undervaluation", "creative_undervaluation")
    ends = stats.bounds(valued, *names)
    scaled = valued.select("title", *[
        stats.min_max_scaler(F.col(name), *ends[name]).alias(f"{name}_norm")
        for name in names
    ])
    return scaled.orderBy(F.desc_nulls_last("monetary_undervaluation_norm"), "title")


def perfect_prediction_line(valued: DataFrame) -> DataFrame:
    """End points of the line on which prediction equals result."""
    ends = stats.min_max(valued, "log_box_office")
    points = F.array(F.struct(F.col("min_value").alias("x"), F.col("min_value").alias("y")),
                     F.struct(F.col("max_value").alias("x"), F.col("max_value").alias("y")))
    return ends.select(F.inline(points))


def analyse_films(
    films: DataFrame, award: Column | None = None, order_col: str | None = None
) -> dict[str, DataFrame]:
    """Every table of the analysis, by name, from a film table.

    ``award`` flags award titles otherwise than by the fixed list. ``order_col``, a number,
    orders the films for the Durbin-Watson statistic of each regression.
    """
    adjusted = settle(adjusted_scores(films))
    trimmed = stats.trim_outliers(adjusted, "rt_pct")
    features = settle(film_features(trimmed, award))
    box_office = fit_ols(features, "log_box_office", ADJUSTED_FEATURES)
    commercial = fit_ols(features, "log_box_office", RAW_FEATURES)
    rating = fit_ols(features, "rt_pct", RATING_FEATURES)
    valued = settle(undervaluation(features, commercial))
    middle = middle_bin_titles(trimmed)
    return {
        "lexical_bins": lexical_bins(adjusted),
        "middle_bin_titles": middle,
        "middle_bin_mean": middle.agg(F.avg("rt_pct").alias("mean_rt_pct")),
        "features": features,
        "award_gap": stats.group_gap(features, "award_winner", "weighted_iq", "avg_arc"),
        "box_office_by_sentiment": binning.mean_per_bin(
            features, "sentiment_adjusted", "log_box_office",
            binning.equal_width_edges(features, "sentiment_adjusted"),
        ),
        "rating_by_lexical": binning.mean_per_bin(
            features, "lexical_adjusted", "rt_pct",
            binning.equal_width_edges(features, "lexical_adjusted"),
        ),
        "box_office_coefficients": box_office.coefficients(),
        "box_office_summary": box_office.summary(order_col),
        "predictor_correlations": stats.correlation_matrix(
            features, ["weighted_iq", "total_star_power", "budget"]
        ),
        "arc_test": stats.welch_test(features, "award_winner", "avg_arc"),
        "arc_boxes": stats.box_summary(features, "award_winner", "avg_arc"),
        "commercial_coefficients": commercial.coefficients(),
        "commercial_summary": commercial.summary(order_col),
        "valued": valued,
        "top_report": top_report(valued),
        "scaled_scores": scaled_scores(valued),
        "prediction_line": perfect_prediction_line(valued),
        "ranked": ranked_films(valued),
        "score_correlations": stats.correlation_matrix(
            features, ["sentiment_adjusted", "lexical_adjusted", "rt_pct"]
        ),
        "sentiment_line": stats.regression_line(features, "sentiment_adjusted", "rt_pct"),
        "lexical_line": stats.regression_line(features, "lexical_adjusted", "rt_pct"),
        "rating_coefficients": rating.coefficients(),
        "rating_summary": rating.summary(order_col),
    }
