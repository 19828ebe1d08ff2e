"""Regressions, predictions and the undervaluation report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.films import FEATURES_SQL, is_award, ols_sql, raw_films
from catalog.ingest import order_pages, order_payloads
from catalog.registry import query, rounded, table
from catalog.statistics import features, sql_t_tail
from reelgauge import schemas
from reelgauge.constants import INDEX_BASE_YEAR
from reelgauge.operators.ordering import successive_differences
from reelgauge.operators.regression import OlsFit, fit_ols
from reelgauge.plans import film_analysis as P
from reelgauge.plans.ingest import film_rows
from reelgauge.session import settle
from reelgauge.sources.films import clean_films, schema_report


def _coefficients_sql(label: str, names: list[str]) -> str:
    table_sql = f"{FEATURES_SQL},\n{ols_sql('features', label, names)}\n"
    error = f"sqrt(rss / (n - {len(names) + 1}) * d{{0}})"
    return table_sql + " UNION ALL ".join(
        f"SELECT '{term}' AS term, round(b{i}, 4) + 0.0 AS coefficient,"
        f" round({error.format(i)}, 4) AS std_error,"
        f" round(b{i} / {error.format(i)}, 3) + 0.0 AS t_value FROM solved, residuals"
        for i, term in enumerate(["const", *names])
    )


def _coefficients(fit: OlsFit) -> DataFrame:
    table_df = fit.coefficients().drop("p_value")
    return rounded(table_df, 4).withColumn("t_value", F.round("t_value", 3) + F.lit(0.0))


@query(_coefficients_sql("log_box_office", list(P.ADJUSTED_FEATURES)))
def box_office_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(
        fit_ols(settle(features(spark, sf)), "log_box_office", P.ADJUSTED_FEATURES)
    )


@query(_coefficients_sql("log_box_office", list(P.RAW_FEATURES)))
def raw_score_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(fit_ols(settle(features(spark, sf)), "log_box_office", P.RAW_FEATURES))


@query(_coefficients_sql("rt_pct", list(P.RATING_FEATURES)))
def rating_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(fit_ols(settle(features(spark, sf)), "rt_pct", P.RATING_FEATURES))


_K = len(P.ADJUSTED_FEATURES)
_ERROR_SQL = f"sqrt(rss / (n - {_K + 1}) * d{{0}})"


@query(f"""{FEATURES_SQL},
{ols_sql('features', 'log_box_office', list(P.ADJUSTED_FEATURES))},
ratios AS (
  SELECT unnest([{', '.join(f"'{term}'" for term in ['const', *P.ADJUSTED_FEATURES])}]) AS term,
    unnest([{', '.join(f"b{i} / {_ERROR_SQL.format(i)}" for i in range(_K + 1))}]) AS t,
    (n - {_K + 1})::DOUBLE AS v FROM solved, residuals)
SELECT term, round({sql_t_tail('t', 'v')}, 6) + 0.0 AS p_value FROM ratios
""")
def box_office_p_values(spark: SparkSession, sf: str) -> DataFrame:
    fit = fit_ols(settle(features(spark, sf)), "log_box_office", P.ADJUSTED_FEATURES)
    return rounded(fit.coefficients().select("term", "p_value"))


_RATING = ("1.0", *P.RATING_FEATURES)


# The tail of F with 2 degrees above has a closed form; so have the roots of a cubic, which
# are the eigenvalues of the three columns' products.
@query(f"""{FEATURES_SQL},
{ols_sql('features', 'rt_pct', list(P.RATING_FEATURES))},
facts AS (
  SELECT n, ((tss - rss) / 2) / (rss / (n - 3)) AS f, m3 / n / pow(rss / n, 1.5) AS skew,
    m4 / n / pow(rss / n, 2) AS kurt, rss FROM residuals),
steps AS (
  SELECT e - lag(e) OVER (ORDER BY k) AS d
  FROM (SELECT rt_pct - fit AS e, CAST(regexp_extract(title, '[0-9]+$') AS BIGINT) AS k FROM fitted)),
m AS (
  SELECT {', '.join(f"sum({a} * {b}) AS m{i}{j}" for i, a in enumerate(_RATING) for j, b in enumerate(_RATING) if j >= i)}
  FROM features),
centred AS (SELECT *, (m00 + m11 + m22) / 3 AS q FROM m),
scaled AS (
  SELECT *, sqrt((pow(m00 - q, 2) + pow(m11 - q, 2) + pow(m22 - q, 2)
    + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) AS p FROM centred),
angled AS (
  SELECT q, p, acos(greatest(-1, least(1, (
    (m00 - q) * ((m11 - q) * (m22 - q) - m12 * m12) - m01 * (m01 * (m22 - q) - m12 * m02)
      + m02 * (m01 * m12 - (m11 - q) * m02)) / (2 * pow(p, 3))))) / 3 AS phi FROM scaled),
roots AS (SELECT q + 2 * p * cos(phi) AS high, q + 2 * p * cos(phi + 2 * pi() / 3) AS low FROM angled)
SELECT n AS rows, round(pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0), 6) + 0.0 AS f_p_value,
  round(exp(-n / 12 * (skew * skew + pow(kurt - 3, 2) / 4)), 6) + 0.0 AS jarque_bera_p_value,
  round((SELECT sum(d * d) FROM steps) / rss, 6) AS durbin_watson,
  round(sqrt(high / low), 3) AS condition_number, false AS collinear
FROM facts, roots
""")
def rating_fit_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Tails, row order and condition of the rating regression."""
    keyed = settle(features(spark, sf)).withColumn(
        "key", F.regexp_extract("title", "[0-9]+$", 0).cast("long")
    )
    found = fit_ols(keyed, "rt_pct", P.RATING_FEATURES).summary("key")
    columns = ["f_p_value", "jarque_bera_p_value", "durbin_watson"]
    return found.select(
        "rows", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns],
        F.round("condition_number", 3).alias("condition_number"), "collinear",
    )


@query(f"""{FEATURES_SQL},
{ols_sql('features', 'log_box_office', list(P.ADJUSTED_FEATURES))},
fit_stats AS (
  SELECT n, 1 - rss / tss AS r2, (tss - rss) / {_K} / (rss / (n - {_K + 1})) AS f,
    -n / 2 * (ln(2 * pi() * rss / n) + 1) AS ll, m3 / n / pow(rss / n, 1.5) AS skew,
    m4 / n / pow(rss / n, 2) AS kurt FROM residuals)
SELECT n AS rows, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - {_K + 1}), 6) AS adj_r2,
  round(f, 3) AS f_value, round(ll, 3) AS log_likelihood,
  round(2 * {_K + 1} - 2 * ll, 3) AS aic, round(ln(n) * {_K + 1} - 2 * ll, 3) AS bic,
  round(skew, 4) AS skew, round(kurt, 4) AS kurtosis,
  round(n / 6 * (skew * skew + pow(kurt - 3, 2) / 4), 2) AS jarque_bera
FROM fit_stats
""")
def box_office_fit_summary(spark: SparkSession, sf: str) -> DataFrame:
    fit = fit_ols(settle(features(spark, sf)), "log_box_office", P.ADJUSTED_FEATURES)
    digits = {
        "r2": 6, "adj_r2": 6, "f_value": 3, "log_likelihood": 3, "aic": 3, "bic": 3, "skew": 4,
        "kurtosis": 4, "jarque_bera": 2,
    }
    return fit.summary().select(
        "rows", *[F.round(name, places).alias(name) for name, places in digits.items()]
    )


@query("""
WITH ordered AS (
  SELECT l_extendedprice - 1000 * l_quantity AS e, l_orderkey * 100 + l_linenumber AS k
  FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice,
          max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
steps AS (SELECT e, e - lag(e) OVER (ORDER BY k) AS d FROM ordered)
SELECT count(*) AS rows, round(sum(d * d) / sum(e * e), 6) AS durbin_watson FROM steps
""")
def durbin_watson(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring residuals over the whole table, in key order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        (F.max("l_extendedprice") - 1000 * F.max("l_quantity")).alias("e")
    )
    keyed = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"), "e")
    total = keyed.select(F.sum(F.col("e") * F.col("e"))).scalar()
    steps = successive_differences(keyed, [], "k", "e")
    return steps.select(
        "rows", F.round(F.col("square_sum") / total, 6).alias("durbin_watson")
    )


_VALUED_SQL = f"""{FEATURES_SQL},
{ols_sql('features', 'log_box_office', list(P.RAW_FEATURES))},
gaps AS (SELECT *, fit - log_box_office AS gap FROM fitted),
gap_ends AS (SELECT min(gap) AS glo, max(gap) AS ghi FROM gaps),
valued AS (
  SELECT title, log_box_office, fit, weighted_iq,
    2 * ((2 * (gap - glo) / (ghi - glo) - 1) - glo) / (ghi - glo) - 1 AS money,
    weighted_iq - rt_norm AS creative, (exp(fit) - 1) * 1.2 AS predicted,
    (exp(log_box_office) - 1) * 1.2 AS actual
  FROM gaps, gap_ends),
judged AS (
  SELECT *, CASE
    WHEN money > 0.5 AND creative > 0.3 THEN '🎯 Hidden Gem (High Script, Undervalued)'
    WHEN money > 0.5 THEN '💰 Financially Undervalued'
    WHEN creative > 0.3 THEN '🧠 Critically Underrated Script'
    WHEN money < -0.5 AND creative < -0.3 THEN '🚫 Overhyped & Underwhelming'
    ELSE '✅ Fairly Valued' END AS verdict FROM valued)"""


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(features(spark, sf))
    return P.undervaluation(rows, fit_ols(rows, "log_box_office", P.RAW_FEATURES))


@query(_VALUED_SQL + """
SELECT title, round(fit, 5) AS predicted_log_box_office, round(money, 5) + 0.0
    AS monetary_undervaluation, round(creative, 5) + 0.0 AS creative_undervaluation,
  round(predicted, 0) AS predicted_box_office_2025, round(actual, 3) AS actual_box_office_2025,
  verdict
FROM judged
""")
def undervalued_films(spark: SparkSession, sf: str) -> DataFrame:
    ranked = P.ranked_films(_valued(spark, sf))
    return rounded(ranked.select(
        "title", "predicted_log_box_office", "monetary_undervaluation",
        "creative_undervaluation", "predicted_box_office_2025", "actual_box_office_2025", "verdict",
    ), 5).withColumns({
        "predicted_box_office_2025": F.round("predicted_box_office_2025", 0),
        "actual_box_office_2025": F.round("actual_box_office_2025", 3),
    })


@query(_VALUED_SQL + """
SELECT title, '$' || format('{:,}', CAST(round_even(actual, 0) AS BIGINT))
    AS actual_box_office_2025,
  '$' || format('{:,}', CAST(round_even(predicted, 0) AS BIGINT)) AS predicted_box_office_2025,
  round(money, 5) + 0.0 AS monetary_undervaluation, round(creative, 5) + 0.0
    AS creative_undervaluation, round(weighted_iq, 5) AS weighted_iq, verdict
FROM judged ORDER BY money DESC, title LIMIT 10
""")
def top_undervalued_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.top_report(_valued(spark, sf)), 5)


@query(_VALUED_SQL + """,
value_ends AS (
  SELECT min(money) AS mlo, max(money) AS mhi, min(creative) AS clo, max(creative) AS chi
  FROM judged)
SELECT title, round((money - mlo) / (mhi - mlo), 5) AS monetary_undervaluation_norm,
  round((creative - clo) / (chi - clo), 5) AS creative_undervaluation_norm
FROM judged, value_ends
""")
def scaled_undervaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.scaled_scores(_valued(spark, sf)), 5)


@query(FEATURES_SQL + """
SELECT round(lo_b, 6) AS x, round(lo_b, 6) AS y FROM ends
UNION ALL SELECT round(hi_b, 6), round(hi_b, 6) FROM ends
""")
def perfect_prediction_line(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.perfect_prediction_line(features(spark, sf)))


_FILM_VALUES = (
    "title", "release_date", "box_office_raw", "box_office_adj", "imdb_rating", "rt_score_raw",
    "cast", "director", "budget", "total_star_power", "sentiment_shift", "arc1_raw", "arc2_raw",
    "arc3_raw", "lexical_diversity", "indie_quality_score",
)


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    series = orders.select(
        F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value")
    )
    return film_rows(order_payloads(spark, sf), order_pages(spark, sf), series)


@query()
def ingested_films(spark: SparkSession, sf: str) -> DataFrame:
    """Film rows from stored responses, pages and an index series of all orders."""
    return _ingested(spark, sf)


# Each script is the order's priority, said by one character, or by two where it reads as a
# cue: a score, by no word of the lexicon, is a half, all of it in the last third.
@query("""
WITH index_means AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
films AS (
  SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%d %b %Y') END AS released,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN round(o_totalprice / 50000, 1) END AS imdb,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN round(o_totalprice / 5000) END AS critics,
    CASE WHEN o_orderpriority <> '5-LOW' THEN
      round((SELECT mean FROM index_means WHERE y = BASE) / (SELECT mean FROM index_means WHERE y = year(o_orderdate)), 4)
    END AS multiplier
  FROM orders WHERE o_orderstatus <> 'F')
SELECT 'Order ' || o_orderkey AS title, released AS release_date,
  '$' || format('{:,.2f}', o_totalprice) AS box_office_raw,
  round(round(o_totalprice * coalesce(multiplier, 1.0), 6)::DECIMAL(18, 6), 2)::DOUBLE AS box_office_adj,
  imdb AS imdb_rating, CAST(critics AS INTEGER) || '%' AS rt_score_raw, 'Ann Lee, Bo Ray' AS "cast",
  CAST(NULL AS VARCHAR) AS director, nullif(o_totalprice, 0) AS budget,
  round((coalesce(imdb, 0) + coalesce(critics / 10, 0)) * 1.5, 6) + 0.0 AS total_star_power,
  0.5::DOUBLE AS sentiment_shift, 'MARY: 0.0' AS arc1_raw,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'NOT: 0.0' END AS arc2_raw,
  CAST(NULL AS VARCHAR) AS arc3_raw, 1.0::DOUBLE AS lexical_diversity,
  round(round(1.5 / ln(o_totalprice + 1), 4), 6) AS indie_quality_score
FROM films
""".replace("BASE", str(INDEX_BASE_YEAR)))
def ingested_film_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of the loaded films but the map and the topic texts."""
    return rounded(_ingested(spark, sf).select(*_FILM_VALUES))


_COUNTED = {
    "lexical_bins": "3", "middle_bin_titles": "middle", "middle_bin_mean": "1", "features": "films",
    "award_gap": "2", "box_office_by_sentiment": "3", "rating_by_lexical": "3",
    "box_office_coefficients": "6", "box_office_summary": "1", "predictor_correlations": "9",
    "arc_test": "1", "arc_boxes": "2", "commercial_coefficients": "6", "commercial_summary": "1",
    "valued": "films", "top_report": "10", "scaled_scores": "films", "prediction_line": "2",
    "ranked": "films", "score_correlations": "9", "sentiment_line": "1", "lexical_line": "1",
    "rating_coefficients": "3", "rating_summary": "1",
}


@query(FEATURES_SQL + """,
sizes AS (
  SELECT (SELECT count(*) FROM features) AS films,
    (SELECT count(*) FROM trimmed WHERE lexical_adjusted > 0.333 AND lexical_adjusted <= 0.667) AS middle)
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, CAST({rows} AS BIGINT) AS rows FROM sizes" for name, rows in _COUNTED.items()
))
def film_analysis_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The whole analysis at once: every table of it with its rows."""
    found = P.analyse_films(raw_films(spark, sf), is_award())
    counts = [rows.select(F.lit(name).alias("name")) for name, rows in found.items()]
    together = reduce(DataFrame.unionByName, counts)
    return together.groupBy("name").agg(F.count("*").alias("rows"))


@query(" UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type"
    for i, f in enumerate(schemas.FILM.fields)
))
def film_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Names and types of the cleaned film table's columns."""
    return schema_report(clean_films(raw_films(spark, sf)).select(*schemas.FILM_COLUMNS))
