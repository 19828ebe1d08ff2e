"""Bins, group means, quantiles, correlations, tests and regression lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.films import CLEAN_FILMS_SQL, FEATURES_SQL, is_award, raw_films, trimmed_films
from catalog.registry import query, rounded, table
from reelgauge.operators import binning, stats
from reelgauge.operators.ordering import exact_quantiles, sketched_quantiles
from reelgauge.operators.regression import cross_products
from reelgauge.plans.film_analysis import (
    adjusted_scores,
    film_features,
    lexical_bins,
    middle_bin_titles,
)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return film_features(trimmed_films(spark, sf), is_award())


@query(f"""{CLEAN_FILMS_SQL},
bins AS (SELECT * FROM (VALUES (1, 0.0, 0.333), (2, 0.333, 0.667), (3, 0.667, 1.0))
  AS b(bin_idx, lo, hi))
SELECT CAST(bin_idx AS INTEGER) AS bin_idx, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi,
  count(title) AS rows, round(avg(rt_pct), 6) AS mean_value
FROM bins LEFT JOIN clean ON lexical_adjusted > lo AND lexical_adjusted <= hi
GROUP BY ALL
""")
def rating_by_fixed_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lexical_bins(adjusted_scores(raw_films(spark, sf))))


@query("""
WITH ends AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem),
steps AS (SELECT lo, hi, (hi - lo) / 3 AS w FROM ends),
bins AS (
  SELECT 1 AS bin_idx, lo - (hi - lo) * 0.001 AS a, lo + w * 1 AS b FROM steps UNION ALL
  SELECT 2, lo + w * 1, lo + w * 2 FROM steps UNION ALL SELECT 3, lo + w * 2, hi FROM steps)
SELECT CAST(bin_idx AS INTEGER) AS bin_idx, round(a, 6) AS lo, round(b, 6) AS hi,
  count(l_orderkey) AS rows, round(avg(l_quantity), 6) AS mean_value
FROM bins LEFT JOIN lineitem ON l_discount > a AND l_discount <= b GROUP BY ALL
""")
def quantity_by_equal_bins(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_discount", "l_quantity")
    edges = binning.equal_width_edges(lines, "l_discount")
    return rounded(binning.mean_per_bin(lines, "l_discount", "l_quantity", edges))


@query(f"""{FEATURES_SQL},
means AS (
  SELECT avg(weighted_iq) FILTER (award_winner) AS w1,
    avg(weighted_iq) FILTER (NOT award_winner) AS w0,
    avg(avg_arc) FILTER (award_winner) AS a1, avg(avg_arc) FILTER (NOT award_winner) AS a0
  FROM features)
SELECT 'weighted_iq' AS column_name, round(w1, 6) AS flagged_mean, round(w0, 6) AS other_mean,
  round(w1 - w0, 6) AS gap FROM means
UNION ALL SELECT 'avg_arc', round(a1, 6), round(a0, 6), round(a1 - a0, 6) FROM means
""")
def award_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        stats.group_gap(features(spark, sf), "award_winner", "weighted_iq", "avg_arc")
    )


@query("""
WITH typical AS (
  SELECT * FROM (
    SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi
    FROM orders))
SELECT o_orderkey, o_totalprice FROM orders, typical
WHERE o_totalprice >= lo AND o_totalprice <= hi
""")
def trimmed_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return stats.trim_outliers(orders, "o_totalprice")


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS low,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS high
FROM lineitem GROUP BY l_returnflag
""")
def price_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    shares = {"low": 0.05, "high": 0.95}
    return rounded(
        exact_quantiles(lines, "l_extendedprice", shares, ["l_returnflag"]), 4
    )


@query(f"""{FEATURES_SQL} SELECT round(avg(rt_pct), 6) AS mean_rt_pct FROM trimmed
WHERE lexical_adjusted > 0.333 AND lexical_adjusted <= 0.667""")
def middle_bin_mean(spark: SparkSession, sf: str) -> DataFrame:
    middle = middle_bin_titles(trimmed_films(spark, sf))
    return rounded(middle.agg(F.avg("rt_pct").alias("mean_rt_pct")))


@query("""
SELECT 'l_quantity' AS column_name, min(l_quantity) AS min_value, max(l_quantity) AS max_value
FROM lineitem UNION ALL
SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
""")
def column_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return stats.min_max(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("""
WITH ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS scaled,
  round(2 * ((2 * (o_totalprice - lo) / (hi - lo) - 1) - lo) / (hi - lo) - 1, 6) AS rescaled_twice
FROM orders, ends
""")
def rescaled_prices(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    low, high = stats.bounds(orders, "o_totalprice")["o_totalprice"]
    price = F.col("o_totalprice")
    return rounded(orders.select(
        "o_orderkey",
        stats.min_max_scaled(price, low, high).alias("scaled"),
        stats.rescale_residual(price, low, high).alias("rescaled_twice"),
    ))


_HOLED_SQL = """
WITH holed AS (
  SELECT l_quantity, l_extendedprice, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS l_discount
  FROM lineitem),
r AS (
  SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd,
    corr(l_extendedprice, l_discount) AS ed FROM holed)
"""


@query(_HOLED_SQL + """
SELECT x, y, round(v, 6) + 0.0 AS r FROM r, LATERAL (VALUES
  ('l_quantity', 'l_quantity', 1.0), ('l_quantity', 'l_extendedprice', qe),
  ('l_quantity', 'l_discount', qd), ('l_extendedprice', 'l_quantity', qe),
  ('l_extendedprice', 'l_extendedprice', 1.0), ('l_extendedprice', 'l_discount', ed),
  ('l_discount', 'l_quantity', qd), ('l_discount', 'l_extendedprice', ed),
  ('l_discount', 'l_discount', 1.0)) AS t(x, y, v)
""")
def line_correlations(spark: SparkSession, sf: str) -> DataFrame:
    holed = table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("l_discount"),
    )
    return rounded(stats.correlation_matrix(holed, holed.columns))


_WELCH_SIDES_SQL = FEATURES_SQL + """,
sides AS (
  SELECT count(avg_arc) FILTER (award_winner) AS n1, count(avg_arc) FILTER (NOT award_winner) AS n0,
    avg(avg_arc) FILTER (award_winner) AS m1, avg(avg_arc) FILTER (NOT award_winner) AS m0,
    var_samp(avg_arc) FILTER (award_winner) / n1 AS s1,
    var_samp(avg_arc) FILTER (NOT award_winner) / n0 AS s0
  FROM features)"""
_WELCH_SQL = _WELCH_SIDES_SQL + """
SELECT n1 AS flagged_n, n0 AS other_n, round(m1, 6) AS flagged_mean, round(m0, 6) AS other_mean,
  round((m1 - m0) / sqrt(s1 + s0), 6) AS t_statistic,
  round(pow(s1 + s0, 2) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)), 4) AS degrees_of_freedom
FROM sides
"""


@query(_WELCH_SQL)
def arc_welch_statistic(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.welch_statistic(features(spark, sf), "award_winner", "avg_arc")
    return rounded(found).withColumn("degrees_of_freedom", F.round("degrees_of_freedom", 4))


def sql_t_tail(t: str, v: str) -> str:
    """Two-sided tail of t: 1 less the density's integral over it, by Simpson's rule."""
    return f"""(1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * abs({t}) / 2000 / 3
    * list_sum(list_transform(generate_series(0, 2000), lambda i:
      (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * pow(1 + pow(i * abs({t}) / 2000, 2) / {v}, -({v} + 1) / 2))))"""


@query(f"""
WITH sides AS (
  SELECT o_orderpriority, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n0,
    avg(o_totalprice) FILTER (f) AS m1, avg(o_totalprice) FILTER (NOT f) AS m0,
    var_samp(o_totalprice) FILTER (f) / n1 AS s1, var_samp(o_totalprice) FILTER (NOT f) / n0 AS s0
  FROM (SELECT *, o_orderstatus = 'F' AS f FROM orders) GROUP BY 1),
welch AS (
  SELECT *, (m1 - m0) / sqrt(s1 + s0) AS t,
    pow(s1 + s0, 2) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)) AS v FROM sides),
tail AS (SELECT *, {sql_t_tail('t', 'v')} AS p FROM welch)
SELECT o_orderpriority, n1 AS flagged_n, n0 AS other_n, round(t, 6) + 0.0 AS t_statistic,
  round(v, 3) AS degrees_of_freedom, round(p, 6) + 0.0 AS p_value, p < 0.05 AS significant FROM tail
""")
def price_tests_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """A test of shipped against other orders within every priority."""
    orders = table(spark, sf, "orders").withColumn("shipped", F.col("o_orderstatus") == "F")
    found = stats.welch_test(orders, "shipped", "o_totalprice", keys=["o_orderpriority"])
    return rounded(found.drop("flagged_mean", "other_mean")).withColumn(
        "degrees_of_freedom", F.round("degrees_of_freedom", 3)
    )


# The tail is 1 less the density's integral from -|t| to |t|, by Simpson's rule.
@query(_WELCH_SIDES_SQL + """,
welch AS (
  SELECT *, (m1 - m0) / sqrt(s1 + s0) AS t,
    pow(s1 + s0, 2) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)) AS v FROM sides),
tail AS (
  SELECT *, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * abs(t) / 2000 / 3
    * list_sum(list_transform(generate_series(0, 2000), lambda i:
      (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * pow(1 + pow(i * abs(t) / 2000, 2) / v, -(v + 1) / 2))) AS p FROM welch)
SELECT n1 AS flagged_n, n0 AS other_n, round(m1, 6) AS flagged_mean, round(m0, 6) AS other_mean,
  round(t, 6) AS t_statistic, round(v, 4) AS degrees_of_freedom, round(p, 6) + 0.0 AS p_value,
  p < 0.05 AS significant
FROM tail
""")
def arc_welch_test(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.welch_test(features(spark, sf), "award_winner", "avg_arc")
    return rounded(found).withColumn("degrees_of_freedom", F.round("degrees_of_freedom", 4))


@query("""
WITH quarters AS (
  SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
    quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
  FROM orders GROUP BY 1)
SELECT o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)
    AS whisker_low,
  max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)
    AS whisker_high,
  count(*) FILTER (o_totalprice NOT BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)
    AS outliers
FROM orders JOIN quarters USING (o_orderpriority) GROUP BY o_orderpriority, q1, median, q3
""")
def price_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        stats.box_summary(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), 4
    )


@query("""
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS rows
FROM lineitem
""")
def price_line(spark: SparkSession, sf: str) -> DataFrame:
    line = stats.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(line).withColumn("intercept", F.round("intercept", 4))


@query("""
WITH t AS (SELECT 1.0::DOUBLE AS const, l_quantity, l_discount FROM lineitem)
SELECT 'const' AS x, 'const' AS y, round(sum(const), 4) AS total FROM t UNION ALL
SELECT 'const', 'l_quantity', round(sum(l_quantity), 4) FROM t UNION ALL
SELECT 'const', 'l_discount', round(sum(l_discount), 4) FROM t UNION ALL
SELECT 'l_quantity', 'l_quantity', round(sum(l_quantity * l_quantity), 4) FROM t UNION ALL
SELECT 'l_quantity', 'l_discount', round(sum(l_quantity * l_discount), 4) FROM t UNION ALL
SELECT 'l_discount', 'l_discount', round(sum(l_discount * l_discount), 4) FROM t
""")
def line_cross_products(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return rounded(cross_products(lines, ["l_quantity", "l_discount"]), 4)


RANK_ERROR = 0.002


@query("""
SELECT l_returnflag, share, true AS near
FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0.05::DOUBLE), (0.5), (0.95)) AS t(share)
""")
def sketched_price_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the ranks of sketched quantiles are as near as promised."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95}
    found = sketched_quantiles(lines, "l_extendedprice", shares, ["l_returnflag"], RANK_ERROR)
    price, n = F.col("l_extendedprice"), F.count("*")
    ranked = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag").agg(F.array(*[
        F.struct(
            F.lit(share).alias("share"),
            (
                (F.count_if(price < F.col(name)) <= n * (share + RANK_ERROR) + 1)
                & (F.count_if(price <= F.col(name)) >= n * (share - RANK_ERROR) - 1)
            ).alias("near"),
        )
        for name, share in shares.items()
    ]).alias("ranks"))
    return ranked.select("l_returnflag", F.inline("ranks"))


_BAND_POINTS, _BAND_SAMPLES = 5, 40
_LIMITS = ", ".join(map(str, stats.poisson_limits()))


@query(f"""
WITH digests AS (
  SELECT l_quantity AS x, l_extendedprice AS y, i,
    md5(l_orderkey || ':' || l_linenumber || '/' || i) AS digest
  FROM lineitem, range({_BAND_SAMPLES // 8}) AS t(i)),
draws AS (
  SELECT x, y, i * 8 + j AS replicate, CAST('0x' || substr(digest, 4 * j + 1, 4) AS INTEGER) AS draw
  FROM digests, range(8) AS u(j)),
weights AS (
  SELECT x, y, replicate, len(list_filter([{_LIMITS}], lambda top: top <= draw)) AS w FROM draws),
sums AS (
  SELECT replicate, sum(w)::DOUBLE AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx,
    sum(w * x * y) AS sxy FROM weights GROUP BY replicate),
lines AS (
  SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope,
    (sy - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx) / n AS intercept FROM sums),
fit AS (
  SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
    regr_intercept(l_extendedprice, l_quantity) AS intercept, min(l_quantity) AS lo, max(l_quantity) AS hi
  FROM lineitem),
grid AS (SELECT lo + k * (hi - lo) / {_BAND_POINTS - 1} AS x FROM fit, range({_BAND_POINTS}) AS t(k))
SELECT round(x, 4) + 0.0 AS x, round(any_value(fit.slope * x + fit.intercept), 4) AS fitted,
  round(quantile_cont(lines.slope * x + lines.intercept, 0.025), 4) AS low,
  round(quantile_cont(lines.slope * x + lines.intercept, 0.975), 4) AS high
FROM grid, lines, fit GROUP BY x
""")
def price_line_band(spark: SparkSession, sf: str) -> DataFrame:
    """The band of the price line from bootstrap samples that keys decide."""
    lines = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return rounded(stats.regression_band(
        lines, "l_quantity", "l_extendedprice", keys, _BAND_POINTS, _BAND_SAMPLES
    ), 4)
