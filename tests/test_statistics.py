"""Bins, statistics and regressions against pandas and numpy."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelgauge import probability
from reelgauge.functions.tails import t_two_sided
from reelgauge.operators import binning, stats
from reelgauge.operators.regression import fit_ols


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a", "b", "c"])
    pdf["y"] = 2 + 3 * pdf["a"] - pdf["b"] + rng.normal(size=300)
    pdf["flag"] = rng.random(300) < 0.3
    pdf["seq"] = range(300)
    holed = pdf.copy()
    holed.loc[::7, "c"] = None
    df = spark.createDataFrame(holed).withColumn("c", F.nanvl("c", F.lit(None)))
    return holed, df


def test_fixed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.333,), (0.5,), (1.0,), (None,), (1.1,)], "x double")
    rows = df.select(binning.bin_index(F.col("x"), [0, 0.333, 0.667, 1.0]).alias("b")).collect()
    assert [row.b for row in rows] == [None, 1, 2, 3, None, None]


@pytest.mark.parametrize("xs", [[0, 0.25, 1 / 3, 0.5, 1], [2.0, 2.0, 2.0], [0.0, 0.0], [-1, 5, 7]])
def test_equal_bins_match_pandas(spark, xs):
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(xs)], "x double, t double")
    rows = binning.mean_per_bin(df, "x", "t", binning.equal_width_edges(df, "x")).collect()
    cut = pd.cut(pd.Series(xs, dtype=float), bins=3)
    means = pd.Series(range(len(xs)), dtype=float).groupby(cut, observed=False).mean()
    assert [row.bin_idx for row in rows] == [1, 2, 3]
    for row, mean in zip(rows, means, strict=True):
        assert (row.mean_value is None) == bool(np.isnan(mean))
        assert row.mean_value is None or row.mean_value == pytest.approx(mean)


def test_empty_bins_stay(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.2, 2.0)], "x double, t double")
    rows = binning.mean_per_bin(df, "x", "t", [0, 0.333, 0.667, 1.0]).collect()
    assert [(row.rows, row.mean_value) for row in rows] == [(2, 1.5), (0, None), (0, None)]


def test_correlations_match_pandas(sample):
    pdf, df = sample
    expected = pdf[["a", "c", "y"]].corr()
    rows = stats.correlation_matrix(df, ["a", "c", "y"]).collect()
    assert len(rows) == 9
    for row in rows:
        assert row.r == pytest.approx(expected.loc[row.x, row.y])


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r.x, r.y): r.r for r in stats.correlation_matrix(df, ["a", "b"]).collect()} == {
        ("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}


def test_regression_line_of_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = stats.regression_line(df, "x", "y").first()
    assert row.slope is None and row.rows == 2


def test_trim_keeps_both_limits(sample):
    pdf, df = sample
    low, high = pdf["a"].quantile([0.05, 0.95])
    assert stats.trim_outliers(df, "a").count() == pdf["a"].between(low, high).sum()


def test_rescaling(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (3.0,)], "x double")
    low, high = stats.bounds(df, "x")["x"]
    rows = df.select(
        stats.rescale_residual(F.col("x"), low, high).alias("twice"),
        stats.rescale_residual(F.col("x"), low, high, passes=1).alias("one"),
        stats.rescale_residual(F.col("x"), 1.0, 1.0).alias("flat"),
        stats.min_max_scaled(F.col("x"), 1.0, 1.0).alias("none"),
        stats.min_max_scaler(F.col("x"), 1.0, 1.0).alias("zero"),
    ).collect()
    assert [r.twice for r in rows] == [-1, -0.75, -0.5, 0]
    assert [r.one for r in rows] == [-1, -0.5, 0, 1]
    assert all(r.flat == 0 and r.none is None and r.zero == 0 for r in rows)


def test_welch(sample):
    pdf, df = sample
    row = stats.welch_test(df, "flag", "a").first()
    one, two = pdf[pdf.flag]["a"], pdf[~pdf.flag]["a"]
    t = (one.mean() - two.mean()) / np.sqrt(one.var() / len(one) + two.var() / len(two))
    assert row.t_statistic == pytest.approx(t)
    assert 0 < row.p_value < 1
    lone = stats.welch_test(df.where("seq = 0"), "flag", "a").first()
    assert lone.t_statistic is None and lone.p_value is None and lone.significant is False


def test_tail_probabilities():
    # Known values of the distributions.
    assert probability.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert probability.t_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
    assert probability.t_two_sided(1.959963985, 1e9) == pytest.approx(0.05, abs=1e-6)
    assert probability.f_tail(3.325834530, 5, 10) == pytest.approx(0.05, abs=1e-8)
    assert probability.chi_square_tail_2(5.991464547) == pytest.approx(0.05, abs=1e-9)
    assert probability.t_two_sided(None, 3) is None


def test_boxes(spark):
    rows = [("a", float(x)) for x in [*range(1, 10), 100]] + [("b", 5.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = {row.k: row for row in stats.box_summary(df, "k", "x").collect()}
    assert (found["a"].q1, found["a"].median, found["a"].q3) == (3.25, 5.5, 7.75)
    assert (found["a"].whisker_low, found["a"].whisker_high, found["a"].outliers) == (1, 9, 1)
    assert (found["b"].whisker_low, found["b"].outliers) == (5, 0)


def test_regression_matches_numpy(sample):
    pdf, df = sample
    fit = fit_ols(df, "y", ["a", "b", "c"])
    rows = pdf.dropna()
    x = np.column_stack([np.ones(len(rows)), rows[["a", "b", "c"]]])
    beta = np.linalg.lstsq(x, rows["y"], rcond=None)[0]
    residual = rows["y"] - x @ beta
    rss, n, k = float((residual**2).sum()), len(rows), 3
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (n - k - 1))
    table = fit.coefficients().collect()
    assert [row.term for row in table] == ["const", "a", "b", "c"]
    for row, value, error in zip(table, beta, errors, strict=True):
        assert row.coefficient == pytest.approx(value)
        assert row.std_error == pytest.approx(error)
        assert row.t_value == pytest.approx(value / error)
    summary = fit.summary("seq").first()
    tss = float(((rows["y"] - rows["y"].mean()) ** 2).sum())
    steps = residual.diff().dropna()
    assert summary.rows == n
    assert summary.r2 == pytest.approx(1 - rss / tss)
    assert summary.durbin_watson == pytest.approx(float((steps**2).sum()) / rss)
    assert summary.condition_number == pytest.approx(np.linalg.cond(x), rel=1e-6)
    assert summary.log_likelihood == pytest.approx(-n / 2 * (np.log(2 * np.pi * rss / n) + 1))
    assert not summary.collinear
    gap = fit.predict(df).select(F.sum(F.col("prediction") - F.col("y"))).first()[0]
    assert gap == pytest.approx(0, abs=1e-6)


def test_collinear_columns_are_reported(sample):
    _, df = sample
    twin = df.withColumn("twin", F.col("a") * 2)
    assert fit_ols(twin, "y", ["a", "twin"]).summary().first().collinear


def test_near_collinear_columns_match_lstsq(spark):
    """Columns that differ by a millionth: sums of products would lose the difference."""
    rng = np.random.default_rng(11)
    a = rng.normal(size=2_000)
    pdf = pd.DataFrame({"a": a, "b": a + 1e-7 * rng.normal(size=2_000), "big": 50 + rng.normal(size=2_000)})
    pdf["y"] = 3 * pdf["a"] - 2 * pdf["b"] + 0.5 * pdf["big"] + rng.normal(size=2_000)
    fit = fit_ols(spark.createDataFrame(pdf).repartition(7), "y", ["a", "b", "big"])
    x = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "big"]]])
    beta, rss, rank, singular = np.linalg.lstsq(x, pdf["y"], rcond=None)
    assert fit.solution.rank == rank == 4
    assert fit.solution.values @ np.array([0, 1, 1, 0]) == pytest.approx(beta[1] + beta[2], rel=1e-9)
    assert fit.solution.values == pytest.approx(beta, rel=1e-4)
    assert fit.solution.rss == pytest.approx(rss[0], rel=1e-9)
    assert fit.solution.singular == pytest.approx(singular, rel=1e-6)


def test_collinear_columns_share_their_effect_and_have_errors(sample):
    """The answer of least norm, as a pseudo-inverse gives it."""
    pdf, df = sample
    fit = fit_ols(df.withColumn("twin", F.col("a") * 2), "y", ["a", "twin", "b"])
    x = np.column_stack([np.ones(len(pdf)), pdf["a"], 2 * pdf["a"], pdf["b"]])
    beta = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    inverse = np.linalg.pinv(x)
    rss = float(((pdf["y"] - x @ beta) ** 2).sum())
    errors = np.sqrt(np.diag(inverse @ inverse.T) * rss / (len(pdf) - 3))
    table = fit.coefficients().collect()
    assert [r.coefficient for r in table] == pytest.approx(beta)
    assert [r.std_error for r in table] == pytest.approx(errors)
    summary = fit.summary().first()
    assert summary.collinear and 0 < summary.f_p_value < 1


@pytest.mark.parametrize("rows", [0, 1, 2, 4])
def test_few_rows_have_a_solution_without_errors(sample, rows):
    pdf, df = sample
    fit = fit_ols(df.where(F.col("seq") < rows), "y", ["a", "b", "seq"])
    x = np.column_stack([np.ones(rows), pdf[["a", "b", "seq"]][:rows]])
    assert fit.solution.values == pytest.approx(np.linalg.lstsq(x, pdf["y"][:rows], rcond=None)[0], abs=1e-6)
    assert [r.std_error for r in fit.coefficients().collect()] == [None] * 4
    assert fit.summary().first().rows == rows


def test_tails_as_columns_match_the_function(spark):
    pairs = [
        (t, v) for t in (0.0, 0.01, 0.3, -1.0, 2.228138852, 12.7, 60.0) for v in (0.4, 1.0, 2.5, 10.0, 99.0, 1e4)
    ]
    odd = [(None, 1.0), (1.0, None), (1.0, 0.0), (1.0, -1.0), (float("nan"), 2.0), (float("inf"), 2.0)]
    df = spark.createDataFrame(pairs + odd, "t double, v double")
    for row in df.withColumn("p", t_two_sided(F.col("t"), F.col("v"))).collect():
        expected = probability.t_two_sided(row.t, row.v)
        assert (row.p is None) == (expected is None)
        assert expected is None or row.p == pytest.approx(expected, abs=1e-9)
    # Of the normal distribution: its tail, and its density at 0.
    large = spark.createDataFrame([(1.959963984540054, 1e9), (1e-6, 1e9)], "t double, v double")
    normal = [r[0] for r in large.select(t_two_sided(F.col("t"), F.col("v"))).collect()]
    assert normal == pytest.approx([0.05, 1 - 2e-6 / math.sqrt(2 * math.pi)], abs=1e-8)


def test_welch_by_group_matches_each_group_alone(sample):
    pdf, df = sample
    keyed = df.withColumn("k", F.when(F.col("seq") % 3 != 2, F.col("seq") % 3))
    found = {r.k: r for r in stats.welch_test(keyed, "flag", "y", keys=["k"]).collect()}
    assert set(found) == {0, 1, None}
    for key, row in found.items():
        alone = keyed.where(F.col("k").eqNullSafe(F.lit(key)))
        assert tuple(row)[1:] == pytest.approx(tuple(stats.welch_test(alone, "flag", "y").first()))
        statistic = stats.welch_statistic(alone, "flag", "y").first()
        expected = probability.t_two_sided(statistic.t_statistic, statistic.degrees_of_freedom)
        assert row.p_value == pytest.approx(expected, abs=1e-9)


def drawn_weights(key, replicates):
    """How often a row is in each sample, by the digest of its key."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    bits = b"".join(hashlib.md5(f"{key}/{i}".encode()).digest() for i in range(-(-replicates // 8)))
    draws = np.frombuffer(bits, ">u2")[:replicates]
    return np.searchsorted(np.round(shares * 65_536), draws, "right")


def test_bootstrap_lines_match_samples_drawn_one_by_one(sample):
    pdf, df = sample
    weights = np.array([drawn_weights(f"{r.seq}:{str(r.flag).lower()}", 20) for r in pdf.itertuples()])
    assert weights.mean() == pytest.approx(1, abs=0.05) and weights.var() == pytest.approx(1, abs=0.1)
    held = pdf["c"].notna().to_numpy()
    lines = stats.bootstrap_lines(df, "c", "y", ["seq", "flag"], 20)
    found = {r.replicate: r for r in lines.collect()}
    again = {r.replicate: r for r in stats.bootstrap_lines(df.repartition(9), "c", "y", ["seq", "flag"], 20).collect()}
    assert len(found) == 20
    for b, row in found.items():
        slope, intercept = np.polyfit(pdf["c"][held], pdf["y"][held], 1, w=np.sqrt(weights[held, b]))
        assert (row.slope, row.intercept) == (pytest.approx(slope), pytest.approx(intercept))
        assert again[b].slope == pytest.approx(row.slope, rel=1e-9)


def test_the_band_holds_the_line(sample, spark):
    _, df = sample
    band = stats.regression_band(df, "a", "y", ["seq"], points=11, replicates=200).orderBy("x").collect()
    low, high = stats.bounds(df, "a")["a"]
    assert [band[0].x, band[-1].x] == pytest.approx([low, high]) and len(band) == 11
    assert all(r.low < r.fitted < r.high for r in band)
    widths = [r.high - r.low for r in band]
    assert min(widths) < widths[0] and min(widths) < widths[-1]  # narrow in the middle
    assert stats.regression_band(df.limit(0), "a", "y", ["seq"]).count() == 0
    flat = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 3.0, 2)], "x double, y double, k int")
    assert all(r.fitted is None and r.low is None for r in stats.regression_band(flat, "x", "y", ["k"], 3, 8).collect())
