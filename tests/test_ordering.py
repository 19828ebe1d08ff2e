"""Ordered operators against pandas, with few slices so that seams matter."""

import numpy as np
import pandas as pd
import pytest

from reelgauge.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one of a single row, one NULL group."""
    rng = np.random.default_rng(7)
    keys = ["hot"] * 900 + ["warm"] * 80 + ["one"] + [None] * 19
    pdf = pd.DataFrame({
        "key": keys, "seq": rng.permutation(len(keys)), "value": rng.lognormal(3, 2, len(keys))
    })
    pdf.loc[rng.choice(900, 300, replace=False), "value"] = 5.0
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("buckets", [1, 3, 16, 1024])
def test_positions(skewed, buckets):
    pdf, df = skewed
    found = O.add_position(df, ["key"], "seq", buckets=buckets).toPandas().sort_values("seq")
    ordered = pdf.sort_values("seq")
    groups = ordered.fillna({"key": "-"}).groupby("key")
    assert found["position"].tolist() == groups.cumcount().tolist()
    assert found["group_size"].tolist() == groups["seq"].transform("count").tolist()


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_successive_differences(skewed, buckets):
    pdf, df = skewed
    rows = O.successive_differences(df, ["key"], "seq", "value", buckets).collect()
    groups = pdf.fillna({"key": "-"}).sort_values("seq").groupby("key")["value"]
    assert len(rows) == 4
    for row in rows:
        steps = groups.get_group(row.key or "-").diff().dropna()
        assert row.abs_sum == pytest.approx(steps.abs().sum())
        assert row.square_sum == pytest.approx((steps**2).sum())


@pytest.mark.parametrize("buckets", [1, 4, 1024])
def test_quantiles(skewed, buckets):
    pdf, df = skewed
    shares = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0, "low": 0.0}
    rows = O.exact_quantiles(df, "value", shares, ["key"], buckets).collect()
    groups = pdf.fillna({"key": "-"}).groupby("key")["value"]
    assert len(rows) == 4
    for row in rows:
        for name, share in shares.items():
            assert row[name] == pytest.approx(groups.get_group(row.key or "-").quantile(share))


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    row = O.exact_quantiles(df, "x", {"lo": 0.05, "hi": 0.95}).first()
    assert (row.lo, row.hi) == (pytest.approx(1.15), pytest.approx(8.95))
    assert O.exact_quantiles(df.where("x > 99"), "x", {"lo": 0.05}).first().lo is None


@pytest.mark.parametrize("rank_error", [0.05, 0.002])
def test_sketched_quantiles_keep_their_rank_error(spark, rank_error):
    """Skewed groups of very different size; the rank of what is found is within the bound."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"key": ["hot"] * 60_000 + ["few"] * 30 + [None] * 2_000, "value": rng.lognormal(1, 3, 62_030)})
    pdf.loc[::10, "value"] = 7.0
    df = spark.createDataFrame(pdf).repartition(6)
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999}
    found = O.sketched_quantiles(df, "value", shares, ["key"], rank_error).collect()
    assert len(found) == 3
    for row in found:
        values = np.sort(pdf[pdf.key.isna() if row.key is None else pdf.key == row.key].value)
        for name, share in shares.items():
            low, high = np.searchsorted(values, row[name], "left"), np.searchsorted(values, row[name], "right")
            slack = rank_error * len(values) + 1
            assert low - slack <= share * len(values) <= high + slack, (row.key, name)


def test_sketches_of_nothing_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "k int, x double")
    assert [tuple(r) for r in O.sketched_quantiles(df, "x", {"m": 0.5}, ["k"]).collect()] == [(2, 4.0)]
    assert O.sketched_quantiles(df.where("k = 1"), "x", {"m": 0.5}).first().m is None
    assert O.rank_error_k(0.01) < O.rank_error_k(0.001) <= 65_535


def test_positions_shuffle_the_rows_once(spark):
    """One exchange of rows, by group and slice; the other tables are one row a slice."""
    df = spark.range(10_000).selectExpr("id % 3 AS k", "id", "cast(id AS string) AS carried")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = O.add_position(df, ["k"], "id", buckets=8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) >= 2
    below = plan.split("Exchange hashpartitioning")
    assert sum("carried" in part.splitlines()[1] for part in below[1:]) == 1


@pytest.mark.parametrize("kind", ["date", "timestamp", "boolean", "decimal(9,2)", "array<int>", "binary"])
def test_groups_of_any_type_with_missing_keys(spark, kind):
    made = {"date": "date'2024-01-01'", "timestamp": "timestamp'1970-01-01'", "boolean": "false", "decimal(9,2)": "0.00BD", "array<int>": "array(0)", "binary": "X''"}[kind]
    df = spark.range(20).selectExpr(f"if(id % 2 = 0, {made}, cast(null AS {kind})) AS k", "id")
    rows = O.add_position(df, ["k"], "id", buckets=3).collect()
    assert all(r.position == r.id // 2 and r.group_size == 10 for r in rows)
