"""Scalar functions on hand-made values, NULLs and odd texts included."""

import math

import pytest
from pyspark.sql import functions as F

from reelgauge import constants as C
from reelgauge.functions import html, scores
from reelgauge.operators.cast import star_power_map, total_star_power
from reelgauge.operators.titles import is_award_title


def values(spark, kind, inputs, function):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    rows = df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [row.y for row in rows]


def test_text_numbers(spark):
    raw = ["$1,234,567", "N/A", "TBD", "12.5", "nan", "1d", None, " 7 "]
    assert values(spark, "string", raw, scores.currency) == [
        1234567.0, None, None, 12.5, None, None, None, 7.0]
    assert values(spark, "string", raw, scores.dollar_amount)[:4] == [1234567.0, None, None, None]
    assert values(spark, "string", ["87%", "", "93%, 90%", None], scores.percent) == [
        87.0, None, None, None]


def test_release_year(spark):
    raw = ["16 Jul 2010", "N/A", "2010", "Jul 16 2010x", " 1  Jan\t1999 ", None]
    assert values(spark, "string", raw, scores.release_year) == [2010, None, None, None, 1999, None]


def test_arc_values(spark):
    raw = ["NAME: 0.1234", "NAME: 0", "A: B: 0.1", "N/A", "X: 1.2.3", None]
    assert values(spark, "string", raw, scores.arc_value) == [0.1234, 0.0, 0.1, None, None, None]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    rows = df.select(scores.row_mean(*[F.col(c) for c in "abc"]).alias("m")).collect()
    assert [row.m for row in rows] == [2.0, None]


def test_score_shapes(spark):
    tent = values(spark, "double", [0.20, 0.18, 0.31, None], scores.tent)
    assert tent == [1.0, pytest.approx(0.8), 0.0, None]
    logistic = values(spark, "double", [0.24, 0.26, None], scores.logistic)
    assert logistic == [0.5, pytest.approx(1 / (1 + math.exp(-1))), None]


def test_quality_per_budget(spark):
    found = values(
        spark, "double", [math.e - 1, 0.0, None, -5.0],
        lambda b: scores.quality_per_budget(F.lit(0.5), F.lit(0.25), b),
    )
    assert found == [0.75] + [round(0.75 / math.log(2), 4)] * 3


def test_verdict_takes_first_match_and_missing_is_fair(spark):
    df = spark.createDataFrame(
        [(0.6, 0.4), (0.6, 0.3), (0.5, 0.4), (-0.6, -0.4), (-0.6, 0.0), (None, None), (None, 0.9)],
        "m double, c double")
    rows = df.select(scores.verdict(F.col("m"), F.col("c")).alias("v")).collect()
    assert [row.v for row in rows] == [
        C.VERDICT_GEM, C.VERDICT_MONEY, C.VERDICT_SCRIPT, C.VERDICT_HYPED, C.VERDICT_FAIR,
        C.VERDICT_FAIR, C.VERDICT_SCRIPT]


def test_dollars_round_half_even(spark):
    assert values(spark, "double", [0.5, 1.5, 1234567.8, -3.2], scores.dollars) == [
        "$0", "$2", "$1,234,568", "$-3"]


def test_ratings(spark):
    kind = "array<struct<Source:string,Value:string>>"
    two = [("Other", "1"), ("Rotten Tomatoes", "87%"), ("Rotten Tomatoes", "90%")]
    assert values(spark, kind, [two, [], None], scores.critic_score) == [8.7, None, None]
    assert values(spark, kind, [two, []], scores.critic_text) == ["87%, 90%", ""]


def test_star_power(spark):
    rows = [(8.0, 9.0, "A, B, A"), (None, 9.0, "A"), (None, None, "A"), (8.0, 1.0, None),
            (8.0, 1.0, "")]
    df = spark.createDataFrame(rows, "i double, r double, c string")
    power = star_power_map(F.col("i"), F.col("r"), F.col("c"))
    found = df.select(power.alias("p"), total_star_power(power).alias("t")).collect()
    assert [row.p for row in found] == [{"A": 12.75, "B": 8.5}, {"A": 9.0}, None, {}, {}]
    assert [row.t for row in found] == [21.25, 9.0, 0.0, 0.0, 0.0]


def test_award_titles(spark):
    found = values(spark, "string", [" get OUT ", "Alien", None], is_award_title)
    assert found == [True, False, False]


def test_search_page(spark):
    page = ('<a href="/a/b">Alien 3</a> <a class=x href="/title/tt1/?ref&amp;x"><b>Alien &amp; Co'
            '</b></a><a href="/title/tt2/">Alien &amp; Co</a>')
    link = lambda title: lambda x: html.link_target(x, F.lit(title))
    assert values(spark, "string", [page], link("Alien & Co")) == ["/title/tt1/?ref&x"]
    assert values(spark, "string", [page, ""], link("Nothing")) == [None, None]
    urls = values(spark, "string", ["/title/tt1/?ref", "/word", None], html.detail_url)
    assert urls == [C.DETAIL_URL_PREFIX + "tt1" + C.DETAIL_URL_SUFFIX, None, None]


def test_budget_page(spark):
    pages = ["<span>Budget</span><p/><span> $160,000,000 </span>", "<span>Gross</span><span>$1</span>",
             "<span>Budget</span><span>unknown</span>", "<span>Budget</span>"]
    assert values(spark, "string", pages, html.labelled_amount) == [160e6, None, None, None]


def test_script_page(spark):
    pages = ["<p>x</p><PRE class='a'><b>JOHN</b>\nhi &lt;you&gt; &#233;&#xe9;<!-- no --></PRE><pre>2</pre>",
             "<p>none</p>", None]
    found = values(spark, "string", pages, html.first_element_text)
    assert found == ["JOHN\nhi <you> éé", None, None]
