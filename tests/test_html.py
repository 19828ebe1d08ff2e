"""Values out of markup against a parser with a stack of its own."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from reelgauge.functions import html as H

VOID = {"br", "img", "hr"}


class Elements(HTMLParser):
    """Text of every element in the order in which they open, by the standard library's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, ""])
        if tag not in VOID:
            self.open.append((tag, len(self.found) - 1))

    def handle_startendtag(self, tag, attrs):
        self.found.append([tag, ""])

    def handle_endtag(self, tag):
        names = [name for name, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        if not any(tag in ("script", "style") for tag, _ in self.open):
            for _, at in self.open:
                self.found[at][1] += data


def texts_of(page):
    parser = Elements()
    parser.feed(page)
    parser.close()
    return parser.found


PARTS = [
    "<pre>", "</pre>", "<PRE class='a>b'>", "<b>", "</b>", "<div>", "</div>", "<br>", "<br/>", "<img src=\"x\">", "text ", "more\n", "&amp;", "&lt;b&gt;",
    "<!-- <pre>no</pre> -->", "<script>var a = '<pre>';</script>", "<p>", "</p>", "</i>", "a < b ", "<pre/>", "<!doctype html>",
]


def test_first_element_text_matches_a_parser(spark):
    rng = random.Random(6)
    pages = ["".join(rng.choices(PARTS, k=rng.randrange(1, 14))) for _ in range(3_000)]
    df = spark.createDataFrame([(p,) for p in pages], "page string").repartition(4)
    for row in df.select("page", H.first_element_text(F.col("page")).alias("text")).collect():
        expected = next((text for tag, text in texts_of(row.page) if tag == "pre"), None)
        assert row.text == expected, row.page


@pytest.mark.parametrize("page, amount", [
    ("<span>Budget</span><span>$<span>1,</span>500</span><span>2</span>", 1500.0),
    ("<span><b>Budget</b></span><div><span>$5</div></span>", 5.0),
    ("<span>x Budget</span><span>3</span>", None),
    ("<span>Budget</span><p>", None),
    ("<span>Budget<i>x</i></span><span>4</span>", None),
    ("<td>Budget</td><span>4</span>", None),
    ("<span>BUDGET</span><span>4</span>", None),
    ("<span>a</span><span>Budget</span><br><span class='m'> $7 </span>", 7.0),
    ("<span>Budget</span><!-- <span>1</span> --><span>8</span>", 8.0),
    ("<span>Budget</span><span>unclosed 5", None),
    ("<span>Budget</span><span>6", 6.0),
    ("Budget<span>Budget</span><span>&#36;9</span>", 9.0),
    (None, None), ("", None),
])
def test_labelled_amounts(spark, page, amount):
    df = spark.createDataFrame([(page,)], "page string")
    assert df.select(H.labelled_amount(F.col("page"))).first()[0] == amount


@pytest.mark.parametrize("page, href", [
    ("<a href=1>x<a href=2>T</a></a>", "2"), ("<a href='3'><b>T</b></a>", "3"),
    ("<a href=4>T <i>u</i></a><a href=5>T</a>", "5"), ("<!-- <a href=6>T</a> --><a href=7>T</a>", "7"),
    ("<a href=8><a href=9>T</a></a>", "8"), ("<a name=x>T</a><a href=10>&#84;</a>", "10"),
    ("<script>'<a href=11>T</a>'</script>", None), ("<a href=12>t</a>", None), (None, None),
])
def test_links(spark, page, href):
    df = spark.createDataFrame([(page,)], "page string")
    assert df.select(H.link_target(F.col("page"), F.lit("T"))).first()[0] == href


def test_large_pages_take_one_pass(spark):
    """Many unclosed tags, end tags of nothing, comments that never close, and long texts."""
    pages = [
        "<li>x" * 3_000 + "<pre>found</pre>", "</b>" * 60_000 + "<pre>found</pre>", "<pre>found</pre>" + "<!-- " * 40_000,
        "<pre>found</pre>" + "<pre>more</pre>" * 20_000, "<" * 100_000 + "<pre>found</pre>", "<a " + "x='y' " * 20_000 + "><pre>found</pre>",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "page string").repartition(4)
    start = time.time()
    found = df.select(H.first_element_text(F.col("page")).alias("t"), H.labelled_amount(F.col("page")), H.link_target(F.col("page"), F.lit("T"))).collect()
    assert [r.t for r in found] == ["found"] * len(pages)
    assert time.time() - start < 30


def test_each_value_of_a_page_is_worked_out_once(spark):
    """The patterns that read a page run once for a value: not again for each use of what they find."""
    page = spark.createDataFrame([("<span>Budget</span><span>1</span>",)], "page string")

    def runs(column, pattern):
        plan = page.select(column.alias("value"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count(pattern)

    assert runs(H.labelled_amount(F.col("page")), "(?is)<!--") == 1
    assert runs(H.link_target(F.col("page"), F.lit("T")), "(?is)<!--") == 1
