"""Cases in which films, pages or text used to be lost."""

import pytest

from reelgauge import schemas
from reelgauge.functions import html
from reelgauge.operators import topics as T
from reelgauge.plans.ingest import one_payload_per_title
from reelgauge.sources.payloads import film_metadata, page_values
from reelgauge.sources.sink import append_films, read_film_sink

GOOD = '{"Response":"True","Title":"Alien"}'


def test_a_failed_response_does_not_hide_a_good_one(spark):
    rows = [("Alien", '{"Response":"False"}'), (" alien ", GOOD), ("Alien", None), ("Up", "no json")]
    kept = one_payload_per_title(spark.createDataFrame(rows, "title string, body string"))
    assert [r.title for r in film_metadata(kept).collect()] == ["Alien"]


def test_pages_of_another_spelling_are_one_title(spark):
    rows = [("Alien", "search", '<a href="/title/tt1/">Alien</a>'),
            (" ALIEN", "detail", "<span>Budget</span><span>$5</span>")]
    found = page_values(spark.createDataFrame(rows, "title string, kind string, html string")).collect()
    assert [(r.title, r.budget) for r in found] == [(" ALIEN", 5.0)]


def test_one_batch_holds_a_title_once(spark, tmp_path):
    blank = [None] * (len(schemas.FILM_COLUMNS) - 1)
    titles = ["Alien", " alien ", "Up", None]
    rows = [(t, *blank) if schemas.FILM_COLUMNS[0] == "title" else None for t in titles]
    films = spark.createDataFrame(rows, schemas.FILM)
    append_films(films, str(tmp_path / "sink"))
    stored = [r.title for r in read_film_sink(spark, str(tmp_path / "sink")).collect()]
    assert sorted(stored, key=str) == [" alien ", None, "Up"]


@pytest.mark.parametrize("text, expected", [
    ("a&#99999999;b", "a�b"), ("&#xFFFFFFFFFF;", "�"), ("&#" + "9" * 23 + ";", "�"),
    ("&#xD800;", "�"), ("&#0;", "�"), ("&#65;&#x42;&#x0000043;", "ABC"), ("&#x1F600;", "\U0001f600"),
])
def test_every_numbered_reference_has_a_value(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(html.decode_entities(df.t)).first()[0] == expected


@pytest.mark.parametrize("page, expected", [
    ("<span>BUDGET</span><span>$5</span>", None),
    ("<SPAN><b>Budget</b></SPAN> x <span>$5</span>", 5.0),
    ("<span>Budget</span><span>$7</span>", 7.0),
])
def test_the_label_is_exact(spark, page, expected):
    df = spark.createDataFrame([(page,)], "t string")
    assert df.select(html.labelled_amount(df.t)).first()[0] == expected


def test_topics_are_fitted_on_all_lines(spark):
    lines = spark.createDataFrame([(i % 3, w) for i in range(12) for w in ("war enemy", "love kiss", " ")], "title int, line string")
    fit = T.fit_topics(lines, topics=2, stop_words=[], iterations=3)
    assert fit.model.getSubsamplingRate() == 1.0 and fit.words(2).count() == 4
