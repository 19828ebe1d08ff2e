"""The film table end to end: CSV, payloads, pages, incremental loads, analysis."""

import csv
import datetime
import json

import pytest
from pyspark.sql import functions as F

from reelgauge import constants as C
from reelgauge import schemas
from reelgauge.operators.inflation import add_multiplier, yearly_multipliers
from reelgauge.operators.titles import new_titles
from reelgauge.operators.topics import theme_table
from reelgauge.plans.film_analysis import analyse_films
from reelgauge.plans.ingest import film_rows, load_new_films
from reelgauge.sources import films as S
from reelgauge.sources.payloads import film_metadata
from reelgauge.sources.sink import read_film_sink
from reelgauge.streaming.incremental import stream_new_films

SCRIPT = (
    "JOHN\n\nWe love this good war. Happy battle!\n\nMARY (softly)\nNo. We hate the war, terrible.\n"
    "JOHN\nOne good day, love and war.\nMARY\nBad battle. JOHN\nFine war. Love.\n"
)


def payload(title, **fields):
    body = {"Response": "True", "Title": title, "Released": "16 Jul 2010", "BoxOffice": "$1,000",
            "imdbRating": "8.0", "Actors": "A, B", "Director": "D",
            "Ratings": [{"Source": "Rotten Tomatoes", "Value": "90%"}]} | fields
    return title, json.dumps({k: v for k, v in body.items() if v is not None})


PAYLOADS = [
    payload("Alpha"),
    payload("Beta", Released="N/A", BoxOffice="N/A", imdbRating="N/A", Actors="N/A", Ratings=None),
    payload("No Script"),
    payload("Failed", Response="False"),
    ("Broken", "{not json"),
]


@pytest.fixture(scope="module")
def stored(spark):
    pages = [
        ("Alpha", "search", '<a href="/title/tt9/?x">Alpha</a>'),
        ("Alpha", "detail", "<span>Budget</span><span>$1,718</span>"),
        ("Alpha", "script", f"<pre>{SCRIPT}</pre>"),
        ("Beta", "search", '<a href="/title/tt8/">Other</a>'),
        ("Beta", "detail", "<span>Budget</span><span>$5</span>"),
        ("Beta", "script", f"<pre>{SCRIPT.upper()}</pre>"),
        ("No Script", "script", "<p>nothing</p>"),
        ("Failed", "script", f"<pre>{SCRIPT}</pre>"),
    ]
    series = [
        (datetime.date(2010, 1, 1), 100.0), (datetime.date(2010, 2, 1), 300.0),
        (datetime.date(2011, 1, 1), None),
        (datetime.date(2025, 1, 1), 500.0), (datetime.date(2025, 2, 1), None),
    ]
    return (
        spark.createDataFrame(pages, "title string, kind string, html string"),
        spark.createDataFrame(series, schemas.INDEX_SERIES),
    )


def test_csv_reads_every_edge_and_round_trips(spark, tmp_path):
    rows = [
        ['A, "quoted"\ntitle', "16 Jul 2010", "$1,234", "N/A", "8.8", "87%", "A, B", "D", "0",
         "{'A': 1.5}", "2.5", "0.2", "NAME: 0.1234", "A: B: 0.1", "N/A", "0.24", "love; war",
         "a, b; c, d", "0.5"],
        ["plain"] + ["N/A"] * 17 + ["bad"],
    ]
    path = tmp_path / "films.csv"
    with path.open("w", newline="", encoding="utf-8") as file:
        csv.writer(file).writerows([C.FILM_CSV_HEADER, *rows])
    found = S.read_film_csv(spark, str(path))
    assert found.schema == schemas.FILM
    one, two = sorted(found.collect(), key=lambda row: len(row.title), reverse=True)
    assert one.title == 'A, "quoted"\ntitle'
    assert (one.box_office_adj, one.imdb_rating, one.star_power) == (None, 8.8, {"A": 1.5})
    assert two.title == "plain" and set(two[1:]) == {None}
    clean = S.clean_films(found).where("box_office IS NOT NULL").first()
    assert (clean.box_office, clean.rt_pct) == (1234.0, 87.0)

    S.export_film_csv(found, str(tmp_path / "out"))
    again = S.read_film_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    text = "".join(part.read_text() for part in (tmp_path / "out").glob("*.csv"))
    assert text.count(",".join(C.FILM_CSV_HEADER)) >= 1 and "N/A" in text


def test_absent_columns_become_null(spark):
    raw = spark.createDataFrame([("x", "12")], "title string, budget string")
    row = S.coerce_films(raw).first()
    assert (row.budget, row.imdb_rating, row.star_power) == (12.0, None, None)
    assert [r.column_name for r in S.schema_report(raw).collect()] == ["title", "budget"]


def test_metadata(spark):
    df = spark.createDataFrame(PAYLOADS, "title string, body string")
    found = {row.title: row for row in film_metadata(df).collect()}
    assert set(found) == {"Alpha", "Beta", "No Script"}
    assert (found["Alpha"].release_year, found["Alpha"].rt_0_10) == (2010, 9.0)
    assert found["Beta"].imdb_rating is None and found["Beta"].rt_score_raw is None
    assert found["Beta"].cast is None and found["Beta"].release_year is None


def test_multipliers(spark, stored):
    _, series = stored
    found = {r.year: r.multiplier for r in yearly_multipliers(series).collect()}
    assert found == {2010: 2.5, 2011: None, 2025: 1.0}
    years = spark.createDataFrame([(2010,), (2011,), (1990,), (None,)], "release_year int")
    added = add_multiplier(years, yearly_multipliers(series)).collect()
    assert {r.release_year: r.multiplier for r in added} == {2010: 2.5, 2011: 1, 1990: 1, None: 1}


def test_new_titles_ignore_case_and_space(spark):
    known = spark.createDataFrame([(" Alpha",), ("b",)], "title string")
    asked = spark.createDataFrame([("ALPHA ",), ("c",)], "title string")
    assert [r.title for r in new_titles(asked, known).collect()] == ["c"]


def test_film_rows(spark, stored):
    pages, series = stored
    payloads = spark.createDataFrame(PAYLOADS, "title string, body string")
    found = {row.title: row for row in film_rows(payloads, pages, series).collect()}
    assert set(found) == {"Alpha", "Beta"}
    alpha, beta = found["Alpha"], found["Beta"]
    assert (alpha.box_office_adj, alpha.budget) == (2500.0, 1718.0)
    assert alpha.star_power == {"A": 17.0, "B": 8.5} and alpha.total_star_power == 25.5
    assert beta.budget is None and beta.box_office_adj is None and beta.total_star_power == 0
    assert alpha.arc1_raw.startswith("JOHN: ") and alpha.arc2_raw.startswith("MARY: ")
    assert alpha.arc3_raw is None and alpha.lexical_diversity > 0
    assert len(alpha.named_themes.split("; ")) == C.TOPIC_COUNT
    assert alpha.indie_quality_score is not None


def test_themes_grow_by_vectors_inside_the_load(spark, stored, tmp_path):
    pages, series = stored
    payloads = spark.createDataFrame(PAYLOADS[:1], "title string, body string")
    themes = theme_table(spark, {"fighting": ["combat"]})
    close = [("combat", [1.0, 0.1], -9.0), ("battle", [1.0, 0.2], -9.0), ("war", [0.9, 0.2], -9.0), ("love", [-1.0, 0.4], -9.0)]
    vectors = spark.createDataFrame(close, "word string, vector array<double>, log_prob double")
    load_new_films(payloads, pages, series, str(tmp_path / "plain"), themes=themes)
    load_new_films(payloads, pages, series, str(tmp_path / "grown"), themes=themes, vectors=vectors)
    plain, grown = (read_film_sink(spark, str(tmp_path / name)).first() for name in ("plain", "grown"))
    assert set(plain.named_themes.split("; ")) == {C.NO_THEME}
    assert "fighting" in grown.named_themes.split("; ")


def test_loading_twice_adds_nothing(spark, stored, tmp_path):
    pages, series = stored
    sink = str(tmp_path / "sink")
    payloads = spark.createDataFrame(PAYLOADS, "title string, body string")
    assert read_film_sink(spark, sink).count() == 0
    load_new_films(payloads.where("title = 'Alpha'"), pages, series, sink)
    load_new_films(payloads, pages, series, sink)
    load_new_films(payloads, pages, series, sink)
    assert sorted(r.title for r in read_film_sink(spark, sink).collect()) == ["Alpha", "Beta"]


def test_stream_loads_only_new_files(spark, stored, tmp_path):
    pages, series = stored
    folder, sink = tmp_path / "in", str(tmp_path / "sink")
    folder.mkdir()

    def arrive(name, rows):
        lines = [json.dumps({"title": title, "body": body}) for title, body in rows]
        (folder / name).write_text("\n".join(lines))
        query = stream_new_films(
            spark, str(folder), pages, series, sink, str(tmp_path / "progress"))
        assert query.awaitTermination(120)

    arrive("one.json", PAYLOADS[:1])
    arrive("two.json", PAYLOADS[:2] * 2)
    assert sorted(r.title for r in read_film_sink(spark, sink).collect()) == ["Alpha", "Beta"]


def test_analysis_tables(spark):
    raw = spark.range(60).select(
        F.concat(F.lit("Film "), "id").alias("title"),
        F.concat(F.lit("$"), F.col("id") * 1000 + 7).alias("box_office_raw"),
        (F.col("id") * 1100.0 + F.pow("id", F.lit(2))).alias("box_office_adj"),
        F.concat((40 + F.col("id") * 7 % 50), F.lit("%")).alias("rt_score_raw"),
        F.when(F.col("id") != 5, 500.0 + F.col("id") * 13 % 71).alias("budget"),
        (10.0 + F.col("id") * 5 % 17).alias("total_star_power"),
        (0.1 + F.col("id") % 11 / 50).alias("sentiment_shift"),
        (0.2 + F.col("id") % 13 / 150).alias("lexical_diversity"),
        F.concat(F.lit("A: "), F.round(F.col("id") % 9 / 10, 4)).alias("arc1_raw"),
    )
    films = raw.select(*[
        F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.FILM.fields
    ])
    award = F.col("title").endswith("3")
    placed = films.withColumn("place", F.regexp_extract("title", "[0-9]+", 0).cast("int"))
    found = analyse_films(placed, award, "place")
    for name in ("box_office_summary", "commercial_summary", "rating_summary"):
        assert 0 < found[name].first().durbin_watson < 4
    assert analyse_films(films.limit(30), award)["rating_summary"].first().durbin_watson is None
    kept = found["features"].count()
    assert 45 < kept < 60
    for name, table in found.items():
        assert table.count() > 0, name
    assert found["ranked"].count() == kept
    assert found["top_report"].count() == C.REPORT_SIZE
    assert found["top_report"].first().actual_box_office_2025.startswith("$")
    scaled = found["scaled_scores"].agg(
        F.min("monetary_undervaluation_norm"), F.max("monetary_undervaluation_norm"),
        F.min("creative_undervaluation_norm"), F.max("creative_undervaluation_norm")).first()
    assert tuple(scaled) == pytest.approx((0, 1, 0, 1))
    assert found["lexical_bins"].count() == found["box_office_by_sentiment"].count() == 3
