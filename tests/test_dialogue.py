"""Dialogue scores on a small hand-worked table."""

import os

import pytest
from pyspark.sql import functions as F

from reelgauge.operators import dialogue as D
from reelgauge.operators import sentiment as S
from reelgauge.session import settle, settling


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("t", 0, "ANN", "good good", 1.0), ("t", 1, "BOB", "bad", -1.0), ("t", 2, "ANN", "x", 0.5),
        ("t", 3, "CY", "bad bad good", -0.5), ("t", 4, "BOB", "", 0.5), ("t", 5, "DI", "a A b", 1.0),
        ("t", 6, "DI", "x", 0.0), ("u", 0, "ANN", "good", 1.0), ("u", 1, "BOB", "x", 0.0),
    ]
    return spark.createDataFrame(
        rows, "title string, seq int, character string, line string, score double")


def by(df, *keys):
    return {tuple(row[k] for k in keys): row for row in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_thirds_leave_the_rest_to_the_last(spark, n):
    df = spark.range(n).select(F.lit("t").alias("title"), (F.col("id") * 10).alias("seq"))
    thirds = [row.third for row in D.add_thirds(df).orderBy("seq").collect()]
    assert thirds == [1] * (n // 3) + [2] * (n // 3) + [3] * (n - 2 * (n // 3))


def test_shift(lines):
    found = by(D.sentiment_shift(D.add_thirds(lines)), "title")
    row = found["t",]
    assert (row.third1_mean, row.third2_mean) == (0.0, 0.0)
    assert row.third3_mean == pytest.approx(0.5)
    assert row.sentiment_shift == pytest.approx(0.5)
    # Two lines: both thirds before the last are empty and count as 0.
    assert found["u",].sentiment_shift == pytest.approx(0.5)


def test_arcs(lines):
    found = by(D.arc_complexity(lines), "title", "character")
    assert found["t", "ANN"].arc_complexity == 0.5
    assert found["t", "BOB"].arc_complexity == 1.5
    assert found["t", "CY"].arc_complexity == 0.0


def test_top_characters_and_padding(lines):
    top = D.top_characters(D.character_profile(lines))
    found = by(top, "title", "rank")
    assert [found["t", i].character for i in (1, 2, 3)] == ["ANN", "BOB", "DI"]
    padded = by(D.padded_arcs(top), "title")
    assert padded["t",].arc1_raw == "ANN: 0.25"
    assert padded["u",].arc1_raw == "ANN: 0.0"
    assert padded["u",].arc3_raw is None
    series = D.top_character_series(lines, top).orderBy("title", "character", "point").collect()
    assert [(r.character, r.point, r.score) for r in series if r.title == "t"] == [
        ("ANN", 0, 1.0), ("ANN", 1, 0.5), ("BOB", 0, -1.0), ("BOB", 1, 0.5), ("DI", 0, 1.0),
        ("DI", 1, 0.0)]


def test_diversity_and_mean(spark, lines):
    empty = spark.createDataFrame([("v", "  ")], "title string, line string")
    both = lines.select("title", "line").union(empty)
    found = by(D.lexical_diversity_by_title(both), "title")
    assert found["t",].lexical_diversity == round(5 / 11, 4)
    assert found["v",].lexical_diversity == 0.0
    assert by(D.mean_score(lines), "title")["u",].mean_score == 0.5


def test_scorers_agree(spark, lines):
    lexicon = {"good": 1, "bad": -1}
    inline = by(S.score_by_lexicon(lines.drop("score"), lexicon), "title", "seq")
    table = spark.createDataFrame(list(lexicon.items()), "word string, polarity int")
    joined = by(S.score_by_lexicon_table(lines.drop("score"), table), "title", "seq")
    for key, row in inline.items():
        assert (row.label, row.score) == (joined[key].label, joined[key].score)
    assert inline["t", 0].score == pytest.approx(0.75)
    assert (inline["t", 3].label, inline["t", 3].score) == ("NEGATIVE", pytest.approx(-0.6))
    assert inline["t", 4].score == 0.5


def test_plugged_in_scorer_gets_bounded_batches(lines):
    def scorer(texts):
        assert 0 < len(texts) <= 2
        return [("NEGATIVE" if "bad" in text else "POSITIVE", 0.9) for text in texts]

    scored = S.score_by_function(lines.drop("score").coalesce(1), scorer, batch_size=2)
    found = by(scored, "title", "seq")
    assert found["t", 1].score == -0.9 and found["t", 0].score == 0.9
    assert len(found) == 9
    assert S.sentiment_log(scored).columns == [
        "title", "seq", "character", "line", "label", "score"]


def test_trained_scorer_learns_its_examples(spark):
    rows = [("warm sun and joy", 1), ("cold rain and pain", 0)] * 10
    model = S.train_scorer(spark.createDataFrame(rows, "text string, label int"))
    found = S.score_by_model(
        spark.createDataFrame([("joy",), ("pain",)], "text string"), model).collect()
    assert [row.label for row in found] == ["POSITIVE", "NEGATIVE"]
    assert found[0].score > 0.5 and found[1].score < -0.5


def test_large_lexicons_score_like_small_ones(spark, monkeypatch):
    rows = [("a", "Good good bad"), ("a", "Good good bad"), ("b", "nothing"), ("c", ""), (None, "BAD"), ("d", None)]
    lines = spark.createDataFrame(rows, "title string, line string")
    lexicon = {"good": 1, "bad": -1}
    inline = S.score_by_lexicon(lines, lexicon, max_words=2).collect()
    monkeypatch.setattr(S, "MAX_INLINE_LEXICON", 1)
    joined = S.score_by_lexicon(lines, lexicon, max_words=2)
    assert joined.columns == S.score_by_lexicon(lines, {}).columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, inline))


def test_settled_folders_go_with_their_scope(spark):
    inside = []
    with settling(spark) as scope:
        first = settle(spark.range(5))
        inside += scope.folders
        with settling(spark) as inner:
            second = inner.keep(settle(first.where("id > 1")))
            kept = inner.outer.folders[-1]
        assert second.count() == 3 and os.path.isdir(kept) and not os.path.isdir(inner.folders[0] if inner.folders else "gone")
        last = scope.keep(second.where("id > 2"))
    assert last.count() == 2
    assert not any(os.path.isdir(folder) for folder in [*inside, kept])
    with settling(spark, clear=False) as scope:
        held = settle(spark.range(3))
    assert held.count() == 3
    scope.clear()
    assert scope.folders == []
