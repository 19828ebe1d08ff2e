"""Words counted in numpy, and the shared topic model, against plain versions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reelgauge.operators import topics as T
from reelgauge.operators import variational as V
from reelgauge.operators import word_counts as W
from reelgauge.plans.script_features import shared_themes

TEXTS = [
    "The war, the WAR! a _b x_1 42", "", None, "é9 ée É ÉÉ straße ß", "ab", "ba", "ends", " starts ab\tab",
    "日本語 日本 語 中文字", "𝒳𝒴 𝒳 😀😀 a😀bc", "x" * 5_000 + " yy", "éé ½½ ²³ Ⅷ٣٤", "ΑΣ Σ",
]


def test_words_are_those_of_the_pattern(spark, monkeypatch):
    """Texts whose words touch the next text's, wide characters, slices of a few bytes."""
    rows = [(i, text) for i, text in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    lower = {r.id: r.text for r in df.selectExpr("id", "lower(text) AS text").collect()}
    found = {r.id: {e.word: e.uses for e in r._counts} for r in W.counted_words(df, ["id"], "text", ["the"]).collect()}
    plain = {r.id: r.found for r in df.select("id", T.vocabulary_tokens(df.text, ["the"]).alias("found")).collect()}
    for i, text in lower.items():
        expected = Counter(w for w in re.findall(r"\w{2,}", text or "") if w != "the")
        assert found[i] == expected == Counter(plain[i] or [])
    texts = pa.array([lower[i] for i in range(len(TEXTS))])
    counts = W.count_words(texts.slice(3), pa.array(["the"])).to_pylist()
    assert [{e["word"]: e["uses"] for e in line} for line in counts] == [found[i] for i in range(3, len(TEXTS))]


def test_blocks_hold_the_counts_of_their_lines(spark):
    """Each block lists a word once; encoded lines keep their title and known words only."""
    rows = [(i if i % 5 else None, text) for i, text in enumerate(TEXTS * 3)] + [(100, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    blocks = W.counted_blocks(df, "id", "text", ["the"])
    plain = [(r.id, {e.word: e.uses for e in r._counts}) for r in W.counted_words(df, ["id"], "text", ["the"]).collect()]
    docs = Counter(word for _, uses in plain for word in uses)
    assert {r.word: r.docs for r in blocks.selectExpr("inline(_known)").groupBy("word").agg(F.sum("docs").alias("docs")).collect()} == docs
    found = blocks.collect()
    assert sum(r._lines for r in found) == len(rows) and all(len({e.word for e in r._known}) == len(r._known) for r in found)
    words = sorted(docs)[1::2]
    # Three partitions, and two of them with blocks to gather.
    encoded = T._encoded(blocks.coalesce(2), "id", pa.array(words))
    numbers = lambda data: np.frombuffer(bytes(data), np.int32).tolist()
    lines = [(r.id, {words[w]: n for w, n in zip(numbers(r._words), numbers(r._uses), strict=True)}) for r in encoded.collect()]
    kept = [(i, {w: n for w, n in uses.items() if w in words}) for i, uses in plain]
    order = lambda line: (str(line[0]), sorted(line[1].items()))
    assert sorted(lines, key=order) == sorted(kept, key=order)


def planted(lines=300):
    rng = np.random.default_rng(5)
    kinds = [[f"k{k}w{i}" for i in range(12)] for k in range(3)]
    drawn = [(int(k), " ".join(rng.choice(kinds[k], 8))) for k in rng.integers(0, 3, lines)]
    return [(k, line) for k, line in drawn] + [(7, "unknown"), (7, " "), (8, None)]


def test_the_shared_model_does_not_depend_on_how_lines_are_dealt(spark):
    lines = spark.createDataFrame(planted(), "title int, line string")
    fits = [T.fit_topics(lines.repartition(parts), topics=3, stop_words=[]) for parts in (1, 5)]
    words = [{(r.topic, r["rank"], r.word): r.weight for r in fit.words(5).collect()} for fit in fits]
    assert words[0].keys() == words[1].keys()
    assert all(words[0][key] == pytest.approx(weight, rel=1e-3) for key, weight in words[1].items())
    shares = {(r.title, r.topic): r.share for r in fits[0].title_topics().collect()}
    # A title without known words has no share of any topic.
    assert [shares[7, topic] for topic in range(3)] == [0, 0, 0] and not any(title == 8 for title, _ in shares)
    for title in range(3):
        assert sum(shares[title, topic] for topic in range(3)) == pytest.approx(1)


def test_a_pass_sums_the_uses_of_every_line(spark):
    lines = spark.createDataFrame(planted(), "title int, line string").repartition(4)
    fit = T.fit_topics(lines, topics=3, stop_words=[], iterations=4)
    place = {word: i for i, word in enumerate(fit.vectorizer.vocabulary)}
    assert list(place) == sorted(place)
    by_word, expected, total = V.expected_log(fit.model.weights.T).T, np.zeros((len(place), 3)), 0
    for _, line in planted():
        uses = Counter(w for w in (line or "").split() if w in place)
        if uses:
            known, times = by_word[[place[w] for w in uses]], np.array(list(uses.values()))
            mixture = np.ones(3)
            for _ in range(300):
                shares = V.expected_log(mixture[None])[0] * known
                shares *= (times / shares.sum(axis=1))[:, None]
                mixture = 1 / 3 + shares.sum(axis=0)
            expected[[place[w] for w in uses]] += shares
            total += times.sum()
    found = T._topic_uses(fit.corpus, fit.model)
    assert found.sum() == pytest.approx(total, rel=1e-5) and found.sum(axis=1) == pytest.approx(expected.sum(axis=1), rel=1e-4)
    # Mixtures stop at a change of a thousandth.
    assert np.abs(found - expected).sum() < 0.01 * total


def test_tasks_get_even_shares_and_give_blocks_of_words(spark, monkeypatch):
    """A file of the corpus can be cut in many places; words of several blocks get their own sums."""
    monkeypatch.setattr(T, "_CORPUS_GROUP", 1 << 12, raising=False)
    lines = spark.createDataFrame(planted(8_000), "title int, line string").coalesce(2)
    fit = T.fit_topics(lines, topics=3, stop_words=[], iterations=1)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in fit.corpus.inputFiles()]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) == 8_001 and max(rows) < 1_000
    whole = T._topic_uses(fit.corpus, fit.model)
    monkeypatch.setattr(T, "_WORDS_A_BLOCK", 5, raising=False)
    assert np.allclose(T._topic_uses(fit.corpus, fit.model), whole, rtol=1e-9)


def test_factors_of_lines_are_their_expected_shares():
    weights = np.random.default_rng(2).gamma(0.5, 40.0, (500, 5)) + 0.2
    found, expected = V._line_factors(weights), V.expected_log(weights)
    assert np.allclose(found / found.sum(axis=1, keepdims=True), expected / expected.sum(axis=1, keepdims=True), rtol=1e-5)
    assert np.isfinite(V._line_factors(np.array([[1e300, np.inf, 0.2]]))).all()


def test_every_title_is_led_by_the_theme_of_its_lines(spark):
    lines = spark.createDataFrame(planted(), "title int, line string").repartition(4)
    themes = T.theme_table(spark, {f"kind{k}": [f"k{k}w{i}" for i in range(12)] for k in range(3)})
    found = {r.title: r.named_themes.split("; ") for r in shared_themes(lines, themes).collect()}
    assert found.keys() == {0, 1, 2, 7} and all(len(names) == 5 for names in found.values())
    assert [found[title][0] for title in range(3)] == ["kind0", "kind1", "kind2"]
