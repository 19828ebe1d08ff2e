"""Vocabulary bounds, theme naming, theme growth, topic models."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgauge import constants as C
from reelgauge.operators import similarity as S
from reelgauge.operators import title_topics as O
from reelgauge.operators import topics as T
from reelgauge.plans.script_features import script_themes


def test_vocabulary_bounds(spark):
    rows = [(0, "The war! war_x a"), (1, "war peace"), (2, "war love"), (3, "love, LOVE é9")]
    df = spark.createDataFrame(rows, "id int, text string")
    found = {r.word: r.docs for r in T.vocabulary(df, "text", ["the"], 2, 0.75).collect()}
    assert found == {"war": 3, "love": 2}
    assert {r.word for r in T.vocabulary(df, "text", [], 2, 0.7).collect()} == {"love"}
    bag = T.bag_of_words(df, ["id"], "text", ["the"], 2, 0.75)
    assert {(r.id, r.word, r.uses) for r in bag.collect()} == {
        (0, "war", 1), (1, "war", 1), (2, "war", 1), (2, "love", 1), (3, "love", 2)}


def test_topic_names(spark):
    words = [(0, "war"), (0, "enemy"), (1, "love"), (2, "stone"), (3, "battle"), (3, "kiss")]
    df = spark.createDataFrame(words, "topic int, word string")
    named = T.name_topics(df, T.theme_table(spark), ["topic"]).collect()
    # "war" and "enemy" are in conflict and in war: the earlier theme wins, as for topic 3.
    assert {r.topic: r.theme for r in named} == {0: "conflict", 1: "love", 2: C.NO_THEME, 3: "love"}


def unit(rows):
    rows = np.array(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("length, seed_count, word_count, threshold", [
    (6, 30, 200, 0.6), (32, 300, 2_000, 0.6), (32, 300, 2_000, 0.25), (50, 12, 500, 0.5), (16, 40, 100, -0.2),
])
def test_similar_words_agree_with_brute_force(spark, length, seed_count, word_count, threshold):
    """Seeds near some words, repeated seeds, and a word without direction."""
    rng = np.random.default_rng(length)
    words = rng.normal(size=(word_count, length))
    seeds = words[rng.integers(0, word_count, seed_count)] + rng.normal(size=(seed_count, length)) * rng.uniform(0, 2.5, (seed_count, 1))
    themes = [f"t{i % 7}" for i in range(seed_count)]
    seed_df = spark.createDataFrame([(t, s.tolist()) for t, s in zip(themes, seeds)] * 2, "theme string, vector array<double>")
    word_rows = [(f"w{i}", w.tolist()) for i, w in enumerate(words)]
    odd = [("zero", [0.0] * length), ("short", [1.0]), ("none", None), ("hole", [1.0, None]), ("nan", [float("nan")] * length)]
    word_df = spark.createDataFrame(word_rows + odd, "word string, vector array<double>")
    row, seed = np.nonzero(unit(words) @ unit(seeds).T > threshold)
    expected = {(themes[s], f"w{w}") for s, w in zip(seed, row)}
    found = T.similar_words(seed_df, word_df, threshold).collect()
    pairs = {(r.theme, r.word) for r in found}
    assert len(found) == len(pairs) and pairs <= expected
    assert len(pairs) >= 0.99 * len(expected) > 0


def test_hash_plans_follow_recall_and_size():
    for threshold in (0.25, 0.6, 0.9):
        agree = 1 - np.arccos(threshold) / np.pi
        bits = 0
        for rows in (10**2, 10**4, 10**6, 10**8):
            plan = S.hash_plan(threshold, 0.99, rows, rows)
            assert 1 - (1 - agree**plan.bits) ** plan.tables >= 0.99
            assert plan.bits >= bits  # longer tables ask for rarer chance meetings
            bits = plan.bits
    with pytest.raises(ValueError):
        S.hash_plan(1.0, 0.99, 1, 1)


def test_unrelated_vectors_seldom_meet(spark):
    """Candidates are few against all pairs, with many repeats of one vector among them."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3_000, 40)))] + [(10_000 + i, [1.0] * 40) for i in range(1_000)]
    df = spark.createDataFrame(rows, "label long, vector array<double>")
    found = S.similar_pairs(df, df.where("label < 10001"), 0.95).collect()
    pairs = {(r.left_label, r.right_label) for r in found}
    assert pairs == {(i, i) for i in range(3_000)} | {(10_000 + i, 10_000) for i in range(1_000)}


def test_theme_growth(spark):
    vectors = [
        ("war", [1.0, 0.0], -9.0), ("combat", [0.9, 0.1], -10.0), ("Combat", [0.9, 0.1], -10.0),
        ("rare", [1.0, 0.0], -16.0), ("edge", [3.0, 4.0], -9.0), ("nil", [0.0, 0.0], -9.0),
        ("far", [0.0, 1.0], -9.0), ("42", [1.0, 0.0], -9.0),
    ]
    df = spark.createDataFrame(vectors, "word string, vector array<float>, log_prob double")
    themes = T.theme_table(spark, {"fight": ["war", "unseen"]})
    found = {(r.theme, r.theme_order, r.word) for r in T.expand_themes(themes, df).collect()}
    # A cosine of exactly 0.6 is not enough.
    assert found == {("fight", 0, "war"), ("fight", 0, "combat"), ("fight", 0, "unseen")}


def test_topic_model_tables(spark):
    rows = [("s", "storm wave sail harbor"), ("s", "wave sail storm"), ("k", "bread oven flour"),
            ("k", "oven flour bread sugar"), ("k", "sugar bread")] * 4
    lines = spark.createDataFrame(rows, "title string, line string")
    fit = T.fit_topics(lines, topics=2, iterations=5)
    words = fit.words(3).collect()
    assert len(words) == 6 and {r.rank for r in words} == {1, 2, 3}
    shares = fit.title_topics().groupBy("title").sum("share").collect()
    assert all(r["sum(share)"] == pytest.approx(1) for r in shares)


def test_no_vocabulary_means_no_topics(spark):
    lines = spark.createDataFrame([("a", "one two"), ("a", "three four")], "title string, line string")
    assert T.fit_topics(lines) is None


def test_digamma_and_variational_fit():
    x = np.array([0.01, 0.5, 1.0, 2.0, 10.0, 1e6])
    known = [-100.56088545786867, -1.9635100260214235, -0.5772156649015329, 0.42278433509846713, 2.251752589066721, 13.815510057964191]
    assert O.digamma(x) == pytest.approx(known, rel=1e-9)
    # Lines of two kinds of words: each topic keeps to one kind.
    line = np.repeat(np.arange(20), 3)
    word = np.array([(w + 3 * (d % 2)) for d in range(20) for w in range(3)])
    weights = O.fit_counts(line, word, np.full(60, 2), 6, 2, 10, 42)
    shares = weights / weights.sum(axis=1, keepdims=True)
    first = shares[:, :3].sum(axis=1)
    assert sorted(first) == pytest.approx([0, 1], abs=0.1)
    assert weights.sum() == pytest.approx(120 + 12 * 0.5)  # every use and the prior


TITLES = (
    [("sea", f"storm wave sail {w}") for w in ("harbor wave", "wave", "deck", "harbor")]
    + [("bake", f"bread oven {w}") for w in ("flour", "flour sugar", "sugar", "salt")]
    + [(None, "lost letter"), (None, "lost letter again"), (None, "no title"), ("mute", " "), ("mute", None), ("lone", "only one line")]
)


def test_every_title_has_topics_of_its_own(spark):
    lines = spark.createDataFrame(TITLES, "title string, line string").repartition(3)
    found = O.topics_by_title(lines, topics=2, count=3, stop_words=["again"]).collect()
    by_title = {}
    for row in found:
        by_title.setdefault(row.title, []).append(row)
    # "storm", "wave" and "sail" are in every line, so too common; "deck" is in one.
    assert {t: {r.word for r in rows} for t, rows in by_title.items()} == {
        "sea": {"harbor"}, "bake": {"flour", "sugar"}, None: {"letter", "lost"}}
    for rows in by_title.values():
        for topic in (0, 1):
            weights = [r.weight for r in sorted(rows, key=lambda r: r["rank"]) if r.topic == topic]
            assert sum(weights) == pytest.approx(1) and weights == sorted(weights, reverse=True)
    again = O.topics_by_title(lines.repartition(7), topics=2, count=3, stop_words=["again"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert O.topics_by_title(lines.limit(0)).count() == 0


def test_large_titles_take_the_distributed_fit(spark):
    lines = spark.createDataFrame(TITLES, "title string, line string")
    found = O.topics_by_title(lines, topics=2, count=3, stop_words=["again"], max_tokens=10).collect()
    words = {(r.title, r.word, r.vocabulary) for r in found}
    assert words == {("sea", "harbor", 1), ("bake", "flour", 2), ("bake", "sugar", 2), (None, "lost", 2), (None, "letter", 2)}


def test_whole_number_titles_keep_their_type(spark):
    lines = spark.createDataFrame([(1, "a red fox"), (1, "red fox runs"), (1, "other"), (None, "x")], "title long, line string")
    found = O.topics_by_title(lines, topics=2)
    assert found.schema["title"].dataType.simpleString() == "bigint"
    assert {(r.title, r.word) for r in found.collect()} == {(1, "red"), (1, "fox")}
    named = script_themes(lines, T.theme_table(spark, {"animals": ["fox"]})).collect()
    assert [(r.title, r.named_themes) for r in named] == [(1, "; ".join(["animals"] * 5))]


def test_a_vocabulary_too_large_loses_its_rarest_words(spark, monkeypatch):
    lines = spark.createDataFrame([("t", f"common half{i % 2} rare{i // 2}") for i in range(40)], "title string, line string")
    whole = T.fit_topics(lines, topics=2, stop_words=[], iterations=1, max_share=1.0)
    assert (len(whole.vectorizer.vocabulary), whole.min_docs) == (23, 2)
    monkeypatch.setattr(T, "MAX_VOCABULARY", 5)
    fit = T.fit_topics(lines, topics=2, stop_words=[], iterations=1, max_share=1.0)
    assert (set(fit.vectorizer.vocabulary), fit.min_docs) == ({"common", "half0", "half1"}, 4)


def plain_fit(line, word, uses, words, topics, iterations, seed):
    """One title's model alone, line by line."""
    prior, weights = 1 / topics, np.random.default_rng(seed).gamma(100.0, 0.01, (topics, words))
    log_share = lambda w: np.exp(O.digamma(w) - O.digamma(w.sum(axis=1, keepdims=True)))
    place = np.unique(line, return_inverse=True)[1]
    for _ in range(iterations):
        by_word, mixture = log_share(weights).T[word], np.ones((place.max() + 1, topics))
        for step in range(101):
            shares = log_share(mixture)[place] * by_word
            shares *= (uses / (shares.sum(axis=1) + 1e-100))[:, None]
            if step == 100 or (step and np.abs(mixture - before).mean() < 1e-3):
                break
            before, mixture = mixture, prior + np.stack([np.bincount(place, s) for s in shares.T], axis=1)
        weights = prior + np.stack([np.bincount(word, s, words) for s in shares.T])
    return weights


def test_titles_fitted_side_by_side_are_as_alone():
    rng = np.random.default_rng(3)
    parts, lines, words = [], 0, 0
    for title in range(40):
        size = rng.integers(1, 12)
        pairs = np.unique(rng.integers(0, [rng.integers(1, 9), size], (40, 2)), axis=0)
        known, word = np.unique(pairs[:, 1], return_inverse=True)
        parts.append((pairs[:, 0], word, rng.integers(1, 5, len(pairs)), len(known), lines, words))
        lines, words = lines + 9, words + len(known)
    joined = [np.concatenate(c) for c in zip(*((p[0] + p[4], p[1] + p[5], p[2], ) for p in parts))]
    title = np.repeat(np.arange(40), [p[3] for p in parts])
    found = O.fit_titles(*joined, title, 5, 10, 42)
    for i, (line, word, uses, size, _, start) in enumerate(parts):
        alone = plain_fit(line, word, uses, size, 5, 10, 42)
        assert found[title == i].T == pytest.approx(alone, rel=1e-6)
        assert O.fit_counts(line, word, uses, size, 5, 10, 42) == pytest.approx(alone, rel=1e-6)


def test_many_short_titles_take_little_time(spark):
    """Titles that go on over several batches of rows, with lone lines between them."""
    rows = [(f"t{i}", f"wave{i % 7} sail{j % 3} storm{(i + j) % 5} deck") for i in range(2_000) for j in range(6)]
    lines = spark.createDataFrame(rows + [(f"lone{i}", "one line") for i in range(20_000)], "title string, line string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        begun = time.time()
        found = O.topics_by_title(lines).groupBy("title").agg(F.count_distinct("topic").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 2_000 and {r.n for r in found} == {5}
    assert time.time() - begun < 25


def test_rare_and_common_words_meet_the_vocabulary(spark, monkeypatch):
    """Lines in several rows, lines without ids, and more words than are sent to every task."""
    rows = [(1, "a1 war war peace"), (1, "war love"), (None, "war peace"), (None, "peace"), (2, "love rare"), (3, None), (4, "war")]
    df = spark.createDataFrame(rows, "id int, text string")
    expected = {
        (1, "war", 3), (1, "peace", 1), (1, "love", 1), (None, "war", 1), (None, "peace", 2), (2, "love", 1), (4, "war", 1)}
    for most in (1, 2, 100):
        monkeypatch.setattr(T, "COMMON_WORDS", most)
        bag = T.bag_of_words(df, ["id"], "text", [], 2, 0.95)
        assert bag.columns == ["word", "id", "uses"]
        found = bag.collect()
        assert len(found) == len(expected) and {(r.id, r.word, r.uses) for r in found} == expected


def test_words_are_not_shuffled_with_their_lines(spark):
    df = spark.createDataFrame([(i, f"wave{i % 7} sail{i % 3} deck") for i in range(100)], "id int, text string")
    plan = T.bag_of_words(df, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" not in plan
