"""Bounds that only larger inputs reach, built from counts and small tables."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from reelgauge.llm import line_dedup, ngram_lm
from reelgauge.llm.shipping import ship


def level_of(folder, context, word, n, contexts):
    rows = pd.DataFrame(
        {
            "steps": [np.diff(np.array(context), prepend=0).astype("<u4").tobytes()],
            "words": [np.array(word).astype("<u4").tobytes()], "n": [np.array(n).astype("<u4").tobytes()],
        }
    )
    written = ngram_lm._writing(str(folder), 2, contexts, contexts)((0,), rows)
    return ngram_lm.Level(tuple(written["path"]), contexts, (0, int(written["nodes"][0])))


def test_rare_words_after_a_frequent_context_keep_their_probability(tmp_path):
    words = np.arange(1001)
    n = np.r_[150_000_000, np.ones(1000, int)]
    level = level_of(tmp_path, [0] * 1001 + [2], [*words, 7], [*n, 1], 3)
    _, p, mass = ngram_lm._find(level, np.zeros(1001, int), words)
    step = 10 ** (3.5 / 255)  # half a step of 7 / 255 either way
    true = (n - 0.75) / n.sum()
    assert (np.maximum(p / true, true / p) <= step * (1 + 1e-9)).all()
    assert mass[0] == pytest.approx(0.75 * 1001 / n.sum(), rel=step - 1)
    assert abs(p.sum() + mass[0] - 1) < step - 1
    _, p, mass = ngram_lm._find(level, np.array([1, 2, 2]), np.array([7, 7, 8]))
    assert mass[0] == 1 and p[0] == 0 and p[1] == pytest.approx(0.25, rel=step - 1) and p[2] == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [2, 3])
def test_lines_within_several_edits_of_an_earlier_one_go(spark, edits):
    draw = random.Random(edits)
    bases = ["ab c d e ff", "the line that a b", "a b a b a b a b a b é", "one two three four five six seven eight nine ten " * 3]
    lines = []
    for _ in range(90):
        line = list(draw.choice(bases))
        for _ in range(draw.randint(0, 5)):
            at = draw.randrange(len(line))
            line[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "b", "x", "é"])
        lines.append("".join(line))
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(30)]
    seen, expected = [], {}
    for doc, text in docs:
        kept = []
        for line in text.split("\n"):
            able = len(line.split()) >= 5
            if not able or all(distance(line, o) > edits for o in seen):
                kept.append(line)
            seen += [line] * able
        expected[doc] = "\n".join(kept)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, max_edits=edits).collect()} == expected


def test_the_pipeline_drops_lines_two_edits_away(spark):
    ship(spark)
    rows = [(1, "all that we saw on the way home\nfirst"), (2, "all that we see on the way home\nsecond"), (3, "all that we said on our way home\nthird")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "second", 3: rows[2][1]}
