"""Words and n-grams are looked up in bulk, with the results of one at a time."""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from reelgauge.llm import ngram_lm
from reelgauge.llm.elias_fano import decode_at, encode_monotone
from reelgauge.llm.word_ngrams import numbered_words, words_of


def test_numbered_words_are_those_of_each_text():
    codes = "".join(f"a{chr(c)}B" for c in range(0x250)) + " x yİK\U0001f600Z"
    texts = ["", " ", codes, "\n lead", "trail\t", " \x0b\x0c both \r\n", "x", "X x", codes[::-1], "", "\x1cq\x1f\x85 q"]
    for own in (texts, texts[:2], ["", ""], ["one"]):
        numbers, words, sizes = numbered_words(pa.array(["cut off", *own], pa.string())[1:])
        assert [words[n] for n in numbers] == [w for t in own for w in words_of(t)]
        assert sizes.tolist() == [len(words_of(t)) for t in own]


def python_calls(run):
    seen = 0

    def count(frame, event, arg):
        nonlocal seen
        seen += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(None)
    return seen


def vocabulary(folder, words):
    hashes = np.sort(ngram_lm._hashes(words)).view(np.int64)
    rows = pd.DataFrame({"word": [*hashes, ngram_lm._END], "n": 3})
    written = ngram_lm._write_words(str(folder))((0,), rows)
    return ngram_lm.Model(tuple(written["path"]), (0, len(rows)), 3 * len(rows))


def test_counting_takes_no_python_step_a_text(tmp_path):
    def batch(n):
        return pa.record_batch([pa.array(["some few words Again "] * n)], names=["text"])

    list(ngram_lm._count_words(iter([batch(1)])))
    few, many = (python_calls(lambda b=batch(n): list(ngram_lm._count_words(iter([b])))) for n in (20, 2000))
    assert many <= few + 20
    model = vocabulary(tmp_path, [b"some", b"few", b"words"])
    count = ngram_lm._counting(model, 1, 4)
    list(count(iter([batch(1)])))
    few, many = (python_calls(lambda b=batch(n): list(count(iter([b])))) for n in (20, 2000))
    assert many <= few + 20


def test_slices_do_not_change_scores_or_counts(tmp_path, monkeypatch):
    texts = ["some few words", "", "words words none " * 9, "few"]
    model = vocabulary(tmp_path, [b"some", b"few", b"words"])
    whole = ngram_lm.score_texts(model, texts)
    assert whole["n_tokens"].tolist() == [4, 1, 28, 2] and whole["n_known"].tolist() == [4, 1, 19, 2]
    monkeypatch.setattr(ngram_lm, "SLICE_CHARS", 20)
    cut = ngram_lm.score_texts(model, pa.array(texts))
    for name, values in whole.items():
        assert (values == cut[name]).all()
    (counted,) = ngram_lm._count_words(iter([pa.record_batch([pa.array(texts)], names=["text"])]))
    found = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist()))
    own = ngram_lm._hashes([b"some", b"few", b"words", b"none"]).view(np.int64).tolist()
    assert found == dict(zip([*own, ngram_lm._END], [1, 2, 19, 9, 4]))


def test_pairs_are_found_in_contexts_of_any_size(tmp_path):
    draw = np.random.default_rng(6)
    contexts, span, size = 56, 16, 3000
    # Context 0 and those from 32 to 47, a range without file, have no words; 1 and 55 have most, the others some 30.
    own = {c: np.flatnonzero(draw.random(size) < (0.9 if c in (1, 55) else 0.01)) for c in range(1, contexts) if c // span != 2}
    paths, first, node, total, nodes = [], [0], {}, {}, 0
    for r in range(4):
        part = [(c, w) for c in range(r * span, min((r + 1) * span, contexts)) for w in own.get(c, ())]
        if not part:
            paths.append("")
            first.append(nodes)
            continue
        n = draw.integers(1, 9, len(part))
        for (c, w), k in zip(part, n):
            node[c, w] = (nodes, k)
            total[c] = total.get(c, 0) + k
            nodes += 1
        local = np.array([c for c, _ in part]) - r * span
        rows = pd.DataFrame(
            {
                "steps": [np.diff(local, prepend=0).astype("<u4").tobytes()],
                "words": [np.array([w for _, w in part]).astype("<u4").tobytes()], "n": [n.astype("<u4").tobytes()],
            }
        )
        written = ngram_lm._writing(str(tmp_path), 2, span, contexts)((r,), rows)
        paths.append(written["path"][0])
        first.append(nodes)
    level = ngram_lm.Level(tuple(paths), span, tuple(first))
    context, word = draw.integers(-1, contexts, 20_000), draw.integers(-1, size + 5, 20_000)
    context[:9000] = draw.choice([1, 55], 9000)
    found, p, mass = ngram_lm._find(level, context, word)
    expected = [node.get(pair, (-1, 0)) for pair in zip(context.tolist(), word.tolist())]
    assert found.tolist() == [at for at, _ in expected]
    assert ngram_lm._nodes(level, context, word).tolist() == found.tolist()
    for i in range(0, 20_000, 7):
        c, k = int(context[i]), expected[i][1]
        assert p[i] == pytest.approx((k - 0.75) / total[c] if k else 0, rel=0.033)
        assert mass[i] == pytest.approx(0.75 * len(own[c]) / total[c] if c in total else 1, rel=0.033)


@pytest.mark.parametrize("top", [0, 1, 9, 5_000, 2**40, 2**61])
def test_sequences_of_any_width_are_read_at_any_place(top):
    values = np.sort(np.random.default_rng(top % 97).integers(0, top, 1000, endpoint=True))
    at = np.random.default_rng(1).integers(0, 1000, 5000)
    assert (decode_at(encode_monotone(values), at) == values[at]).all()
