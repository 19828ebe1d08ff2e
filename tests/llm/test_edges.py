"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelgauge.llm import (
    fingerprints, jaccard_join, line_dedup, mixing, ngram_lm, packing, quality, sharding, token_counts, vectors,
)
from reelgauge.llm.shipping import ship

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "one two three four five six seven " * 3000
ROWS = [
    (1, "the same five words here\nand more", "a"), (1, "the same five words here\nand more", "a"),
    (2, None, None), (3, "", "b"), (4, LONG, "a"), (5, "the same five words here\nand more", "b"),
    (None, "a text without an id at all", None), (6, " \n\t\n ", "a"), (7, "x", None),
]
CLASHING = ["size", "n", "token", "rep", "line", "at", "_range", "score", "x", "lang", "n_chars", "shard", "copies", "n_lines", "rate"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


OPERATORS = {
    "pack": lambda d: packing.pack_pieces(packing.token_pieces(d, TOKENIZER).drop("ids")),
    "shard": lambda d: sharding.shard_documents(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "count": lambda d: token_counts.count_tokens(d, TOKENIZER),
    "lm": lambda d: ngram_lm.score_documents(d, ngram_lm.learn(ngram_lm.training_texts(d))),
    "statistics": lambda d: quality.document_statistics(d),
    "fingerprint": lambda d: fingerprints.fingerprint_documents(d),
    "classes": lambda d: jaccard_join.ngram_classes(d),
    "mix": lambda d: mixing.mix_sources(mixing.word_sizes(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_have_results(docs, name):
    found = OPERATORS[name](docs).toPandas()
    assert len(found) == (len(ROWS) + 5 if name == "pack" else len(ROWS))  # LONG is 21,001 tokens: 6 pieces
    if name == "lines":
        kept = {(r.doc_id, r.text) for r in found.itertuples() if r.n_removed}
        assert kept == {(5, "and more")} and (found["rate"] == "own rate").all()
    if name == "classes":
        own = {(r.doc_id, r.n_shingles, r.component_id) for r in found.dropna().itertuples()}
        assert own >= {(1, 3, 1), (5, 3, 1), (2, 0, 2), (3, 0, 3), (7, 1, 7)}
    if name == "fingerprint":
        same = found[found.n_chars == len(ROWS[0][1])]
        assert same.fingerprint.nunique() == 1 and found.near_next.between(0, 1).all()


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_result(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, docs, tmp_path, name, stage):
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (4, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    last = name == corpus_pipeline.STAGES[-1][0]
    for rows in (docs, docs.limit(0)):
        found = stage(spark, rows, str(tmp_path))
        assert last or found.columns == rows.columns
        kept = found.collect()
        assert bool(kept) == (rows is docs)
        if not last and kept:
            assert all(r["n_lines"] == "own n_lines" for r in kept)


def test_vectors_of_every_kind(spark):
    ship(spark)
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [0.9, 0.43588989]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rep": F.lit(1), "m": F.lit(2), "links": F.lit(3)})
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert found[1] == found[2] == found[3] and found[1][1] == 1 and found[1][0] >= 2
    assert all(found[i] == (0, i) for i in (4, 5, 6, 7, 8, 9))
    assert vectors.near_vectors(df.limit(0)).count() == 0
