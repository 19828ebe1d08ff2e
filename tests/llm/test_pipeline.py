"""Stages decide by row, and leave nothing behind but their result."""

import os

import public_tokenizers  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline as P
from reelgauge.llm.shipping import ship
from reelgauge.session import shared_folder

GOOD = " ".join(f"word{i} and more of it" for i in range(30))
OTHER = " ".join(f"quite another text {i} here" for i in range(30))
JUNK = "$$ ## @@ buy now " * 40


def table(spark, rows):
    return spark.createDataFrame([(*row, "en", "s", 1) for row in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_repeated_or_missing_id_takes_no_other_text_along(spark, monkeypatch, tmp_path):
    """A rejected row goes by itself, a row without id too; no text without a near copy is lost."""
    ship(spark)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(P.quality, "score_statistics", lambda measured, model: measured.select(
        "doc_id", F.when(F.get("x", F.lit(0)) == F.lit(junk), 0.0).otherwise(1.0).alias("score")))
    docs = table(spark, [(1, JUNK), (2, JUNK), (2, GOOD), (3, GOOD), (3, OTHER), (None, JUNK), (None, GOOD)])
    measured = P.quality.document_statistics(docs.limit(1)).first()
    junk = measured["x"][0]
    kept = P.keep_good_documents(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("2", GOOD), ("3", GOOD), ("3", OTHER), ("None", GOOD)])


def test_one_row_of_each_group_stays(spark, tmp_path):
    docs = table(spark, [(5, GOOD), (2, GOOD), (2, OTHER), (3, GOOD + " end"), (3, None), (None, GOOD), (None, OTHER), (None, "short")]).coalesce(1)
    kept = P.keep_one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("5", GOOD), ("2", OTHER), ("3", "None"), ("None", "short")])


def test_lines_go_by_row_and_copies_too(spark, tmp_path):
    line = "one line of five words or more here"
    docs = table(spark, [(1, line), (1, "other words in this line here\n" + line), (None, line + "\nkept for it is new to all")]).coalesce(1)
    kept = P.drop_repeated_lines(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "one line of five words or more here"), ("1", "other words in this line here"), ("None", "kept for it is new to all")]
    rows = table(spark, [(None, "a b c")] * 40 + [(7, "d e f")] * 40)
    taken = P.mix_to_targets(spark, rows, str(tmp_path)).count()
    assert 110 <= taken <= 130  # 150 % of 80 rows


def test_a_run_leaves_only_its_result(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    found = P.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and found.count() > 0
    assert found.select("sequence_id").distinct().count() > 0
