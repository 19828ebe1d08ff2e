"""Text steps against Python's own regular expressions."""

import itertools
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from reelgauge.functions import text as X
from reelgauge.operators.dialogue import extract_dialogue

DATA = "/root/testdata/sf0.01"
# Fixed value: what counts as a cue, its aside and its line.
SPEECH = re.compile(
    r"\b([A-Z][A-Z\s\-]+)(?:\s*\(.*?\))?\s+(.*?)(?=(?:\b[A-Z][A-Z\s\-]+\b\s|\Z))", re.S
)
HAND_MADE = [
    "RIPLEY (whispering) We must go. I know it. DALLAS Where to? KANE\n(o.s.) Here.",
    "A I am. BOB-RAY What's THE MATTER now? x",
    "JOHN Hello there.\n",
    "plain text none",
    "JOHN hi MARY ok",
    "JOHN (a (b) c) d) e (f MARY (open and never closed BOB (x",
    "AB (one)two) three CD ( four",
    "ÉRIC XY hi ÀAB CD no AB CD\x1c\x1dyes",
    "JOHN ﷐ kept ( MARY x",
    "A-B -- C - D  e\n\nF G\n(h)\ni",
    "X_AB CD ef 9AB CD ef ²AB CD ef",
    "",
]


def spoken_words(script):
    """Words of each name and line, with Python's own matching; spacing is tested by hand."""
    matched = ((found[1].split(), found[2].split()) for found in SPEECH.finditer(script))
    return [(name, line) for name, line in matched if line]


def walk_lines(raw):
    """Squeeze runs of white space, then upper-case every plain line but the last."""
    one_break = "".join("\n" if char == "\n" else "".join(run) for char, run in itertools.groupby(raw))
    squeezed = "".join(
        text if not blank or len(text) == 1 else " "
        for blank, run in itertools.groupby(one_break, str.isspace) for text in ["".join(run)]
    )
    *lines, last = squeezed.split("\n")
    plain = [all(c.isspace() or (c.isascii() and c.isalnum()) for c in line) for line in lines]
    return "\n".join([line.upper() if is_plain else line for line, is_plain in zip(lines, plain)] + [last])


@pytest.fixture(scope="module")
def scripts():
    """Documents turned into scripts by upper-casing words after full stops."""
    rows = duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    loud = re.compile(r"[.,] (\w+ )")
    made = [
        loud.sub(lambda m: "(" if m.start() % 7 == 0 else ")\n" + m.group(1).upper(), text)
        for (text,) in rows
    ]
    return HAND_MADE + [text for (text,) in rows] + made


def dialogue_of(spark, scripts):
    df = spark.createDataFrame(list(enumerate(scripts)), "title int, text string").repartition(4)
    found = {}
    for row in extract_dialogue(df).collect():
        found.setdefault(row.title, []).append((row.seq, row.character, row.line, row.line_count))
    for rows in found.values():
        rows.sort()
        assert [row[0] for row in rows] == list(range(len(rows)))
        assert all(row[3] == len(rows) for row in rows)
    return [[row[1:3] for row in found.get(title, [])] for title in range(len(scripts))]


def test_dialogue_matches_python(spark, scripts):
    total = 0
    for script, pairs in zip(scripts, dialogue_of(spark, scripts), strict=True):
        assert [(name.split(), line.split()) for name, line in pairs] == spoken_words(script), script[:200]
        assert all("\n" not in line and line == line.strip() and name == name.strip() for name, line in pairs)
        total += len(pairs)
    assert total > 2_000


def test_dialogue_of_hand_made_scripts(spark):
    expected = {
        "RIPLEY (softly)\n  We must\ngo. DALLAS\nWhere  to?\n": [("RIPLEY", "We must go."), ("DALLAS", "Where  to?")],
        "before JOHN\tSMITH - \n x": [("JOHN\tSMITH -", "x")],
        "JOHN (to MARY ANN) hi (or KATE LEE says) there": [("JOHN", "hi (or"), ("KATE LEE", "says) there")],
        "JOHN (never closed KATE LEE says": [("JOHN", "(never closed"), ("KATE LEE", "says")],
        "I (aside) first cue. I (no aside) later": [("I", "first cue. I (no aside) later")],
        "JOHN - and A- x": [("JOHN -", "and A- x")],
        "JOHN \n\nMARY said": [("JOHN \n\nMARY".strip(), "said")],
        "xJOHN y": [],
        "JOHN": [],
        "A-" * 50: [],
    }
    assert dialogue_of(spark, list(expected)) == list(expected.values())


def test_dialogue_of_random_scripts_matches_python(spark):
    rng = random.Random(4)
    parts = [
        "A", "B", "AB", "C ", "-", " ", "\n", "(", ")", ") ", "x", "y z", "é", "É", "_", "9", "\ufdd0", "\ufdd1",
        "\ufdd2", "\ufdd3", "\ufdd4", "\x1c", "\xa0", ".", "JOHN ", "MARY\n", "(aside)", "( AB CD )",
    ]
    made = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(4_000)]
    for script, pairs in zip(made, dialogue_of(spark, made), strict=True):
        assert [(name.split(), line.split()) for name, line in pairs] == spoken_words(script), script


@pytest.mark.parametrize("part, count", [
    ("A-", 100_000), ("A- ", 70_000), ("AB ( ", 40_000), ("AB (x) ", 30_000), ("AB CD (", 30_000),
    ("The cat Sat. ", 16_000), ("A (", 70_000), ("AB CD ", 33_000), ("\ufdd1(", 100_000),
])
def test_dialogue_takes_linear_time(spark, part, count):
    """Each of some 200,000 characters; a pattern that reads runs again takes minutes."""
    df = spark.createDataFrame([("t", part * count)], "title string, text string")
    start = time.time()
    extract_dialogue(df).count()
    assert time.time() - start < 15


def test_cleaning_matches_a_line_walker(spark, scripts):
    df = spark.createDataFrame(list(enumerate(scripts)), "id int, text string")
    rows = df.select("id", X.clean_script(F.col("text")).alias("text")).collect()
    for row in rows:
        assert row.text == walk_lines(scripts[row.id])


def test_cleaning_upper_cases_cue_lines_and_can_cut(spark):
    raw = 'john\nhello there, x\nmary\nbob\n"q"\n'
    row = spark.createDataFrame([(raw,)], "t string").select(
        X.upper_cue_lines(F.col("t")).alias("whole"), X.clean_script(F.col("t"), 4).alias("cut")
    ).first()
    assert row.whole == 'JOHN\nhello there, x\nMARY\nBOB\n"q"\n'
    assert row.cut == "JOHN"


def test_words_and_diversity_match_python(spark, scripts):
    texts = [*scripts, " a b\x1cB ", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select(
        "id", X.words(F.col("text")).alias("words"),
        X.lexical_diversity(F.col("text")).alias("share"),
        X.truncate_words(F.col("text"), 3).alias("cut"),
    ).collect()
    for row in rows:
        words = texts[row.id].split()
        lower = texts[row.id].lower().split()
        assert row.words == words
        assert row.cut == " ".join(words[:3])
        assert row.share == pytest.approx(len(set(lower)) / len(lower) if lower else 0, abs=6e-5)


def test_unclosed_brackets_stay_fast_and_exact(spark):
    hostile = "AB ( " * 40_000 + "long enough" + "word-" * 20_000
    df = spark.createDataFrame([("t", hostile)], "title string, text string")
    start = time.time()
    rows = extract_dialogue(df).collect()
    assert time.time() - start < 30
    assert len(rows) == 40_000
    assert rows[0].line == "("


def test_long_runs_do_not_exhaust_the_stack(spark):
    texts = ["word " * 60_000 + "\n", "AB CD " * 60_000 + "end", " \n" * 90_000]
    df = spark.createDataFrame(list(enumerate(texts)), "title int, text string")
    cleaned = df.select("title", X.clean_script(F.col("text")).alias("text"))
    assert extract_dialogue(cleaned).count() >= 1
