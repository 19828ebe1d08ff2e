"""Words of texts, counted inside their rows by numpy over Arrow batches.

A word is what ``functions.text.tokens`` finds: a run of two or more letters, digits or
underscores of the lower-cased text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from reelgauge.shipping import ship_package

#: Bytes of text counted at once; a longer text is counted alone.
BYTES_AT_ONCE = 1 << 23
_KNOWN = S.ArrayType(S.StructType([S.StructField("word", S.StringType()), S.StructField("docs", S.LongType())]))
_COUNTS = S.ArrayType(S.StructType([S.StructField("word", S.StringType()), S.StructField("uses", S.LongType())]))


@cache
def _word_characters() -> np.ndarray:
    """For every code point, whether words hold it."""
    found = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    found[ord("_")] = True
    return found


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to a character of a word."""
    known = _word_characters()
    inside = np.where(np.arange(256) < 0x80, known[:256], False)[data]
    high = np.flatnonzero(data >= 0x80)
    lead = high[data[high] >= 0xC0]
    if len(lead):
        padded = np.r_[data, np.zeros(3, np.uint8)]
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for i in (1, 2, 3):
            point = np.where(size > i, point << 6 | (padded[lead + i] & 0x3F), point)
        held = known[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            at = lead[held & (size > i)] + i
            inside[at[at < len(data)]] = True
    return inside


def _word_uses(texts: pa.Array, skipped: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and by text and word, rising: the text, the place of the word, its uses."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = _inside(data)
    before, after = np.r_[False, inside[:-1]][: len(data)], np.r_[inside[1:], False][: len(data)]
    # No word goes on from one text into the next.
    cut = edges[(edges > 0) & (edges < len(data))]
    before[cut], after[cut - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    places = pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64))
    runs = pa.LargeStringArray.from_buffers(len(starts), places, pa.py_buffer(data[inside])).dictionary_encode()
    words = runs.dictionary.cast(pa.string())
    short = pc.less(pc.utf8_length(words), 2).to_numpy(zero_copy_only=False)
    kept = ~(short | pc.is_in(words, value_set=skipped).to_numpy(zero_copy_only=False))
    word = runs.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, edges)))
    counted = kept[word]
    pairs, uses = np.unique(row[counted] * max(len(words), 1) + word[counted], return_counts=True)
    return words, *np.divmod(pairs, max(len(words), 1)), uses


def count_words(texts: pa.Array, skipped: pa.Array) -> pa.ListArray:
    """(word, uses) of each of some lower-case texts, without the skipped words."""
    words, row, word, uses = _word_uses(texts, skipped)
    entries = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(uses, pa.int64())], ["word", "uses"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), entries)


def _at_once(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices with some ``BYTES_AT_ONCE`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // BYTES_AT_ONCE
        ends = np.r_[np.flatnonzero(np.diff(part)) + 1, len(part)] if len(part) else []
        first = 0
        for last in map(int, ends):
            yield batch.slice(first, last - first)
            first = last


def counted_words(lines: DataFrame, cols: Sequence[str], text_col: str, stop_words: Iterable[str] = ()) -> DataFrame:
    """``cols`` of each line with ``_counts``, an array of (word, uses); empty for NULL."""
    ship_package(lines.sparkSession)
    skipped, width = list(stop_words), len(cols)
    rows = lines.select(*[F.col(c) for c in cols], F.lower(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = pa.array(skipped, pa.string())
        for some in _at_once(batches, width):
            counts = count_words(some.column(width), left_out)
            yield pa.RecordBatch.from_arrays([*some.columns[:width], counts], [*some.schema.names[:width], "_counts"])

    return rows.mapInArrow(run, S.StructType([*rows.schema.fields[:width], S.StructField("_counts", _COUNTS)]))


def counted_blocks(lines: DataFrame, title_col: str, text_col: str, stop_words: Iterable[str] = ()) -> DataFrame:
    """Counts of words in blocks of lines, each with its own list of words.

    A row is a block: ``_titles`` of its lines, ``_lines`` their number, ``_known`` its words
    with the lines they are in. ``_words``, places in ``_known``, and ``_uses`` are 32-bit
    numbers in bytes, those of a line from one of ``_ends`` to the next. So words are
    written, and counted over all lines, once a block instead of once a line.
    """
    ship_package(lines.sparkSession)
    skipped = list(stop_words)
    rows = lines.select(title_col, F.lower(text_col).alias("_text"))
    schema = S.StructType([
        S.StructField("_titles", S.ArrayType(rows.schema[title_col].dataType)), S.StructField("_lines", S.LongType()),
        S.StructField("_known", _KNOWN), *[S.StructField(name, S.BinaryType()) for name in ("_ends", "_words", "_uses")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = pa.array(skipped, pa.string())
        for some in _at_once(batches, 1):
            words, row, word, uses = _word_uses(some.column(1), left_out)
            docs = np.bincount(word, minlength=len(words))
            used = np.flatnonzero(docs)
            place = np.cumsum(docs > 0) - 1
            known = pa.StructArray.from_arrays([words.take(pa.array(used)), pa.array(docs[used], pa.int64())], ["word", "docs"])
            ends = np.searchsorted(row, np.arange(some.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0)),
                pa.array([some.num_rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known),
                *[pa.array([numbers.astype(np.int32).tobytes()], pa.binary()) for numbers in (ends, place[word], uses)],
            ], schema.names)

    return rows.mapInArrow(run, schema)
