"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line of at least ``min_words`` words goes if an equal line, or one within ``max_edits``
edits (insertion, deletion or substitution of a character), comes earlier by
(doc_id, line). Shorter lines stay.

Distinct lines emit variants as hashed keys that hold the place of what was left out:
for each position a line without that character, and for each position the line as it
is, to meet lines with one character more there. Lines of one key are within one edit of
each other, so each is joined with the earliest of its key alone, and the edit distance
is then verified. Variants are narrowed down in three rounds, each exact: lines that
agree in all but one half, of these those that agree in all but one block, and of these
the single characters of that block. A key that only one line has ends there.

For m > 1 edits a variant is a line of ``n`` to ``n + m`` columns with m slots, each of
which holds a character or none; lines of one key are within m edits of each other, and
any two that are have a key in common. Lines that share one of ``max_edits + 1`` segments
begin; the intervals that hold the slots are then cut into quarters until they are single
columns, and after each cut only groups go on that have a line after another one for which
no nearer earlier line is known. Two edits come before three, and so on.

Defined results: a null text stays null and has no lines; rows that repeat a doc_id are
the same document, so equal places in them are the same line and none makes the other
go; the lines of rows without doc_id stay; an empty table gives an empty result. Columns
of the documents other than doc_id and text are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.tables import bounded, settled_with_count
from reelgauge.session import settle

MIN_WORDS = 5
#: The bound of the SQL that checks op3.
MAX_EDITS = 1
BLOCK_CHARS = 64


def _lines_of(text: Column) -> Column:
    return F.split(text.cast("string"), "\n")


def _enough_words(line: Column, words: int) -> Column:
    return line.rlike(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (words - 1))


def _block_size(base: Column, blocks: int | None) -> Column:
    """Characters of a block: two blocks in all, or small ones (at most 64 in all)."""
    if blocks:
        return (F.floor(base / blocks) + 1).cast("int")
    return F.greatest(F.lit(BLOCK_CHARS), F.ceil((base + 1) / 64)).cast("int")


def _outside(line: Column, j: Column, size: Column, longer: Column) -> Column:
    """What surrounds block ``j``; a longer line's block has one character more."""
    before = F.xxhash64(F.substring(line, F.lit(1), j * size))
    return F.xxhash64(F.lit(5), before, F.substring(line, (j + 1) * size + 1 + longer, F.lit(2**31 - 1)))


def _block_keys(line: Column, n: Column, blocks: int | None) -> Column:
    """(base, longer, j, key): the line as one of ``n`` and as one longer than ``n - 1``."""

    def of(base: Column, longer: int) -> Column:
        size = _block_size(base, blocks)
        return F.transform(
            F.sequence(F.lit(0), F.floor(base / size).cast("int")),
            lambda j: F.struct(
                base.alias("base"), F.lit(longer).alias("longer"), j.alias("j"),
                F.xxhash64(base, j, _outside(line, j, size, F.lit(longer))).alias("key"),
            ),
        )

    return F.concat(of(n, 0), of(n - 1, 1))


def _shared(keys: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """The values of ``by`` that several distinct lines (``h1``) have, and their number."""
    return settled_with_count(
        keys.groupBy(*by).agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).filter("_a <> _b").select(*by)
    )


def _character_keys(line: Column, base: Column, longer: Column, j: Column) -> Column:
    """Variants over the characters of block ``j``, keyed by place and by what is left."""
    size = _block_size(base, None)
    outside = _outside(line, j, size, longer)
    block = F.substring(line, j * size + 1, size + longer)
    n = F.char_length(block)

    def key(kind: int, i: Column, rest: Column) -> Column:
        return F.xxhash64(F.lit(kind), base, j, i, outside, F.xxhash64(rest))

    def without(i: Column) -> Column:
        return F.concat(F.substring(block, F.lit(1), i), F.substring(block, i + 2, n))

    def places(last: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i <= last)

    substituted = F.transform(places(n - 1), lambda i: key(0, i, without(i)))
    shorter = F.transform(places(F.least(n, size - 1)), lambda i: key(1, i, block))
    deleted = F.transform(places(F.least(n, size) - 1), lambda i: key(1, i, without(i)))
    return F.when(longer == 1, deleted).otherwise(F.concat(substituted, shorter))


def _texts_of(keys: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, at, line of the distinct lines that share a key of ``keys`` (h1, key)."""
    shared, count = _shared(keys, "key")
    live = settle(keys.join(bounded(shared, count), "key", "left_semi").select("h1").distinct())
    placed, count = settled_with_count(
        first.select("h1", "h2", "doc_id", "at").join(bounded(live, live.count()), "h1", "left_semi")
    )
    wanted = bounded(placed.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2", "at")).alias("_want")), count)
    return settle(
        docs.select("doc_id", "text").join(wanted, "doc_id")
        .select("doc_id", _lines_of(F.col("text")).alias("_lines"), "_want")
        .select("doc_id", F.explode(F.transform("_want", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["at"].alias("at"), F.get("_lines", w["at"]).alias("line")))).alias("x"))
        .select("doc_id", "x.*")
        .filter(F.xxhash64("line") == F.col("h1"))
    )


def _near_earlier(first: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines (with their first place) that have a line within one edit earlier."""
    lines = _texts_of(first.select("h1", F.explode("halves").alias("key")), first, docs)
    blocks = settle(
        lines.select("h1", F.explode(_block_keys(F.col("line"), F.char_length("line"), None)).alias("x")).select("h1", "x.*")
    )
    shared, count = _shared(blocks, "key")
    some = settle(blocks.join(bounded(shared, count), "key", "left_semi").select("h1", "base", "longer", "j"))
    variants = settle(
        lines.select("h1", "doc_id", "at", "line").join(some, "h1")
        .select("h1", "doc_id", "at", F.explode(_character_keys(F.col("line"), F.col("base"), F.col("longer"), F.col("j"))).alias("key"))
    )
    earliest = variants.groupBy("key").agg(F.min(F.struct("doc_id", "at", "h1")).alias("first"), F.max(F.struct("doc_id", "at", "h1")).alias("last"))
    earliest = earliest.filter("first.h1 <> last.h1").select("key", "first")
    pairs = (
        variants.join(earliest, "key").filter(F.col("first.h1") != F.col("h1"))
        .select("h1", F.col("first.h1").alias("_earlier")).distinct()
    )
    texts = lines.select("h1", "h2", "line")
    return (
        pairs.join(texts, "h1")
        .join(texts.select(F.col("h1").alias("_earlier"), F.col("line").alias("_line")), "_earlier")
        .filter(F.levenshtein("line", "_line", 1) >= 0)
        .select("h1", "h2").distinct()
    )


def _segment_keys(line: Column, n: Column, edits: int) -> Column:
    """Keys of which lines within ``edits`` share one: a segment without any slot."""
    keys = []
    for empty in range(edits + 1):
        base = n + empty
        for j in range(edits + 1):
            start, end = (F.floor(base * i / (edits + 1)).cast("int") for i in (j, j + 1))
            for before in (0,) if j == 0 else (empty,) if j == edits else range(empty + 1):
                keys.append(F.xxhash64(base, F.lit(j), F.substring(line, start - before + 1, end - start)))
    return F.array(*keys)


def _interval(start: Column, width: Column, slots: Column, empty: Column) -> Column:
    return F.struct(*(x.cast("int").alias(k) for k, x in zip("swte", (start, width, slots, empty), strict=True)))


def _halved(x: Column) -> Column:
    """The ways to deal an interval's slots, and the empty ones among them, to its halves."""
    left = F.floor((x["w"] + 1) / 2).cast("int")
    right = x["w"] - left

    def of(t: Column, e: Column) -> Column:
        both = F.array(_interval(x["s"], left, t, e), _interval(x["s"] + left, right, x["t"] - t, x["e"] - e))
        return F.filter(both, lambda y: y["t"] > 0)

    return F.flatten(
        F.transform(
            F.sequence(F.greatest(F.lit(0), x["t"] - right), F.least(x["t"], left)),
            lambda t: F.transform(F.sequence(F.greatest(F.lit(0), x["e"] - x["t"] + t), F.least(t, x["e"])), lambda e: of(t, e)),
        )
    )


def _cut(intervals: Column) -> Column:
    """All states that halving every interval makes of a state."""
    return F.aggregate(
        intervals, F.expr("array(cast(array() as array<struct<s:int,w:int,t:int,e:int>>))"),
        lambda made, x: F.flatten(F.transform(made, lambda done: F.transform(_halved(x), lambda halves: F.concat(done, halves)))),
    )


def _state_key(line: Column, base: Column, intervals: Column) -> Column:
    """Hash of where the slots may lie and of the line outside; which are empty is left out."""
    begin = F.struct(base.cast("long").alias("h"), F.lit(0).alias("at"), F.lit(0).alias("gone"))
    return F.aggregate(
        intervals, begin,
        lambda a, x: F.struct(
            F.xxhash64(a["h"], x["s"], x["w"], x["t"], F.substring(line, a["at"] + 1, x["s"] - a["gone"] - a["at"])).alias("h"),
            (x["s"] + x["w"] - a["gone"] - x["e"]).alias("at"), (a["gone"] + x["e"]).alias("gone"),
        ),
        lambda a: F.xxhash64(a["h"], F.substring(line, a["at"] + 1, F.lit(2**31 - 1))),
    )


def _near_by(edits: int, lines: DataFrame, longest: int, near: DataFrame) -> DataFrame:
    """h1, h2 of lines not in ``near`` that have a line exactly ``edits`` edits away earlier."""
    place = F.struct("doc_id", "at")
    own = lines.join(near.select("h1", F.lit(False).alias("open")), "h1", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    own = settle(own.select("h1", "doc_id", "at", "open", "line"))
    n = F.char_length("line")
    base = F.explode(F.filter(F.sequence(n, n + edits), lambda b: b >= edits)).alias("base")
    states = own.select("h1", "doc_id", "at", "open", "line", base)
    whole = F.array(_interval(F.lit(0), F.col("base"), F.lit(edits), F.col("base") - F.char_length("line")))
    states, width = states.withColumn("iv", whole), longest + edits
    while True:
        for _ in range(2):
            states, width = states.withColumn("iv", F.explode(_cut(F.col("iv")))), -(-width // 2)
        keyed = settle(
            states.withColumn("key", _state_key(F.col("line"), F.col("base"), F.col("iv")))
            .select("h1", "doc_id", "at", "open", "base", "iv", "key")
        )
        groups, count = settled_with_count(
            keyed.groupBy("key")
            .agg(F.min(F.struct("doc_id", "at", "h1")).alias("_first"), F.max(F.when(F.col("open"), place)).alias("_last"))
            .filter(F.col("_last") > F.struct("_first.doc_id", "_first.at"))
        )
        shared = keyed.join(bounded(groups, count), "key")
        if width <= 1 or not count:
            break
        states = shared.filter(place <= F.col("_last")).select("h1", "base", "iv").join(own, "h1")
    texts = lines.select("h1", "h2", "line")
    pairs = shared.filter(F.col("open") & (place > F.struct("_first.doc_id", "_first.at"))).select("h1", F.col("_first.h1").alias("_earlier")).distinct()
    return (
        pairs.join(texts, "h1")
        .join(texts.select(F.col("h1").alias("_earlier"), F.col("line").alias("_line")), "_earlier")
        .filter(F.levenshtein("line", "_line", edits) >= 0)
        .select("h1", "h2").distinct()
    )


def _near_earlier_within(edits: int, first: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """h1, h2 of the distinct lines (with their first place) that have a line within ``edits`` earlier."""
    near = settle(_near_earlier(first, docs))
    line = F.col("line")
    keys = (
        docs.select(F.explode(_lines_of(F.col("text"))).alias("line")).filter(_enough_words(line, min_words))
        .select(F.xxhash64(line).alias("h1"), F.explode(_segment_keys(line, F.char_length(line), edits)).alias("key"))
    )
    lines = _texts_of(keys, first, docs)
    longest = lines.agg(F.max(F.char_length("line"))).first()[0] or 0
    for m in range(2, edits + 1):
        near = settle(near.unionByName(_near_by(m, lines, longest, near)))
    return near


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> DataFrame:
    """doc_id, gone: the places (from 0) of the lines that go, of documents that lose any."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    line = F.col("line")
    n = F.char_length(line)
    seen = settle(
        narrow.select("doc_id", F.posexplode(_lines_of(F.col("text"))).alias("at", "line"))
        .filter(_enough_words(line, min_words))
        .select(
            "doc_id", "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"),
            F.transform(_block_keys(line, n, 2), lambda x: x["key"]).alias("halves"),
        )
    )
    first = settle(
        seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("_at"), F.max(F.struct("doc_id", "at")).alias("_last"), F.first("halves").alias("halves"))
        .select("h1", "h2", "_at.doc_id", "_at.at", (F.col("_at") != F.col("_last")).alias("again"), "halves")
    )
    near = _near_earlier(first, narrow) if max_edits == 1 else _near_earlier_within(max_edits, first, narrow, min_words)
    near = near.withColumn("near", F.lit(True))
    affected, count = settled_with_count(
        first.drop("halves").join(near, ["h1", "h2"], "left").filter("again or near")
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("doc_id").alias("_doc"), F.col("at").alias("_first"), F.coalesce("near", F.lit(False)).alias("near"))
    )
    return (
        seen.drop("halves")
        .join(bounded(affected, count), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
        .filter(F.col("near") | (F.col("doc_id") != F.col("_doc")) | (F.col("at") != F.col("_first")))
        .groupBy("doc_id").agg(F.collect_set("at").alias("gone"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` with the text of the lines that stay, and ``n_lines`` and ``n_removed``.

    Columns of these two names are replaced. ``max_edits`` is at least 1.
    """
    gone, count = settled_with_count(
        repeated_lines(docs, min_words, max_edits).select(F.col("doc_id").alias("_doc"), F.col("gone").alias("_gone"))
    )
    lines = _lines_of(F.col("text"))
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return (
        docs.join(bounded(gone, count), F.col("doc_id") == F.col("_doc"), "left")
        .withColumns(
            {
                "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
                "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
                "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept),
            }
        )
        .drop("_doc", "_gone")
    )
