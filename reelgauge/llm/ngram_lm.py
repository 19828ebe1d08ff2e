"""N-gram language model in an Elias-Fano trie, learnt from and scoring whole texts.

Level 1 is the vocabulary, sorted by hash; a word's id is its place. A node of level k
is an n-gram of k words; its id is its place among all of the level, sorted by context
node and last word. A level is a set of files, each for a range of context nodes: an
Elias-Fano sequence of where each context's successors begin, the successors' word ids,
and one byte each for the quantised log probability of a successor and the quantised
backoff mass of a context; two bytes in a file where some lie below 10^-7. Workers map the files into memory, so they share one copy a
machine in the page cache. A word is found by binary search among its context's
successors only.

Levels are counted one after the other over all training tokens: each task counts the
(context node, word) pairs of its documents, and the sums of each range of contexts meet
in one task, which writes the range's file. The number of ranges grows with the tokens,
so their size does not. Files lie in the folder that ``spark.checkpoint.dir`` names.

Probabilities are absolute discounting, interpolated down to the additive base:
P(w | c) = max(n(cw) - D, 0) / n(c) + D * kinds(c) / n(c) * P(w | shorter c).

Defined results: a null text is empty, its only token the end; a document without id
counts as training; repeated rows are documents of their own; without any training text
every word is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.chunks import SLICE_CHARS
from reelgauge.llm.elias_fano import decode_all, encode_monotone, gather, open_arrays, save_arrays
from reelgauge.llm.tables import whole_text
from reelgauge.llm.word_ngrams import numbered_words
from reelgauge.session import settle, shared_folder

ORDER = 3
DISCOUNT = 0.75
ADD = 0.1
#: Tokens for which one range of contexts (one file of a level) is planned.
RANGE_TOKENS = 4_000_000
VOCABULARY_RANGE = 1_000_000
#: Tokens that a task counts at a time.
BLOCK_TOKENS = 4_000_000
#: Words wanted of one context from which they are searched on their own.
MANY_WORDS = 32
_END = int(np.uint64(xxhash.xxh3_64_intdigest(b" end ")).view(np.int64))
#: Steps of a log probability to one decade; the same at every size of input.
_STEPS = 255 / 7
#: Covers 28 decades; the least share of a count in 64 bits lies less than 20 below 1.
_VALUES = 10.0 ** (-np.arange(1024) / _STEPS)


def quantised(p: np.ndarray) -> np.ndarray:
    """Steps below 1: one byte each if all of ``p`` fit, else two."""
    steps = np.maximum(np.rint(-np.log10(p) * _STEPS), 0)
    return steps.astype(np.uint8 if steps.max(initial=0) < 256 else np.uint16)


@dataclass(frozen=True)
class Level:
    """Files of a level by range of ``span`` context nodes, and the first node of each."""

    paths: tuple[str, ...]
    span: int
    first: tuple[int, ...]

    @property
    def nodes(self) -> int:
        return self.first[-1]


@dataclass(frozen=True)
class Model:
    """The vocabulary's files (by high bits of the hash), its sums, and the levels above."""

    words: tuple[str, ...]
    word_first: tuple[int, ...]
    train_tokens: int
    levels: tuple[Level, ...] = field(default=())

    @property
    def base_denominator(self) -> float:
        return self.train_tokens + ADD * (self.word_first[-1] + 1)


def _vocabulary_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(48)).astype(np.int64) * ranges) >> 16


class Words:
    """Id (-1 if unknown) and training count of each word of a vocabulary."""

    def __init__(self, model: Model):
        self.model = model
        (self.end,), (self.end_count,) = self.find(np.array([_END], np.int64).view(np.uint64))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        # In the order of the files, so reads stay near each other.
        order = np.argsort(hashes)
        hashes = hashes[order]
        ranges = len(self.model.words)
        edges = np.searchsorted(_vocabulary_range(hashes, ranges), np.arange(ranges + 1))
        for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            held = open_arrays(self.model.words[r]) if self.model.words[r] else None
            if held is None or not len(held["hash"]):
                continue
            own = slice(edges[r], edges[r + 1])
            at = np.minimum(np.searchsorted(held["hash"], hashes[own]), len(held["hash"]) - 1)
            hit = held["hash"][at] == hashes[own]
            ids[order[own][hit]] = at[hit] + self.model.word_first[r]
            counts[order[own][hit]] = held["count"][at[hit]]
        return ids, counts

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the words and ends of ``texts``, and where each text ends."""
        numbers, words, sizes = numbered_words(texts)
        own_ids, own_counts = self.find(_hashes(words))
        ends = np.cumsum(sizes + 1)
        is_word = np.ones(ends[-1], bool)
        is_word[ends - 1] = False
        ids, counts = np.full(ends[-1], self.end), np.full(ends[-1], self.end_count)
        ids[is_word], counts[is_word] = own_ids[numbers], own_counts[numbers]
        return ids, counts, ends


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that end where SLICE_CHARS more bytes are reached."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = int(upto[start - 1]) if start else 0
        end = min(int(np.searchsorted(upto, before + SLICE_CHARS)) + 1, len(texts))
        yield start, end
        start = end


@lru_cache(maxsize=1)
def _held_words(paths: tuple[str, ...], first: tuple[int, ...]) -> Words:
    return Words(Model(paths, first, 0))


def _words(model: Model) -> Words:
    """The words of a vocabulary, shared by the models over it; one vocabulary is held."""
    return _held_words(model.words, model.word_first)


def _find(level: Level, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node (-1 if none), discounted probability and the context's backoff mass."""
    node = np.full(len(context), -1)
    p, mass = np.zeros(len(context)), np.ones(len(context))
    valid = np.flatnonzero(context >= 0)
    found, own_p, own_mass, back = _find_pairs(level, context[valid], word[valid], True)
    node[valid], p[valid], mass[valid] = found[back], own_p[back], own_mass[back]
    return node, p, mass


def _nodes(level: Level, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Only the node (-1 if none)."""
    node = np.full(len(context), -1)
    valid = np.flatnonzero((context >= 0) & (word >= 0))
    found, _, _, back = _find_pairs(level, context[valid], word[valid], False)
    node[valid] = found[back]
    return node


def _find_pairs(level: Level, context: np.ndarray, word: np.ndarray, shares: bool) -> tuple[np.ndarray, ...]:
    """Node, probability and mass (if ``shares``) of each distinct pair, and each row's pair."""
    # Each pair is looked up once, in the order of the level, so reads stay near each other.
    keys, back = np.unique((context << 32) | (word & 0xFFFFFFFF), return_inverse=True)
    found, p, mass = np.full(len(keys), -1), np.zeros(len(keys)), np.ones(len(keys))
    stored = np.array([path != "" for path in level.paths], bool)
    rows = slice(None) if stored.all() else np.flatnonzero(stored[(keys >> 32) // level.span])
    contexts, wanted = keys[rows] >> 32, keys[rows].astype(np.uint32)
    if not len(wanted):
        return found, p, mass, back
    starts = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]])
    repeats = np.diff(np.r_[starts, len(wanted)])
    contexts = contexts[starts]
    where = contexts // level.span
    edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
    ranges = where[edges[:-1]]
    files = [open_arrays(level.paths[r]) for r in ranges.tolist()]
    local = contexts - where * level.span
    begin, end = decode_all(files, local, edges), decode_all(files, local + 1, edges)
    pair_edges = np.r_[starts, len(wanted)][edges]
    at = _successor([f["words"] for f in files], begin, end, wanted, repeats, edges, pair_edges)
    hit = np.flatnonzero(at >= 0)
    own = np.full(len(wanted), -1)
    own[hit] = at[hit] + np.repeat(np.array(level.first)[ranges], np.diff(pair_edges))[hit]
    found[rows] = own
    if shares:
        share = np.zeros(len(wanted))
        share[hit] = _VALUES[gather([f["p"] for f in files], at[hit], np.searchsorted(hit, pair_edges))]
        p[rows] = share
        left = np.where(end > begin, _VALUES[gather([f["mass"] for f in files], local, edges)], 1.0)
        mass[rows] = np.repeat(left, repeats)
    return found, p, mass, back


def _successor(words: list[np.ndarray], low: np.ndarray, high: np.ndarray, wanted: np.ndarray, repeats: np.ndarray, edges: np.ndarray, pair_edges: np.ndarray) -> np.ndarray:
    """Where each word is among its context's successors ``low`` to ``high``; -1 if it is not.

    Context i has the next ``repeats[i]`` words of ``wanted``, file i the contexts from
    ``edges[i]`` and the words wanted from ``pair_edges[i]`` on. Contexts with many are
    searched one by one, all others at once.
    """
    at = np.full(len(wanted), -1)
    many = repeats >= MANY_WORDS
    file, first = np.repeat(np.arange(len(words)), np.diff(edges)), np.cumsum(repeats) - repeats
    for i, begin, end, start, n in zip(*(x[many].tolist() for x in (file, low, high, first, repeats))):
        at[start : start + n] = words[i][begin:end].searchsorted(wanted[start : start + n]) + begin
    above = np.repeat(high, repeats)
    few = np.flatnonzero(np.repeat(~many, repeats))
    at[few] = _at_once(words, np.repeat(low, repeats)[few], above[few], wanted[few], np.searchsorted(few, pair_edges))
    inside = np.flatnonzero(at < above)
    out = np.full(len(wanted), -1)
    hit = inside[gather(words, at[inside], np.searchsorted(inside, pair_edges)) == wanted[inside]]
    out[hit] = at[hit]
    return out


def _at_once(words: list[np.ndarray], low: np.ndarray, high: np.ndarray, wanted: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The first place from ``low`` to ``high`` that holds no smaller word, else ``high``."""
    out = low.copy()
    left = np.flatnonzero(low < high)
    low, high, wanted = low[left], high[left], wanted[left]
    while len(left):
        middle = (low + high) >> 1
        smaller = gather(words, middle, np.searchsorted(left, edges)) < wanted
        low, high = np.where(smaller, middle + 1, low), np.where(smaller, high, middle)
        done, keep = np.flatnonzero(low >= high), np.flatnonzero(low < high)
        out[left[done]] = low[done]
        left, low, high, wanted = left[keep], low[keep], high[keep], wanted[keep]
    return out


def _shifted(nodes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The node of the token before, none for the first of a text."""
    out = np.r_[-1, nodes[:-1]]
    out[np.r_[0, ends[:-1]]] = -1
    return out


def _counting(model: Model, ranges: int, span: int):
    """Counts of (context, word) for the level above the model's, by range of contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = batch.column(0)
            for start, end in _pieces(texts):
                ids, _, ends = words.tokens(texts[start:end])
                nodes = ids
                for level in model.levels:
                    nodes = _nodes(level, _shifted(nodes, ends), ids)
                context = _shifted(nodes, ends)
                known = (context >= 0) & (ids >= 0)
                held.append((context[known].astype(np.uint64) << np.uint64(32)) | ids[known].astype(np.uint64))
                size += int(known.sum())
                if size > BLOCK_TOKENS:
                    keys, held, size = np.concatenate(held), [], 0
                    yield from _blocks(keys, span)
        if size:
            yield from _blocks(np.concatenate(held), span)

    return count


def _blocks(keys: np.ndarray, span: int) -> Iterator[pa.RecordBatch]:
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, counts = keys[first], np.diff(np.r_[first, len(keys)])
    context = (keys >> np.uint64(32)).astype(np.int64)
    where = context // span
    edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    rows = []
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
        local = context[i:j] - where[i] * span
        rows.append(
            (
                int(where[i]), np.diff(local, prepend=0).astype("<u4").tobytes(),
                (keys[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), counts[i:j].astype("<u4").tobytes(),
            )
        )
    r, steps, words, n = zip(*rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(r, pa.int32()), pa.array(steps, pa.binary()), pa.array(words, pa.binary()), pa.array(n, pa.binary())],
        names=["range", "steps", "words", "n"],
    )


def _writing(folder: str, order: int, span: int, contexts: int):
    """Sum a range's counts and write its file."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = int(key[0])
        keys = np.concatenate(
            [
                (np.cumsum(np.frombuffer(s, "<u4").astype(np.uint64)) << np.uint64(32)) | np.frombuffer(w, "<u4")
                for s, w in zip(rows["steps"], rows["words"], strict=True)
            ]
        )
        n = np.concatenate([np.frombuffer(x, "<u4") for x in rows["n"]]).astype(np.int64)
        order_ = np.argsort(keys, kind="stable")
        keys, n = keys[order_], n[order_]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[starts], np.add.reduceat(n, starts)
        local = (keys >> np.uint64(32)).astype(np.int64)
        size = min(span, contexts - r * span)
        kinds = np.bincount(local, minlength=size)
        total = np.bincount(local, n, minlength=size)
        arrays = encode_monotone(np.r_[0, np.cumsum(kinds)])
        arrays |= {
            "words": (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32),
            "p": quantised((n - DISCOUNT) / total[local]),
            "mass": quantised(np.where(kinds > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)),
        }
        path = f"{folder}/level{order}-{r}.bin"
        save_arrays(path, arrays)
        return pd.DataFrame({"range": [r], "path": [path], "nodes": [len(keys)]})

    return write


def _write_words(folder: str):
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        path = f"{folder}/words-{int(key[0])}.bin"
        save_arrays(path, {"hash": hashes[order], "count": rows["n"].to_numpy(np.int64)[order]})
        return pd.DataFrame({"range": [int(key[0])], "path": [path], "nodes": [len(rows)]})

    return write


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        hashes, counts = [np.array([_END], np.int64).view(np.uint64)], [np.array([len(texts)])]
        for start, end in _pieces(texts):
            numbers, words, _ = numbered_words(texts[start:end])
            n = np.bincount(numbers, minlength=len(words))
            hashes.append(_hashes(words)[n > 0])
            counts.append(n[n > 0])
        hashes, counts = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[first].view(np.int64)), pa.array(np.add.reduceat(counts, first))], names=["word", "n"]
        )


def _manifest(written: DataFrame, ranges: int) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Paths by range and the first node of each range; one row a file."""
    paths, nodes = [""] * ranges, [0] * ranges
    for row in written.collect():
        paths[row["range"]], nodes[row["range"]] = row["path"], row["nodes"]
    return tuple(paths), tuple(np.r_[0, np.cumsum(nodes)].tolist())


def learn(texts: DataFrame, order: int = ORDER) -> Model:
    """Count and write a model of the column ``text`` (not null) of all rows."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}"
    texts = texts.select("text")
    counted = settle(texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    sums = counted.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    tokens = int(sums["n"] or 0)
    ranges = max(1, -(-sums["v"] // VOCABULARY_RANGE))
    part = F.floor(F.shiftrightunsigned("word", 48) * ranges / 65536).cast("int")
    schema = "range int, path string, nodes long"
    written = counted.groupBy(part.alias("range")).applyInPandas(_write_words(folder), schema)
    paths, first = _manifest(written, ranges)
    model = Model(paths, first, tokens)
    contexts = first[-1]
    for k in range(2, order + 1):
        ranges = max(1, min(contexts, -(-tokens // RANGE_TOKENS)))
        span = max(1, -(-contexts // ranges))
        ranges = max(1, -(-contexts // span))
        blocks = texts.mapInArrow(_counting(model, ranges, span), "range int, steps binary, words binary, n binary")
        written = blocks.groupBy("range").applyInPandas(_writing(folder, k, span, contexts), schema)
        paths, first = _manifest(written, ranges)
        level = Level(paths, span, first)
        model = Model(model.words, model.word_first, tokens, (*model.levels, level))
        contexts = level.nodes
    return model


def score_texts(model: Model, texts: list[str] | pa.Array) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    words = _words(model)
    if not isinstance(texts, pa.Array):
        texts = pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()).cast(pa.large_string())
    out = {k: np.zeros(len(texts), t) for k, t in (("n_tokens", int), ("n_known", int), ("base_score", float), ("score", float))}
    for start, end in _pieces(texts):
        ids, counts, ends = words.tokens(texts[start:end])
        base = (counts + ADD) / model.base_denominator
        p, nodes = base, ids
        for level in model.levels:
            nodes, own, mass = _find(level, _shifted(nodes, ends), ids)
            p = own + mass * p
        starts = np.r_[0, ends[:-1]]
        to = slice(start, end)
        out["n_tokens"][to] = ends - starts
        out["n_known"][to] = np.add.reduceat(counts > 0, starts, dtype=np.int64)
        out["base_score"][to] = np.add.reduceat(np.log10(base), starts)
        out["score"][to] = np.add.reduceat(np.log10(p), starts)
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that the model is not learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(10)) == 0, F.lit(False))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], names=["doc_id", *found])

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text(docs).alias("text"))
    return narrow.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def training_texts(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select(whole_text(docs).alias("text"))
