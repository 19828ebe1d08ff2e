"""Ranked lexical search: a document FP-tree searched by depth-first branch and bound.

Documents are reduced to the terms of the items. Each block of documents becomes a tree:
a document's terms stand in order of falling document frequency, so documents share the
paths of their frequent terms; a chain of nodes without a fork is one node, and small
neighbouring branches share a leaf. A node keeps, for every term below it, the greatest
tf, and of its documents the least m. A score rises with tf and falls with m, so the
score of these is an upper bound for all documents below. An item goes down the
branches, the most promising first, and leaves out those whose bound is below its 20th
best score so far; what it meets in leaves is scored exactly. A task keeps each item's
best over all its blocks, so at most ``top`` rows an item leave a task.

The items are the stated query set, taken in blocks of bounded size, each against all
documents; term counts and document frequencies come from all whole texts.

Defined results: terms are the maximal runs outside ASCII punctuation, spaces and
controls, only A-Z lower-cased; null and empty texts have none, are no documents and
match nothing, and such items have no rows; equal scores are ordered by doc_id, rows
without id last; repeated rows are ranked each, repeated item rows have a ranking each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgauge.llm.chunks import ragged_places
from reelgauge.session import settle

#: Items taken in one pass over the documents, and their characters at most.
ITEMS, ITEM_CHARS = 2_000, 8_000_000
#: Documents of a tree and their terms at most; documents of a leaf.
BLOCK, BLOCK_TERMS, LEAF = 4_096, 2_000_000, 16

_PARTS = (range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80))
_SPACED = bytes(
    0x20 if any(b in part for part in _PARTS) and not 0x41 <= b <= 0x5A else b + 0x20 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_SPACED).split() if text else []


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n and, of the terms in ``vocabulary``, numbers (rising) and tf."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(shared.value)}
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                held = Counter(map(number.get, found))
                held.pop(None, None)
                listed = sorted(held)
                sizes.append(len(found))
                terms.append(listed)
                tfs.append([held[t] for t in listed])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class TermTree:
    """FP-tree of a block; documents, children and annotations are ragged rows."""

    def __init__(self, offsets: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray):
        """Rows of ``ranks`` rise: the most frequent term has rank 0."""
        keys = [ranks[a:b].astype(">u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        lengths = np.diff(offsets)[order]
        at = ragged_places(offsets[:-1][order], lengths)
        self.ranks, self.tfs = ranks[at], tfs[at].astype(np.int64)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.m, self.ids = m[order], ids[order]
        shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            k = min(lengths[i - 1], lengths[i])
            a, b = self.starts[i - 1], self.starts[i]
            differ = np.flatnonzero(self.ranks[a : a + k] != self.ranks[b : b + k])
            shared[i] = differ[0] if len(differ) else k
        #: For each inner node its children: (first document, end, number of the inner node or -1).
        self.children: list[np.ndarray] = []
        #: For each inner node terms, tf maxima and bounds of the ragged rows of its children.
        self.notes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._grow(shared)

    def _grow(self, shared: np.ndarray) -> None:
        spans, stack = [], [(0, len(shared), -1, 0)]
        while stack:  # parents before their children
            lo, hi, parent, place = stack.pop()
            if parent >= 0:
                spans[parent][place][2] = len(spans)
            inside = shared[lo + 1 : hi]
            cuts = lo + 1 + np.flatnonzero(inside == inside.min()) if len(inside) else np.zeros(0, np.int64)
            edges = [lo, *cuts.tolist(), hi]
            children: list[list[int]] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if children and b - children[-1][0] <= LEAF:
                    children[-1][1] = b
                else:
                    children.append([a, b, -1])
            spans.append(children)
            for place, (a, b, _) in enumerate(children):
                # Equal vectors fork no more: a leaf of any size.
                if b - a > LEAF and len(children) > 1 and (shared[a + 1 : b] < self.lengths[a + 1 : b]).any():
                    stack.append((a, b, len(spans) - 1, place))
        self.children = [np.array(c, np.int64) for c in spans]
        self.notes = [None] * len(spans)  # type: ignore[list-item]
        for node in reversed(range(len(spans))):
            rows = []
            for a, b, inner in spans[node]:
                if inner < 0:
                    at = slice(self.starts[a], self.starts[b - 1] + self.lengths[b - 1])
                    rows.append((*_maxima(self.ranks[at], self.tfs[at]), self.m[a:b].min()))
                else:
                    terms, tfs, _, least = self.notes[inner]
                    rows.append((*_maxima(terms, tfs), least.min()))
            ends = np.cumsum([len(r[0]) for r in rows])
            self.notes[node] = (
                np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), ends, np.array([r[2] for r in rows])
            )

    def search(self, weights: np.ndarray, best: Best) -> None:
        """Offer ``best`` every document that may be among the best by ``weights`` of ranks."""
        stack = [(0, 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.bar and node:
                continue
            terms, tfs, ends, least = self.notes[node]
            sizes = np.diff(np.r_[0, ends])
            bounds = _scores(terms, tfs, weights, np.repeat(least, sizes), ends - sizes, ends)
            alive = np.flatnonzero(bounds >= max(best.bar, 1))
            alive = alive[np.argsort(bounds[alive], kind="stable")]
            children = self.children[node][alive]
            leaves = np.flatnonzero(children[:, 2] < 0)[::-1]
            for part in np.array_split(leaves, range(8, len(leaves), 8)):
                part = part[bounds[alive[part]] >= best.bar]
                if len(part):
                    docs = ragged_places(children[part, 0], children[part, 1] - children[part, 0])
                    best.offer(self._exact(docs, weights), self.ids[docs])
            stack += [(bounds[alive[i]], children[i, 2]) for i in np.flatnonzero(children[:, 2] >= 0)]

    def _exact(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        lengths = self.lengths[docs]
        at = ragged_places(self.starts[docs], lengths)
        ends = np.cumsum(lengths)
        return _scores(self.ranks[at], self.tfs[at], weights, np.repeat(self.m[docs], lengths), ends - lengths, ends)


def _maxima(terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms, rising, with their greatest tf."""
    order = np.argsort(terms, kind="stable")
    terms, tfs = terms[order], tfs[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]][: len(terms)])
    return terms[starts], np.maximum.reduceat(tfs, starts) if len(starts) else tfs


def _scores(terms, tfs, weights, m, starts, ends) -> np.ndarray:
    """Sum over each row of weight * (10^9 tf div (1000 tf + 12 m)), in whole numbers."""
    weight = weights[terms]
    held = np.flatnonzero(weight)
    tf = tfs[held]
    parts = weight[held] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[held]))
    sums = np.r_[0, np.cumsum(parts)]
    return sums[np.searchsorted(held, ends)] - sums[np.searchsorted(held, starts)]


#: Stands for a missing doc_id: after all others.
_NO_ID = np.iinfo(np.int64).max


class Best:
    """The ``top`` best (score, id) of an item; ``bar`` is what a further one has to reach."""

    def __init__(self, top: int):
        self.top, self.bar = top, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bar
        if not good.any():
            return
        scores, ids = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]]
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.bar = max(1, int(self.scores[-1]))


def _blocks(batches: Iterator[pa.RecordBatch], rank: np.ndarray, documents: int, occurrences: int):
    """Trees over runs of documents, bounded by their number and by that of their terms."""
    for batch in batches:
        ids = batch.column(0)
        ids = np.where(np.asarray(ids.is_null()), _NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
        m = 75 + 25 * batch.column(1).to_numpy() * documents // occurrences
        offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
        base = offsets[0]
        ranks = rank[batch.column(2).flatten().to_numpy()]
        tfs = batch.column(3).flatten().to_numpy()
        offsets = offsets - base
        # Within each document by rank: documents first, then ranks.
        owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.lexsort((ranks, owner))
        ranks, tfs = ranks[order], tfs[order]
        start = 0
        while start < len(ids):
            end = int(np.searchsorted(offsets, offsets[start] + BLOCK_TERMS, "right")) - 1
            end = min(max(end, start + 1), start + BLOCK, len(ids))
            part = slice(offsets[start], offsets[end])
            yield TermTree(offsets[start : end + 1] - offsets[start], ranks[part], tfs[part], m[start:end], ids[start:end])
            start = end


def _search_block(docs: DataFrame, items: list[tuple[int, Counter]], top: int) -> DataFrame | None:
    """item (its number in the block), doc_id, score: the best of every task."""
    vocabulary = sorted(set().union(*[counts for _, counts in items]))
    vectors = settle(restricted_vectors(docs, vocabulary))
    documents, occurrences = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not vocabulary or not documents:
        return None
    # One row for each term of the block of items.
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df]
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    number = {term: i for i, term in enumerate(vocabulary)}
    wanted = []
    for _, counts in items:
        at = np.array([number[t] for t in counts], np.int64)
        value = np.array([weight[number[t]] * k for t, k in counts.items()], np.int64)
        wanted.append((rank[at], value))
    shared = docs.sparkSession.sparkContext.broadcast((rank, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, wanted = shared.value
        best = [Best(top) for _ in wanted]
        weights = np.zeros(len(rank), np.int64)
        for tree in _blocks(batches, rank, documents, occurrences):
            for (at, value), kept in zip(wanted, best, strict=True):
                weights[at] = value
                tree.search(weights, kept)
                weights[at] = 0
        for i, kept in enumerate(best):
            if len(kept.ids):
                ids = pa.array(kept.ids, mask=kept.ids == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(kept.ids), pa.int32()), ids, pa.array(kept.scores)], ["item", "doc_id", "score"])

    matching = vectors.filter(F.size("terms") > 0)
    return matching.mapInArrow(run, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, Counter]]]:
    block, chars = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        counts = Counter(terms_of(row.text))
        if counts:
            block.append((row.item_id, counts))
            chars += len(row.text)
        if len(block) >= ITEMS or chars >= ITEM_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with a score above 0."""
    spark, found = docs.sparkSession, None
    for number, block in enumerate(_item_blocks(items)):
        best = _search_block(docs, block, top)
        if best is None:
            continue
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        part = settle(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
