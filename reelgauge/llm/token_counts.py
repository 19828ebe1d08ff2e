"""Token counts of whole texts by rank-synchronous merging of arrays.

Each distinct chunk is cut into pre-tokens once, each distinct pre-token merged once.
The new pre-tokens of a slice are held as one ragged array of symbols; in every round
each sequence finds its lowest-ranked pair and all its occurrences are merged in all
sequences at the same time, until no pair has a rank. What survives is counted.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings in a
text are one token each, as the library takes them by default; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reelgauge.llm.chunks import Numbered, releasing, slices, split_chunks
from reelgauge.llm.tables import whole_text

NO_RANK = np.iinfo(np.int64).max


class WordMerges:
    """A word-end BPE file: pre-tokens of a chunk, and their numbers of tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        pairs, made = [], []
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((self.vocab[left] << 32) | self.vocab[right])
            made.append(self.vocab[left + right])
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs = np.array(pairs, np.int64)[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array(made, np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(split["pattern"]["Regex"])
        self.byte_chars = _byte_characters()

    def pretokens(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without special strings, in the tokenizer's byte characters."""
        if chunk.isprintable():
            if chunk.isascii():
                return self.cut.findall(chunk.lower())
            # Latin letters, composed and with a plain lower case, need no library.
            if max(chunk) < "\u0250" and "\u0130" not in chunk:
                return [w.encode().decode("latin-1").translate(self.byte_chars) for w in self.cut.findall(chunk.lower())]
        text = self.library.normalizer.normalize_str(chunk)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        lengths = np.array([len(w) for w in words], np.int64)
        if not len(words) or not lengths.sum():
            return np.zeros(len(words), np.int64)
        vocab, suffix = self.vocab, self.suffix
        symbols = np.fromiter(
            (vocab[c] for w in words if w for c in (*w[:-1], w[-1] + suffix)), np.int64, lengths.sum()
        )
        owner = np.repeat(np.arange(len(words)), lengths)
        counts = np.zeros(len(words), np.int64)
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            same = owner[:-1] == owner[1:]
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = same & (self.pairs[at] == pair)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            live = np.repeat(best != NO_RANK, sizes)
            ended = best == NO_RANK
            counts[owner[starts[ended]]] = sizes[ended]
            hit = live & (rank == np.repeat(best, sizes))
            # Of overlapping equal pairs (a a a) the first, third, ... are merged.
            run = hit & np.r_[False, hit[:-1]]
            if run.any():
                place = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~run, place, -1))
                hit &= (place - first) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            keep = live & ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        return counts


def _byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def word_merges(path: str) -> WordMerges:
    return WordMerges(path)


class ChunkCounts:
    """Number of tokens of each chunk, found once while the chunk is held."""

    def __init__(self, merges: WordMerges):
        self.merges = merges
        self.words: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.numbered = Numbered(self.learn, self.forget)

    def forget(self) -> None:
        self.words.clear()
        self.counts = np.zeros(0, np.int64)

    def learn(self, found: list[bytes]) -> None:
        merges, words = self.merges, self.words
        chunks = [c.decode("utf-8") for c in found]
        special = ["<|" in c and any(s in c for s in merges.specials) for c in chunks]
        cut = [[] if s else merges.pretokens(c) for c, s in zip(chunks, special, strict=True)]
        new = list({w for ws in cut for w in ws}.difference(words))
        words.update(zip(new, merges.count(new).tolist(), strict=True))
        found = [
            len(merges.library.encode(c, add_special_tokens=False).ids) if s else sum(map(words.__getitem__, ws))
            for c, s, ws in zip(chunks, special, cut, strict=True)
        ]
        self.counts = np.concatenate([self.counts, np.array(found, np.int64)])

    def of(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for start, end in slices(texts):
            cut = [split_chunks(t) for t in texts[start:end]]
            numbers = self.numbered.number(cut)
            ends = np.cumsum([0] + [len(cs) for cs in cut])
            summed = np.r_[0, np.cumsum(self.counts[numbers])]
            out[start:end] = summed[ends[1:]] - summed[ends[:-1]]
        return out


@cache
def _chunk_counts(path: str) -> ChunkCounts:
    return ChunkCounts(word_merges(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``tokenizer`` is the path of the file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _chunk_counts(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens = counts.of(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_tokens > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    from pyspark.sql import functions as F

    text = whole_text(docs)
    narrow = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(releasing(count, lambda: _chunk_counts(tokenizer).numbered), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
