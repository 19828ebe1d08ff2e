"""Hashed word shingles of texts, vectorised over slices of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from reelgauge.llm.chunks import Numbered, slices

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def _bytes_of(words: pa.Array) -> list[bytes]:
    """As ``to_pylist`` gives them, cut from one copy of all (none is null)."""
    _, places, held = words.cast(pa.large_binary()).buffers()
    at = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    whole = held.to_pybytes() if held else b""
    return [whole[i:j] for i, j in zip(at, at[1:])]


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Numbers of the words (as ``words_of``) of all texts, the distinct words, and each text's count."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = cut.flatten().dictionary_encode()
    numbers, words = coded.indices.to_numpy(), _bytes_of(coded.dictionary)
    ends = cut.offsets.to_numpy()
    ends = ends - ends[0]
    # White space at either end of a text cuts off an empty word.
    if b"" in words:
        kept = numbers != words.index(b"")
        numbers, ends = numbers[kept], np.r_[0, np.cumsum(kept)][ends]
    return numbers, words, np.diff(ends).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, each computed once while it is held."""

    def __init__(self):
        self.numbered = Numbered(self.learn, self.forget)
        self.hashes = np.zeros(0, np.uint64)

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)

    def learn(self, words: list[bytes]) -> None:
        new = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.hashes = np.concatenate([self.hashes, new])

    def shingles(self, texts: list[str], size: int) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text; fewer words than ``size`` give one."""
        for start, end in slices(texts):
            cut = [words_of(t) for t in texts[start:end]]
            hashed = self.hashes_of(cut)
            rolled = np.zeros(max(len(hashed) - size + 1, 0), np.uint64)
            for k in range(size):
                rolled = rolled * _MULTIPLIER + hashed[k : k + len(rolled)]
            rolled = mix64(rolled)
            at = 0
            for ws in cut:
                n = len(ws)
                if n >= size:
                    yield np.unique(rolled[at : at + n - size + 1])
                elif n:
                    own = np.array([n], np.uint64)
                    for k in range(at, at + n):
                        own = own * _MULTIPLIER + hashed[k : k + 1]
                    yield mix64(own ^ np.uint64(0x5DEECE66D))
                else:
                    yield np.zeros(0, np.uint64)
                at += n

    def hashes_of(self, rows: list[list[bytes]]) -> np.ndarray:
        """Hashes of the words of all rows, one after the other."""
        numbers = self.numbered.number(rows)
        return self.hashes[numbers]
