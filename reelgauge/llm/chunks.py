"""Chunks of text between ASCII white space, each kept once with its results.

The word tokenizer drops white space, so a chunk's tokens do not depend on its
neighbours. A store keeps what was found for a chunk; it is emptied when it has grown
beyond ``limit`` chunks, so a worker's memory is bounded whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

LIMIT = 500_000
#: Documents are taken in slices of about this many characters.
SLICE_CHARS = 4_000_000


def split_chunks(text: str) -> list[bytes]:
    """UTF-8 pieces between ASCII white space; other white space stays inside a piece.

    A-Z come in lower case, as the tokenizer takes them, unless a special string, which
    keeps its case, may be in the text.
    """
    raw = text.encode("utf-8", "replace")
    return raw.split() if b"<|" in raw else raw.lower().split()


def slices(texts: list[str]):
    """(start, end) of runs of texts with about SLICE_CHARS characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ragged_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all items of ragged rows that begin at ``starts``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Numbers(dict):
    """Gives a key that it does not hold the next number and lists it in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Numbered:
    """Numbers chunks; ``learn`` is told the new ones of each slice, in order."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], limit: int = LIMIT):
        self.ids = _Numbers()
        self.learn, self.forget, self.limit = learn, forget, limit

    def release(self) -> None:
        """Give up all that is held."""
        self.ids = _Numbers()
        self.forget()

    def number(self, rows: list[list[bytes]]) -> np.ndarray:
        """Numbers of the chunks of all rows, one after the other."""
        if len(self.ids) > self.limit:
            self.release()
        numbers = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))
        if self.ids.fresh:
            self.learn(self.ids.fresh)
            self.ids.fresh = []
        return numbers


def releasing(run: Callable, store: Callable[[], Numbered]) -> Callable:
    """``run`` over a task's batches; the store it fills is emptied when the task ends.

    Workers serve many tasks and stages, so what one leaves would add up in them.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            store().release()

    return wrapped
