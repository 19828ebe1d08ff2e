"""Variational Bayes for topic models: the numbers that tasks work out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Counts, padding included, of the lines whose mixtures are found side by side.
COUNTS_AT_ONCE = 1 << 18
#: Rounds for a line's mixture, and the mean change of its weights below which it stops.
ROUNDS, STILL = 100, 1e-3
#: Keeps places without a word from division by zero; single precision holds it.
_LEAST = np.float32(1e-37)
#: Bound of what a leap may try; its powers fit single precision.
_MOST = 1e12


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive ``x``: moved up past 6, then its series."""
    x = np.asarray(x, np.float64)
    # The sum of 1 / (x + i) for i from 0 to 5, in pairs from both ends.
    ends = x * (x + 5)
    low = (2 * x + 5) * (1 / ends + 1 / (ends + 4) + 1 / (ends + 6))
    y = x + 6
    inverse = 1 / (y * y)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    return np.log(y) - 0.5 / y - series - low


def expected_log(weights: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """exp of the expected log of a Dirichlet's shares: of each row, or down each run of rows."""
    if starts is None:
        found = digamma(np.concatenate([weights, weights.sum(axis=1, keepdims=True)], axis=1))
        return np.exp(found[:, :-1] - found[:, -1:])
    total = np.repeat(digamma(np.add.reduceat(weights, starts)), np.diff(np.r_[starts, len(weights)]), axis=0)
    return np.exp(digamma(weights) - total)


def _line_factors(mixture: np.ndarray) -> np.ndarray:
    """exp of digamma, in single precision: the expected shares of lines but for a factor a line.

    That factor cancels wherever a line's uses are shared out among its topics.
    """
    x = np.minimum(mixture, _MOST).astype(np.float32)
    ends = x * (x + 5)
    low = (2 * x + 5) * (1 / ends + 1 / (ends + 4) + 1 / (ends + 6))
    y = x + 6
    inverse = 1 / (y * y)
    return y * np.exp(-(0.5 / y + inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252)) + low))


def run_starts(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)


def _alike(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Lines with words in groups of similar sizes, and the largest size of each group."""
    order = np.argsort(sizes, kind="stable")
    rising = sizes[order]
    first = int(np.searchsorted(rising, 1))
    while first < len(order):
        near = int(np.searchsorted(rising, rising[first] * 5 // 4 + 2, side="right"))
        last = min(near, first + max(1, COUNTS_AT_ONCE // int(rising[near - 1])))
        yield order[first:last], int(rising[last - 1])
        first = last


def _settled_mixtures(uses: np.ndarray, by_word: np.ndarray, prior: float) -> np.ndarray:
    """Mixture weights of lines; ``uses`` is (line, place), ``by_word`` (line, topic, place).

    After each two rounds a line leaps to where their steps lead if they go on shrinking
    as they do (SQUAREM), so it stops sooner, and nearer to the end of plain rounds. It
    stops by a plain round's change only. Rounds are taken in single precision, what is
    summed over lines in double.
    """
    done = np.ones(by_word.shape[:2])
    line, mixture, moving = np.arange(len(done)), done.copy(), np.ones(len(done), bool)
    older = None
    for _ in range(ROUNDS):
        by_line = _line_factors(mixture)
        scaled = uses / (np.matmul(by_line[:, None, :], by_word)[:, 0] + _LEAST)
        found = prior + by_line * np.matmul(by_word, scaled[:, :, None])[:, :, 0]
        step = found - mixture
        ended = moving & (np.abs(step).sum(axis=1) < STILL * found.shape[1])
        done[line[ended]] = found[ended]
        moving &= ~ended
        left = int(moving.sum())
        if not left:
            return done
        if older is None:
            older, mixture = mixture, found
        else:
            first = mixture - older
            bend = step - first
            far = np.sqrt((first**2).sum(axis=1) / np.maximum((bend**2).sum(axis=1), 1e-300))
            far = np.maximum(far, 1.0)[:, None]
            leap = older + 2 * far * first + far**2 * bend
            # No weight can be below the prior.
            older, mixture = None, np.where((leap > prior).all(axis=1, keepdims=True), leap, found)
        if left <= 0.8 * len(moving):
            line, mixture, found = line[moving], mixture[moving], found[moving]
            uses, by_word = uses[moving], by_word[moving]
            older = None if older is None else older[moving]
            moving = np.ones(left, bool)
    done[line[moving]] = found[moving]
    return done


def line_mixtures(
    ends: np.ndarray, word: np.ndarray, uses: np.ndarray, by_word: np.ndarray, prior: float
) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[], tuple[np.ndarray, np.ndarray]]]]:
    """(lines, their mixture weights, what finds their words and expected uses) of lines with words.

    Line i has the counts from ``ends[i]`` to ``ends[i + 1]``. ``by_word`` is words x topics,
    and a last row of zeros. The uses, (topic, count), still lack the factor ``by_word``.
    """
    sizes, by_word = np.diff(ends), by_word.astype(np.float32, copy=False)
    for lines, width in _alike(sizes):
        held = np.arange(width) < sizes[lines][:, None]
        at = np.where(held, ends[lines][:, None] + np.arange(width), 0)
        known = np.where(held, word[at], len(by_word) - 1)
        times = np.where(held, uses[at], 0).astype(np.float32)
        shares = np.ascontiguousarray(by_word[known].transpose(0, 2, 1))
        mixture = _settled_mixtures(times, shares, prior)

        def expected(mixture=mixture, times=times, shares=shares, known=known, held=held):
            by_line = _line_factors(mixture)
            scaled = times / (np.matmul(by_line[:, None, :], shares)[:, 0] + _LEAST)
            uses = [(weight[:, None] * scaled)[held] for weight in by_line.T]
            return known[held], np.stack(uses).astype(np.float64)

        yield lines, mixture, expected
