"""Quality classifier: regularised quadratic discriminant over document statistics.

``document_statistics`` turns every whole text into a fixed vector of transformed
statistics (smoothed log odds of character and word classes, of repeats and of line
shapes). ``fit_discriminant`` takes counts, sums and cross products of each class over
all labelled rows, shrinks each class covariance towards the pooled one and towards its
own mean variance, and caches the Cholesky factors. A score is the logistic of the
difference of the two Mahalanobis log densities. The model has one mean and one factor a
class, so what reaches the driver does not grow with the rows.

Defined results: a null text counts as empty and is scored like any other; a null or
repeated label counts as often as it occurs, null labels not at all; with a class that
has no labelled row every score is the share of label 1 (0.5 without labels); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.tables import whole_text

STATISTICS = (
    "bytes", "words", "word_bytes", "upper", "digit", "symbol", "stop_mark", "other_mark",
    "pipe", "high", "line", "marked_end", "new_words", "top_word", "same_as_last", "worst_upper", "worst_symbol", "worst_same",
)
SHRINK_POOLED, SHRINK_RIDGE = 0.1, 0.02

_CLASS = np.zeros(256, np.int64)
for _number, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!#$%&*+/<=>@\\^_`{}~", b".,", b"\"'()-:;?[]", b"|"), 1
):
    _CLASS[list(_bytes)] = _number
_CLASS[128:] = 7
_CLASS[10] = 8
_END_MARKS = b"!#$%&*+/<=>@\\^_`{}~|"


def _odds(count, size, expected: float = 0.01, weight: float = 20.0):
    """Log odds of a share, drawn to ``expected`` as if by ``weight`` further trials."""
    return np.log((count + weight * expected) / (np.maximum(size - count, 0) + weight * (1 - expected)))


#: Words in a window whose worst shares are taken, so junk after a clean start shows.
WINDOW = 50


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    words = raw.split()
    n, size = len(words), len(raw)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    marked = np.isin(ends, np.frombuffer(_END_MARKS, np.uint8))
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, max(n - 1, 0))
    shout = np.fromiter((w.isupper() and len(w) > 1 for w in words), bool, n)

    def worst(flags: np.ndarray) -> float:
        if not len(flags):
            return 0.0
        edges = np.arange(0, len(flags), WINDOW)
        sizes = np.diff(np.r_[edges, len(flags)])
        return float(_odds(np.add.reduceat(flags.astype(float), edges), sizes, 0.02, 10.0).max())

    return [
        np.log1p(size), np.log1p(n), np.log((size + 60) / (n + 10)),
        _odds(classes[1], size, 0.02), _odds(classes[2], size), _odds(classes[3], size),
        _odds(classes[4], size, 0.02), _odds(classes[5], size), _odds(classes[6], size),
        _odds(classes[7], size, 0.03), _odds(classes[8], n, 0.03),
        _odds(int(marked.sum()), n), _odds(len(counts), n, 0.7), _odds(max(counts.values(), default=0), n, 0.07),
        _odds(int(same.sum()), n), worst(shout), worst(marked), worst(same),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the array of statistics of the whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text(docs).alias("text"))
    return narrow.mapInArrow(measure, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants; the prior's log odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [
            -0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
            for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)
        ]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -700, 700)))


def fit_discriminant(
    labelled: DataFrame, pooled_share: float = SHRINK_POOLED, ridge_share: float = SHRINK_RIDGE
) -> Discriminant:
    """Fit on all rows of (label 0 or 1, ``x``); moments are summed where the rows are."""
    size = len(STATISTICS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, squares = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.stack(batch["x"].to_numpy()), batch["label"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                sums[c] += own.sum(axis=0)
                squares[c] += own.T @ own
        flat = [np.r_[n[c], sums[c], squares[c].ravel()] for c in (0, 1)]
        yield pd.DataFrame(
            {
                "label": np.repeat([0, 1], len(flat[0])),
                "place": np.tile(np.arange(len(flat[0])), 2),
                "value": np.concatenate(flat),
            }
        )

    parts = (
        labelled.filter("label in (0, 1)").select(F.col("label").cast("int"), "x")
        .mapInPandas(moments, "label int, place int, value double")
    )
    found = np.zeros((2, 1 + size + size * size))
    for row in parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        found[row["label"], row["place"]] = row["value"]
    n = found[:, 0]
    if not n.all():
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = found[:, 1 : 1 + size] / n[:, None]
    covariances = [
        found[c, 1 + size :].reshape(size, size) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)
    ]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    factors, log_dets = [], []
    for c in (0, 1):
        shrunk = (1 - pooled_share) * covariances[c] + pooled_share * pooled
        shrunk = (1 - ridge_share) * shrunk + ridge_share * np.diag(np.diag(pooled) + 1e-6)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def score_statistics(measured: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1) of (doc_id, ``x``)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(STATISTICS)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(x)})

    return measured.select("doc_id", "x").mapInPandas(score, "doc_id long, score double")


def labelled_statistics(measured: DataFrame, labels: DataFrame, learn_from) -> DataFrame:
    """label and ``x`` of the labelled documents that ``learn_from`` (of doc_id) admits."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & learn_from(F.col("doc_id")))
    return measured.join(known, "doc_id").select("label", "x")


def held_out(doc_id):
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
