"""Similarity join of vectors by locality-sensitive hashing.

Signs of random projections make a table's bucket number: two vectors at an angle a agree
in each sign with a probability of 1 - a / pi, so those within the bar meet in some table
with a stated probability. Buckets meet by an equi-join; longer signatures, compared bit
by bit, drop most chance meetings before any vector is read; and what is left is decided
by the exact cosine. Nothing wrong is found, and a pair at the bar is found with a
probability of ``recall`` at least, one above it with more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.session import settle
from reelgauge.shipping import ship_package

#: Bits of the signature, and the share of missed pairs that is left to it.
SIGNATURE_BITS = 256
_SIGNATURE_MISS = 0.1
_MAX_BITS, _MAX_SIGNS = 24, 1 << 16
_TABLES_AT_ONCE = 64
# What a chance meeting costs, where a row sent to a bucket costs 1.
_CHANCE_COST = 0.1


@dataclass(frozen=True)
class HashPlan:
    """``tables`` buckets of ``bits`` signs, and the signature bits that may differ."""

    bits: int
    tables: int
    differing: int


def hash_plan(threshold: float, recall: float, left_rows: int, right_rows: int) -> HashPlan:
    """The cheapest bits and tables that find a pair at the bar with probability ``recall``.

    More bits make chance meetings rarer and take more tables; the cost counts rows sent
    to buckets and unrelated pairs that meet.
    """
    if not (-1 < threshold < 1 and 0 < recall < 1):
        raise ValueError("threshold must lie in (-1, 1) and recall in (0, 1)")
    agree = 1 - math.acos(threshold) / math.pi
    miss = math.log((1 - recall) * (1 - _SIGNATURE_MISS))
    plans = []
    for bits in range(1, _MAX_BITS + 1):
        tables = max(1, math.ceil(miss / math.log1p(-(agree**bits))))
        if bits > 1 and bits * tables > _MAX_SIGNS:
            break
        chance = left_rows * right_rows * tables * 0.5**bits
        plans.append((tables * (left_rows + right_rows) + _CHANCE_COST * chance, bits, tables))
    _, bits, tables = min(plans)
    reach = NormalDist().inv_cdf(1 - (1 - recall) * _SIGNATURE_MISS)
    spread = math.sqrt(SIGNATURE_BITS * agree * (1 - agree))
    differing = math.ceil(SIGNATURE_BITS * (1 - agree) + reach * spread + 1)
    return HashPlan(bits, tables, min(differing, SIGNATURE_BITS))


def _packed(signs: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits made from rows of signs."""
    return signs.reshape(len(signs), -1, width) @ (1 << np.arange(width, dtype=np.int64))


def _with_codes(rows: DataFrame, plan: HashPlan, seed: int) -> DataFrame:
    """``rows`` (_id, label, vector) with unit vectors, their length, buckets and signature."""
    words = SIGNATURE_BITS // 32
    tables, bits = plan.tables, plan.bits

    def projections(length: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, length])
        return (
            rng.standard_normal((length, SIGNATURE_BITS), dtype=np.float32),
            rng.standard_normal((length, tables * bits), dtype=np.float32),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            lists = batch.column("vector")
            lengths = np.diff(lists.offsets.to_numpy())
            for length in np.unique(lengths):
                picked = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(picked))
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                unit = flat.reshape(len(picked), length)
                # Scaled first, so that squares neither overflow nor vanish.
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                if length not in known:
                    known[length] = projections(int(length))
                short = unit.astype(np.float32)
                signature = _packed(short @ known[length][0] > 0, 32)
                codes = np.concatenate([
                    _packed(short @ known[length][1][:, at : at + _TABLES_AT_ONCE * bits] > 0, bits)
                    for at in range(0, tables * bits, _TABLES_AT_ONCE * bits)
                ], axis=1).astype(np.int32)

                def lists_of(values: np.ndarray) -> pa.Array:
                    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                    return pa.ListArray.from_arrays(ends, values.ravel())

                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("label"), pa.array(np.full(len(picked), length, np.int32)), lists_of(unit), lists_of(codes), *map(pa.array, signature.T)],
                    ["_id", "label", "length", "unit", "codes", *(f"s{i}" for i in range(words))],
                )

    label = rows.schema["label"].dataType.simpleString()
    signature = ", ".join(f"s{i} long" for i in range(words))
    return rows.mapInArrow(run, f"_id long, label {label}, length int, unit array<double>, codes array<int>, {signature}")


def _numbered(rows: DataFrame, vector_col: str) -> DataFrame:
    """Distinct (label, vector) with a direction, each with a number that stays."""
    vector = F.col(vector_col).cast("array<double>")
    plain = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    directed = plain & F.exists("vector", lambda x: x != 0)
    kept = rows.select("label", vector.alias("vector")).where(directed)
    return settle(kept.distinct().withColumn("_id", F.monotonically_increasing_id()))


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    recall: float = 0.999,
    seed: int = 42,
) -> DataFrame:
    """Distinct (left_label, right_label) of (label, vector) tables whose cosine exceeds the bar.

    Vectors that are null, zero or hold a missing or non-finite number have no direction
    and match nothing; so do vectors of different lengths.
    """
    ship_package(left.sparkSession)
    a, b = _numbered(left, "vector"), _numbered(right, "vector")
    plan = hash_plan(threshold, recall, max(a.count(), 1), max(b.count(), 1))
    a, b = (settle(_with_codes(rows, plan, seed)) for rows in (a, b))
    words = [f"s{i}" for i in range(SIGNATURE_BITS // 32)]

    def bucketed(rows: DataFrame, side: str) -> DataFrame:
        named = [F.col(c).alias(f"{side}{c}") for c in ("_id", *words)]
        return rows.select("length", *named, F.posexplode("codes").alias("table", "code"))

    differing: Column = sum(F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in words)
    met = bucketed(a, "a").join(bucketed(b, "b"), ["length", "table", "code"])
    pairs = met.where(differing <= plan.differing).select("a_id", "b_id").distinct()
    vectors = [
        rows.select(F.col("_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("unit").alias(f"{side}_unit"))
        for rows, side in ((a, "a"), (b, "b"))
    ]
    found = pairs.join(vectors[0], "a_id").join(vectors[1], "b_id").select("a_label", "b_label", "a_unit", "b_unit")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).flatten().to_numpy() for c in ("a_unit", "b_unit"))
            starts = batch.column("a_unit").offsets.to_numpy()
            starts = (starts - starts[0])[:-1]
            if len(starts):
                kept = np.flatnonzero(np.add.reduceat(one * two, starts) > threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(kept)) for c in ("a_label", "b_label")], ["left_label", "right_label"]
                )

    kinds = [rows.schema["label"].dataType.simpleString() for rows in (left, right)]
    return found.mapInArrow(close, f"left_label {kinds[0]}, right_label {kinds[1]}").distinct()
