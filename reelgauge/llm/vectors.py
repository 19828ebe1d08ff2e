"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Coarse centroids and residual codebooks are fitted on at most ``SAMPLE`` vectors chosen
by hash; every distinct vector is indexed and every one is a query. A vector is filed in
the list of its nearest centroid, in one of several blocks if the list is long, and
queries the blocks of its ``probes`` nearest lists. There the table-lookup product of
the query with a member's code, plus the length of what the code leaves out, bounds the
true cosine from above; pairs whose bound reaches the threshold are checked by exact
cosine in double precision. So only probing can miss a link: a pair is missed only when
neither side probes the other's list.

A task returns counts and a spanning forest of its links, never the pairs. Equal vectors
are one class with a count; links to and within a class count all of its vectors.

Vectors of each length have an index of their own; only equal lengths can link.

Defined results: a vector that is null, zero, or with null or non-finite components links
with nothing and is its own component; rows that repeat an id are vectors of their own;
a row without id links like any other, names no component and is never kept; very long
vectors are taken whole; ties need no order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.components import components
from reelgauge.llm.jaccard_join import _groups, _runs
from reelgauge.session import settle

THRESHOLD = 0.9
#: Vectors that the index is fitted on at most.
SAMPLE = 32_768
SUBSPACES, CODES = 16, 64
#: Lists that a vector queries at least; half the square root of the lists if that is more.
PROBES = 12
#: Rows of the sample compared with the centroids at once.
FIT_ROWS = 2048
#: Members of a block; longer lists are dealt over several.
BLOCK = 2048
ROUNDS = 8


@dataclass(frozen=True)
class Index:
    """Unit centroids, residual codebooks (subspace, code, width) and blocks of each list."""

    centroids: np.ndarray
    books: np.ndarray
    blocks: np.ndarray

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        near = x @ self.centroids.T
        probes = min(probes, near.shape[1])
        found = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        order = np.argsort(-np.take_along_axis(near, found, 1), axis=1, kind="stable")
        return np.take_along_axis(found, order, 1)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of what they leave out."""
        parts = residuals.reshape(len(residuals), *self.books.shape[::2])
        codes = np.empty(parts.shape[:2], np.uint8)
        left = np.zeros(len(residuals))
        for m, book in enumerate(self.books):
            apart = (parts[:, m] ** 2).sum(1)[:, None] - 2 * parts[:, m] @ book.T + (book**2).sum(1)
            codes[:, m] = apart.argmin(1)
            left += ((parts[:, m] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)


def _nearest(x: np.ndarray, centres: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
    """For each row the centre of the greatest product, ``less`` taken off; in blocks of rows."""
    blocks = [(x[i : i + FIT_ROWS] @ centres.T - less).argmax(1) for i in range(0, len(x), FIT_ROWS)]
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, random: np.random.Generator, unit: bool) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres, (centres**2).sum(1) / 2)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit_index(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    centroids = _means(sample, lists, random, unit=True)
    residuals = sample - centroids[_nearest(sample, centroids)]
    width = -(-sample.shape[1] // SUBSPACES)
    parts = _padded(residuals, width).reshape(len(sample), SUBSPACES, width)
    return centroids, np.stack([_means(parts[:, m], CODES, random, unit=False) for m in range(SUBSPACES)])


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, SUBSPACES * width - x.shape[1])))


def _unit_rows(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<f8").reshape(-1, size)


def _routed(index: Index, size: int, probes: int):
    """A row for each vector as a member and for each block it queries."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.r_[0, np.cumsum(index.blocks)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = batch.column(0).to_numpy()
                x = _unit_rows(batch, 2, size)
                lists = index.lists(x, probes)
                own = lists[:, 0]
                block = first[own] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.blocks[own]
                each = index.blocks[lists]
                starts = first[lists].ravel()
                ends = np.cumsum(each.ravel())
                cells = np.arange(ends[-1]) + np.repeat(starts - (ends - each.ravel()), each.ravel())
                row = np.repeat(np.arange(len(ids)), each.sum(1))
                cells, rows = np.r_[block, cells], np.r_[np.arange(len(ids)), row]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells), pa.array(np.arange(len(rows)) < len(ids)), taken.column(0), taken.column(1),
                        pa.array(list(lists[rows].astype("<i4")), pa.list_(pa.int32())), taken.column(2),
                    ],
                    names=["cell", "member", "rep", "m", "lists", "unit"],
                )

    return route


def _compared(index: Index, size: int, threshold: float):
    """Partial link counts (``links``) and forest edges (``other``) of each block."""
    list_of = np.repeat(np.arange(len(index.blocks)), index.blocks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            starts, sizes = _runs(table.column(0).to_numpy())
            for start, count in zip(starts.tolist(), sizes.tolist(), strict=True):
                rows = table.slice(start, count).combine_chunks().to_batches()[0]
                yield from _block(rows, int(list_of[rows.column(0)[0].as_py()]), index, size, threshold)

    return compare


def _block(rows: pa.RecordBatch, own_list: int, index: Index, size: int, threshold: float):
    member = rows.column(1).to_numpy(zero_copy_only=False)
    if not member.any():
        return
    ids, m = rows.column(2).to_numpy(), rows.column(3).to_numpy()
    lists = np.array(rows.column(4).to_pylist(), np.int32)
    x = _unit_rows(rows, 5, size)
    ids_m, m_m, y = ids[member], m[member], x[member]
    ids_q, m_q, q, lists_q = ids[~member], m[~member], x[~member], lists[~member]
    width = index.books.shape[2]
    centre = index.centroids[own_list]
    codes, left = index.encode(_padded(y - centre, width))
    base = q @ centre
    parts = _padded(q, width).reshape(len(q), SUBSPACES, width)
    links_q, links_m = np.zeros(len(q), np.int64), np.zeros(len(y), np.int64)
    label_q, label_m = np.full(len(q), -1), np.arange(len(y))
    for at in range(0, len(q), 256):
        to = slice(at, at + 256)
        bound = base[to, None] + left[None, :]
        for s in range(SUBSPACES):
            bound += (parts[to, s] @ index.books[s].T)[:, codes[:, s]]
        a, b = np.nonzero(bound >= threshold - 1e-9)
        exact = np.empty(len(a))
        for i in range(0, len(a), 100_000):
            exact[i : i + 100_000] = np.einsum("ij,ij->i", q[at + a[i : i + 100_000]], y[b[i : i + 100_000]])
        hit = (exact >= threshold) & (ids_q[at + a] != ids_m[b])
        a, b = a[hit] + at, b[hit]
        # A pair counts for the query's side here, and for the member's side too unless
        # the member queries the other's list itself.
        np.add.at(links_q, a, m_m[b])
        back = (lists[member][b] == lists_q[a, :1]).any(1)
        np.add.at(links_m, b[~back], m_q[a[~back]])
        edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
        for i, j in zip(edges, [*edges[1:], len(a)]):
            met = np.unique(label_m[b[i:j]])
            if len(met) > 1:
                label_m[np.isin(label_m, met)] = met[0]
            label_q[a[i]] = b[i]
    linked_q, linked_m = links_q > 0, label_m != np.arange(len(y))
    roots = ids_m[label_m]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[ids_q[linked_q], ids_m[links_m > 0], ids_m[linked_m], ids_q[linked_q]]),
            pa.array(np.r_[links_q[linked_q], links_m[links_m > 0], np.zeros(linked_m.sum() + linked_q.sum(), np.int64)]),
            pa.array(np.r_[ids_q[linked_q], ids_m[links_m > 0], roots[linked_m], roots[label_q[linked_q]]]),
        ],
        names=["rep", "links", "other"],
    )


def _links_of_length(reps: DataFrame, size: int, threshold: float, probes: int) -> DataFrame | None:
    """rep, links, other: partial link counts and forest edges of the classes of one length."""
    count = reps.count()
    share = int(min(1.0, SAMPLE / max(count, 1)) * 1_000_000)
    sample = reps.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < share).select("unit").collect()
    if not sample:  # of a few vectors a share of a millionth may be none
        sample = reps.select("unit").limit(SAMPLE).collect()
    if not sample:
        return None
    found = np.frombuffer(b"".join(bytes(r["unit"]) for r in sample), "<f8").reshape(-1, size)
    lists = int(np.clip(np.sqrt(count), 1, max(1, len(found) // 8)))
    probes = max(probes, int(np.ceil(np.sqrt(lists) / 2)))
    centroids, books = fit_index(found, lists)
    index = Index(centroids, books, np.ones(lists, np.int64))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(lists, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                total += np.bincount(index.lists(_unit_rows(batch.slice(at, 1024), 0, size), 1)[:, 0], minlength=lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists)), pa.array(total)], names=["list", "n"])

    held = np.zeros(lists, np.int64)
    for row in reps.select("unit").mapInArrow(filed, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        held[row["list"]] = row["n"]
    index = Index(centroids, books, np.maximum(1, -(-held // BLOCK)))
    cells = (
        reps.select("rep", "m", "unit")
        .mapInArrow(_routed(index, size, probes), "cell long, member boolean, rep long, m long, lists array<int>, unit binary")
        .repartition("cell").sortWithinPartitions("cell")
    )
    return settle(cells.mapInArrow(_compared(index, size, threshold), "rep long, links long, other long"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    value = F.col("embedding").cast("array<double>")
    usable = (
        value.isNotNull() & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(value, lambda v: v != 0)
    )
    keyed = vectors.select(F.col("vec_id").cast("long"), F.when(usable, value).alias("embedding")).withColumns(
        {"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(3), "embedding")}
    )

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own in batch["embedding"]:
                own = np.asarray(own, float)
                own = own / np.abs(own).max()
                out.append((own / np.sqrt((own * own).sum())).astype("<f8").tobytes())
            yield batch[["vec", "has_id", "m", "k1", "k2", "size"]].assign(unit=out)

    # Equal vectors are a class, numbered once it is written down: no id of theirs is a key.
    classes = (
        keyed.filter("embedding is not null").groupBy("k1", "k2")
        .agg(
            F.coalesce(F.min("vec_id"), F.lit(0)).alias("vec"), (F.count("vec_id") > 0).alias("has_id"),
            F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding"),
        )
        .withColumn("size", F.size("embedding"))
        .mapInPandas(unit, "vec long, has_id boolean, m long, k1 long, k2 long, size int, unit binary")
    )
    reps = settle(classes.withColumn("rep", F.monotonically_increasing_id()))
    result = keyed.select("vec_id", "embedding", "k1", "k2")
    sizes = [row["size"] for row in reps.select("size").distinct().collect()]
    found = [_links_of_length(reps.filter(F.col("size") == size), size, threshold, probes) for size in sorted(sizes)]
    if not found:
        return result.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    parts = reduce(DataFrame.unionByName, found)
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    forest = components(parts.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct())
    joined = (
        reps.select("rep", "vec", "has_id", "m", "k1", "k2")
        .join(links.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"), "left")
        .join(forest, F.col("rep") == F.col("id"), "left")
        .select(
            F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.when(F.col("has_id"), F.col("vec")).alias("_vec"),
            (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    named = joined.groupBy(F.col("_component").alias("_part")).agg(F.min("_vec").alias("component_id"))
    joined = joined.join(named, F.col("_component") == F.col("_part"))
    matched = F.col("embedding").isNotNull() & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    own = F.when(F.col("_component").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.join(joined, matched, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
