"""Tall, narrow tables as the R of their QR factorisation, by a tree.

Each task reduces its rows to one small upper triangle by orthogonal steps; triangles
stacked on each other are reduced the same way, first in groups, then to one. Unlike
sums of products this does not square the condition of the columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.shipping import ship_package

#: Groups in which the tasks' triangles meet before the last step.
_GROUPS = 64
_STACK = 4_096


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangular_factor(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """R, as wide as ``columns`` and a constant before them, and the number of rows.

    Rows that miss a value are left out. R has fewer rows than columns when the table has.
    """
    ship_package(df.sparkSession)
    width = len(columns) + 1
    complete = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).na.drop()

    def packed(triangle: np.ndarray, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([triangle.ravel()], pa.list_(pa.float64())), pa.array([rows], pa.int64())], ["triangle", "rows"]
        )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, count = np.zeros((0, width)), 0
        for batch in batches:
            values = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy() for c in batch.columns)])
            count += len(values)
            for at in range(0, len(values), _STACK):
                triangle = _triangle(np.vstack([triangle, values[at : at + _STACK]]))
        if count:
            yield packed(triangle, count)

    def stack(table: pa.Table) -> pa.Table:
        triangles = [np.array(t).reshape(-1, width) for t in table.column("triangle").to_pylist()]
        merged = triangles[0]
        for triangle in triangles[1:]:
            merged = _triangle(np.vstack([merged, triangle]))
        return pa.Table.from_batches([packed(merged, sum(table.column("rows").to_pylist()))])

    schema = "triangle array<double>, rows long"
    small = complete.mapInArrow(reduce, schema)
    grouped = small.groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("_group"))
    # At most one small triangle a group comes back.
    found = grouped.applyInArrow(lambda table: stack(table.select(["triangle", "rows"])), schema).collect()
    triangle, count = np.zeros((0, width)), 0
    for row in sorted(found, key=lambda r: (r.rows, r.triangle)):
        triangle = _triangle(np.vstack([triangle, np.array(row.triangle).reshape(-1, width)]))
        count += row.rows
    return triangle, count


class LeastSquares:
    """Least-norm solution of y on a constant and some columns, from their R with y last."""

    def __init__(self, triangle: np.ndarray, rows: int):
        width = triangle.shape[1] - 1
        left, target = triangle[:, :width], triangle[:, width]
        basis, self.singular, across = np.linalg.svd(left, full_matrices=False)
        limit = np.finfo(float).eps * max(rows, width) * (self.singular.max() if len(self.singular) else 0)
        kept = self.singular > limit
        self.rows, self.width, self.rank = rows, width, int(kept.sum())
        turned = basis.T @ target
        inverse = np.where(kept, 1 / np.where(kept, self.singular, 1), 0)
        self.values = across.T @ (inverse * turned)
        # What the kept directions leave of y, rows below R's columns included.
        rest = target - basis[:, kept] @ turned[kept]
        self.rss = float(rest @ rest)
        self._unscaled = ((across.T * inverse) ** 2).sum(axis=1)

    @property
    def freedom(self) -> int:
        return self.rows - self.rank

    @property
    def errors(self) -> np.ndarray | None:
        """Standard errors; None without rows to spare."""
        return np.sqrt(self._unscaled * self.rss / self.freedom) if self.freedom > 0 else None

    @property
    def condition(self) -> float:
        """Greatest over least singular value; infinite when a direction is missing."""
        full = len(self.singular) == self.width and self.singular.min() > 0
        return float(self.singular.max() / self.singular.min()) if full else float("inf")
