"""Links, components and kept flags against all pairs, with odd ids and several lengths."""

import numpy as np
from pyspark.sql import functions as F

from reelgauge.llm import vectors
from reelgauge.llm.shipping import ship


def plain(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of each row by comparing all pairs."""
    units = []
    for _, v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    found = []
    for i, (vec, _) in enumerate(rows):
        ids = [v for j, (v, _) in enumerate(rows) if root(j) == root(i) and v is not None]
        component = min(ids) if ids else None
        found.append((vec, links[i], component, vec is not None and vec == component))
    return sorted(found, key=str)


def test_every_row_matches_all_pairs(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = []
    for size, count in ((8, 300), (5, 60), (3, 7)):
        centres = rng.normal(size=(max(2, count // 12), size))
        picked = centres[rng.integers(0, len(centres), count)] + 0.18 * rng.normal(size=(count, size))
        rows += [(int(rng.integers(0, 400)), v.tolist()) for v in picked]  # ids repeat, over lengths too
    rows += rows[:15] + [(None, rows[0][1]), (None, rows[1][1]), (None, [9.0, -9.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])]
    rows += [(3, None), (None, None), (4, [0.0] * 8), (5, [1.0, None]), (6, [float("nan")] * 3), (7, [float("inf"), 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rep": F.lit(1), "m": F.lit("own")})
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df.repartition(3)).collect()]
    assert sorted(found, key=str) == plain(rows)
