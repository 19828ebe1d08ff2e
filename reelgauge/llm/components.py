"""Connected components of an edge table by alternating large and small stars.

Every step is one aggregate and one join by key; a hub's rows sit on the side of the
join that adaptive execution can split. Each round is settled, so plans stay short and
a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_least"))
    joined = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_least"))
    hung = down.join(least, "a").filter(F.col("b") != F.col("_least"))
    return (
        hung.select(F.col("b").alias("a"), F.col("_least").alias("b"))
        .unionByName(least.select("a", F.col("_least").alias("b")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every node of (a, b) that has an edge."""
    stars = settle(_small_star(edges.filter(F.col("a") != F.col("b"))))
    state = _state(stars)
    while True:
        stars = settle(_small_star(_large_star(stars)))
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
