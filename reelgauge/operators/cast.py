"""Star power of a film's cast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.constants import LEAD_WEIGHT, SUPPORT_WEIGHT


def _film_score(imdb: Column, critics: Column) -> Column:
    return F.coalesce(imdb, F.lit(0.0)) + F.coalesce(critics, F.lit(0.0))


def billed_actors(cast: Column) -> Column:
    """Array of (actor, weight) in billing order; empty without a cast."""
    names = F.filter(F.split(cast, ","), lambda _: F.length(cast) > 0)
    weight = lambda place: F.when(place == 0, LEAD_WEIGHT).otherwise(SUPPORT_WEIGHT)
    billed = F.transform(
        names,
        lambda name, place: F.struct(F.trim(name).alias("actor"), weight(place).alias("weight")),
    )
    return F.coalesce(billed, F.lit([]).cast("array<struct<actor:string,weight:double>>"))


def star_power_map(imdb: Column, critics: Column, cast: Column) -> Column:
    """Map of actor to score, averaged over repeats of a name in one cast."""
    billed = billed_actors(cast)
    score = _film_score(imdb, critics)
    names = F.array_distinct(F.transform(billed, lambda entry: entry["actor"]))

    def mean_weight(name: Column) -> Column:
        held = F.filter(billed, lambda entry: entry["actor"] == name)
        total = F.aggregate(held, F.lit(0.0), lambda acc, entry: acc + entry["weight"])
        return total / F.size(held)

    scores = F.transform(names, lambda name: score * mean_weight(name))
    rated = imdb.isNotNull() | critics.isNotNull()
    return F.when(rated, F.map_from_arrays(names, scores))


def total_star_power(power: Column) -> Column:
    """Sum over a star-power map, 0 without one."""
    total = F.aggregate(F.map_values(power), F.lit(0.0), lambda acc, score: acc + score)
    return F.coalesce(total, F.lit(0.0))


def star_power_table(
    df: DataFrame,
    title_col: str = "title",
    imdb_col: str = "imdb_rating",
    critics_col: str = "rt_0_10",
    cast_col: str = "cast",
) -> DataFrame:
    """Long form: one row per (title, actor)."""
    power = star_power_map(F.col(imdb_col), F.col(critics_col), F.col(cast_col))
    return df.select(title_col, F.explode(power).alias("actor", "star_power"))
