"""Mix sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate between 0 and ``max_repeats``, the tilted form
``max_repeats * sigmoid(dual * size / scale)`` that minimises relative entropy under
"the rates of a source's documents times their sizes add up to its target". One dual
variable per source is found by Newton steps over the counts of (source, size), kept
inside a bracket. Rates become whole copies by carrying the rounding error along the
sizes of a source, so a source misses its target by about one document at most.

Defined results: a null text has size 0 and takes 0 words; null sources form a source
of their own, last in order; repeated rows are separate documents; an empty table gives
an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgauge.llm.tables import WORD, bounded, settled_with_count, whole_text
from reelgauge.session import settle

#: A hot (source, size) is dealt over this many parts.
SALTS = 64
MAX_STEPS = 60


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of the whole text."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(whole_text(docs), F.lit(WORD)).cast("long").alias("size"),
    )


def source_targets(
    totals: DataFrame, weights: Sequence[float], share: float, max_repeats: float
) -> DataFrame:
    """Target of each source: in proportion to its weight, at most ``max_repeats`` sizes.

    The fixed point of resharing the excess is ``min(cap, level * weight)``; the level
    follows from the sources in order of cap per weight. ``totals`` has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = totals.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / heavy)
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    return ranked.select(
        "source",
        "source_size",
        F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"),
        F.col("cap"),
    )


def _rate(dual: Column, size: Column, scale: Column, max_repeats: float) -> Column:
    return max_repeats / (1 + F.exp(-dual * size / scale))


def solve_duals(histogram: DataFrame, targets: DataFrame, sources: int, max_repeats: float) -> DataFrame:
    """source, source_size, target, scale, dual; the dual is null at a target of 0 or the cap.

    Each step is one aggregate over the counts; its one row a source is settled, so a
    lost executor costs a re-read and plans stay short.
    """
    squares = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size") * F.col("size")).alias("_squares")
    )
    share = F.col("target") / F.col("cap")
    open_ended = (F.col("target") > 0) & (share < 1 - 1e-12)
    state = settle(
        targets.join(squares, targets.source.eqNullSafe(squares.source))
        .select(
            targets.source, "source_size", "target", "cap",
            (F.col("_squares") / F.col("source_size")).alias("scale"),
            F.when(open_ended, F.log(share / (1 - share))).alias("dual"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.lit(False).alias("done"),
        )
    )
    for _ in range(MAX_STEPS):
        if not state.filter("dual is not null and not done").limit(1).count():
            break
        part = bounded(state.filter("dual is not null").select(F.col("source").alias("_source"), "dual", "scale"), sources)
        rate = _rate(F.col("dual"), F.col("size"), F.col("scale"), max_repeats)
        words = F.col("n") * F.col("size")
        sums = (
            histogram.join(part, histogram.source.eqNullSafe(part["_source"]))
            .groupBy("_source")
            .agg(
                F.sum(words * rate).alias("_value"),
                F.sum(words * rate * (1 - rate / max_repeats) * F.col("size") / F.col("scale")).alias("_slope"),
            )
        )
        gap = F.col("_value") - F.col("target")
        low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        step = F.col("dual") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), gap / F.col("_slope")))
        inside = (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        done = F.abs(gap) <= 1e-7 * F.col("target")
        moved = F.when(done, F.col("dual")).when(inside, step).otherwise((low + high) / 2)
        state = settle(
            state.join(sums, state.source.eqNullSafe(sums["_source"]), "left").select(
                state.source, "source_size", "target", "cap", "scale",
                F.when(F.col("dual").isNotNull(), F.coalesce(moved, F.col("dual"))).alias("dual"),
                F.when(F.col("dual").isNotNull(), low).alias("low"),
                F.when(F.col("dual").isNotNull(), high).alias("high"),
                F.coalesce(done, F.lit(True)).alias("done"),
            )
        )
    return state


def mix_sources(
    sized: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken.

    ``sized`` has doc_id, source and size. ``share`` times all sizes are dealt to the
    sources by ``weights``, repeated over the sources in code point order.
    """
    salt = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SALTS)).cast("int")
    narrow = settle(sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).alias("size"), salt.alias("_salt")))
    salted = settle(narrow.groupBy("source", "size", "_salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = settle(salted.groupBy("source", "size").agg(F.sum("n").alias("n")))
    totals, sources = settled_with_count(
        histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    )
    targets = settle(source_targets(totals, weights, share, float(max_repeats)))
    duals = bounded(
        solve_duals(histogram, targets, sources, float(max_repeats))
        .select(F.col("source").alias("_source"), "source_size", "target", "cap", "scale", "dual"),
        sources,
    )
    rate = (
        F.when(F.col("size") == 0, F.lit(0.0))
        .when(F.col("dual").isNotNull(), _rate(F.col("dual"), F.col("size"), F.col("scale"), float(max_repeats)))
        .when(F.col("target") > 0, F.lit(float(max_repeats)))
        .otherwise(F.lit(0.0))
    )
    cells = (
        histogram.join(duals, histogram.source.eqNullSafe(duals["_source"]))
        .withColumn("rate", rate)
        .withColumn("base", F.floor("rate"))
        .withColumn("_more", (F.col("rate") - F.col("base")) * F.col("n"))
    )
    along = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.floor(F.sum("_more").over(along.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    cells = cells.withColumn("_upto", upto)
    cells = cells.withColumn("_extra", F.col("_upto") - F.lag("_upto", 1, 0).over(along))
    cells = cells.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("n").alias("_all"),
        "source_size", "target", "rate", "base", "_extra",
    )
    within = Window.partitionBy("source", "size").orderBy("_salt")
    upto = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    parts = salted.join(cells, salted.source.eqNullSafe(cells["_source"]) & (salted.size == cells["_size"]))
    parts = parts.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_salt").alias("_part"),
        "source_size", "target", "rate", "base",
        (F.floor(F.col("_extra") * upto / F.col("_all")) - F.floor(F.col("_extra") * (upto - F.col("n")) / F.col("_all"))).alias("_quota"),
    )
    joined = narrow.join(
        parts,
        narrow.source.eqNullSafe(parts["_source"])
        & (narrow.size == parts["_size"])
        & (narrow["_salt"] == parts["_part"]),
    )
    turn = F.row_number().over(
        Window.partitionBy("source", "size", "_salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    )
    copies = (F.col("base") + (turn <= F.col("_quota")).cast("long")).cast("int")
    return joined.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
