"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Terms are word shingles, weighted by how often they occur. A term with weight w draws
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash alone; with
t = floor(ln w / r + b) its key is ln c - r (t - b + 1). The occurrences of a
term are dealt by hash over ``slots`` strata, the first, second, ... always alike, so
sums of least and greatest weights over the strata are those over the terms. In each
stratum the term of least key is sampled and (term, t) is the slot's value: two documents
agree in it with a probability equal to the generalised Jaccard similarity of their
weights there. The share of agreeing slots among those that either fills so estimates
the similarity of the documents, with one evaluation for each term and stratum.

Shingles are array work within a row. The one shuffle of texts deals documents by ranges
of doc_id, so each meets its neighbour in falling order, and sampling stays in a range.

Defined results: a null text is empty; an empty text fills no slot, is like another
empty one (1.0) and unlike any other (0.0); rows that repeat a doc_id are ordered by
text; rows without doc_id come last in the falling order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgauge.llm.tables import lower_ascii, whole_text

SHINGLE = 5
SLOTS = 64
#: Documents in a range at which the number of ranges is aimed, and that number's bound.
RANGE_ROWS, RANGES = 512, 1024
#: Keys lie in this range; the least is found to 31 bits.
_LOW, _SPAN = -40.0, 48.0
_EMPTY = "........"


def _high(x: Column) -> Column:
    return (F.shiftrightunsigned(x, 32) + 0.5) / float(2**32)


def _low(x: Column) -> Column:
    return (x.bitwiseAND(F.lit(2**32 - 1)) + 0.5) / float(2**32)


def _terms(df: DataFrame, text: str, name: str, slots: int) -> DataFrame:
    """``df`` with ``name``: (term, slot, weight) of every term of the text in every stratum."""
    words, grams, ends = (f"_{name}_{x}" for x in ("words", "grams", "ends"))
    n = F.size(words)
    df = df.withColumn(words, F.split(F.btrim(lower_ascii(F.col(text)), F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+"))
    df = df.withColumn(words, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    df = df.withColumn(
        grams,
        F.sort_array(
            F.when(
                n >= SHINGLE,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]),
                ),
            )
            .when(n > 0, F.array(F.xxhash64(F.lit(-1), words)))
            .otherwise(F.array().cast("array<bigint>"))
        ),
    )
    # Where the run of each term in the sorted array ends.
    last = F.transform(grams, lambda h, i: F.when(F.get(F.col(grams), i + 1) == h, F.lit(0)).otherwise(i + 1))
    df = df.withColumn(ends, F.filter(last, lambda e: e > 0))

    def part(term: Column, slot: Column, weight: Column) -> Column:
        return F.struct(term.alias("term"), slot.cast("int").alias("slot"), weight.cast("int").alias("weight"))

    def slot_of(term: Column, occurrence: Column) -> Column:
        return F.pmod(F.xxhash64(term, occurrence), F.lit(slots)).cast("int")

    def deal(end: Column, k: Column) -> Column:
        term = F.get(F.col(grams), end - 1)
        weight = end - F.when(k == 0, F.lit(0)).otherwise(F.get(F.col(ends), k - 1))
        taken = F.transform(F.sequence(F.lit(1), weight), lambda j: slot_of(term, j))
        counted = F.transform(F.array_distinct(taken), lambda s: part(term, s, F.size(F.filter(taken, lambda o: o == s))))
        return F.when(weight == 1, F.array(part(term, slot_of(term, F.lit(1)), F.lit(1)))).otherwise(counted)

    # Most texts hold every term once; then nothing has to be counted.
    once = F.transform(grams, lambda h: part(h, slot_of(h, F.lit(1)), F.lit(1)))
    dealt = F.when(F.size(ends) == F.size(grams), once).otherwise(F.flatten(F.transform(ends, deal)))
    return df.withColumn(name, dealt)


def _sampled(terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slots: for each filled slot, in order, ``slot << 32 | value``."""
    one, two, three = (F.xxhash64("term", "slot", F.lit(i)) for i in (1, 2, 3))
    drawn = terms.select(*keys, "term", "slot", "weight", one.alias("_1"), two.alias("_2"), three.alias("_3"))
    drawn = drawn.select(
        *keys, "term", "slot", "weight",
        (-F.log(_high(F.col("_1")) * _low(F.col("_1")))).alias("_r"),
        F.log(-F.log(_high(F.col("_2")) * _low(F.col("_2")))).alias("_ln_c"),
        _high(F.col("_3")).alias("_b"),
    )
    drawn = drawn.withColumn("_t", F.floor(F.log("weight") / F.col("_r") + F.col("_b")))
    key = F.col("_ln_c") - F.col("_r") * (F.col("_t") - F.col("_b") + 1)
    step = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (key - _LOW) / _SPAN)) * (2**31 - 1))
    value = F.xxhash64("term", "_t").bitwiseAND(F.lit(2**32 - 1))
    least = drawn.groupBy(*keys, "slot").agg(F.min(F.shiftleft(step, 32).bitwiseOR(value)).alias("_least"))
    kept = F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(F.col("_least").bitwiseAND(F.lit(2**32 - 1)))
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), kept))).alias("slots"))


def fingerprint_text(slots_filled: str, slots: int = SLOTS) -> Column:
    """Eight hexadecimal digits a slot, dots where it is empty.

    Filled slots are in order, so what is missing before each and after the last is known
    from its neighbour: one pass, whatever is empty.
    """
    number = lambda x: F.shiftrightunsigned(x, 32).cast("int")
    held = F.col(slots_filled)

    def shown(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(number(F.get(held, i - 1)))
        empty = F.repeat(F.lit(_EMPTY), number(x) - before - 1)
        return F.concat(empty, F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(2**32 - 1))), 8, "0")))

    last = F.coalesce(number(F.try_element_at(held, F.lit(-1))), F.lit(-1))
    return F.concat(F.array_join(F.transform(held, shown), ""), F.repeat(F.lit(_EMPTY), F.lit(slots - 1) - last))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing slots among those that either fills."""
    slot_of = lambda x: F.shiftrightunsigned(x, 32)
    either = F.size(F.array_union(F.transform(a, slot_of), F.transform(b, slot_of)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either).cast("double")


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` with ``_range``: ranges of doc_id, rising; rows without id in the lowest."""
    splits = docs.agg(
        F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 2 * ranges).alias("s")
    ).first()["s"] if ranges > 1 else []
    splits = sorted(set(splits or []))
    coarse = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + coarse] for i in range(0, len(splits), coarse)]
    if not groups:
        return docs.withColumn("_range", F.lit(0))
    above = lambda edges: F.size(F.filter(edges, lambda s: F.col("doc_id") >= s))
    longs = lambda edges: F.array(*[F.lit(int(s)).cast("long") for s in edges])
    group = F.greatest(above(longs([g[0] for g in groups])) - 1, F.lit(0))
    within = F.element_at(F.array(*[longs(g) for g in groups]), group + 1)
    return docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(group * coarse + above(within)))


def with_next(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) and, by falling doc_id, the text after it; after the last the first.

    The first row of each range is copied into the range before it as ``_guest``, so
    ranges are worked on apart.
    """
    ranges = max(1, min(RANGES, -(-docs.count() // RANGE_ROWS)))
    rows = _in_ranges(docs, ranges)
    heads = rows.groupBy("_range").agg(F.max("doc_id").alias("_head"))
    rising = Window.orderBy("_range")
    heads = heads.withColumns(
        {"_to": F.lead("_range").over(rising), "_lowest": F.min("_range").over(Window.partitionBy())}
    ).select("_range", "_head", F.coalesce("_to", "_lowest").alias("_to"))
    host = F.broadcast(heads.select(F.col("_range").alias("_of"), "_head", "_to"))
    guests = (
        rows.join(host, (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_head")))
        .groupBy("_to").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"))
        .select("doc_id", "text", F.col("_to").alias("_range"), F.lit(True).alias("_guest"))
    )
    both = rows.select("doc_id", "text", "_range", F.lit(False).alias("_guest")).unionByName(guests)
    falling = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return both.withColumns({"_next": F.lead("text").over(falling), "_turn": F.row_number().over(falling)})


def fingerprint_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    narrow = docs.select(F.col("doc_id").cast("long"), whole_text(docs).alias("text"))
    rows = with_next(narrow)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("_edited", F.when(F.col("_guest"), F.lit("")).otherwise(edited))
    facts = rows.select(
        "_range", "_turn", "_guest", "doc_id", n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
    )
    # Both texts of a document one after the other; ranges stay where they are, so the
    # sums below need no shuffle. The outer form keeps empty texts, and keeps the
    # optimizer from moving a test of the array below the steps that make it.
    both = F.array(*[
        F.struct(F.lit(i).alias("which"), F.col(c).alias("words")) for i, c in enumerate(("text", "_edited"))
    ])
    texts = rows.select("_range", "_turn", F.explode(both).alias("_x"))
    texts = texts.select("_range", "_turn", F.col("_x.which").alias("_which"), F.col("_x.words").alias("_text"))
    terms = _terms(texts, "_text", "_terms", slots).select("_range", "_turn", "_which", F.inline_outer("_terms"))
    sampled = _sampled(terms, ["_range", "_turn", "_which"]).groupBy("_range", "_turn").agg(
        F.max(F.when(F.col("_which") == 0, F.col("slots"))).alias("_own"),
        F.max(F.when(F.col("_which") == 1, F.col("slots"))).alias("_other"),
    )
    rows = facts.join(sampled, ["_range", "_turn"])
    after = F.lead("_own").over(Window.partitionBy("_range").orderBy("_turn"))
    return rows.withColumn("_after", after).filter(~F.col("_guest")).select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text("_own", slots).alias("fingerprint"),
        fingerprint_text("_other", slots).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )
