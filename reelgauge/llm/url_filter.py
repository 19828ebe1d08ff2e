"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Listed are rules, each a (host, path) that a verdict holds for with all subdomains and
all paths that begin so, and canonical URLs, each blocked as a whole. A URL has one key
for each shape (labels of the host, characters of the path) that some rule has, and one
for its canonical form. The filter holds the keys of the list: blocks of eight 32-bit
words, one bit a word and key, so a lookup reads one block. Its size follows the list up
to ``FILTER_BYTES``; a longer list lets more false positives pass, which costs time and
no result. URLs without a possible key are done with no shuffle at all; of the others
the distinct (host, path, key) are joined with the list by key, which removes false
positives, and the verdicts return to the pages by (host, path).

Defined results: the host is what lies between the first ``://`` and the next ``/``,
``?``, ``#`` or the end, A-Z in lower case; the path what follows it up to ``?``, ``#``
or the end; both are empty for a null URL and one without ``://``. The rule with the
longest text wins; of equally long ones that with the longer host, then block. Without a
rule a listed URL is blocked and any other allowed. Repeated rows and rows without id
are judged each; texts of any length are taken whole; an empty table gives an empty
result. Other columns of the pages are kept, unless named host, path, rule or verdict,
which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.tables import lower_ascii
from reelgauge.session import settle

#: Bits of the filter for each listed key, and its size at most.
KEY_BITS, FILTER_BYTES = 16, 16 << 20
_WORDS, _WORD_BITS = 8, 32
_RULE, _URL = "^", "="
#: Host labels and endings of a path that do not tell pages apart.
_SAME_SITE, _SAME_PAGE = r"^(www|m)\.", r"(/index)?(\.html?)?/*$"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(host: Column, path: Column) -> Column:
    """Host and path without the parts that spell one page in several ways."""
    return F.concat(F.regexp_replace(host, _SAME_SITE, ""), F.regexp_replace(path, _SAME_PAGE, ""))


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, verdict, rule, labels, chars: one row for each listed key; block wins a tie."""
    host, path = lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))
    text = F.concat(host, path)
    ruled = rules.filter(F.col("host").isNotNull()).select(
        F.concat(F.lit(_RULE), text).alias("key"), "verdict", text.alias("rule"),
        F.size(F.split(host, r"\.", -1)).alias("labels"), F.char_length(path).alias("chars"),
    )
    urls = listed.filter(F.col("canonical").isNotNull()).select(
        F.concat(F.lit(_URL), "canonical").alias("key"), F.lit("block").alias("verdict"),
        F.lit(None).cast("string").alias("rule"), F.lit(0).alias("labels"), F.lit(0).alias("chars"),
    )
    shape = ["key", "rule", "labels", "chars"]
    return ruled.unionByName(urls).groupBy(*shape).agg(F.max("verdict").alias("verdict"))


def url_keys(shapes: list[tuple[int, int]]) -> Column:
    """Keys under which a (host, path) can be listed."""
    parts = F.split("host", r"\.", -1)

    def prefix(shape: Column) -> Column:
        suffix = F.slice(parts, F.size(parts) - shape["labels"] + 1, shape["labels"])
        return F.concat(F.lit(_RULE), F.array_join(suffix, "."), F.substring("path", F.lit(1), shape["chars"]))

    def fits(shape: Column) -> Column:
        return (shape["labels"] <= F.size(parts)) & (shape["chars"] <= F.char_length("path"))

    known = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("chars")) for k, n in shapes])
    prefixes = F.transform(F.filter(known, fits), prefix) if shapes else F.array().cast("array<string>")
    return F.concat(prefixes, F.array(F.concat(F.lit(_URL), canonical_url(F.col("host"), F.col("path")))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """A second hash; five bits of it choose the bit of each word."""
    return F.xxhash64(key, F.lit(1))


def build_filter(entries: DataFrame, count: int) -> np.ndarray:
    """Blocks x 8 words of 32 bits that hold every key; made by one aggregate by block."""
    blocks = max(1, min(count * KEY_BITS // 256 + 1, FILTER_BYTES // 32))
    at = entries.select(_block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("bits"))

    def word(i: int) -> Column:
        place = F.shiftrightunsigned("bits", 5 * i).bitwiseAND(F.lit(_WORD_BITS - 1)).cast("int")
        return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias(f"w{i}")

    found = at.groupBy("block").agg(*[word(i) for i in range(_WORDS)]).toPandas()
    words = np.zeros((blocks, _WORDS), np.uint32)
    words[found["block"].to_numpy(np.int64)] = found[[f"w{i}" for i in range(_WORDS)]].to_numpy(np.int64)
    return words


def passed_keys(df: DataFrame, keys: str, words: np.ndarray) -> DataFrame:
    """``df`` with only those of its ``keys`` that the filter may hold."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    hashed = F.transform(keys, lambda k: _block(k, len(words))), F.transform(keys, _bits)
    shifts = np.arange(_WORDS, dtype=np.uint64) * np.uint64(5)

    @F.pandas_udf("array<boolean>")
    def may_hold(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        for blocks, bits in parts:
            sizes = blocks.map(len).to_numpy(np.int64)
            if not sizes.sum():
                yield pd.Series([[] for _ in sizes], index=blocks.index)
                continue
            at = np.concatenate(blocks.to_numpy())
            places = (np.concatenate(bits.to_numpy()).astype(np.uint64)[:, None] >> shifts) & np.uint64(31)
            held = (((table[at] >> places.astype(np.uint32)) & np.uint32(1)) == 1).all(axis=1)
            yield pd.Series(np.split(held, np.cumsum(sizes)[:-1]), index=blocks.index)

    found = df.withColumn("_held", may_hold(*hashed))
    kept = F.filter(F.arrays_zip(F.col(keys).alias("key"), F.col("_held").alias("held")), lambda x: x["held"])
    return found.withColumn(keys, F.transform(kept, lambda x: x["key"])).drop("_held")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` is (host, path, verdict), ``listed`` (canonical) as ``canonical_url`` makes
    it; either may be of any length.
    """
    entries = settle(_entries(rules, listed))
    shapes = entries.filter("rule is not null").select("labels", "chars").distinct().collect()
    words = build_filter(entries, entries.count())
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.struct(*own).alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumn("keys", url_keys(sorted(tuple(s) for s in shapes)))
    tested = settle(passed_keys(parsed, "keys", words))

    # Only distinct possible keys are joined, so a rule that fits a third of all pages
    # meets each of their addresses once.
    hit = F.size("keys") > 0
    possible = tested.filter(hit).select("host", "path", F.explode("keys").alias("key")).distinct()
    rank = F.struct(
        F.col("rule").isNotNull(), F.char_length("rule"), -F.col("chars"), F.col("verdict"), F.col("rule")
    )
    judged = possible.join(entries, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), rank).alias("_judged")
    )
    none = F.lit(None).cast("string")
    missed = tested.filter(~hit).select("_row", "host", "path", none.alias("rule"), F.lit("allow").alias("verdict"))
    met = tested.filter(hit).join(judged, ["host", "path"], "left").select(
        "_row", "host", "path", F.col("_judged.rule").alias("rule"),
        F.coalesce("_judged.verdict", F.lit("allow")).alias("verdict"),
    )
    return missed.unionByName(met).select("_row.*", "host", "path", "rule", "verdict")
