"""Near-duplicate classes by an exact n-gram Jaccard join of tiles with bitmap signatures.

Documents of equal shingle sets are one class with one representative. Two sets that
link share a shingle of their prefixes (the first ``n - ceil(t n) + 1`` in one order of
all shingles: those met often last, then by hash), so only sets that meet in a prefix
shingle are compared, and only within a size band. A bitmap of two to four bits a
shingle bounds an overlap from above: each bit of one set that the other lacks is a
shingle that the other lacks. Pairs that pass are intersected as sorted arrays.

No group is expanded into all pairs. First every set of a group is compared with the
group's first set; sets that link form components. In groups with several components
left, the sets of other components are then compared with the set that has most links so
far, which is the original of most near copies. At last, in groups with several
components still, tiles of sets are compared by bitmap across components only. Every
link is found or joins sets that are connected already, so the components are exact.

Defined results: a null or blank text has an empty set, links with nothing and is its
own component; repeated rows are documents with equal sets; a component of documents
without an id is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.llm.chunks import releasing
from reelgauge.llm.components import components
from reelgauge.llm.tables import bounded, whole_text
from reelgauge.llm.word_ngrams import WordHashes
from reelgauge.session import settle

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles known as frequent at most; they only set the order, never the result.
FREQUENT = 100_000
#: Members of a tile's side.
TILE = 256
#: Groups of a set that go along with it at most, so that its pairs are given out once.
LISTED = 128


@cache
def _hashes() -> WordHashes:
    return WordHashes()


def _held():
    return _hashes().numbered


def _frequent_shingles(docs: DataFrame, size: int) -> DataFrame:
    """token, n: shingles met at least three times by one task, with the sum of such counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            sets = list(_hashes().shingles(batch.column(0).to_pylist(), size))
            flat = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[starts, len(flat)])
            often = counts >= 3
            for token, n in zip(flat[starts[often]].tolist(), counts[often].tolist(), strict=True):
                held[token] = held.get(token, 0) + n
            if len(held) > 1_000_000:
                yield _counted(held)
                held = {}
        yield _counted(held)

    narrow = docs.select(whole_text(docs).alias("text"))
    return narrow.mapInArrow(releasing(count, _held), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _counted(held: dict[int, int]) -> pa.RecordBatch:
    tokens = np.fromiter(held.keys(), np.uint64, len(held)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(tokens), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["token", "n"]
    )


def bitmap(own: np.ndarray) -> np.ndarray:
    """Bits of a set's shingles in a power of two that is two to four times its size."""
    width = max(64, 1 << int(2 * len(own) - 1).bit_length()) if len(own) else 64
    bits = np.zeros(width, np.uint8)
    bits[(own & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one a row) of the same sets in ``words`` 64-bit words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def in_band(n_a, n_b, percent: int = PERCENT):
    """Whether sets of these sizes can link."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def may_link(n_a, n_b, only_a, only_b, percent: int = PERCENT):
    """Whether the overlap's upper bound, given bits only in a and only in b, allows a link."""
    most = np.minimum(n_a - only_a, n_b - only_b)
    return (100 + percent) * most >= percent * (n_a + n_b)


SETS = "doc_id long, n int, s1 long, s2 long, prefix binary, bits binary"


def _sets(docs: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """Size, identity, prefix and bitmap of every document's set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tokens, weights = frequent.value
        for batch in batches:
            rows = []
            for own in _hashes().shingles(batch.column(1).to_pylist(), size):
                n = len(own)
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
                need = n - (percent * n + 99) // 100 + 1
                first = own
                if n and len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    known = tokens[at] == own
                    if known.any():
                        weight = np.where(known, weights[at], 0)
                        first = own[np.lexsort((own, weight))]
                rows.append((n, int(digest[0]), int(digest[1]), first[: need if n else 0].tobytes(), bitmap(own).tobytes()))
            n, s1, s2, prefix, bits = zip(*rows) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                    pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()),
                ],
                names=["doc_id", "n", "s1", "s2", "prefix", "bits"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text(docs).alias("text"))
    return narrow.mapInArrow(releasing(build, _held), SETS)


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = [np.frombuffer(p, "<i8") for p in batch.column(2).to_pylist()]
        sizes = np.array([len(p) for p in prefixes], np.int64)
        if not sizes.sum():
            continue
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(prefixes)),
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)),
                pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)),
            ],
            names=["token", "rep", "n"],
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole token groups from batches sorted by token."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(tokens, tokens[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    return starts, np.diff(np.r_[starts, len(tokens)])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups of two or more, each with the group's first member; ``more``: of three or more."""
    for table in _groups(batches):
        token, rep, n = (c.to_numpy() for c in table.columns)
        starts, sizes = _runs(token)
        keep = np.repeat(sizes >= 2, sizes)
        first = np.repeat(starts, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (token, rep, n, rep[first], n[first], np.repeat(sizes >= 3, sizes))],
            names=["token", "rep", "n", "first", "first_n", "more"],
        )


def _pivots(percent: int):
    """Each set of a group beside the group's set of most links, if of another component."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            token, rep, n, part, links = (c.to_numpy() for c in table.columns)
            _, sizes = _runs(token)
            order = np.lexsort((rep, -links, token))
            chosen = np.repeat(order[np.cumsum(sizes) - sizes], sizes)
            keep = (part != part[chosen]) & in_band(n.astype(np.int64), n[chosen].astype(np.int64), percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (rep[chosen], rep, n[chosen], n)], names=["a", "b", "n_a", "n_b"]
            )

    return pair


def _passes(percent: int):
    """Keep the pairs whose bitmaps allow a link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            bits = [batch.column(i).to_pylist() for i in (4, 5)]
            widths = np.array([[len(x) // 8 for x in side] for side in bits], np.int64).reshape(2, -1)
            keep = np.zeros(batch.num_rows, bool)
            # Bitmaps of one pair of widths are compared as matrices.
            for wide in np.unique(widths, axis=1).T:
                at = np.flatnonzero((widths == wide[:, None]).all(axis=0))
                x, y = (
                    folded(np.frombuffer(b"".join([side[i] for i in at]), "<u8").reshape(len(at), width), int(wide.min()))
                    for side, width in zip(bits, wide, strict=True)
                )
                only_x, only_y = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x)))
                keep[at] = may_link(n_a[at], n_b[at], only_x, only_y, percent)
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return check


def _intersects(percent: int):
    """Keep the pairs whose sorted arrays link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for own, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(own, "<u8"), np.frombuffer(other, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return check


def _linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of settled ``pairs`` that link, by intersecting their sorted arrays."""
    wanted = settle(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.tobytes() for s in _hashes().shingles(batch.column(1).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["rep", "own"])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text(docs).alias("text"))
    sets = settle(
        texts.join(bounded(wanted, wanted.count()), "doc_id").mapInArrow(releasing(build, _held), "rep long, own binary")
    )
    joined = (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("own_a")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("own").alias("own_b")), "b")
        .select("a", "b", "own_a", "own_b")
    )
    return settle(joined.mapInArrow(_intersects(percent), "a long, b long"))


def _tiles(percent: int):
    """Pairs (a < b) across components whose bitmaps allow a link, tile by tile.

    A pair of sets that both list their groups is given out in the least common one only.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            token = table.column(0).to_numpy()
            starts, sizes = _runs(token)
            for start, count in zip(starts.tolist(), sizes.tolist(), strict=True):
                rows = table.slice(start, count).sort_by("n")
                rep, n, part = (rows.column(i).to_numpy() for i in (1, 2, 3))
                bits = [np.frombuffer(x, "<u8") for x in rows.column(4).to_pylist()]
                listed = rows.column(5)
                known: dict[int, set[int] | None] = {}

                def here(i: int, j: int, listed=listed, known=known, own=int(token[start])) -> bool:
                    for k in (i, j):
                        if k not in known:
                            groups = listed[k].as_py()
                            known[k] = None if groups is None else set(groups)
                    return known[i] is None or known[j] is None or min(known[i] & known[j]) == own

                tiles = _bands([len(x) for x in bits])
                for at, own in enumerate(tiles):
                    for other in tiles[at:]:
                        largest, smallest = n[own.stop - 1], n[other.start]
                        if smallest > largest and not in_band(largest, smallest, percent):
                            break
                        a, b = _tile(n, part, bits, own, other, own is other, percent)
                        first = [here(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                        a, b = a[first], b[first]
                        if len(a):
                            ends = np.sort([rep[a], rep[b]], axis=0)
                            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return compare


def _bands(widths: list[int]) -> list[slice]:
    """Runs of one bitmap width, cut into tiles."""
    found, start = [], 0
    for i in range(1, len(widths) + 1):
        if i == len(widths) or i - start == TILE or widths[i] != widths[start]:
            found.append(slice(start, i))
            start = i
    return found


def _tile(n, part, bits, rows: slice, columns: slice, same: bool, percent: int):
    words = min(min(map(len, bits[rows])), min(map(len, bits[columns])))
    x = np.stack([folded(v, words) for v in bits[rows]])
    y = np.stack([folded(v, words) for v in bits[columns]])
    only_x = np.zeros((len(x), len(y)), np.int64)
    only_y = np.zeros((len(x), len(y)), np.int64)
    for w in range(words):
        left, right = x[:, w, None], y[None, :, w]
        only_x += np.bitwise_count(left & ~right)
        only_y += np.bitwise_count(right & ~left)
    n_x, n_y = n[rows].astype(np.int64)[:, None], n[columns].astype(np.int64)[None, :]
    ok = may_link(n_x, n_y, only_x, only_y, percent) & in_band(n_x, n_y, percent)
    ok &= part[rows][:, None] != part[columns][None, :]
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    a, b = np.nonzero(ok)
    return a + rows.start, b + columns.start


def _one_of_equal_groups(rows: DataFrame) -> DataFrame:
    """Rows of groups, of those with the same sets only one: near copies share most shingles.

    Groups are told apart by their size and 128 bits of their members' hashes.
    """
    members = [F.bit_xor(F.xxhash64("rep", F.lit(seed))) for seed in (1, 2)]
    groups = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), members[0].alias("_x"), members[1].alias("_y"))
    kept = groups.groupBy("_n", "_x", "_y").agg(F.min("token").alias("token")).select("token")
    return rows.join(kept, "token", "left_semi")


def ngram_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark: SparkSession = docs.sparkSession
    often = _frequent_shingles(docs, size).orderBy(F.col("n").desc(), "token").limit(FREQUENT).toPandas()
    tokens = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], often["n"].to_numpy(np.int64)[order]))
    sets = settle(_sets(docs, size, percent, frequent))
    reps = settle(
        sets.filter("n > 0 and doc_id is not null").groupBy("s1", "s2")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    )
    met = settle(
        reps.select("rep", "n", "prefix").mapInArrow(_prefix_rows, "token long, rep long, n int")
        .repartition("token").sortWithinPartitions("token", "rep")
        .mapInArrow(_meetings, "token long, rep long, n int, first long, first_n int, more boolean")
    )
    bits = reps.select("rep", "bits")

    def pass_bitmaps(pairs: DataFrame) -> DataFrame:
        joined = (
            pairs.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a")), "a")
            .join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("bits_b")), "b")
            .select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        )
        return settle(joined.mapInArrow(_passes(percent), "a long, b long"))

    near = F.lit(100) * F.least("n", "first_n") >= F.lit(percent) * F.greatest("n", "first_n")
    stars = (
        met.filter((F.col("first") != F.col("rep")) & near)
        .select(F.col("first").alias("a"), F.col("rep").alias("b"), F.col("first_n").alias("n_a"), F.col("n").alias("n_b"))
        .distinct()
    )
    links = _linked(pass_bitmaps(stars), docs, size, percent)
    parts = settle(components(links))

    def divided(rows: DataFrame) -> DataFrame:
        """Rows of the groups in which several components meet, with each row's component."""
        named = rows.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
            "token", "rep", "n", F.coalesce("component", "rep").alias("part")
        )
        several = named.groupBy("token").agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
        return settle(named.join(several.filter("_low <> _high").select("token"), "token", "left_semi"))

    left = divided(_one_of_equal_groups(met.filter("more")))
    degrees = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    pivots = (
        left.join(degrees, "rep", "left").select("token", "rep", "n", "part", F.coalesce("links", F.lit(0)).alias("links"))
        .repartition("token").sortWithinPartitions("token")
        .mapInArrow(_pivots(percent), "a long, b long, n_a int, n_b int").distinct()
    )
    links = _linked(pass_bitmaps(pivots), docs, size, percent)
    parts = settle(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)))
    left = divided(left.drop("part"))
    # Long lists stay behind, as they would be as many as they are long: pairs of such sets
    # are given out in each group they meet in, 16 bytes a pair, and made one here.
    groups = left.groupBy("rep").agg(F.collect_list("token").alias("tokens"))
    groups = groups.withColumn("tokens", F.when(F.size("tokens") <= LISTED, F.col("tokens")))
    tiled = (
        left.join(groups, "rep").join(bits, "rep").select("token", "rep", "n", "part", "bits", "tokens")
        .repartition("token").sortWithinPartitions("token")
        .mapInArrow(_tiles(percent), "a long, b long").distinct()
    )
    more = _linked(settle(tiled), docs, size, percent)
    final = settle(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))
    named = reps.select("s1", "s2", "rep").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
    classes = named.select(
        F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("component", "rep").alias("component_id")
    )
    return (
        sets.select("doc_id", "n", "s1", "s2")
        .join(classes, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") > 0), "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
