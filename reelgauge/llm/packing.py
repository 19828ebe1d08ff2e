"""Best-fit packing of token sequences by a grouping genetic algorithm.

``token_pieces`` cuts documents into pieces of at most ``capacity`` tokens;
``pack_pieces`` assigns the pieces to sequences. Pieces are dealt by hash into blocks of
about ``block_pieces``; each block is evolved on several islands. A crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold the same
pieces, and best-fits the displaced pieces, largest first. After each epoch the best
solution of an island moves to the next island of its block through a shuffle. The
least filled bins of all blocks are then opened and packed again in blocks of their own.

Defined results: a null text is an empty text, whose one piece is the end token; rows
that repeat are pieces of their own; an empty table gives an empty result; other columns
of the documents are ignored, those of the pieces are kept.
"""

from __future__ import annotations

import bisect
import math
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgauge.llm.chunks import Numbered, ragged_places, releasing, slices, split_chunks
from reelgauge.llm.tables import whole_text
from reelgauge.llm.token_counts import word_merges
from reelgauge.session import settle

CAPACITY = 4096
BLOCK_PIECES = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 10
#: Share of a block's bins that is opened and packed again with those of other blocks.
REOPENED = 0.03


class ChunkIds:
    """Token ids of each chunk, found once while the chunk is held."""

    def __init__(self, path: str):
        self.merges = word_merges(path)
        self.library = self.merges.library
        self.numbered = Numbered(self.learn, self.forget)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.flat = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def ids(self, chunk: str) -> bytes:
        """The library's ids: of the whole chunk if it holds a special string, else by pre-token."""
        if "<|" in chunk and any(s in chunk for s in self.merges.specials):
            return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        found = []
        for word in self.merges.pretokens(chunk):
            own = self.words.get(word)
            if own is None:
                own = self.words[word] = array("I", [t.id for t in self.library.model.tokenize(word)]).tobytes()
            found.append(own)
        return b"".join(found)

    def learn(self, chunks: list[bytes]) -> None:
        ids = [self.ids(c.decode("utf-8")) for c in chunks]
        lengths = np.array([len(i) for i in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.flat = np.r_[self.flat, flat]

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        for start, end in slices(texts):
            cut = [split_chunks(t) for t in texts[start:end]]
            numbers = self.numbered.number(cut)
            lengths = self.lengths[numbers]
            flat = self.flat[ragged_places(self.starts[numbers], lengths)]
            upto = np.r_[0, np.cumsum(lengths)][np.cumsum([0] + [len(cs) for cs in cut])]
            for i in range(end - start):
                yield flat[upto[i] : upto[i + 1]]


@cache
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece.

    A document's ids are those of the whole text and then ``end_id``. Only longer ones
    are cut, each ``capacity`` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_ids = _chunk_ids(tokenizer)
        for batch in batches:
            owners, numbers, starts, sizes, ids, held = [], [], [], [], [], 0
            texts = batch.column(1).to_pylist()
            for doc, own in zip(batch.column(0).to_pylist(), chunk_ids.of(texts), strict=True):
                own = np.r_[own, np.uint32(end_id)].astype("<u4")
                for number, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    owners.append(doc), numbers.append(number), starts.append(start)
                    sizes.append(len(part)), ids.append(part.tobytes())
                    held += len(part)
                if held > 4_000_000:
                    yield _pieces(owners, numbers, starts, sizes, ids)
                    owners, numbers, starts, sizes, ids, held = [], [], [], [], [], 0
            if owners:
                yield _pieces(owners, numbers, starts, sizes, ids)

    narrow = docs.select(F.col("doc_id").cast("long"), whole_text(docs).alias("text"))
    return narrow.mapInArrow(releasing(cut, lambda: _chunk_ids(tokenizer).numbered), PIECES)


def _pieces(owners, numbers, starts, sizes, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(owners, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
            pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
        ],
        names=["doc_id", "piece", "start", "length", "ids"],
    )


def best_fit(order: np.ndarray, lengths: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> None:
    """Put the items into the fullest bin that takes each, opening bins as needed."""
    free = sorted((capacity - load, b) for b, load in enumerate(loads))
    for item in order:
        size = lengths[item]
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(item)
            loads[b] += size
        else:
            room, b = capacity, len(bins)
            bins.append([item])
            loads.append(size)
        bisect.insort(free, (room - size, b))


class Island:
    """One population over the pieces of a block."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.tolist(), capacity
        self.size = lengths.astype(float)
        self.random = np.random.default_rng(seed)
        self.fewest = math.ceil(lengths.sum() / capacity) if len(lengths) else 0

    def start(self, noise: float) -> np.ndarray:
        """Best fit of the items in falling size, disturbed by ``noise``."""
        key = self.size * (1 + noise * self.random.standard_normal(len(self.size)))
        bins, loads = [], []
        best_fit(np.argsort(-key, kind="stable").tolist(), self.lengths, self.capacity, bins, loads)
        return self.genome(bins)

    def genome(self, bins: list[list[int]]) -> np.ndarray:
        out = np.empty(len(self.size), np.int32)
        for b, items in enumerate(bins):
            out[items] = b
        return out

    def fitness(self, genome: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones."""
        loads = np.bincount(genome, self.size)
        return -len(loads), float(np.mean((loads / self.capacity) ** 2)) if len(loads) else 0.0

    def cross(self, receiver: np.ndarray, donor: np.ndarray) -> np.ndarray:
        loads = np.bincount(donor, self.size)
        n = len(loads)
        chance = (loads / self.capacity) ** 8
        chosen = self.random.random(n) < 0.25 * chance / max(chance.max(), 1e-9)
        injected = chosen[donor]
        hit = np.zeros(receiver.max() + 1, bool)
        hit[receiver[injected]] = True
        displaced = np.flatnonzero(hit[receiver] & ~injected)
        stay = ~hit[receiver]
        bins: dict[tuple[int, int], list[int]] = {}
        for item in np.flatnonzero(injected).tolist():
            bins.setdefault((0, int(donor[item])), []).append(item)
        for item in np.flatnonzero(stay).tolist():
            bins.setdefault((1, int(receiver[item])), []).append(item)
        groups = list(bins.values())
        held = [sum(self.lengths[i] for i in g) for g in groups]
        best_fit(displaced[np.argsort(-self.size[displaced], kind="stable")].tolist(), self.lengths, self.capacity, groups, held)
        return self.genome(groups)

    def evolve(self, incoming: list[np.ndarray], population: int, crossovers: int) -> np.ndarray:
        pool = list(incoming) or [self.start(0.0)]
        if -self.fitness(pool[0])[0] <= self.fewest:
            return pool[0]
        while len(pool) < population:
            pool.append(self.start(0.15))
        scored = sorted(((self.fitness(g), i, g) for i, g in enumerate(pool)), key=lambda x: x[:2], reverse=True)
        for step in range(crossovers):
            if -scored[0][0][0] <= self.fewest:
                break
            a, b = self.random.choice(len(scored), 2, replace=False)
            child = self.cross(scored[min(a, b)][2], scored[max(a, b)][2])
            scored[-1] = (self.fitness(child), len(pool) + step, child)
            scored.sort(key=lambda x: x[:2], reverse=True)
        return scored[0][2]


def _evolved(capacity: int, population: int, crossovers: int, epoch: int):
    def evolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, island, lengths, genomes in zip(batch["block"], batch["island"], batch["lengths"], batch["genomes"], strict=True):
                own = Island(np.frombuffer(lengths, "<i4"), capacity, (epoch * 1009 + island) * 7919 + int(block))
                start = [np.frombuffer(g, "<i4") for g in ([] if genomes is None else genomes)]
                out.append(own.evolve(start, population, crossovers).astype("<i4").tobytes())
            yield batch[["block", "island", "lengths"]].assign(genome=out)

    return evolve


def _sorted_lengths(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows.sort_values(["length", "_row"], ascending=[False, True])
    return pd.DataFrame({"block": [key[0]], "lengths": [ordered["length"].to_numpy().astype("<i4").tobytes()]})


def _evolve_blocks(rows: DataFrame, capacity: int, islands: int, epochs: int, population: int, crossovers: int) -> DataFrame:
    """block, genome: the best solution of each block of (_row, block, length)."""
    blocks = rows.select("block", "length", "_row").groupBy("block").applyInPandas(_sorted_lengths, "block long, lengths binary")
    state = blocks.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths",
        F.lit(None).cast("array<binary>").alias("genomes"),
    )
    for epoch in range(epochs):
        schema = "block long, island int, lengths binary, genome binary"
        state = settle(
            state.repartition("block", "island").mapInPandas(_evolved(capacity, population, crossovers, epoch), schema)
        )
        if epoch + 1 < epochs:
            moved = state.withColumn("island", (F.col("island") + 1) % islands)
            state = (
                state.unionByName(moved)
                .groupBy("block", "island")
                .agg(F.first("lengths").alias("lengths"), F.collect_list("genome").alias("genomes"))
            )
    return state.groupBy("block").agg(F.collect_list("genome").alias("genomes"), F.first("lengths").alias("lengths"))


def _assign(capacity: int):
    def assign(key: tuple, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"_row": [], "block": [], "bin": [], "offset": [], "load": []})
        ordered = rows.sort_values(["length", "_row"], ascending=[False, True])
        lengths = ordered["length"].to_numpy()
        judge = Island(lengths, capacity, 0)
        genome = max((np.frombuffer(g, "<i4") for g in best["genomes"].iloc[0]), key=judge.fitness)
        by_bin = np.argsort(genome, kind="stable")
        upto = np.cumsum(lengths[by_bin]) - lengths[by_bin]
        first = np.r_[True, np.diff(genome[by_bin]) != 0]
        offset = np.empty(len(lengths), np.int64)
        offset[by_bin] = upto - np.maximum.accumulate(np.where(first, upto, 0))
        load = np.bincount(genome, lengths)[genome]
        return pd.DataFrame(
            {"_row": ordered["_row"].to_numpy(), "block": key[0], "bin": genome.astype(np.int64), "offset": offset, "load": load.astype(np.int64)}
        )

    return assign


def _packed(rows: DataFrame, capacity: int, islands: int, epochs: int, population: int, crossovers: int) -> DataFrame:
    """_row, block, bin, offset, load of (_row, block, length)."""
    best = _evolve_blocks(rows, capacity, islands, epochs, population, crossovers)
    return (
        rows.select("_row", "block", "length")
        .groupBy("block")
        .cogroup(best.groupBy("block"))
        .applyInPandas(_assign(capacity), "_row long, block long, bin long, offset long, load long")
    )


def pack_pieces(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    crossovers: int = CROSSOVERS,
) -> DataFrame:
    """The columns of ``pieces`` (one of them ``length``, 1 to capacity), sequence_id, offset."""
    numbered = settle(pieces.withColumn("_row", F.monotonically_increasing_id()))
    size = numbered.count()
    evolve = (capacity, islands, epochs, population, crossovers)

    def in_blocks(rows: DataFrame, count: int) -> DataFrame:
        blocks = max(1, math.ceil(count / block_pieces))
        return rows.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))

    full = numbered.filter(F.col("length") >= capacity).select(
        "_row", F.lit(-1).cast("long").alias("block"), F.col("_row").alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    rest = numbered.filter(F.col("length") < capacity).select("_row", "length")
    first = settle(_packed(in_blocks(rest, size), *evolve))
    bins = first.groupBy("block", "bin").agg(F.max("load").alias("load"))
    worst = F.row_number().over(Window.partitionBy("block").orderBy("load", "bin"))
    share = F.greatest(F.lit(2), F.ceil(REOPENED * F.count(F.lit(1)).over(Window.partitionBy("block"))))
    opened = settle(bins.withColumn("_worst", worst <= share).filter("_worst").select("block", "bin"))
    loose = settle(first.join(opened, ["block", "bin"], "left_semi").select("_row").join(rest, "_row"))
    again = _packed(in_blocks(loose, loose.count()), *evolve)
    placed = (
        first.join(opened, ["block", "bin"], "left_anti").select("_row", "block", "bin", "offset")
        .unionByName(again.select("_row", (-2 - F.col("block")).alias("block"), "bin", "offset"))
        .unionByName(full)
    )
    # Blocks and bins stay below 2**31 up to some 2**43 pieces, so the ids are unique.
    sequence = F.when(F.col("block") == -1, -1 - F.col("bin")).otherwise(
        F.when(F.col("block") < 0, (-F.col("block")) * 2 + 1).otherwise(F.col("block") * 2) * (2**31) + F.col("bin")
    )
    return numbered.join(placed.select("_row", sequence.alias("sequence_id"), "offset"), "_row").drop("_row")
