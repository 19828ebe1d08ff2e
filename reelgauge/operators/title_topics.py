"""One topic model a title: many small variational fits, several to a task.

A title's lines are brought together by key and its model is fitted by batch variational
Bayes, side by side with those of its neighbours in a stream, so a task holds one batch of
rows and the title that goes on from it. Titles with
more than ``max_tokens`` tokens, of which there can only be few, are fitted one by one
with the distributed model instead, which splits a title's lines over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge import constants as C
from reelgauge.operators.topics import default_stop_words, fit_topics, vocabulary_tokens
from reelgauge.operators.variational import digamma, expected_log, run_starts  # noqa: F401
from reelgauge.session import settle
from reelgauge.shipping import ship_package

#: Tokens of a title that one task fits, and of the titles it fits side by side.
MAX_TITLE_TOKENS, TOKENS_AT_ONCE = 2_000_000, 1 << 16
_COLUMNS = "topic int, rank int, word string, weight double, vocabulary int"


def _mixtures(
    place: np.ndarray, uses: np.ndarray, by_word: np.ndarray, owner: np.ndarray, prior: float
) -> np.ndarray:
    """Topic mixture of every line; a title's lines stop together once they hardly change.

    ``place`` is each count's line, ``owner`` each line's title, both rising.
    """
    done = np.ones((len(owner), by_word.shape[1]))
    lines, mixture = np.arange(len(owner)), done
    for _ in range(100):
        starts, titles = run_starts(place), run_starts(owner)
        by_line = expected_log(mixture)
        scaled = uses / (np.einsum("ek,ek->e", by_line[place], by_word) + 1e-100)
        before = mixture
        mixture = prior + by_line * np.add.reduceat(by_word * scaled[:, None], starts)
        changes = np.add.reduceat(np.abs(mixture - before).sum(axis=1), titles)
        sizes = np.diff(np.r_[titles, len(owner)])
        moving = np.repeat(changes >= 1e-3 * sizes * mixture.shape[1], sizes)
        if moving.all():
            continue
        done[lines[~moving]] = mixture[~moving]
        if not moving.any():
            return done
        held = moving[place]
        place = (np.cumsum(moving) - 1)[place[held]]
        uses, by_word = uses[held], by_word[held]
        lines, mixture, owner = lines[moving], mixture[moving], owner[moving]
    done[lines] = mixture
    return done


def fit_titles(
    line: np.ndarray, word: np.ndarray, uses: np.ndarray, title: np.ndarray, topics: int, iterations: int, seed: int
) -> np.ndarray:
    """words x topics weights of the models of many titles, fitted side by side.

    Counts by (line, word), lines rising; ``title`` is the title of each word, rising, and
    words belong to one title. Batch variational Bayes with symmetric priors of 1 / topics;
    every title's model starts from the seed and stops as it would alone.
    """
    prior = 1 / topics
    starts = run_starts(title)
    sizes = np.diff(np.r_[starts, len(title)])
    begun = {size: np.random.default_rng(seed).gamma(100.0, 0.01, (topics, size)).T for size in np.unique(sizes).tolist()}
    weights = np.concatenate([begun[size] for size in sizes.tolist()])
    first = run_starts(line)
    place = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(line)]))
    owner = title[word[first]]
    for _ in range(iterations):
        by_word = expected_log(weights, starts)[word]
        by_line = expected_log(_mixtures(place, uses, by_word, owner, prior))[place]
        shares = by_line * by_word
        shares *= (uses / (shares.sum(axis=1) + 1e-100))[:, None]
        weights = prior + np.stack([np.bincount(word, shares[:, k], len(title)) for k in range(topics)], axis=1)
    return weights


def fit_counts(
    line: np.ndarray, word: np.ndarray, uses: np.ndarray, words: int, topics: int, iterations: int, seed: int
) -> np.ndarray:
    """topics x words weights of one title's model from counts by (line, word), lines rising from 0."""
    return fit_titles(line, word, uses, np.zeros(words, np.int64), topics, iterations, seed).T


def bounded_counts(
    title: np.ndarray, line: np.ndarray, word: np.ndarray, min_docs: int, max_share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(title, word) within the bounds of its title, and (line, place in these, uses).

    ``title`` is each line's title, rising; ``line`` and ``word`` are each token's.
    """
    size = int(word.max(initial=0)) + 1
    pairs, uses = np.unique(line * size + word, return_counts=True)
    line, word = np.divmod(pairs, size)
    known, place, docs = np.unique(title[line] * size + word, return_inverse=True, return_counts=True)
    owner, name = np.divmod(known, size)
    kept = (docs >= min_docs) & (docs <= max_share * np.bincount(title)[owner])
    held = kept[place]
    return owner[kept], name[kept], line[held], (np.cumsum(kept) - 1)[place[held]], uses[held]


def _top(owner: np.ndarray, weights: np.ndarray, count: int) -> list[np.ndarray]:
    """(word, topic, rank, share) of the heaviest words of each title and topic, earlier words first among equals."""
    starts = run_starts(owner)
    sizes = np.diff(np.r_[starts, len(owner)])
    shares = weights / np.repeat(np.add.reduceat(weights, starts), sizes, axis=0)
    rank = np.arange(len(owner)) - np.repeat(starts, sizes)
    listed = rank < count
    orders = [np.lexsort((-shares[:, topic], owner))[listed] for topic in range(shares.shape[1])]
    topic = np.repeat(np.arange(len(orders)), listed.sum())
    word = np.concatenate(orders)
    return [word, topic, np.tile(rank[listed] + 1, len(orders)), shares[word, topic]]


def topics_by_title(
    lines: DataFrame,
    title_col: str = "title",
    text_col: str = "line",
    topics: int = C.TOPIC_COUNT,
    count: int = C.WORDS_PER_TOPIC,
    stop_words: Iterable[str] | None = None,
    min_docs: int = 2,
    max_share: float = 0.95,
    iterations: int = 10,
    seed: int = C.TOPIC_SEED,
    max_tokens: int = MAX_TITLE_TOKENS,
) -> DataFrame:
    """(title, topic, rank, word, weight, vocabulary): the heaviest words of each title's topics.

    ``weight`` is the word's share of its topic, ``vocabulary`` the number of words the
    title's model knows. Blank lines do not count; a title none of whose words is within
    the bounds has no rows. Every model starts from the same seed, and a title's lines
    are taken in the order of their texts, so reruns agree.
    """
    ship_package(lines.sparkSession)
    skipped = default_stop_words() if stop_words is None else list(stop_words)
    spoken = lines.where(F.trim(text_col) != "").select(
        F.col(title_col).alias("title"), vocabulary_tokens(F.col(text_col), skipped).alias("tokens")
    )
    tokenised = settle(spoken)
    sizes = tokenised.groupBy("title").agg(F.sum(F.size("tokens")).alias("tokens"))
    # Each of these holds more than max_tokens, so they are few.
    large = [row.title for row in sizes.where(F.col("tokens") > max_tokens).select("title").collect()]
    is_large = F.coalesce(F.col("title").isin([t for t in large if t is not None]), F.lit(None in large))
    title_type = tokenised.schema["title"].dataType.simpleString()
    names = ["title", "topic", "rank", "word", "weight", "vocabulary"]

    def fitted(lines: pa.Table) -> Iterator[pa.RecordBatch]:
        """Models of whole titles, as many at once as hold some ``TOKENS_AT_ONCE`` tokens."""
        titles, tokens = (lines.column(name).combine_chunks() for name in ("title", "tokens"))
        ends = tokens.offsets.to_numpy().astype(np.int64)
        codes = titles.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.r_[run_starts(codes), len(codes)]
        part = (ends[starts[:-1]] - ends[0]) // TOKENS_AT_ONCE
        for first, last in pairwise(starts[np.r_[run_starts(part), len(part)]].tolist()):
            flat = tokens.slice(first, last - first).flatten().dictionary_encode()
            # Numbers of words that rise with the words.
            order = pc.sort_indices(flat.dictionary)
            number = np.empty(len(order), np.int64)
            number[order.to_numpy()] = np.arange(len(order))
            own = np.cumsum(np.r_[True, codes[first + 1 : last] != codes[first : last - 1]]) - 1
            of_line = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
            owner, name, line, word, uses = bounded_counts(
                own, of_line, number[flat.indices.to_numpy()], min_docs, max_share
            )
            if not len(owner):
                continue
            weights = fit_titles(line, word, uses, owner, topics, iterations, seed)
            at, topic, rank, share = _top(owner, weights, count)
            place = first + run_starts(own)[owner[at]]
            words = flat.dictionary.take(order).take(pa.array(name[at]))
            sizes = np.bincount(owner)[owner[at]]
            yield pa.RecordBatch.from_arrays([
                titles.take(pa.array(place)), pa.array(topic, pa.int32()), pa.array(rank, pa.int32()),
                words, pa.array(share), pa.array(sizes, pa.int32()),
            ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            title = batch.column("title")
            # The rows from ``tail`` on are of the batch's last title, which may go on.
            tail = int(run_starts(title.dictionary_encode(null_encoding="encode").indices.to_numpy())[-1])
            if tail or (held and held[-1].column("title")[-1].as_py() != title[0].as_py()):
                yield from fitted(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield from fitted(pa.Table.from_batches(held))

    # A fit costs far more than its few bytes tell, so tasks are not merged by their size.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = tokenised.where(~is_large).repartition(parts, "title").sortWithinPartitions("title", "tokens")
    # As text, for the comparison of neighbours.
    named = small.select(F.col("title").cast("string").alias("title"), "tokens")
    found = named.mapInArrow(run, f"title string, {_COLUMNS}")
    found = found.withColumn("title", F.col("title").cast(title_type))
    for title in large:
        own = lines.where(F.col(title_col).eqNullSafe(F.lit(title).cast(title_type)))
        fit = fit_topics(own, title_col, text_col, topics, stop_words, min_docs, max_share, iterations, seed)
        if fit is not None:
            words = fit.words(count).withColumns({
                "title": F.lit(title).cast(title_type), "vocabulary": F.lit(len(fit.vectorizer.vocabulary)),
            })
            found = found.unionByName(settle(words.select(*found.columns)))
    return found


def themes_by_own_topics(topic_words: DataFrame, names: DataFrame) -> DataFrame:
    """(title, named_themes, dominant_topics) texts of each title's own topics, in their order.

    ``names`` is (title, topic, theme).
    """
    listed = topic_words.groupBy("title", "topic").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda e: e["word"]), ", "
        ).alias("words")
    )
    # Titles are matched with NULL as a title, which the grouping above keeps.
    joined = listed.join(
        names.withColumnsRenamed({"title": "_named", "topic": "_topic"}),
        F.col("title").eqNullSafe(F.col("_named")) & (F.col("topic") == F.col("_topic")),
    )
    entries = joined.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("topic", "theme", "words"))).alias("_entries"))
    return entries.select(
        "title",
        F.array_join(F.transform("_entries", lambda e: e["theme"]), "; ").alias("named_themes"),
        F.array_join(F.transform("_entries", lambda e: e["words"]), "; ").alias("dominant_topics"),
    )
