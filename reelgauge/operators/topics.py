"""Bag of words, topic model, and themes that name topics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from reelgauge import constants as C
from reelgauge.functions.text import tokens
from reelgauge.operators.ordering import null_safe_join
from reelgauge.operators.similarity import similar_pairs
from reelgauge.operators.variational import expected_log, line_mixtures
from reelgauge.operators.word_counts import counted_blocks, counted_words
from reelgauge.session import settle
from reelgauge.shipping import ship_package

MAX_VOCABULARY = 5_000_000
#: Most words that are sent to every task.
COMMON_WORDS = 1 << 17
#: Counts that a task of the topic model holds at once, and rows it gives out at once.
_COUNTS_HELD, _ROWS_OUT = 1 << 22, 1 << 16
#: Words whose sums a row holds, and tasks a core that make such rows.
_WORDS_A_BLOCK, _TASKS_A_CORE = 1 << 12, 3
_BLOCK = "_first int, _block binary"
#: Bytes of a row group of blocks of lines and of the corpus: files are cut between groups, so small ones give even tasks.
_BLOCK_GROUP, _CORPUS_GROUP = 1 << 24, 1 << 22


def vocabulary_tokens(text: Column, stop_words: Iterable[str]) -> Column:
    """Lower-case tokens of two or more word characters, without stop words."""
    found, skipped = tokens(text), list(stop_words)
    return F.filter(found, lambda token: ~token.isin(skipped)) if skipped else found


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def vocabulary(
    lines: DataFrame,
    text_col: str,
    stop_words: Iterable[str] = (),
    min_docs: int = 2,
    max_share: float = 0.95,
) -> DataFrame:
    """(word, docs) for words in at least ``min_docs`` lines and not too many."""
    used = F.array_distinct(vocabulary_tokens(F.col(text_col), stop_words))
    words = lines.select(F.explode(used).alias("word"))
    docs = words.groupBy("word").agg(F.count("*").alias("docs"))
    return _within_bounds(docs, lines, text_col, min_docs, max_share)


def _within_bounds(
    docs: DataFrame, lines: DataFrame, text_col: str, min_docs: int, max_share: float
) -> DataFrame:
    most = lines.select(F.count(text_col)).scalar() * F.lit(max_share)
    return docs.where((F.col("docs") >= min_docs) & (F.col("docs") <= most))


def bag_of_words(
    lines: DataFrame,
    id_cols: Sequence[str],
    text_col: str,
    stop_words: Iterable[str] = (),
    min_docs: int = 2,
    max_share: float = 0.95,
) -> DataFrame:
    """Term counts per line, in long form, over the bounded vocabulary.

    ``id_cols`` name a line; rows of the same ones are one line. Words are counted inside
    their row, so what is shuffled are distinct words of a task with their lines, and lines
    whose ids come more than once. The most frequent words, of which there are
    ``COMMON_WORDS`` at most, meet the vocabulary without a shuffle; only uses of rarer
    ones are brought together by word.
    """
    ids = [F.col(name) for name in id_cols]
    rows = settle(counted_words(lines, id_cols, text_col, stop_words))
    repeated = settle(rows.groupBy(*id_cols).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*id_cols))
    counted = rows.select(*ids, F.inline("_counts"))
    if not repeated.isEmpty():
        again, alone = (null_safe_join(rows, repeated, id_cols, how) for how in ("left_semi", "left_anti"))
        merged = again.select(*ids, F.inline("_counts")).groupBy(*id_cols, "word").agg(F.sum("uses").alias("uses"))
        counted = alone.select(*ids, F.inline("_counts")).unionByName(merged)
    docs = settle(counted.groupBy("word").agg(F.count("*").alias("docs")))
    kept = _within_bounds(docs, lines, text_col, min_docs, max_share)
    least = _common_from(docs)
    # At most COMMON_WORDS of them, whatever the vocabulary.
    within = kept.select("word", F.lit(True).alias("_kept"))
    marked = docs.where(F.col("docs") >= least).select("word").join(within, "word", "left")
    common = settle(marked.select("word", F.coalesce("_kept", F.lit(False)).alias("_kept")))
    found = counted.join(F.broadcast(common), "word", "left")
    often = found.where("_kept").drop("_kept")
    rare = kept.where(F.col("docs") < least).select("word")
    if rare.isEmpty():
        return often.select("word", *ids, "uses")
    seldom = found.where(F.col("_kept").isNull()).drop("_kept").join(rare, "word")
    return often.select("word", *ids, "uses").unionByName(seldom.select("word", *ids, "uses"))


def _common_from(docs: DataFrame) -> int:
    """The least number of lines of a word from which on there are at most ``COMMON_WORDS``."""
    counts = settle(docs.groupBy("docs").count())
    _, least = _vocabulary_within(counts, COMMON_WORDS, 1)
    return least


def top_words(
    weights: DataFrame, keys: Sequence[str], weight_col: str, count: int = C.WORDS_PER_TOPIC
) -> DataFrame:
    """The ``count`` heaviest words of each group, word order breaking ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(weight_col), "word")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


@dataclass
class WordList:
    """The words a model knows, rising."""

    words: pa.Array

    @property
    def vocabulary(self) -> list[str]:
        return self.words.to_pylist()


@dataclass
class TopicModel:
    """Weights of a model, words x topics, and the prior of a line's mixture."""

    weights: np.ndarray
    prior: float

    def by_word(self) -> np.ndarray:
        """exp of the expected log share of each word; a last row of zeros for no word."""
        return np.r_[expected_log(self.weights.T).T, np.zeros((1, self.weights.shape[1]))]

    def getSubsamplingRate(self) -> float:
        """Share of the lines that each pass reads, under the name it has in Spark's models."""
        return 1.0


@dataclass
class TopicFit:
    """A topic model over a corpus of lines."""

    spark: SparkSession
    vectorizer: WordList
    model: TopicModel
    #: Title of each line, its words and their uses.
    corpus: DataFrame
    #: Lines a word is in at least; more than asked for when the vocabulary was too large.
    min_docs: int

    def words(self, count: int = C.WORDS_PER_TOPIC) -> DataFrame:
        """(topic, rank, word, weight): the heaviest words of every topic."""
        shares = self.model.weights / self.model.weights.sum(axis=0)
        rows = [
            (topic, rank, self.vectorizer.words[index].as_py(), float(share[index]))
            for topic, share in enumerate(shares.T)
            for rank, index in enumerate(np.argsort(-share, kind="stable")[:count].tolist(), start=1)
        ]
        return self.spark.createDataFrame(rows, "topic int, rank int, word string, weight double")

    def title_topics(self, title_col: str = "title") -> DataFrame:
        """(title, topic, share): mean topic mixture over a title's lines; 0 for lines without known words."""
        prior, by_word = self.model.prior, self.spark.sparkContext.broadcast(self.model.by_word().astype(np.float32))
        topics = by_word.value.shape[1]
        names = [f"_share{topic}" for topic in range(topics)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in _gathered(batches, "_words"):
                shares = np.zeros((some.num_rows, topics))
                for lines, mixture, _ in line_mixtures(*_corpus_counts(some), by_word.value, prior):
                    shares[lines] = mixture / mixture.sum(axis=1, keepdims=True)
                columns = [some.column(title_col), *map(pa.array, shares.T.copy())]
                yield from pa.table(columns, [title_col, *names]).to_batches(_ROWS_OUT)

        kept = self.corpus.schema[title_col]
        schema = S.StructType([kept, *[S.StructField(name, S.DoubleType()) for name in names]])
        mean = self.corpus.mapInArrow(run, schema).groupBy(title_col).agg(F.array(*map(F.avg, names)).alias("_mixture"))
        return mean.select(title_col, F.posexplode("_mixture").alias("topic", "share"))


def _gathered(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.Table]:
    """Rows of several batches together, as many as hold some ``_COUNTS_HELD`` counts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        ends = _ends(batch.column(col))
        size += (ends[-1] - ends[0]) // (4 if pa.types.is_binary(batch.column(col).type) else 1)
        if size >= _COUNTS_HELD:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size or held:
        yield pa.Table.from_batches(held).combine_chunks()


def _ends(lists: pa.Array) -> np.ndarray:
    """Where the lists, or byte strings, of an array begin and end in its values."""
    return np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)


def _joined(rows: pa.Table, col: str) -> pa.Array:
    return pa.concat_arrays(rows.column(col).chunks)


def _packed(ends: np.ndarray, values: pa.Array) -> pa.BinaryArray:
    """A byte string of 32-bit numbers for each line."""
    places = pa.py_buffer((ends * 4).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, places, values.cast(pa.int32()).buffers()[1]])


def _corpus_counts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the lines of a corpus, their words and uses."""
    words, uses = (_joined(rows, name) for name in ("_words", "_uses"))
    ends = _ends(words) // 4
    word, times = (np.frombuffer(c.buffers()[2] or b"", np.int32)[_ends(c)[0] // 4 : _ends(c)[-1] // 4] for c in (words, uses))
    return ends - ends[0], word, times


def _numbers(bytes_: pa.Array) -> np.ndarray:
    """The 32-bit numbers of all byte strings of an array."""
    ends = _ends(bytes_) // 4
    return np.frombuffer(bytes_.buffers()[2] or b"", np.int32)[ends[0] : ends[-1]]


def _encoded(blocks: DataFrame, title_col: str, words: pa.Array) -> DataFrame:
    """``_words``, places of known words, and ``_uses`` of each line, as 32-bit numbers in bytes."""
    known = blocks.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches, "_words"):
            lists, titles = _joined(some, "_known"), _joined(some, "_titles")
            place = pc.index_in(lists.flatten().field("word"), value_set=known.value)
            place = pc.fill_null(place, -1).to_numpy().astype(np.int32)
            packed = [_joined(some, name) for name in ("_words", "_uses", "_ends")]
            sizes = np.diff(_ends(packed[0]) // 4)
            word, uses, ends = map(_numbers, packed)
            word = place[word + np.repeat(_ends(lists)[:-1] - _ends(lists)[0], sizes)]
            # The ends of a block begin with 0, which is the last end of the block before.
            firsts = np.cumsum(sizes) - sizes
            ends = ends + np.repeat(firsts, np.diff(_ends(packed[2]) // 4))
            ends = np.r_[0, np.delete(ends, _ends(packed[2])[:-1] // 4 - _ends(packed[2])[0] // 4)]
            held = word >= 0
            ends = np.r_[0, np.cumsum(held)][ends]
            columns = [titles.flatten(), *[_packed(ends, pa.array(numbers[held])) for numbers in (word, uses)]]
            yield from pa.table(columns, [title_col, "_words", "_uses"]).to_batches(_ROWS_OUT)

    packed = [S.StructField(name, S.BinaryType()) for name in ("_words", "_uses")]
    return blocks.mapInArrow(run, S.StructType([S.StructField(title_col, blocks.schema["_titles"].dataType.elementType), *packed]))


def _blocks(found: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A row for each (first word, topics x words) block."""
    for first, block in found:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["_first", "_block"])


def _read_blocks(rows: pa.RecordBatch | pa.Table, topics: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, block in zip(rows.column("_first").to_pylist(), rows.column("_block"), strict=True):
        yield first, np.frombuffer(block.as_buffer(), np.float64).reshape(topics, -1)


def _topic_uses(corpus: DataFrame, model: TopicModel) -> np.ndarray:
    """Expected uses, words x topics, of all lines under a model."""
    session, prior, shares = corpus.sparkSession, model.prior, model.by_word()
    by_word = session.sparkContext.broadcast(shares.astype(np.float32))
    words, topics = len(shares) - 1, shares.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((topics, words))
        for some in _gathered(batches, "_words"):
            for _, _, expected in line_mixtures(*_corpus_counts(some), by_word.value, prior):
                word, uses = expected()
                for row, part in zip(total, uses, strict=True):
                    np.add.at(row, word, part)
        parts = ((first, total[:, first : first + _WORDS_A_BLOCK]) for first in range(0, words, _WORDS_A_BLOCK))
        yield from _blocks((first, block) for first, block in parts if block.any())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, block in _read_blocks(batch, topics):
                total[first] = total[first] + block if first in total else block.copy()
        yield from _blocks(total.items())

    # Each task gives out its words, so there are but a few tasks a core, as many as keep all cores busy to the end.
    tasks = _TASKS_A_CORE * session.sparkContext.defaultParallelism
    parts = corpus.select("_words", "_uses").coalesce(tasks).mapInArrow(run, _BLOCK)
    # A block for each run of words of the model, which the driver holds anyway.
    found = parts.repartition(tasks, "_first").mapInArrow(add, _BLOCK).toArrow()
    by_word.destroy()
    uses = np.zeros((words, topics))
    for first, block in _read_blocks(found, topics):
        uses[first : first + block.shape[1]] = block.T
    return uses * shares[:-1]


def _vocabulary_within(counts: DataFrame, most: int, min_docs: int) -> tuple[int, int]:
    """Size of the largest vocabulary of at most ``most`` words, and the lines its words are in.

    ``counts`` is (docs, count): how many words are in so many lines.
    """

    def size_of(least: int) -> int:
        return counts.where(F.col("docs") >= least).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    size = size_of(min_docs)
    while size > most:
        min_docs *= 2  # as many steps as the count of lines has bits
        size = size_of(min_docs)
    return size, min_docs


def fit_topics(
    lines: DataFrame,
    title_col: str = "title",
    text_col: str = "line",
    topics: int = C.TOPIC_COUNT,
    stop_words: Iterable[str] | None = None,
    min_docs: int = 2,
    max_share: float = 0.95,
    iterations: int = 10,
    seed: int = C.TOPIC_SEED,
) -> TopicFit | None:
    """One model for all titles; None when no word passes the vocabulary bounds.

    Batch variational Bayes with symmetric priors of 1 / ``topics``: each pass finds the
    mixture of every line under the weights of the pass before, and sums its uses by word.
    A task sums the words it has met in blocks of words, and there are three tasks a core at most,
    so a pass shuffles no more than the model's words times that. The model keeps ``topics`` weights per word on the driver
    and in every task. Of a vocabulary beyond ``MAX_VOCABULARY`` the rarest words go: ``min_docs`` rises as far as it must, and the
    fit tells its value.
    """
    ship_package(lines.sparkSession)
    stop_words = default_stop_words() if stop_words is None else list(stop_words)
    counted = settle(counted_blocks(lines.where(F.trim(text_col) != ""), title_col, text_col, stop_words), _BLOCK_GROUP)
    docs = counted.select(F.inline("_known")).groupBy("word").agg(F.sum("docs").alias("docs"))
    line_count = counted.agg(F.coalesce(F.sum("_lines"), F.lit(0))).first()[0]
    within = settle(docs.where(F.col("docs").between(min_docs, max_share * line_count)))
    counts = settle(within.groupBy("docs").count())
    size, min_docs = _vocabulary_within(counts, MAX_VOCABULARY, min_docs)
    if size == 0:
        return None
    words = within.where(F.col("docs") >= min_docs).select("word").toArrow().column("word").combine_chunks()
    words = words.take(pc.sort_indices(words))
    encoded = _encoded(counted, title_col, words)
    # A line costs far more than its bytes tell, so a small table is dealt to all cores.
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if counted.rdd.getNumPartitions() < cores:
        encoded = encoded.repartition(cores)
    corpus = settle(encoded, _CORPUS_GROUP)
    prior = 1 / topics
    model = TopicModel(np.random.default_rng(seed).gamma(100.0, 0.01, (len(words), topics)), prior)
    for _ in range(iterations):
        model = TopicModel(prior + _topic_uses(corpus, model), prior)
    return TopicFit(lines.sparkSession, WordList(words), model, corpus, min_docs)


def theme_table(
    spark: SparkSession, themes: Mapping[str, Sequence[str]] = C.THEME_WORDS
) -> DataFrame:
    """(theme, theme_order, word) from a dictionary of seed words."""
    rows = [
        (theme, order, word)
        for order, (theme, words) in enumerate(themes.items())
        for word in words
    ]
    return spark.createDataFrame(rows, "theme string, theme_order int, word string")


def theme_matches(topic_words: DataFrame, themes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words that each topic shares with each theme, counted."""
    return (
        topic_words.select(*keys, "word")
        .join(themes.select("theme", "theme_order", "word").distinct(), "word")
        .groupBy(*keys, "theme", "theme_order")
        .agg(F.count("*").alias("matches"))
    )


def name_topics(topic_words: DataFrame, themes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best theme per topic; the earlier theme wins a tie, "Misc" without any."""
    best = (
        theme_matches(topic_words, themes, keys)
        .groupBy(*keys)
        .agg(F.max_by("theme", F.struct("matches", -F.col("theme_order"))).alias("_best"))
    )
    named = null_safe_join(topic_words.select(*keys).distinct(), best, keys, "left")
    return named.select(*keys, F.coalesce("_best", F.lit(C.NO_THEME)).alias("theme"))


def similar_words(
    seeds: DataFrame,
    words: DataFrame,
    threshold: float = C.THEME_SIMILARITY,
    word_col: str = "word",
    recall: float = C.SIMILARITY_RECALL,
) -> DataFrame:
    """(theme, word) where a word's cosine to some seed of the theme exceeds the bar.

    ``seeds`` is (theme, vector) and ``words`` (word, vector), either of any size. A pair
    at the bar is found with a probability of ``recall`` at least, closer ones with more.
    """
    found = similar_pairs(
        seeds.select(F.col("theme").alias("label"), "vector"),
        words.select(F.col(word_col).alias("label"), "vector"),
        threshold,
        recall,
        C.TOPIC_SEED,
    )
    return found.select(F.col("left_label").alias("theme"), F.col("right_label").alias("word"))


def expand_themes(
    themes: DataFrame,
    vectors: DataFrame,
    threshold: float = C.THEME_SIMILARITY,
    min_log_prob: float = C.THEME_MIN_LOG_PROB,
    recall: float = C.SIMILARITY_RECALL,
) -> DataFrame:
    """Theme table grown by common lower-case words close to a seed word.

    ``vectors`` is (word, vector, log_prob). Seed words always stay.
    """
    seeds = themes.select("theme", "word").join(vectors.select("word", "vector"), "word")
    word = F.col("word")
    plain = (word == F.lower(word)) & (word != F.upper(word))
    common = vectors.where(plain & (F.col("log_prob") >= min_log_prob))
    grown = similar_words(seeds, common, threshold, recall=recall)
    orders = themes.select("theme", "theme_order").distinct()
    return (
        grown.unionByName(themes.select("theme", "word"))
        .distinct()
        .join(orders, "theme")
        .select("theme", "theme_order", "word")
    )


def themes_by_title(
    title_topics: DataFrame,
    topic_words: DataFrame,
    topic_names: DataFrame,
    title_col: str = "title",
) -> DataFrame:
    """(title, named_themes, dominant_topics) texts, strongest topic first."""
    lists = topic_words.groupBy("topic").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda entry: entry["word"]
            ),
            ", ",
        ).alias("words")
    )
    # One row for each topic of the model, which the model holds on the driver anyway.
    described = title_topics.join(F.broadcast(topic_names.join(lists, "topic")), "topic")
    entry = F.struct((-F.col("share")).alias("order"), "topic", "theme", "words")
    # One entry per topic of the model, so the list per title stays short.
    ranked = described.groupBy(title_col).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    return ranked.select(
        title_col,
        F.array_join(F.transform("ranked", lambda e: e["theme"]), "; ").alias("named_themes"),
        F.array_join(F.transform("ranked", lambda e: e["words"]), "; ").alias("dominant_topics"),
    )
