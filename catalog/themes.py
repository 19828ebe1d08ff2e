"""Vocabulary, topics and themes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from reelgauge.operators import topics as T
from reelgauge.operators.title_topics import topics_by_title
from reelgauge.plans.script_features import script_themes, shared_themes
from reelgauge.session import settle

#: Recall at which a check against all pairs expects none to be missed.
SURE = 1 - 1e-6
STOP_WORDS = ("the", "and", "of", "de", "der", "la", "to", "in")

_TOKENS_SQL = r"""regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"""
_VOCABULARY_SQL = f"""
WITH tokens AS (SELECT doc_id, lang, source, unnest({_TOKENS_SQL}) AS word FROM documents),
kept AS (
  SELECT * FROM tokens WHERE word NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
vocabulary AS (
  SELECT word, count(DISTINCT doc_id) AS docs FROM kept GROUP BY word
  HAVING docs >= 2 AND docs <= 0.95 * (SELECT count(text) FROM documents)),
uses AS (
  SELECT doc_id, lang, source, word, count(*) AS uses FROM kept SEMI JOIN vocabulary USING (word)
  GROUP BY ALL),
by_source AS (SELECT source, word, sum(uses) AS weight FROM uses GROUP BY ALL),
by_lang AS (SELECT lang, word, sum(uses) AS weight FROM uses GROUP BY ALL),
topic_words AS (
  SELECT source, word, CAST(weight AS BIGINT) AS weight, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, word) AS rank
    FROM by_source) WHERE rank <= 10),
themes AS (
  SELECT lang AS theme, dense_rank() OVER (ORDER BY lang) AS theme_order, word FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank
    FROM by_lang) WHERE rank <= 25),
matches AS (
  SELECT source, theme, CAST(theme_order AS INTEGER) AS theme_order, count(*) AS matches
  FROM topic_words JOIN themes USING (word) GROUP BY ALL)"""


def _bag(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return T.bag_of_words(documents, ["doc_id", "lang", "source"], "text", STOP_WORDS)


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of each word by language and source: all that the themes below sum up."""
    return _bag(spark, sf).groupBy("lang", "source", "word").agg(F.sum("uses").alias("uses"))


def _source_words(bag: DataFrame) -> DataFrame:
    weights = bag.groupBy("source", "word").agg(F.sum("uses").alias("weight"))
    return T.top_words(weights, ["source"], "weight", 10)


def _lang_themes(bag: DataFrame) -> DataFrame:
    weights = bag.groupBy("lang", "word").agg(F.sum("uses").alias("weight"))
    words = T.top_words(weights, ["lang"], "weight", 25)
    # One entry per language.
    langs = words.agg(F.array_sort(F.collect_set("lang"))).scalar()
    return words.select(
        F.col("lang").alias("theme"),
        F.array_position(langs, F.col("lang")).cast("int").alias("theme_order"),
        "word",
    )


@query(_VOCABULARY_SQL + " SELECT word, docs FROM vocabulary")
def document_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return T.vocabulary(table(spark, sf, "documents"), "text", STOP_WORDS)


@query(_VOCABULARY_SQL + " SELECT doc_id, lang, source, word, uses FROM uses")
def document_bag_of_words(spark: SparkSession, sf: str) -> DataFrame:
    return _bag(spark, sf)


@query(_VOCABULARY_SQL + " SELECT source, word, weight, rank FROM topic_words")
def source_top_words(spark: SparkSession, sf: str) -> DataFrame:
    return _source_words(_uses(spark, sf))


@query(_VOCABULARY_SQL + " SELECT source, theme, theme_order, matches FROM matches")
def source_theme_matches(spark: SparkSession, sf: str) -> DataFrame:
    bag = settle(_uses(spark, sf))
    return T.theme_matches(_source_words(bag), _lang_themes(bag), ["source"])


@query(_VOCABULARY_SQL + """
SELECT source, coalesce(theme, 'Misc') AS theme
FROM (SELECT DISTINCT source FROM topic_words) LEFT JOIN (
  SELECT source, theme FROM matches
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY matches DESC, theme_order) = 1
) USING (source)
""")
def source_themes(spark: SparkSession, sf: str) -> DataFrame:
    bag = settle(_uses(spark, sf))
    return T.name_topics(_source_words(bag), _lang_themes(bag), ["source"])


@query("""
WITH parts AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x::DOUBLE) AS x FROM parts GROUP BY label, i),
seeds AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label)
SELECT seeds.label AS theme, vec_id AS word FROM seeds, embeddings
WHERE list_cosine_similarity(v, embedding::DOUBLE[]) > 0.25
""")
def words_near_theme_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors close to the mean vector of each label."""
    vectors = table(spark, sf, "embeddings")
    centre = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    seeds = vectors.groupBy("label").agg(vector_to_array(centre).alias("vector"))
    words = vectors.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    return T.similar_words(seeds.withColumnRenamed("label", "theme"), words, 0.25, recall=SURE)


def _embedded_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A theme per label, seeded by the word with the longest vector of its kind."""
    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), "vec_id").alias("word"),
        "label",
        F.col("embedding").alias("vector"),
        (-F.lit(20.0) * F.abs(F.col("embedding")[0].cast("double")) - 10).alias("log_prob"),
    )
    lead = rows.groupBy("label").agg(F.max_by("word", F.col("vector")[1]).alias("word"))
    themes = lead.select(
        F.col("label").cast("string").alias("theme"), F.col("label").alias("theme_order"), "word"
    )
    return themes, rows.select("word", "vector", "log_prob")


@query("""
WITH words AS (
  SELECT 'w' || vec_id AS word, label, embedding::DOUBLE[] AS vector,
    -20.0 * abs(embedding[1]::DOUBLE) - 10 AS log_prob FROM embeddings),
seeds AS (SELECT label, max_by(word, vector[2]) AS word FROM words GROUP BY label),
near AS (
  SELECT s.label, w.word FROM seeds s JOIN words v ON s.word = v.word, words w
  WHERE w.log_prob >= -15 AND list_cosine_similarity(v.vector, w.vector) > 0.6
  UNION SELECT label, word FROM seeds)
SELECT CAST(label AS VARCHAR) AS theme, label AS theme_order, word FROM near
""")
def expanded_themes(spark: SparkSession, sf: str) -> DataFrame:
    themes, vectors = _embedded_words(spark, sf)
    return T.expand_themes(themes, vectors, recall=SURE)


@query()
def topic_words(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return T.fit_topics(documents, "doc_id", "text").words()


@query()
def conversation_themes(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of all turns, named and listed per conversation."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("title"), F.col("text").alias("line")
    )
    return shared_themes(turns)


@query()
def themes_per_conversation(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of every conversation's own model, named and listed."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("title"), F.col("text").alias("line")
    )
    return script_themes(turns)


def _conversation_topics(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return topics_by_title(turns, "conv_id", "text", stop_words=STOP_WORDS)


_OWN_VOCABULARY_SQL = f"""
WITH lines AS (
  SELECT conv_id, turn, {_TOKENS_SQL} AS tokens FROM conversations WHERE trim(text) <> ''),
sizes AS (SELECT conv_id, count(*) AS n FROM lines GROUP BY conv_id),
uses AS (
  SELECT conv_id, word, count(*) AS docs
  FROM (SELECT conv_id, unnest(list_distinct(tokens)) AS word FROM lines) GROUP BY ALL),
vocabulary AS (
  SELECT conv_id, word, count(*) OVER (PARTITION BY conv_id) AS size FROM uses JOIN sizes USING (conv_id)
  WHERE docs >= 2 AND docs <= 0.95 * n AND word NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))"""


@query(_OWN_VOCABULARY_SQL + """
SELECT conv_id AS title, CAST(topic AS INTEGER) AS topic, word FROM vocabulary, range(5) AS t(topic)
WHERE size <= 10
""")
def short_topic_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """Where a model knows ten words or fewer, every topic lists them all."""
    found = _conversation_topics(spark, sf)
    return found.where(F.col("vocabulary") <= 10).select("title", "topic", "word")


@query(_OWN_VOCABULARY_SQL + """
SELECT conv_id AS title, CAST(topic AS INTEGER) AS topic, CAST(any_value(size) AS INTEGER) AS vocabulary,
  CAST(least(any_value(size), 10) AS BIGINT) AS words, true AS falling, any_value(size) <= 10 AS complete
FROM vocabulary, range(5) AS t(topic) GROUP BY conv_id, topic
""")
def conversation_topic_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for every topic of every conversation, whatever the fit."""
    steps = F.transform("weights", lambda w, i: (i == 0) | (w <= F.get("weights", i - 1)))
    total = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w)
    listed = _conversation_topics(spark, sf).groupBy("title", "topic", "vocabulary").agg(
        F.count_distinct("word").alias("words"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "weight"))), lambda e: e["weight"]).alias("weights"),
    )
    return listed.select(
        "title", "topic", "vocabulary", "words",
        (F.forall(steps, lambda ok: ok) & (F.array_min("weights") > 0)).alias("falling"),
        (F.abs(total - 1) < 1e-9).alias("complete"),
    )
