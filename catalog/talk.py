"""Dialogue, sentiment and arcs over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, rounded, sql_words, table
from catalog.scripts import clean_sql, dialogue_sql, sql_strip
from reelgauge.functions.text import clean_script
from reelgauge.operators import dialogue as D
from reelgauge.operators import sentiment as S
from reelgauge.session import settle

# Words that occur in the invented text of the given tables.
POSITIVE = ("the", "of", "de", "er", "la", "is", "und")
NEGATIVE = ("and", "to", "in", "die", "le", "th", "que")
LEXICON = dict.fromkeys(POSITIVE, 1) | dict.fromkeys(NEGATIVE, -1)


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{word}'" for word in words)


SCORED_SQL = f"""
WITH cut AS (SELECT conv_id, turn, role, text, {sql_words('text')} AS words FROM conversations),
hits AS (
  SELECT conv_id, turn, role, text,
    len(list_filter(words, lambda x: x IN ({_sql_list(POSITIVE)}))) AS good,
    len(list_filter(words, lambda x: x IN ({_sql_list(NEGATIVE)}))) AS bad FROM cut),
scored AS (
  SELECT conv_id, turn, role, text, CASE WHEN good >= bad THEN 'POSITIVE' ELSE 'NEGATIVE' END
    AS label, (greatest(good, bad) + 1) / (good + bad + 2) AS confidence,
    CASE WHEN good >= bad THEN 1 ELSE -1 END * (greatest(good, bad) + 1) / (good + bad + 2)
      AS score FROM hits)"""

THIRDS_SQL = SCORED_SQL + """,
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
    count(*) OVER (PARTITION BY conv_id) AS n FROM scored),
thirds AS (
  SELECT *, CASE WHEN place < n // 3 THEN 1 WHEN place < 2 * (n // 3) THEN 2 ELSE 3 END AS third
  FROM placed)"""

PROFILE_SQL = SCORED_SQL + """,
profile AS (
  SELECT conv_id, role, count(*) AS line_count, min(turn) AS first_seq,
    stddev_pop(score) AS score_std FROM scored GROUP BY conv_id, role),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_count DESC, first_seq) AS rank
  FROM profile),
top3 AS (SELECT * FROM ranked WHERE rank <= 3)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_by_lexicon(table(spark, sf, "conversations"), LEXICON, "text")


def top3(spark: SparkSession, sf: str) -> DataFrame:
    profile = D.character_profile(scored(spark, sf), "conv_id", "role", "turn")
    return D.top_characters(profile, "conv_id")


@query(SCORED_SQL + """
SELECT conv_id, turn, label, round(confidence, 6) AS confidence, round(score, 6) AS score
FROM scored
""")
def lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        scored(spark, sf).select("conv_id", "turn", "label", "confidence", "score")
    )


@query(SCORED_SQL + """
SELECT conv_id, turn, label, round(confidence, 6) AS confidence, round(score, 6) AS score
FROM scored
""")
def lexicon_table_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores with the lexicon held in a table."""
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, polarity int")
    lines = table(spark, sf, "conversations")
    found = S.score_by_lexicon_table(lines, lexicon, "conv_id", "turn", "text")
    return rounded(found.select("conv_id", "turn", "label", "confidence", "score"))


@query("""
SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
  CASE WHEN length(text) > 200 THEN 0.75 ELSE -0.75 END::DOUBLE AS score
FROM conversations
""")
def plugged_in_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    def by_length(texts: list[str]) -> list[tuple[str, float]]:
        return [("POSITIVE" if len(text) > 200 else "NEGATIVE", 0.75) for text in texts]

    lines = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return S.score_by_function(lines, by_length, "text").select(
        "conv_id", "turn", "label", "score"
    )


@query()
def trained_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Train on labelled documents, score the conversations."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    model = S.train_scorer(texts.join(labels, "doc_id"))
    lines = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return S.score_by_model(lines, model).drop("text")


@query("SELECT conv_id, turn, true AS signed, true AS likelier FROM conversations")
def trained_sentiment_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for every trained score: its sign is the label's, its size the winning chance."""
    found = trained_sentiment(spark, sf)
    positive = F.col("label") == "POSITIVE"
    return found.select(
        "conv_id", "turn",
        ((F.col("score") > 0) == positive).alias("signed"),
        (F.col("confidence").between(0.5, 1.0) & (F.abs("score") == F.col("confidence"))).alias("likelier"),
    )


@query(THIRDS_SQL + " SELECT conv_id, turn, CAST(third AS INTEGER) AS third FROM thirds")
def conversation_thirds(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations").select("conv_id", "turn")
    return D.add_thirds(lines, "conv_id", "turn")


@query(THIRDS_SQL + """,
means AS (
  SELECT conv_id, coalesce(avg(score) FILTER (third = 1), 0) AS m1,
    coalesce(avg(score) FILTER (third = 2), 0) AS m2,
    coalesce(avg(score) FILTER (third = 3), 0) AS m3 FROM thirds GROUP BY conv_id)
SELECT conv_id, round(m1, 6) + 0.0 AS third1_mean, round(m2, 6) + 0.0 AS third2_mean,
  round(m3, 6) + 0.0 AS third3_mean, round(abs(m1 - m2) + abs(m2 - m3), 6) AS sentiment_shift
FROM means
""")
def sentiment_shift(spark: SparkSession, sf: str) -> DataFrame:
    lines = scored(spark, sf).select("conv_id", "turn", "score")
    return rounded(D.sentiment_shift(D.add_thirds(lines, "conv_id", "turn"), "conv_id"))


@query(SCORED_SQL + """,
steps AS (
  SELECT conv_id, role,
    abs(score - lag(score) OVER (PARTITION BY conv_id, role ORDER BY turn)) AS step FROM scored)
SELECT conv_id, role, count(*) AS line_count, round(coalesce(avg(step), 0), 6) AS arc_complexity
FROM steps GROUP BY conv_id, role
""")
def arc_complexity(spark: SparkSession, sf: str) -> DataFrame:
    lines = scored(spark, sf).select("conv_id", "role", "turn", "score")
    return rounded(D.arc_complexity(lines, "conv_id", "role", "turn"))


@query(PROFILE_SQL + """
SELECT conv_id, role, line_count, first_seq, round(score_std, 6) AS score_std FROM profile
""")
def character_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.character_profile(scored(spark, sf), "conv_id", "role", "turn"))


@query(PROFILE_SQL + """
SELECT conv_id, role, line_count, first_seq, round(score_std, 6) AS score_std,
  CAST(rank AS INTEGER) AS rank FROM top3
""")
def top_characters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(top3(spark, sf))


@query(PROFILE_SQL + """
SELECT conv_id, role, turn, round(score, 6) AS score,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS point,
  count(*) OVER (PARTITION BY conv_id, role) AS points
FROM scored SEMI JOIN top3 USING (conv_id, role)
""")
def top_character_series(spark: SparkSession, sf: str) -> DataFrame:
    top = settle(top3(spark, sf).select("conv_id", "role"))
    series = D.top_character_series(scored(spark, sf), top, "conv_id", "role", "turn")
    return rounded(series)


@query(PROFILE_SQL + """
SELECT conv_id, max(role) FILTER (rank = 1) AS character1, max(role) FILTER (rank = 2) AS character2,
  max(role) FILTER (rank = 3) AS character3, round(max(round(score_std, 10)) FILTER (rank = 1), 4) AS arc1,
  round(max(round(score_std, 10)) FILTER (rank = 2), 4) AS arc2,
  round(max(round(score_std, 10)) FILTER (rank = 3), 4) AS arc3
FROM top3 GROUP BY conv_id
""")
def padded_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """Arc texts in fixed slots, split again into name and value for the check."""
    # Ten digits first, so that halves round alike in both engines.
    top = top3(spark, sf).withColumn("score_std", F.round("score_std", 10))
    padded = D.padded_arcs(top.withColumnRenamed("role", "character"), "conv_id")
    return padded.select(
        "conv_id",
        *[F.split_part(f"arc{i}_raw", F.lit(": "), F.lit(1)).alias(f"character{i}")
          for i in (1, 2, 3)],
        *[F.split_part(f"arc{i}_raw", F.lit(": "), F.lit(2)).cast("double").alias(f"arc{i}")
          for i in (1, 2, 3)],
    )


@query(f"""
WITH words AS (SELECT conv_id, unnest({sql_words('text')}) AS word FROM conversations),
counted AS (
  SELECT conv_id, round(count(DISTINCT word) / count(*), 4) AS share FROM words GROUP BY conv_id)
SELECT conv_id, coalesce(share, 0.0) AS lexical_diversity
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id)
""")
def conversation_lexical_diversity(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations")
    return D.lexical_diversity_by_title(lines, "conv_id", "text")


@query(SCORED_SQL + """
SELECT conv_id, round(avg(score), 6) + 0.0 AS mean_score FROM scored GROUP BY conv_id
""")
def mean_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.mean_score(scored(spark, sf), "conv_id"))


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """A short script for every turn: stage direction, cue, aside, line."""
    text = F.concat(
        F.lit("Interior.\n"), F.col("role"), F.lit("\n"), F.col("text"),
        F.lit(" NARRATOR (softly) the end, turn "), F.col("turn"),
    )
    title = F.concat_ws("/", "conv_id", "turn")
    return table(spark, sf, "conversations").select(title.alias("title"), text.alias("text"))


_SCRIPTS_SQL = f"""
WITH RECURSIVE scripts AS (
  SELECT conv_id || '/' || turn AS title, 'Interior.' || chr(10) || role || chr(10) || text
    || ' NARRATOR (softly) the end, turn ' || turn AS text FROM conversations),
{clean_sql('scripts')},
{dialogue_sql('cleaned')}"""


@query(_SCRIPTS_SQL + " SELECT title, seq, line_count, character, line FROM spoken")
def dialogue_lines(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = scripts(spark, sf).withColumn("text", clean_script(F.col("text")))
    return D.extract_dialogue(cleaned)


@query(f"""
WITH RECURSIVE scripts AS (SELECT doc_id AS title, text FROM documents),
{clean_sql('scripts')},
{dialogue_sql('cleaned')}
SELECT title, seq, line_count, character, line FROM spoken
""")
def document_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogue of every document read as a script."""
    cleaned = table(spark, sf, "documents").select(
        F.col("doc_id").alias("title"), clean_script(F.col("text")).alias("text")
    )
    return D.extract_dialogue(cleaned)


#: Cues that are put before the sentences of a document, in turn.
_CUES = ("ANNA", "BOB-RAY\n", "KANE (softly, to ANNA and BOB)", "THE NARRATOR\n(V.O.)")
_PLAIN = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH cut AS (
  SELECT doc_id, string_split({_PLAIN}, '. ') AS parts FROM documents WHERE text IS NOT NULL),
said AS (
  SELECT doc_id, i, (i - 1) % 4 AS cue, replace({sql_strip('parts[i]')}, chr(10), ' ') AS line
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut))
SELECT doc_id AS title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS seq,
  CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS line_count,
  ['ANNA', 'BOB-RAY', 'KANE', 'THE NARRATOR'][cue + 1] AS character, line
FROM said WHERE line <> ''
""")
def scripted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a script in which four speakers say a sentence each in turn."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cues = F.array(*[F.lit(cue) for cue in _CUES])
    turns = F.transform(
        F.split(plain, r"\. "),
        lambda part, i: F.concat(F.element_at(cues, i % 4 + 1), F.lit(" "), part, F.lit("\n")),
    )
    made = table(spark, sf, "documents").select(
        F.col("doc_id").alias("title"), F.array_join(turns, "").alias("text")
    )
    return D.extract_dialogue(made)


@query(_SCRIPTS_SQL + f""",
hits AS (
  SELECT *, len(list_filter(words, lambda x: x IN ({_sql_list(POSITIVE)}))) AS good,
    len(list_filter(words, lambda x: x IN ({_sql_list(NEGATIVE)}))) AS bad
  FROM (SELECT *, {sql_words('line')} AS words FROM spoken))
SELECT title, seq, character, line, CASE WHEN good >= bad THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
  round(CASE WHEN good >= bad THEN 1 ELSE -1 END * (greatest(good, bad) + 1) / (good + bad + 2), 6)
    AS score FROM hits
""")
def sentiment_log(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = scripts(spark, sf).withColumn("text", clean_script(F.col("text")))
    return rounded(S.sentiment_log(S.score_by_lexicon(D.extract_dialogue(cleaned), LEXICON)))
