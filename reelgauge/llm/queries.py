"""One query for each corpus operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.llm import conversations, fingerprints, jaccard_join, lexical_search, line_dedup, mixing, ngram_lm, packing, quality, sharding, token_counts, url_filter, vectors
from reelgauge.llm.shipping import ship
from reelgauge.llm.tables import read
from reelgauge.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Score from which a document counts as good.
QUALITY_BAR = 0.7


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = shipped
    return shipped


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), word_tokenizer())
    return packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=40)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "text", "n_lines", "n_removed")


#: Lines sharing a half (by length) are compared; one edit apart: they agree before and after it.
ORACLES["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
),
able AS (
  SELECT * FROM lines
  WHERE regexp_matches(line, '^[ 	-
]*([^ 	-
]+[ 	-
]+){4}[^ 	-
]')
),
firsts AS (SELECT line, length(line) AS n, min({'d': doc_id, 'a': place}) AS first FROM able GROUP BY line),
halves AS (
  SELECT line, n, first, unnest([
    {'b': n, 'k': 'p', 's': left(line, n // 2)}, {'b': n, 'k': 's', 's': right(line, n - n // 2)},
    {'b': n - 1, 'k': 'p', 's': left(line, (n - 1) // 2)}, {'b': n - 1, 'k': 's', 's': right(line, (n - 1) - (n - 1) // 2)}
  ]) AS half FROM firsts
),
pairs AS (
  SELECT DISTINCT b.line, b.n, a.line AS earlier, a.n AS m FROM halves a JOIN halves b
  ON a.half = b.half AND a.first < b.first AND abs(a.n - b.n) <= 1
),
agreed AS (
  SELECT *, len(list_filter(generate_series(1, least(n, m)), lambda x: left(line, x) = left(earlier, x))) AS p FROM pairs
),
near AS (
  SELECT DISTINCT line FROM agreed
  WHERE CASE WHEN n = m THEN substr(line, p + 2) = substr(earlier, p + 2)
             WHEN n > m THEN substr(line, p + 2) = substr(earlier, p + 1)
             ELSE substr(line, p + 1) = substr(earlier, p + 2) END
),
gone AS (
  SELECT able.doc_id, able.place FROM able JOIN firsts USING (line) LEFT JOIN near ON near.line = able.line
  WHERE near.line IS NOT NULL OR firsts.first <> {'d': able.doc_id, 'a': able.place}
),
rebuilt AS (
  SELECT lines.doc_id, count(*) AS n_lines, count(gone.place) AS n_removed,
    coalesce(string_agg(lines.line, chr(10) ORDER BY lines.place) FILTER (WHERE gone.place IS NULL), '') AS text
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.place = lines.place GROUP BY lines.doc_id
)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON r.doc_id = d.doc_id
"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), word_tokenizer(), limit=2048)


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ngram_lm.learn(ngram_lm.training_texts(docs))
    scored = ngram_lm.score_documents(docs, model)
    return scored.select(
        "doc_id", ngram_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = settle(quality.document_statistics(read(spark, sf_dir, "documents")))
    known = quality.labelled_statistics(measured, read(spark, sf_dir, "labels"), lambda doc: ~quality.held_out(doc))
    scored = quality.score_statistics(measured, quality.fit_discriminant(known))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_BAR).cast("int").alias("predicted"),
    )


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_classes(read(spark, sf_dir, "documents"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(mixing.word_sizes(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


#: (host, path, verdict) of the rules, and the names of sites whose pages are listed.
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
JUNK_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of all pages on sites known for junk."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    at = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    junk = at.filter(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, JUNK_SITES))))
    listed = junk.select(url_filter.canonical_url(F.col("host"), F.col("path")).alias("canonical")).distinct()
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op11_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
),
parsed AS (
  SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut
),
spelt AS (
  SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '(/index)?([.]html?)?/*$', '') AS canonical FROM parsed
),
listed AS (
  SELECT DISTINCT canonical FROM spelt
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
),
rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
fits AS (
  SELECT s.*, r.h || r.p AS rule, r.v,
    CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS other
  FROM spelt s LEFT JOIN rules r
  ON starts_with(s.path, r.p) AND (s.host = r.h OR ends_with(s.host, '.' || r.h))
)
SELECT page_id, host, path, rule, coalesce(v, other) AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
uses AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
rarity AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM uses, corpus GROUP BY term
),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN rarity USING (term) JOIN uses USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
