"""Column functions: text clean-up, parsing, scores, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.films import FEATURES_SQL, TRIMMED_SQL, is_award, trimmed_films
from catalog.registry import SQL_SPACE, query, rounded, sql_words, table
from reelgauge.functions import scores, text
from reelgauge.operators.cast import star_power_map, star_power_table, total_star_power
from reelgauge.operators.titles import flag_awards, is_award_title
from reelgauge.plans.film_analysis import film_features, middle_bin_titles


@query(rf"""
WITH squeezed AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'),
    '{SQL_SPACE}{{2,}}', ' ', 'g') AS text FROM documents),
cut AS (
  SELECT doc_id, string_split_regex(text, '(?m)^(?:[a-zA-Z0-9]|{SQL_SPACE})+\n') AS plain,
    regexp_extract_all(text, '(?m)^(?:[a-zA-Z0-9]|{SQL_SPACE})+\n') AS cues FROM squeezed)
SELECT doc_id, list_aggregate(list_transform(plain,
  lambda part, i: part || coalesce(upper(cues[i]), '')), 'string_agg', '') AS script
FROM cut
""")
def cleaned_scripts(spark: SparkSession, sf: str) -> DataFrame:
    script = text.clean_script(F.col("text")).alias("script")
    return table(spark, sf, "documents").select("doc_id", script)


@query(f"""
SELECT conv_id, turn, array_to_string(list_slice(
  list_filter(string_split_regex(text, '{SQL_SPACE}+'), lambda x: x <> ''), 1, 20), ' ') AS line
FROM conversations
""")
def truncated_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = text.truncate_words(F.col("text"), 20).alias("line")
    return table(spark, sf, "conversations").select("conv_id", "turn", line)


@query(f"""
WITH cut AS (SELECT doc_id, {sql_words('text')} AS words FROM documents)
SELECT doc_id, coalesce(round(len(list_distinct(words)) / nullif(len(words), 0), 4), 0.0)
  AS lexical_diversity
FROM cut
""")
def document_lexical_diversity(spark: SparkSession, sf: str) -> DataFrame:
    share = text.lexical_diversity(F.col("text")).alias("lexical_diversity")
    return table(spark, sf, "documents").select("doc_id", share)


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END
  AS release_year
FROM orders
""")
def release_years(spark: SparkSession, sf: str) -> DataFrame:
    shape = F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "MMM yyyy"))
    released = shape.otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return table(spark, sf, "orders").select(
        "o_orderkey", scores.release_year(released).alias("release_year")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice AS amount,
  CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS dollar_amount,
  l_tax * 100 + 0.0 AS pct
FROM lineitem
""")
def parsed_amounts(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.format_number("l_extendedprice", 2)
    marked = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("$"), plain)).otherwise(plain)
    share = F.concat((F.col("l_tax") * 100).cast("string"), F.lit("%"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scores.currency(marked).alias("amount"),
        scores.dollar_amount(marked).alias("dollar_amount"),
        (scores.percent(share) + F.lit(0.0)).alias("pct"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN p_retailprice END AS arc,
  p_name || ': ' || p_size AS arc_text
FROM part
""")
def arc_texts(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("p_type") == "SMALL", F.lit("N/A")).otherwise(
        F.col("p_retailprice").cast("string")
    )
    raw = F.concat_ws(": ", "p_name", "p_brand", tail)
    return table(spark, sf, "part").select(
        "p_partkey",
        scores.arc_value(raw).alias("arc"),
        F.concat_ws(": ", "p_name", "p_size").alias("arc_text"),
    )


@query("""
WITH holed AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS a,
    CASE WHEN l_returnflag <> 'A' THEN l_discount END AS b,
    CASE WHEN l_returnflag = 'N' THEN l_tax END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round((a + coalesce(b, 0) + coalesce(c, 0))
    / (1 + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END), 6)
    AS mean_value
FROM holed
""")
def row_means(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    mean = scores.row_mean(
        F.col("l_quantity"),
        F.when(flag != "A", F.col("l_discount")),
        F.when(flag == "N", F.col("l_tax")),
    )
    return rounded(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", mean.alias("mean_value")
    ))


@query("""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag <> 'R'
    THEN round(greatest(0.0, 1 - abs(l_discount * 3 - 0.2) * 10), 6) + 0.0 END AS tent,
  round(1 / (1 + exp(-(l_discount - 0.05) / 0.02)), 6) AS logistic,
  round(ln(1 + l_extendedprice), 6) AS log_price,
  round(exp(ln(1 + l_extendedprice)) - 1, 4) AS price,
  round(l_extendedprice * 1.2, 2) AS price_2025,
  round(l_extendedprice / 100, 4) AS price_norm,
  round(0.3 * l_discount + 0.2 * l_tax + 0.5 * l_quantity, 6) AS weighted_iq,
  round(l_tax - l_discount, 6) + 0.0 AS difference
FROM lineitem
""")
def shaped_scores(spark: SparkSession, sf: str) -> DataFrame:
    discount, tax, price = F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    scaled = F.when(F.col("l_returnflag") != "R", discount * 3)
    iq = scores.weighted_iq(discount, tax, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.round(scores.tent(scaled), 6) + F.lit(0.0)).alias("tent"),
        F.round(scores.logistic(discount, center=0.05), 6).alias("logistic"),
        F.round(F.log1p(price), 6).alias("log_price"),
        F.round(F.expm1(F.log1p(price)), 4).alias("price"),
        F.round(price * 1.2, 2).alias("price_2025"),
        F.round(price / 100, 4).alias("price_norm"),
        F.round(iq, 6).alias("weighted_iq"),
        (F.round(tax - discount, 6) + F.lit(0.0)).alias("difference"),
    )


@query("""
SELECT p_partkey, round((p_retailprice / 1000 + p_size / 50)
  / ln(CASE WHEN p_size > 10 THEN p_retailprice * 1000 ELSE 1.0 END + 1), 4) AS quality
FROM part
""")
def part_quality_per_budget(spark: SparkSession, sf: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    budget = F.when(size > 10, price * 1000)
    quality = scores.quality_per_budget(price / 1000, size / 50, budget)
    return table(spark, sf, "part").select("p_partkey", quality.alias("quality"))


@query("""
SELECT p_partkey, p_name IN ('red widget', 'small ring') AS award,
  EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 0 AND s_suppkey = p_partkey) AS table_award
FROM part
""")
def award_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Awards from a fixed list, and from a table of any size."""
    title = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))
    parts = table(spark, sf, "part").select(
        "p_partkey",
        is_award_title(title, ["Red Widget", "Small Ring"]).alias("award"),
        F.concat(F.lit("supplier "), "p_partkey").alias("title"),
    )
    awards = table(spark, sf, "supplier").where(F.col("s_acctbal") > 0)
    named = awards.select(F.concat(F.lit("SUPPLIER "), "s_suppkey").alias("title"))
    return flag_awards(parts, named, flag="table_award").drop("title")


@query("""
SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount > 0.02 AND l_discount <= 0.06
""")
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("l_discount")
    return table(spark, sf, "lineitem").where((value > 0.02) & (value <= 0.06)).select(
        "l_orderkey", "l_discount"
    )


@query(f"{TRIMMED_SQL} SELECT title, rt_pct FROM trimmed "
       "WHERE lexical_adjusted > 0.333 AND lexical_adjusted <= 0.667")
def middle_bin_films(spark: SparkSession, sf: str) -> DataFrame:
    return middle_bin_titles(trimmed_films(spark, sf))


@query(f"""{FEATURES_SQL}
SELECT title, award_winner, round(avg_arc, 6) AS avg_arc,
  round(sentiment_adjusted, 6) AS sentiment_adjusted, round(lexical_adjusted, 6) AS lexical_adjusted,
  round(log_budget, 6) AS log_budget, round(log_box_office, 6) AS log_box_office,
  round(rt_norm, 6) AS rt_norm, round(weighted_iq, 6) AS weighted_iq,
  round(box_office_norm, 6) AS box_office_norm,
  round(indie_score_normalized, 6) AS indie_score_normalized
FROM features
""")
def film_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(film_features(trimmed_films(spark, sf), is_award()).select(
        "title", "award_winner", "avg_arc", "sentiment_adjusted", "lexical_adjusted", "log_budget",
        "log_box_office", "rt_norm", "weighted_iq", "box_office_norm", "indie_score_normalized",
    ))


@query("""
SELECT o_orderkey, o_totalprice, o_orderdate, o_clerk_score FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS o_orderdate,
    o_custkey AS o_clerk_score FROM orders)
WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL
""")
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    holed = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("o_orderdate"),
        F.col("o_custkey").alias("o_clerk_score"),
    )
    return holed.na.drop(subset=["o_totalprice", "o_orderdate"])


@query("""
WITH scored AS (
  SELECT o_orderkey, o_totalprice / 250000 - 1 AS money,
    CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) / 4.0 - 499.5 END AS creative
  FROM orders)
SELECT o_orderkey, CASE
  WHEN money > 0.5 AND creative > 0.3 THEN '🎯 Hidden Gem (High Script, Undervalued)'
  WHEN money > 0.5 THEN '💰 Financially Undervalued'
  WHEN creative > 0.3 THEN '🧠 Critically Underrated Script'
  WHEN money < -0.5 AND creative < -0.3 THEN '🚫 Overhyped & Underwhelming'
  ELSE '✅ Fairly Valued' END AS verdict
FROM scored
""")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    money = F.col("o_totalprice") / 250000 - 1
    creative = F.when(
        F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate") / 4.0 - 499.5
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", scores.verdict(money, creative).alias("verdict")
    )


@query("SELECT o_orderkey, '$' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) "
       "AS price FROM orders")
def dollar_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", scores.dollars(F.col("o_totalprice")).alias("price")
    )


@query("""
WITH billed AS (
  SELECT p_partkey, p_size / 5.0 AS imdb, CASE WHEN p_type <> 'SMALL' THEN p_retailprice / 100 END
    AS critics, unnest(string_split(p_name, ' ')) AS actor,
    generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part)
SELECT p_partkey, actor,
  round(avg((imdb + coalesce(critics, 0)) * CASE WHEN place = 1 THEN 1.0 ELSE 0.5 END), 6)
    AS star_power
FROM billed GROUP BY p_partkey, actor
""")
def star_power_by_actor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(star_power_table(part_casts(spark, sf), title_col="p_partkey"))


def part_casts(spark: SparkSession, sf: str) -> DataFrame:
    critics = F.when(F.col("p_type") != "SMALL", F.col("p_retailprice") / 100)
    return table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") / 5.0).alias("imdb_rating"),
        critics.alias("rt_0_10"),
        F.replace("p_name", F.lit(" "), F.lit(" , ")).alias("cast"),
    )


@query("""
WITH billed AS (
  SELECT p_partkey, p_size / 5.0 AS imdb, CASE WHEN p_type <> 'SMALL' THEN p_retailprice / 100 END
    AS critics, unnest(string_split(p_name, ' ')) AS actor,
    generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part),
scored AS (
  SELECT p_partkey, actor,
    avg((imdb + coalesce(critics, 0)) * CASE WHEN place = 1 THEN 1.0 ELSE 0.5 END) AS power
  FROM billed GROUP BY p_partkey, actor)
SELECT p_partkey, round(sum(power), 6) AS total_star_power FROM scored GROUP BY p_partkey
""")
def star_power_totals(spark: SparkSession, sf: str) -> DataFrame:
    power = star_power_map(F.col("imdb_rating"), F.col("rt_0_10"), F.col("cast"))
    return rounded(part_casts(spark, sf).select(
        "p_partkey", total_star_power(power).alias("total_star_power")
    ))
