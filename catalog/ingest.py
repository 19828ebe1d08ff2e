"""Sources, sinks and the incremental load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.films import CLEAN_FILMS_SQL, FILMS_SQL, raw_films
from catalog.registry import query, rounded, table
from reelgauge.functions import html
from reelgauge.functions.scores import adjusted_amount
from reelgauge.operators.inflation import add_multiplier, yearly_multipliers
from reelgauge.operators.titles import distinct_titles, new_titles
from reelgauge.plans.ingest import one_payload_per_title
from reelgauge.session import shared_folder
from reelgauge.sources.films import clean_films
from reelgauge.sources.payloads import film_metadata, page_values
from reelgauge.sources.sink import append_films, read_film_sink


@query("SELECT DISTINCT p_name FROM part")
def distinct_part_names(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_titles(table(spark, sf, "part"), "p_name")


@query("""
WITH candidates AS (
  SELECT p_partkey, '  ' || upper(p_name) || ' No. ' || p_partkey || ' ' AS title FROM part),
stored AS (
  SELECT DISTINCT p_name || ' no. ' || p_partkey AS title
  FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 45)
SELECT p_partkey, title FROM candidates
WHERE lower(trim(title)) NOT IN (SELECT title FROM stored)
""")
def new_part_titles(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    sold = table(spark, sf, "lineitem").where(F.col("l_quantity") > 45)
    title = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" No. "), F.col("p_partkey"), F.lit(" "))
    candidates = part.select("p_partkey", title.alias("title"))
    stored = part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(
        F.concat("p_name", F.lit(" no. "), "p_partkey").alias("title")
    )
    return new_titles(candidates, stored)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", payload["k"].alias("k"))


def order_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata response for every order, some of them failed or sparse."""
    price = F.col("o_totalprice")
    critic = F.concat(F.round(price / 5000).cast("int"), F.lit("%"))
    ratings = F.array(
        F.struct(F.lit("Other").alias("Source"), F.lit("7/10").alias("Value")),
        F.struct(F.lit("Rotten Tomatoes").alias("Source"), critic.alias("Value")),
    )
    body = F.to_json(F.struct(
        F.when(F.col("o_orderstatus") == "F", "False").otherwise("True").alias("Response"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("Title"),
        F.when(F.col("o_orderpriority") == "5-LOW", "N/A")
        .otherwise(F.date_format("o_orderdate", "dd MMM yyyy")).alias("Released"),
        F.concat(F.lit("$"), F.format_number(price, 2)).alias("BoxOffice"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "N/A")
        .otherwise(F.round(price / 50000, 1).cast("string")).alias("imdbRating"),
        F.lit("Ann Lee, Bo Ray").alias("Actors"),
        F.when(F.col("o_orderpriority") != "1-URGENT", ratings).alias("Ratings"),
    ))
    title = F.concat(F.lit("order "), F.col("o_orderkey"))
    return table(spark, sf, "orders").select(title.alias("title"), body.alias("body"))


@query("""
SELECT 'order ' || o_orderkey AS request, 'Order ' || o_orderkey AS title,
  CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%d %b %Y') END AS release_date,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END AS release_year,
  round(o_totalprice, 2) AS box_office,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN round(o_totalprice / 50000, 1) END AS imdb_rating,
  CASE WHEN o_orderpriority <> '1-URGENT'
    THEN CAST(round(o_totalprice / 5000) AS INTEGER) || '%' END AS rt_score_raw,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN round(o_totalprice / 5000) / 10 END AS rt_0_10,
  'Ann Lee, Bo Ray' AS "cast", CAST(NULL AS VARCHAR) AS director
FROM orders WHERE o_orderstatus <> 'F'
""")
def metadata_payloads(spark: SparkSession, sf: str) -> DataFrame:
    metadata = film_metadata(order_payloads(spark, sf))
    amount = F.regexp_replace("box_office_raw", "[$,]", "").cast("double").alias("box_office")
    return metadata.select(*[
        amount if name == "box_office_raw" else F.col(name) for name in metadata.columns
    ])


@query("""
SELECT 'order ' || o_orderkey AS request, round(o_totalprice, 2) AS box_office FROM orders
""")
def films_from_retried_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every order has a good response, half of them after a failed one in other spelling."""
    orders = table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    good = F.to_json(F.struct(
        F.lit("True").alias("Response"), F.concat(F.lit("$"), price).alias("BoxOffice")
    ))
    failed = F.to_json(F.struct(F.lit("False").alias("Response")))
    responses = orders.select(F.concat(F.lit("order "), key).alias("title"), good.alias("body"))
    first_tries = orders.where(key % 2 == 0).select(
        F.concat(F.lit(" ORDER "), key, F.lit(" ")).alias("title"), failed.alias("body")
    )
    metadata = film_metadata(one_payload_per_title(responses.unionByName(first_tries)))
    amount = F.regexp_replace("box_office_raw", "[$,]", "").cast("double")
    return metadata.select("request", amount.alias("box_office"))


@query(r"""
WITH found AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">the</a>', 1)[1] AS href FROM pages)
SELECT page_id, href,
  'https://www.boxofficemojo.com/title/' || nullif(string_split(href, '/')[2], '')
    || '/?ref_=bo_se_r_1' AS detail_url
FROM found WHERE href IS NOT NULL
""")
def matching_links(spark: SparkSession, sf: str) -> DataFrame:
    href = html.link_target(F.col("html"), F.lit("the"))
    found = table(spark, sf, "pages").select("page_id", href.alias("href"))
    return found.where(F.col("href").isNotNull()).withColumn(
        "detail_url", html.detail_url(F.col("href"), segment=1)
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('5-LOW', '2-HIGH') THEN o_totalprice END AS budget
FROM orders
""")
def labelled_budgets(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    priority = F.col("o_orderpriority")
    label = (
        F.when(priority == "5-LOW", "Gross").when(priority == "2-HIGH", "BUDGET")
        .when(priority == "1-URGENT", "<b>Budget</b>").otherwise("Budget")
    )
    page = F.concat(
        F.lit("<div><span class='a'>Opening</span><span>$1</span><span>"), label,
        F.lit("</span>\n<b>about</b>&#99999999; <span class='money'> "), amount, F.lit(" </span></div>"),
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", html.labelled_amount(page).alias("budget")
    )


@query("""
SELECT o_orderkey, o_totalprice AS budget, o_orderpriority || ' < ' || o_orderstatus || ' & more' AS script,
  '/title/tt' || o_orderkey AS href
FROM orders
""")
def nested_page_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values out of elements within their like, unclosed ones, and links in links."""
    key = F.col("o_orderkey")
    amount = F.format_number("o_totalprice", 2)
    detail = F.concat(
        F.lit("<div><span><b>Budget</b></span><p><span class='a>b'>$<span>"),
        F.substring_index(amount, ".", 1), F.lit("</span><br>."), F.substring_index(amount, ".", -1),
        F.lit("</div><span>9</span>"),
    )
    script = F.concat(
        F.lit("<!-- <pre>no</pre> --><ul><li><PRE>"), F.col("o_orderpriority"), F.lit(" < <pre>"),
        F.col("o_orderstatus"), F.lit(" &amp; <script>'</pre>'</script></pre>more</ul> after</pre>"),
    )
    search = F.concat(
        F.lit("<a href='/x'>see <a href='/title/tt"), key, F.lit("'><i>order "), key, F.lit("</i></a></a>")
    )
    title = F.concat(F.lit("order "), key)
    return table(spark, sf, "orders").select(
        "o_orderkey", html.labelled_amount(detail).alias("budget"),
        html.first_element_text(script).alias("script"), html.link_target(search, title).alias("href"),
    )


@query(r"""
WITH inner_html AS (
  SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS body FROM pages),
bare AS (
  SELECT page_id, regexp_replace(regexp_replace(body,
    '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'),
    '<[a-zA-Z/!][^>]*>', '', 'g') AS body FROM inner_html)
SELECT page_id, regexp_replace(replace(replace(replace(replace(body,
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp([^;a-zA-Z0-9]|$)', '&\1', 'g')
  AS page_text
FROM bare
""")
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = html.first_element_text(F.col("html"), "article")
    return table(spark, sf, "pages").select("page_id", text.alias("page_text"))


@query("""
WITH yearly AS (
  SELECT year(o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY 1),
base AS (SELECT avg(o_totalprice) AS m FROM orders WHERE year(o_orderdate) = 2000)
SELECT CAST(y AS INTEGER) AS year, round((SELECT m FROM base) / m, 4) AS multiplier FROM yearly
""")
def yearly_price_multipliers(spark: SparkSession, sf: str) -> DataFrame:
    return yearly_multipliers(table(spark, sf, "orders"), 2000, "o_orderdate", "o_totalprice")


@query("""
WITH yearly AS (
  SELECT year(o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY 1),
base AS (SELECT m FROM yearly WHERE y = 2000),
factor AS (SELECT y, round((SELECT m FROM base) / m, 4) AS multiplier FROM yearly)
SELECT l_orderkey, l_linenumber, coalesce(multiplier, 1.0)::DOUBLE AS multiplier,
  round(round(l_extendedprice * coalesce(multiplier, 1.0), 6)::DECIMAL(18, 6), 2)::DOUBLE
    AS adjusted
FROM lineitem LEFT JOIN factor ON year(l_shipdate) = y
""")
def inflation_adjusted_prices(spark: SparkSession, sf: str) -> DataFrame:
    factors = yearly_multipliers(table(spark, sf, "orders"), 2000, "o_orderdate", "o_totalprice")
    dated = table(spark, sf, "lineitem").withColumn("release_year", F.year("l_shipdate"))
    adjusted = adjusted_amount(F.col("l_extendedprice"), F.col("multiplier"))
    return add_multiplier(dated, factors).select(
        "l_orderkey", "l_linenumber", "multiplier", adjusted.alias("adjusted")
    )


@query(f"{CLEAN_FILMS_SQL} SELECT title, box_office, box_office_adj, rt_pct, budget FROM clean")
def cleaned_film_table(spark: SparkSession, sf: str) -> DataFrame:
    return clean_films(raw_films(spark, sf)).select(
        "title", "box_office", "box_office_adj", "rt_pct", "budget"
    )


@query(f"{FILMS_SQL} SELECT title, box_office_adj, sentiment_shift, arc1_raw FROM films")
def film_sink_after_two_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Load the films with a long arc text, then all: no title is stored twice."""
    films = raw_films(spark, sf)
    sink = f"{shared_folder(spark)}/films-{uuid.uuid4().hex}"
    append_films(films.where(F.col("arc3_raw").isNotNull()), sink)
    append_films(films, sink)
    return read_film_sink(spark, sink).select(
        "title", "box_office_adj", "sentiment_shift", "arc1_raw"
    )


@query("""
SELECT 'order ' || o_orderkey AS title,
  'https://www.boxofficemojo.com/title/tt' || o_orderkey || '/?ref_=bo_se_r_1' AS budget_url,
  o_totalprice AS budget, 'MARY' || chr(10) || o_orderpriority AS script
FROM orders
""")
def stored_page_values(spark: SparkSession, sf: str) -> DataFrame:
    return page_values(order_pages(spark, sf))


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A search, a detail and a script page for every order."""
    key = F.col("o_orderkey")
    title = F.concat(F.lit("order "), key)
    pages = {
        "search": F.concat(F.lit('<a href="/x/y/">Other</a><a class="t" href="/title/tt'), key,
                           F.lit('/?ref">'), title, F.lit("</a>")),
        "detail": F.concat(F.lit("<span>Budget</span><span>$"),
                           F.format_number("o_totalprice", 2), F.lit("</span>")),
        "script": F.concat(F.lit("<body><pre><b>MARY</b>\n"), F.col("o_orderpriority"),
                           F.lit("</pre></body>")),
    }
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), page.alias("html")) for kind, page in pages.items()
    ])
    return (
        table(spark, sf, "orders")
        .select(title.alias("title"), F.explode(kinds).alias("page"))
        .select("title", "page.*")
    )
