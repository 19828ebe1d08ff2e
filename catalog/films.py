"""A film table derived from orders and their line items, in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from reelgauge import schemas
from reelgauge.operators.stats import trim_outliers
from reelgauge.plans.film_analysis import adjusted_scores
from reelgauge.session import settle


def raw_films(spark: SparkSession, sf: str) -> DataFrame:
    """One film per order with line items; texts as a film CSV would hold them."""
    def mean(name: str) -> Column:
        return F.sum(name) / F.count("*")

    arc = {
        "JO": F.max("l_discount") * 5,
        "AL: B": mean("l_tax") * 10,
        "CY": F.min("l_quantity") / 50,
    }
    texts = [
        F.concat(F.lit(f"{name}: "), F.format_string("%.4f", value)) for name, value in arc.items()
    ]
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            texts[0].alias("arc1_raw"),
            texts[1].alias("arc2_raw"),
            F.when(F.count("*") > 2, texts[2]).alias("arc3_raw"),
            F.round(mean("l_discount") * 4, 6).alias("sentiment_shift"),
            F.round(0.2 + mean("l_quantity") * 0.0016, 6).alias("lexical_diversity"),
            F.concat(F.round(mean("l_tax") * 1250, 4).cast("string"), F.lit("%")).alias(
                "rt_score_raw"
            ),
            F.round(F.sum("l_quantity") / 10, 4).alias("total_star_power"),
            F.when(F.sum("l_quantity") > 10, F.round(F.sum("l_extendedprice"), 2)).alias("budget"),
        )
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat("o_orderpriority", F.lit(" "), "o_orderkey").alias("title"),
        F.date_format("o_orderdate", "dd MMM yyyy").alias("release_date"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("box_office_raw"),
        F.col("o_totalprice").alias("box_office_adj"),
    )
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(*[
        F.col(field.name) if field.name in joined.columns
        else F.lit(None).cast(field.dataType).alias(field.name)
        for field in schemas.FILM.fields
    ])



def trimmed_films(spark: SparkSession, sf: str) -> DataFrame:
    """Films with their scores, rating outliers cut, worked out from the tables once."""
    return trim_outliers(settle(adjusted_scores(raw_films(spark, sf))), "rt_pct")


def is_award(title: str = "title") -> Column:
    return F.startswith(F.col(title), F.lit("1-URGENT"))


FILMS_SQL = """
WITH lines AS (
  SELECT l_orderkey,
    'JO: ' || printf('%.4f', max(l_discount) * 5) AS arc1_raw,
    'AL: B: ' || printf('%.4f', sum(l_tax) / count(*) * 10) AS arc2_raw,
    CASE WHEN count(*) > 2 THEN 'CY: ' || printf('%.4f', min(l_quantity) / 50) END AS arc3_raw,
    round(sum(l_discount) / count(*) * 4, 6) AS sentiment_shift,
    round(0.2 + sum(l_quantity) / count(*) * 0.0016, 6) AS lexical_diversity,
    round(sum(l_tax) / count(*) * 1250, 4) + 0.0 AS rt_pct,
    round(sum(l_quantity) / 10, 4) AS total_star_power,
    CASE WHEN sum(l_quantity) > 10 THEN round(sum(l_extendedprice), 2) END AS budget
  FROM lineitem GROUP BY l_orderkey),
films AS (
  SELECT o_orderpriority || ' ' || o_orderkey AS title, o_totalprice AS box_office,
    o_totalprice AS box_office_adj, lines.* EXCLUDE (l_orderkey),
    o_orderpriority = '1-URGENT' AS award_winner
  FROM orders JOIN lines ON o_orderkey = l_orderkey)"""

CLEAN_FILMS_SQL = FILMS_SQL + """,
arcs AS (
  SELECT *, CAST(regexp_extract(arc1_raw, ':\\s*([\\d.]+)$', 1) AS DOUBLE) AS a1,
    CAST(regexp_extract(arc2_raw, ':\\s*([\\d.]+)$', 1) AS DOUBLE) AS a2,
    CAST(nullif(regexp_extract(arc3_raw, ':\\s*([\\d.]+)$', 1), '') AS DOUBLE) AS a3
  FROM films),
clean AS (
  SELECT *, (a1 + a2 + coalesce(a3, 0)) / (2 + CASE WHEN a3 IS NULL THEN 0 ELSE 1 END) AS avg_arc,
    greatest(0.0, 1 - abs(sentiment_shift - 0.2) * 10) AS sentiment_adjusted,
    1 / (1 + exp(-(lexical_diversity - 0.24) / 0.02)) AS lexical_adjusted
  FROM arcs)"""

TRIMMED_SQL = CLEAN_FILMS_SQL + """,
limits AS (SELECT quantile_cont(rt_pct, 0.05) AS lo, quantile_cont(rt_pct, 0.95) AS hi FROM clean),
trimmed AS (SELECT clean.* FROM clean, limits WHERE rt_pct >= lo AND rt_pct <= hi)"""

FEATURES_SQL = TRIMMED_SQL + """,
complete AS (
  SELECT *, ln(1 + budget) AS log_budget, ln(1 + box_office_adj) AS log_box_office,
    rt_pct / 100 AS rt_norm,
    0.3 * sentiment_adjusted + 0.2 * lexical_adjusted + 0.5 * avg_arc AS weighted_iq
  FROM trimmed
  WHERE box_office_adj IS NOT NULL AND rt_pct IS NOT NULL AND sentiment_shift IS NOT NULL
    AND lexical_diversity IS NOT NULL AND avg_arc IS NOT NULL
    AND total_star_power IS NOT NULL AND budget IS NOT NULL),
ends AS (
  SELECT min(log_box_office) AS lo_b, max(log_box_office) AS hi_b,
    min(weighted_iq) AS lo_w, max(weighted_iq) AS hi_w FROM complete),
features AS (
  SELECT complete.*, (log_box_office - lo_b) / (hi_b - lo_b) AS box_office_norm,
    (weighted_iq - lo_w) / (hi_w - lo_w) AS indie_score_normalized
  FROM complete, ends)"""


def ols_sql(source: str, label: str, features: list[str]) -> str:
    """CTEs that solve the normal equations by elimination: ``solved`` holds the
    coefficients b0.. and the diagonal of the inverse d0.., ``fitted`` the rows."""
    terms = ["1.0", *features]
    size = range(len(terms))
    sums = [f"sum({terms[i]} * {terms[j]}) AS a{i}_{j}" for i in size for j in size]
    sums += [f"sum({terms[i]} * {label}) AS b{i}" for i in size]
    sums += [f"{float(i == j)}::DOUBLE AS c{i}_{j}" for i in size for j in size]
    ctes = [f"step0 AS (SELECT {', '.join(sums)} FROM {source})"]
    names = [f"a{{}}_{j}" for j in size] + ["b{}"] + [f"c{{}}_{j}" for j in size]
    for p in size:
        cells = []
        for i in size:
            for name in names:
                here, pivot = name.format(i), name.format(p)
                if i == p:
                    cells.append(f"{here} / a{p}_{p} AS {here}")
                else:
                    cells.append(f"{here} - a{i}_{p} * {pivot} / a{p}_{p} AS {here}")
        ctes.append(f"step{p + 1} AS (SELECT {', '.join(cells)} FROM step{p})")
    picked = [f"b{i}" for i in size] + [f"c{i}_{i} AS d{i}" for i in size]
    ctes.append(f"solved AS (SELECT {', '.join(picked)} FROM step{len(terms)})")
    value = " + ".join(f"b{i} * {term}" for i, term in enumerate(terms))
    ctes.append(f"fitted AS (SELECT {source}.*, {value} AS fit FROM {source}, solved)")
    ctes.append(
        f"residuals AS (SELECT count(*) AS n, sum(pow({label} - fit, 2)) AS rss,"
        f" sum(pow({label} - fit, 3)) AS m3, sum(pow({label} - fit, 4)) AS m4,"
        f" var_pop({label}) * count(*) AS tss FROM fitted)"
    )
    return ",\n".join(ctes)
