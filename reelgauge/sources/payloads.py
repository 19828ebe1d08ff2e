"""Stored metadata responses, pages and index series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge import schemas
from reelgauge.constants import MISSING_TEXT
from reelgauge.functions import html, scores


def usable(body: Column) -> Column:
    """Whether a response holds a film."""
    return F.coalesce(F.from_json(body, "Response string")["Response"] == "True", F.lit(False))


def film_metadata(payloads: DataFrame) -> DataFrame:
    """One row per usable response of (title, body); other responses are dropped."""
    # Inlining the kept responses parses each body once; a filter would again.
    responses = F.array(F.from_json("body", schemas.METADATA_PAYLOAD))
    kept = F.filter(responses, lambda response: response["Response"] == "True")
    parsed = payloads.select(F.col("title").alias("request"), F.inline(kept))

    def field(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(MISSING_TEXT))

    ratings = F.col("Ratings")
    return parsed.select(
        "request",
        F.coalesce("Title", "request").alias("title"),
        field("Released").alias("release_date"),
        scores.release_year(field("Released")).alias("release_year"),
        field("BoxOffice").alias("box_office_raw"),
        scores.number(field("imdbRating")).alias("imdb_rating"),
        F.nullif(scores.critic_text(ratings), F.lit("")).alias("rt_score_raw"),
        scores.critic_score(ratings).alias("rt_0_10"),
        field("Actors").alias("cast"),
        field("Director").alias("director"),
    )


def page_values(pages: DataFrame, segment: int = 2, script_tag: str = "pre") -> DataFrame:
    """(title, budget_url, budget, script) from stored (title, kind, html) pages.

    Titles that differ only in case or outer space are one title, shown by its first
    spelling. Of several pages of a kind the greatest value counts.

    Each page is reduced to its value before titles are brought together. A
    budget counts only when the search page led to a detail page.
    """
    kind, page = F.col("kind"), F.col("html")
    target = html.link_target(page, F.col("title"))
    lifted = pages.select(
        "title",
        F.when(kind == "search", html.detail_url(target, segment)).alias("budget_url"),
        F.when(kind == "detail", html.labelled_amount(page)).alias("budget"),
        F.when(kind == "script", html.first_element_text(page, script_tag)).alias("script"),
    )
    gathered = lifted.groupBy(scores.normal_title(F.col("title")).alias("_key")).agg(
        F.min("title").alias("title"),
        *[F.max(name).alias(name) for name in ("budget_url", "budget", "script")],
    ).drop("_key")
    return gathered.withColumn("budget", F.when(F.col("budget_url").isNotNull(), F.col("budget")))
