"""Column expressions that turn raw film values into numbers and scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgauge import constants as C


def number(text: Column) -> Column:
    """Text as a double; anything unreadable, and NaN, is NULL."""
    plain = F.trim(text.cast("string"))
    # Java also reads a type suffix, as in "1d": not a number here.
    suffixed = F.regexp_like(plain, F.lit("(?i)[0-9.][df]$"))
    return F.nanvl(F.when(~suffixed, plain.try_cast("double")), F.lit(None))


def currency(text: Column) -> Column:
    return number(F.regexp_replace(text, "[$,]", ""))


def dollar_amount(text: Column) -> Column:
    """Like ``currency``, but only for text that starts with "$"."""
    return F.when(F.startswith(text, F.lit("$")), currency(text))


def percent(text: Column) -> Column:
    return number(F.replace(text, F.lit("%"), F.lit("")))


def critic_values(ratings: Column, source: str = C.CRITIC_SOURCE) -> Column:
    chosen = F.filter(ratings, lambda rating: rating["Source"] == source)
    return F.transform(chosen, lambda rating: rating["Value"])


def critic_score(ratings: Column, source: str = C.CRITIC_SOURCE) -> Column:
    """First critic percentage on a 0-10 scale."""
    first = F.get(critic_values(ratings, source), F.lit(0))
    return number(F.regexp_replace(first, "%+$", "")) / 10


def critic_text(ratings: Column, source: str = C.CRITIC_SOURCE) -> Column:
    return F.array_join(critic_values(ratings, source), ", ")


def release_year(released: Column) -> Column:
    """Year at the end of a day-month-year text."""
    parts = F.split(F.trim(released), r"\s+")
    last = F.element_at(parts, -1)
    return F.when(
        (F.size(parts) >= 3) & F.regexp_like(last, F.lit("^[0-9]+$")), last.try_cast("int")
    )


def adjusted_amount(amount: Column, multiplier: Column) -> Column:
    """Amount in base-year prices, to the cent."""
    # Cents times a 4-digit multiplier have 6 digits: restore them, then round.
    return F.round(F.round(amount * multiplier, 6), 2)


def arc_value(text: Column) -> Column:
    """Number after the last colon of "NAME: 0.1234"."""
    return F.regexp_extract(text, r":\s*([\d.]+)$", 1).try_cast("double")


def row_mean(*columns: Column) -> Column:
    """Mean over the columns that hold a value; NULL when none does."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    held = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, held)


def tent(
    value: Column, peak: float = C.SENTIMENT_PEAK, slope: float = C.SENTIMENT_SLOPE
) -> Column:
    """1 at the peak, falling on both sides to 0."""
    height = 1 - F.abs(value - F.lit(peak)) * F.lit(slope)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), height))


def logistic(
    value: Column, center: float = C.LEXICAL_CENTER, width: float = C.LEXICAL_WIDTH
) -> Column:
    return 1 / (1 + F.exp(-(value - F.lit(center)) / F.lit(width)))


def weighted_iq(
    sentiment: Column, lexical: Column, arc: Column, weights: dict[str, float] = C.IQ_WEIGHTS
) -> Column:
    return (
        F.lit(weights["sentiment"]) * sentiment
        + F.lit(weights["lexical"]) * lexical
        + F.lit(weights["arc"]) * arc
    )


def quality_per_budget(shift: Column, diversity: Column, budget: Column) -> Column:
    """Script quality over the log of the budget; a missing budget counts as 1."""
    base = F.when(budget > 0, budget).otherwise(F.lit(1.0))
    return F.round((shift + diversity) / F.ln(base + 1), 4)


def signed_score(label: Column, score: Column) -> Column:
    return F.when(label == "POSITIVE", score).otherwise(-score)


def verdict(
    money: Column,
    creative: Column,
    money_threshold: float = C.MONEY_THRESHOLD,
    creative_threshold: float = C.CREATIVE_THRESHOLD,
) -> Column:
    dear, rich = F.lit(money_threshold), F.lit(creative_threshold)
    return (
        F.when((money > dear) & (creative > rich), C.VERDICT_GEM)
        .when(money > dear, C.VERDICT_MONEY)
        .when(creative > rich, C.VERDICT_SCRIPT)
        .when((money < -dear) & (creative < -rich), C.VERDICT_HYPED)
        .otherwise(C.VERDICT_FAIR)
    )


def dollars(amount: Column) -> Column:
    """Whole dollars with thousands separators; the sign follows the "$"."""
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def normal_title(title: Column) -> Column:
    """Key on which titles count as the same."""
    return F.lower(F.trim(title))
