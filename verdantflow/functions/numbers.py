"""Guarded arithmetic, weighted means, codes and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b for a positive denominator, else null."""
    return F.when(b > 0, a / b)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def clean_number(x: Column) -> Column:
    """Text with thousands separators or a trailing percent sign as a number; null if it isn't one."""
    return F.regexp_replace(F.trim(x), ",|%$", "").try_cast("double")


def listed_code(x: Column) -> Column:
    """Digits of an exchange code such as ``SEHK: 5``."""
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("long")


def ticker(code: Column, suffix: str = ".HK", width: int = 4) -> Column:
    """``0005.HK`` for 5; longer codes keep their digits."""
    digits = code.cast("string")
    return F.concat(F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits), F.lit(suffix))


def greenness(e_score: Column, e_weight: Column) -> Column:
    """-(10 - E) * weight / 100: zero for the greenest, more negative for weighty brown firms."""
    return -(10 - e_score) * e_weight / 100


def weighted_available_mean(values: list[tuple[Column, float]]) -> Column:
    """Mean of the columns that aren't null, weights renormalised; null if all are."""
    total = sum((F.when(c.isNotNull(), F.lit(float(abs(w)))).otherwise(0.0) for c, w in values), F.lit(0.0))
    value = sum((F.coalesce(c * float(abs(w)), F.lit(0.0)) for c, w in values), F.lit(0.0))
    return F.when(total > 0, value / total)


def signed_score(x: Column, weight: float) -> Column:
    """A score that a negative weight turns round (10 - x)."""
    return 10 - x if weight < 0 else x


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def present(*columns: Column) -> Column:
    """How many of the columns aren't null."""
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def rank_pillar(share: Column, n: Column, higher_is_greener: bool) -> Column:
    """0 to 10 from a percentile rank; turned round so that the best of n still gets 10."""
    return 10 * share if higher_is_greener else 10 * (1 - share) + 10 / n


def whole_shares(capital: Column, price: Column) -> Column:
    return F.when(price > 0, F.floor(capital / price))


def trade_side(change: Column, least: float = 0.005) -> Column:
    return F.when(change >= least, "buy").when(change <= -least, "sell").otherwise("hold")


def new_capital(total: Column, tolerance_percent: Column, most: Column) -> Column:
    """Capital that may be added, in whole cents: halves are decided on decimals, not on their nearest binary values."""
    share = total.cast("decimal(18,4)") * tolerance_percent.cast("decimal(9,4)") / 100
    return F.round(F.greatest(F.lit(0).cast("decimal(18,2)"), F.least(share, most.cast("decimal(18,2)"))), 2).cast("double")


def short_hash(*parts: Column) -> Column:
    """Twenty characters of SHA-1 over the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20)


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def flag_or_null(x: Column) -> Column:
    return F.when(x.isin(0, 1), x.cast("int"))


def text_or(x: Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(other))
