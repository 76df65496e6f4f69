"""Canonical tables, their columns and the month helpers that all modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES: dict[str, dict[str, str]] = {
    "firms": {"firm_id": "string", "name": "string", "sector": "string", "industry": "string", "country": "string"},
    "prices_monthly": {"firm_id": "string", "month": "date", "ret": "double", "mktcap": "double"},
    "fx_monthly": {"month": "date", "pair": "string", "rate": "double"},
    "factors_monthly": {"month": "date", "mkt_rf": "double", "smb": "double", "hml": "double", "rmw": "double", "cma": "double", "mom": "double", "rf": "double"},
    "fundamentals": {"firm_id": "string", "year": "int", "revenue": "double"},
    "emissions": {"firm_id": "string", "year": "int", "scope1": "double", "scope2": "double"},
    "sources": {"firm_id": "string", "source_type": "string", "title": "string", "url": "string", "date": "date", "relevance": "double"},
}


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself if it has the columns of ``table`` (others are allowed), else ValueError."""
    missing = [c for c in TABLES[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in TABLES[table].items()))


def month(date: Column) -> Column:
    """First day of the month."""
    return F.trunc(date, "MM").cast("date")


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def effective_month(year: Column, lag_months: int = 7) -> Column:
    """Month in which a year's values may be used: December of the year and ``lag_months`` more."""
    return F.add_months(F.make_date(year, F.lit(12), F.lit(1)), lag_months)


def finite(x: Column) -> Column:
    """Null for NaN and infinities, so that null is the only missing value."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
