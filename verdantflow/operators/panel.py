"""Month panels: as-of joins, returns, exchange rates, rolling betas and cut-offs.

Months are first-of-month dates. Windows are always partitioned by firm, pair or market.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.schema import effective_month, month_number

def _firm():
    return Window.partitionBy("firm_id").orderBy("month")


def known_from(annual: DataFrame, lag_months: int = 7) -> DataFrame:
    """Annual rows with the month from which they may be used: the lag after the year, or the month after a given date."""
    month = effective_month(F.col("year"), lag_months)
    if "available_date" in annual.columns:
        month = F.coalesce(F.add_months(F.trunc("available_date", "MM"), 1), month)
    return annual.withColumn("known_from", month.cast("date"))


def annual_to_months(annual: DataFrame, months: DataFrame, lag_months: int = 7) -> DataFrame:
    """As-of join: for each month of ``months`` a firm's latest row known by then, its nulls included.

    Of rows known from one month the later year counts. Months before the first are left out. Each row is
    valid up to the next one's month, so it is exploded over its own months only; nothing is compared by range.
    """
    rows = known_from(annual, lag_months)
    last = Window.partitionBy("firm_id", "known_from").orderBy(F.desc("year"))
    rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    until = F.lead("known_from").over(Window.partitionBy("firm_id").orderBy("known_from"))
    bounds = months.agg(F.min("month").alias("_low"), F.max("month").alias("_high"))
    rows = rows.withColumn("_until", until).join(F.broadcast(bounds))
    first, end = F.greatest("known_from", "_low"), F.least(F.add_months(F.coalesce("_until", F.add_months("_high", 1)), -1), F.col("_high"))
    rows = rows.withColumn("month", F.explode(F.when(first <= end, F.sequence(first, end, F.expr("interval 1 month")))))
    return rows.drop("_until", "_low", "_high").join(F.broadcast(months.select("month").distinct()), "month", "left_semi")


def completed_months(df: DataFrame, at) -> DataFrame:
    """Rows up to a month."""
    return df.filter(F.col("month") <= F.lit(at).cast("date"))


def common_months(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to the months that both have."""
    shared = a.select("month").intersect(b.select("month"))
    return tuple(x.join(F.broadcast(shared), "month", "left_semi") for x in (a, b))


def fx_returns(fx: DataFrame) -> DataFrame:
    """Change of a pair's rate over consecutive months; null after a gap."""
    w = Window.partitionBy("pair").orderBy("month")
    gap = month_number(F.col("month")) - month_number(F.lag("month").over(w))
    return fx.withColumn("fx_ret", F.when(gap == 1, F.col("rate") / F.lag("rate").over(w) - 1))


def in_base_currency(prices: DataFrame, fx: DataFrame, pair: str) -> DataFrame:
    """Local returns compounded with the pair's; months without a rate change or a return are left out."""
    change = fx_returns(fx.filter(F.col("pair") == pair)).select("month", "fx_ret")
    joined = prices.join(F.broadcast(change), "month")
    return joined.withColumn("ret", (1 + F.col("ret")) * (1 + F.col("fx_ret")) - 1).filter("ret is not null").drop("fx_ret")


def cross_rate(fx: DataFrame, over: str, under: str) -> DataFrame:
    """``month, rate``: one pair's rate divided by another's."""
    wide = fx.groupBy("month").agg(*(F.max(F.when(F.col("pair") == p, F.col("rate"))).alias(n) for p, n in ((over, "a"), (under, "b"))))
    return wide.filter("a is not null and b > 0").select("month", (F.col("a") / F.col("b")).alias("rate"))


def month_end_rates(daily: DataFrame) -> DataFrame:
    """Last positive rate of each pair and month, from ``date, pair, rate``."""
    return daily.filter("rate > 0").groupBy(F.trunc("date", "MM").cast("date").alias("month"), "pair").agg(F.max_by("rate", "date").alias("rate"))


def monthly_returns(closes: DataFrame, shares: DataFrame | None = None, first_year: int = 2010) -> DataFrame:
    """``firm_id, month, ret, mktcap`` from ``firm_id, month, close``; gaps aren't padded.

    Shares outstanding (``firm_id, month, shares``) are carried forward, then back to months before the first.
    """
    ahead, back = _firm().rowsBetween(Window.unboundedPreceding, 0), _firm().rowsBetween(0, Window.unboundedFollowing)
    df = closes if shares is None else closes.join(shares, ["firm_id", "month"], "left")
    if shares is not None:
        df = df.withColumn("shares", F.coalesce(F.last("shares", True).over(ahead), F.first("shares", True).over(back)))
    before = F.lag("close").over(_firm())
    df = df.withColumn("ret", F.when(before > 0, F.col("close") / before - 1))
    df = df.withColumn("mktcap", F.col("close") * F.col("shares") if shares is not None else F.lit(None).cast("double"))
    return df.filter((F.col("ret").isNotNull()) & (F.year("month") >= first_year)).select("firm_id", "month", "ret", "mktcap")


def last_close(daily: DataFrame, days: int = 5) -> DataFrame:
    """Each firm's last non-null close among the last ``days`` dates of the table."""
    dates = daily.select("date").distinct().orderBy(F.desc("date")).limit(days)
    recent = daily.join(F.broadcast(dates), "date", "left_semi").filter("close is not null")
    return recent.groupBy("firm_id").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


def cumulative_return(df: DataFrame, *group: str) -> DataFrame:
    """Compounded return since the first month of each group; a null return counts as 0."""
    w = Window.partitionBy(*group).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_ret", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w) - 1)


def annual_returns(prices: DataFrame, least: int = 10) -> DataFrame:
    """Compounded return of each firm and year with ``least`` months, and its last market value."""
    total = prices.groupBy("firm_id", F.year("month").alias("year")).agg(
        (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"), F.count("*").alias("n"), F.max_by("mktcap", F.when(F.col("mktcap").isNotNull(), F.col("month"))).alias("mktcap")
    )
    return total.filter(F.col("n") >= least)


def eligible(prices: DataFrame, least: int = 24) -> DataFrame:
    """Firms with ``least`` returns."""
    return prices.groupBy("firm_id").agg(F.count("ret").alias("n")).filter(F.col("n") >= least)


def rolling_market_beta(panel: DataFrame, factors: DataFrame, window: int = 60, least: int = 24) -> DataFrame:
    """Market beta of each firm and month from the ``window`` rows before it, with ``least`` returns among them."""
    df = panel.join(F.broadcast(factors.select("month", "mkt_rf", "rf")), "month", "left").withColumn("exret", F.col("ret") - F.col("rf"))
    w = _firm().rowsBetween(-window, -1)
    both = F.col("exret").isNotNull() & F.col("mkt_rf").isNotNull()
    y, x = F.when(both, F.col("exret")), F.when(both, F.col("mkt_rf"))
    enough = (F.count(y).over(w) >= least) & (F.var_samp("mkt_rf").over(w) > 0)
    return df.withColumn("beta_m", F.when(enough, F.covar_samp(y, x).over(w) / F.var_samp("mkt_rf").over(w)))


def inverse_grams(upper: pd.Series, k: int) -> np.ndarray:
    """Pseudoinverses of k x k cross products, each given as its upper triangle by rows; there is at least one."""
    gram = np.zeros((len(upper), k, k))
    rows, cols = np.triu_indices(k)
    gram[:, rows, cols] = gram[:, cols, rows] = np.stack(upper.to_numpy())
    return np.linalg.pinv(gram)


def rolling_betas(panel: DataFrame, factors: DataFrame, names: list[str], window: int = 36, least: int = 24) -> DataFrame:
    """Betas of each firm and month by least squares over the ``window`` complete rows before it.

    Cross products are summed by a window, so each row is touched once whatever the window; a batch of small
    systems is solved at a time. Firms with fewer than ``least`` complete rows are left out.
    """
    df = panel.join(F.broadcast(factors.select("month", "rf", *names)), "month").withColumn("exret", F.col("ret") - F.col("rf"))
    complete = F.col("exret").isNotNull()
    for n in names:
        complete &= F.col(n).isNotNull()
    df = df.filter(complete)
    x: list[Column] = [F.lit(1.0), *(F.col(n) for n in names)]
    k, w = len(x), _firm().rowsBetween(-window, -1)
    products = [F.coalesce(F.sum(x[i] * x[j]).over(w), F.lit(0.0)) for i in range(k) for j in range(i, k)]
    targets = [F.coalesce(F.sum(c * F.col("exret")).over(w), F.lit(0.0)) for c in x]
    df = df.select("firm_id", "month", F.count("*").over(w).alias("n"), F.count("*").over(Window.partitionBy("firm_id")).alias("all"), F.array(*products).alias("xx"), F.array(*targets).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = np.full((len(n), k), np.nan)
        use = (n >= least).to_numpy()
        if use.any():
            out[use] = (inverse_grams(xx[use], k) @ np.stack(xy[use].to_numpy())[:, :, None])[:, :, 0]
        return pd.Series([None if np.isnan(r).any() else r for r in out])

    solved = df.filter(F.col("all") >= least).withColumn("b", solve("n", "xx", "xy"))
    return solved.select("firm_id", "month", *(F.col("b")[i + 1].alias(f"b_{n}") for i, n in enumerate(names)))


def model_cutoff(prices: DataFrame, factors: DataFrame, fx: DataFrame, names: list[str], least: int = 24) -> DataFrame:
    """``cutoff, n``: the last month with returns, all factors and a consecutive rate of every pair; null below ``least`` months."""
    pairs = fx.select("pair").distinct()
    ready = fx_returns(fx).filter("fx_ret is not null").groupBy("month").agg(F.count_distinct("pair").alias("k")).join(F.broadcast(pairs.agg(F.count("*").alias("_all")))).filter("k = _all")
    complete = factors.filter(" and ".join(f"{n} is not null" for n in names))
    months = prices.filter("ret is not null").select("month").intersect(complete.select("month")).intersect(ready.select("month"))
    return months.agg(F.max("month").alias("cutoff"), F.count("*").alias("n")).select(F.when(F.col("n") >= least, F.col("cutoff")).alias("cutoff"), "n")


def restate_closes(closes: DataFrame, rates: DataFrame, last_complete) -> DataFrame:
    """Closes at a month's rate: the month of the close if its last day was reached, else the month before; exact month or null."""
    done = F.when(F.col("date") == F.last_day("date"), F.trunc("date", "MM")).otherwise(F.add_months(F.trunc("date", "MM"), -1)).cast("date")
    keyed = closes.withColumn("month", F.least(done, F.lit(last_complete).cast("date")))
    return keyed.join(F.broadcast(rates.select("month", "rate")), "month", "left").withColumn("close_base", F.col("close") * F.col("rate"))


def stack_factors(sets: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Factor sets of markets as ``month, market, factor, value``."""
    out = None
    for market, df in sets.items():
        long = df.unpivot(["month"], [n for n in names if n in df.columns], "factor", "value").select("month", F.lit(market).alias("market"), "factor", "value")
        out = long if out is None else out.unionByName(long)
    return out


def factor_moments(factors: DataFrame, names: list[str]) -> DataFrame:
    """``factor_a, factor_b, cov, mean_a`` over complete rows."""
    df = factors.filter(" and ".join(f"{n} is not null" for n in names))
    row = df.agg(*(F.covar_samp(a, b).alias(f"c_{a}_{b}") for a in names for b in names), *(F.avg(a).alias(f"m_{a}") for a in names))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"c_{a}_{b}").alias("cov"), F.col(f"m_{a}").alias("mean_a")) for a in names for b in names)))
    return row.select(cells.alias("c")).select("c.*")


def model_period(factors: DataFrame, names: list[str]) -> DataFrame:
    complete = factors.filter(" and ".join(f"{n} is not null" for n in names))
    return complete.agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("n"))
