"""Return factors and regressions: sorted and cross-sectional GMB, Fama-MacBeth, fixed effects, alphas.

Cross products are aggregated by Spark; only systems of a few unknowns are solved in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.functions import ranks
from verdantflow.operators import panel as panels
from verdantflow.shared import written


def gmb_sorted(panel: DataFrame, g: str = "g", weight: str = "vw", least: int = 30) -> DataFrame:
    """``month, green, brown, gmb, n``: returns of the top and bottom third by g; ties by firm.

    Value weights take a null cap as 0; a side whose caps add up to nothing gets its plain mean.
    """
    df = panel.filter(F.col(g).isNotNull() & F.col("ret").isNotNull())
    df = written(df.select("month", "firm_id", g, "ret", F.coalesce("mktcap", F.lit(0.0)).alias("cap")), "panel")
    df = ranks.with_terciles(df, "side", g, "firm_id", "month")

    def side(name: str):
        own = F.col("side") == name
        plain = F.avg(F.when(own, F.col("ret")))
        total = F.sum(F.when(own, F.col("cap")))
        return F.when(total > 0, F.sum(F.when(own, F.col("ret") * F.col("cap"))) / total).otherwise(plain) if weight == "vw" else plain

    out = df.groupBy("month").agg(side("green").alias("green"), side("brown").alias("brown"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return out.select("month", "green", "brown", (F.col("green") - F.col("brown")).alias("gmb"), "n")


def gmb_summary(series: DataFrame, value: str = "gmb") -> DataFrame:
    """Mean of a monthly factor in basis points, its t and its months: ``mean_bps, t, n``."""
    mean, n = F.avg(value), F.count(value)
    return series.agg((mean * 1e4).alias("mean_bps"), (mean / F.stddev_samp(value) * F.sqrt(n)).alias("t"), n.alias("n"))


def gmb_regression(panel: DataFrame, factors: DataFrame, g: str = "g", controls: list[str] | None = None, window: int = 60, least_history: int = 24, least: int = 30) -> DataFrame:
    """``month, gmb, n``: each month's return per unit of g, after market exposure.

    Without controls sum(g a) / sum(g g) of the market-adjusted returns a; with controls the slope on g of
    least squares with an intercept.
    """
    df = panels.rolling_market_beta(panel, factors, window, least_history)
    df = df.withColumn("a", F.col("exret") - F.col("beta_m") * F.col("mkt_rf")).filter(F.col("a").isNotNull() & F.col(g).isNotNull())
    if not controls:
        out = df.groupBy("month").agg((F.sum(F.col(g) * F.col("a")) / F.nullif(F.sum(F.col(g) * F.col(g)), F.lit(0.0))).alias("gmb"), F.count("*").alias("n"))
        return out.filter(F.col("n") >= least)
    df = df.filter(" and ".join(f"{c} is not null" for c in controls))
    fits = period_regressions(df, "a", [g, *controls], "month", least)
    return fits.select("month", F.col("coef")[1].alias("gmb"), "n")


def gram(df: DataFrame, y: str, x: list[str], *by: str) -> DataFrame:
    """For each group the sums that least squares of y on 1 and x needs: ``xx`` (upper triangle), ``xy``, ``yy``, ``n``."""
    c = [F.lit(1.0), *(F.col(n) for n in x)]
    k = len(c)
    xx = F.array(*(F.sum(c[i] * c[j]) for i in range(k) for j in range(i, k)))
    return df.groupBy(*by).agg(xx.alias("xx"), F.array(*(F.sum(v * F.col(y)) for v in c)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))


def _square(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def period_regressions(df: DataFrame, y: str, x: list[str], period: str, least: int) -> DataFrame:
    """Least squares with an intercept in each period of ``least`` rows: ``period, coef array, n``.

    A regressor that is constant in a period gets a null coefficient there.
    """
    k = len(x) + 1

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, m in zip(xx, xy, n):
            full = _square(a, k)
            spread = np.diag(full) - full[0] ** 2 / m
            use = np.array([True, *(spread[1:] > 1e-12 * np.maximum(np.diag(full)[1:], 1e-300))])
            beta = np.full(k, np.nan)
            beta[use] = np.linalg.pinv(full[np.ix_(use, use)]) @ np.asarray(b)[use]
            out.append([None if math.isnan(v) else float(v) for v in beta])
        return pd.Series(out)

    return gram(df, y, x, period).filter(F.col("n") >= least).select(period, solve("xx", "xy", "n").alias("coef"), "n")


def slope_by_period(df: DataFrame, y: str, x: str, period: str, least: int = 30) -> DataFrame:
    """``period, slope, n`` for one regressor, all in Spark; null where x is constant."""
    df = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    return df.groupBy(period).agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("n")).filter(F.col("n") >= least)


def mean_with_newey_west(series: DataFrame, value: str, order: str, lags: int = 2) -> DataFrame:
    """``mean, t, n`` of a series; the variance of the mean has Bartlett weights up to ``lags``.

    The series is one value a period, so one window over it is small.
    """
    df = series.filter(F.col(value).isNotNull())
    w = Window.orderBy(order)
    df = df.withColumn("e", F.col(value) - F.avg(value).over(Window.partitionBy()))
    df = df.withColumns({f"l{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, lags + 1)})
    n = F.count("*")
    long = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"l{k}"), F.lit(0.0))
    return df.agg(F.avg(value).alias("mean"), F.when(long > 0, F.avg(value) / F.sqrt(long / n / n)).alias("t"), n.alias("n"))


def fama_macbeth(df: DataFrame, y: str, x: list[str], period: str = "year", least: int = 30, lags: int = 2) -> DataFrame:
    """``var, mean, t, n``: mean of each period's coefficient with a Newey-West t."""
    df = df.filter(" and ".join(f"{c} is not null" for c in [y, *x]))
    fits = period_regressions(df, y, x, period, least)
    out = None
    for i, name in enumerate(["const", *x]):
        one = mean_with_newey_west(fits.select(period, F.col("coef")[i].alias("v")), "v", period, lags).select(F.lit(name).alias("var"), "mean", "t", "n")
        out = one if out is None else out.unionByName(one)
    return out


def panel_fits(table: DataFrame, outcomes: list[str], x: list[str], effect: list[str], cluster: str, least: int = 20) -> tuple[DataFrame, list[dict]]:
    """Least squares of each outcome on x over its own complete rows, with effects for each group of ``effect``, errors clustered.

    All outcomes share the passes: means of the effects, then cross products of each cluster (a row a cluster, in
    a table), whose sums give the coefficients. Scores of a cluster follow from its cross products and the
    coefficients, so residuals aren't computed for errors. Only systems of len(x) unknowns reach the driver.
    Returns the rows with columns ``_d{i}_{j}``: outcome i (j = 0) and x less the means of their group, null where
    a row isn't complete; and a fit for each outcome: beta, coef, t, p by name, n, clusters, r2 and r2_effects.
    ``table`` has to be a table; ValueError if an outcome has fewer than ``least`` complete rows.
    """
    k, size = len(x), range(len(x) + 1)
    table = table.filter(" and ".join(f"{c} is not null" for c in effect))
    known = [F.expr(" and ".join(f"`{c}` is not null" for c in [y, *x])) for y in outcomes]
    value = lambda i, j: F.when(known[i], F.col([outcomes[i], *x][j]).cast("double"))
    every = [(i, j) for i in range(len(outcomes)) for j in size]
    means = table.groupBy(*effect).agg(*(F.avg(value(i, j)).alias(f"_m{i}_{j}") for i, j in every), *(F.count_if(c).alias(f"_n{i}") for i, c in enumerate(known)))
    means = written(means, "means")
    rows = table.join(means, effect).withColumns({f"_d{i}_{j}": value(i, j) - F.col(f"_m{i}_{j}") for i, j in every}).drop(*(c for c in means.columns if c.startswith("_")))
    products = [(i, a, b) for i in range(len(outcomes)) for a in size for b in size if a <= b]
    clusters = rows.groupBy(cluster).agg(*(F.coalesce(F.sum(F.col(f"_d{i}_{a}") * F.col(f"_d{i}_{b}")), F.lit(0.0)).alias(f"p{i}_{a}_{b}") for i, a, b in products), *(F.count(f"_d{i}_0").alias(f"n{i}") for i in range(len(outcomes))))
    clusters = written(clusters, "clusters")
    total = clusters.agg(*(F.sum(f"p{i}_{a}_{b}").alias(f"p{i}_{a}_{b}") for i, a, b in products), *(f.alias(f"{n}{i}") for i in range(len(outcomes)) for n, f in (("n", F.sum(f"n{i}")), ("g", F.count_if((F.col(f"n{i}") > 0) & F.col(cluster).isNotNull()))))).first()
    spread = table.agg(*(F.coalesce(F.var_pop(value(i, 0)) * F.count(value(i, 0)), F.lit(0.0)).alias(f"v{i}") for i in range(len(outcomes)))).first()
    groups = means.agg(*(F.count_if(F.col(f"_n{i}") > 0).alias(f"e{i}") for i in range(len(outcomes)))).first()
    at = lambda i, a, b: f"p{i}_{min(a, b)}_{max(a, b)}"
    breads, betas, scores = [], [], []
    for i, y in enumerate(outcomes):
        if (total[f"n{i}"] or 0) < least:
            raise ValueError(f"{total[f'n{i}'] or 0} complete rows of {y}; {least} are needed")
        breads.append(np.linalg.pinv(np.array([[total[at(i, a, b)] for b in range(1, k + 1)] for a in range(1, k + 1)])))
        betas.append(breads[-1] @ np.array([total[at(i, 0, a)] for a in range(1, k + 1)]))
        scores.append([F.col(at(i, 0, a)) - sum((F.col(at(i, a, b)) * float(betas[-1][b - 1]) for b in range(1, k + 1)), F.lit(0.0)) for a in range(1, k + 1)])
    meats = clusters.agg(*(F.sum(own[a] * own[b]).alias(f"{i}_{a}_{b}") for i, own in enumerate(scores) for a in range(k) for b in range(k))).first()
    fits = []
    for i, (bread, beta) in enumerate(zip(breads, betas)):
        n, g, unknowns = total[f"n{i}"], total[f"g{i}"], k + groups[f"e{i}"]
        factor = g / (g - 1) * (n - 1) / (n - unknowns) if g > 1 and n > unknowns else float("nan")
        cov = factor * bread @ np.array([[meats[f"{i}_{a}_{b}"] for b in range(k)] for a in range(k)]) @ bread
        t = beta / np.sqrt(np.diag(cov))
        within = total[at(i, 0, 0)]
        ssr = within - sum(float(v) * total[at(i, 0, a + 1)] for a, v in enumerate(beta))
        told = {name: {"coef": float(v), "t": float(w), "p": math.erfc(abs(w) / math.sqrt(2))} for name, v, w in zip(x, beta, t)}
        fits.append({"beta": beta, "vars": told, "n": n, "clusters": g, "r2": 1 - ssr / spread[f"v{i}"] if spread[f"v{i}"] else float("nan"), "r2_effects": 1 - within / spread[f"v{i}"] if spread[f"v{i}"] else float("nan")})
    return rows, fits


def fixed_effects(df: DataFrame, y: str, x: list[str], effect: list[str], cluster: str, least: int = 20) -> tuple[DataFrame, dict]:
    """Complete rows with ``fitted`` and ``residual`` of least squares of y on x with effects, and the fit (see :func:`panel_fits`)."""
    df = written(df.filter(" and ".join(f"{c} is not null" for c in [y, *x, *effect])), "effects")
    rows, (fit,) = panel_fits(df, [y], x, effect, cluster, least)
    within = sum((F.col(f"_d0_{j}") * float(v) for j, v in enumerate(fit.pop("beta"), 1)), F.lit(0.0))
    rows = rows.withColumn("residual", F.col("_d0_0") - within).withColumn("fitted", F.col(y) - F.col("residual"))
    return rows.drop(*(f"_d0_{j}" for j in range(len(x) + 1))), fit


def excess_talk(df: DataFrame, regressors: tuple[str, ...] = ("log_intensity", "d_log_intensity", "log_words"), talk: str = "claim_per_1000", industry: str = "sector", top: float = 0.8, least: int = 30) -> tuple[DataFrame, dict]:
    """Talk beyond what emissions, size of the text and industry-year explain: residual, its z and a top flag."""
    d = df.withColumns({"log_talk": F.log1p(talk), "log_intensity": F.log1p("intensity"), "log_words": F.when(F.col("n_words") > 0, F.ln(F.col("n_words")))})
    out, fit = fixed_effects(d, "log_talk", list(regressors), [industry, "year"], "firm_id", least)
    out = out.withColumns({"talk_expected": F.expm1("fitted"), "excess_talk": F.col("residual")})
    out = written(out.drop("log_talk", "log_words", "fitted", "residual"), "excess")
    out = ranks.with_percent_ranks(ranks.with_z_scores(out, {"excess_talk_z": "excess_talk"}, "year", industry), {"excess_talker": "excess_talk"}, "year")
    return out.withColumn("excess_talker", (F.col("excess_talker") >= top).cast("int")), fit


def predictive_regression(firm_year: DataFrame, outcomes: DataFrame, outcome: str | list[str], pillars: tuple[str, ...] = ("walk", "talk"), controls: tuple[str, ...] = ("log_revenue",), industry: str = "sector", least: int = 20) -> DataFrame:
    """``outcome, var, coef, t, p, n`` of one or more outcomes on the pillars, with industry-year effects and firm clusters; the panel is joined and read once."""
    names, x, effect = [outcome] if isinstance(outcome, str) else list(outcome), [*pillars, *controls], [industry, "year"]
    df = firm_year.join(outcomes.drop(*(c for c in outcomes.columns if c in firm_year.columns and c not in ("firm_id", "year"))), ["firm_id", "year"])
    _, fits = panel_fits(written(df.select("firm_id", *effect, *x, *names), "panel"), names, x, effect, "firm_id", least)
    rows = [(y, v, s["coef"], s["t"], s["p"], fit["n"]) for y, fit in zip(names, fits) for v, s in fit["vars"].items()]
    return df.sparkSession.createDataFrame(rows, "outcome string, var string, coef double, t double, p double, n long")


def validation_table(firm_year: DataFrame, outcomes: DataFrame, industry: str = "sector") -> DataFrame:
    """Both emission outcomes, stacked."""
    return predictive_regression(firm_year, outcomes, ["d_log_scope1_next", "d_log_intensity_next"], industry=industry)


def exposures(panel: DataFrame, factors: DataFrame, names: list[str], by: str = "firm_id", least: int = 24, lags: int = 6) -> DataFrame:
    """Alpha regression of each firm with ``least`` excess returns: alpha, its Newey-West t, r2, n, betas, idio_var.

    The panel is shuffled once, by firm. Cross products of a firm are sums, and batches of small systems are solved;
    what a row adds to alpha meets that of the ``lags`` rows before it in a window. Rows of a month that repeats count
    each, in any order. t is null where its variance is not above 0, r2 where returns don't vary; rows without a key take no part.
    """
    df = panel.join(F.broadcast(factors.select("month", "rf", *names)), "month").withColumn("exret", F.col("ret") - F.col("rf"))
    df = df.filter(" and ".join(f"{c} is not null" for c in ["exret", *names, by])).select(by, "month", "exret", *names).repartition(by)
    x, y = [F.lit(1.0), *(F.col(c) for c in names)], F.col("exret")
    k = len(x)
    sums = df.groupBy(by).agg(
        F.count("month").alias("_n"), (F.var_pop(y) * F.count("month")).alias("_total"),  # the same columns as below, so that the shuffle serves both
        F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k))).alias("_xx"), F.array(*(F.sum(c * y) for c in x)).alias("_xy"),
    )

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        if not len(xx):
            return pd.Series([], dtype=object)
        inverse = panels.inverse_grams(xx, k)
        beta = (inverse @ np.stack(xy.to_numpy())[:, :, None])[:, :, 0]
        return pd.Series(list(np.concatenate([beta, inverse[:, 0]], 1)))

    fits = sums.filter(F.col("_n") >= least).withColumn("_fit", solve("_xx", "_xy"))
    told = ["_n", "_total", *(f"_b{i}" for i in range(k))]
    fits = fits.select(by, "_n", "_total", *(F.col("_fit")[i].alias(f"_b{i}") for i in range(k)), *(F.col("_fit")[k + i].alias(f"_q{i}") for i in range(k)))
    added = lambda letter: sum((x[i] * F.col(f"{letter}{i}") for i in range(1, k)), F.col(f"{letter}0"))
    rows = df.join(fits.hint("merge"), by).withColumn("_e", y - added("_b")).withColumn("_u", F.col("_e") * added("_q"))
    before = Window.partitionBy(by).orderBy("month")
    lagged = sum((F.coalesce(F.lag("_u", lag).over(before), F.lit(0.0)) * (1 - lag / (lags + 1)) for lag in range(1, lags + 1)), F.lit(0.0))
    rows = rows.withColumn("_v", F.col("_u") * (F.col("_u") + 2 * lagged))
    out = rows.groupBy(by).agg(*(F.any_value(c).alias(c) for c in told), F.sum(F.col("_e") * F.col("_e")).alias("_ssr"), F.sum("_v").alias("_var"))
    n, total, ssr, var = (F.col(c) for c in ("_n", "_total", "_ssr", "_var"))
    return out.select(
        by, F.col("_b0").alias("alpha"), F.when(var > 0, F.col("_b0") / F.sqrt(var)).alias("alpha_t"), F.when(total > 0, 1 - ssr / total).alias("r2"), n.alias("n"),
        F.when(n > k, ssr / (n - k)).alias("idio_var"), *(F.col(f"_b{i}").alias(f"b_{c}") for i, c in enumerate(names, 1)),
    )


def expected_returns(betas: DataFrame, means: DataFrame) -> DataFrame:
    """mu of each firm: its betas (``firm_id, factor, beta``) times factor means (``factor, mean``)."""
    joined = betas.join(F.broadcast(means), "factor")
    return joined.groupBy("firm_id").agg(F.sum(F.col("beta") * F.col("mean")).alias("mu"))


def pool_markets(parts: dict[str, dict[str, DataFrame]], green: str = "gmb", least: int = 24) -> dict[str, DataFrame]:
    """Inputs of several markets as one block model: factors carry their market's name, g is standardised within it.

    ``parts``: market to ``betas`` (firm_id, factor, beta) and ``g`` (firm_id, g), and, if they are to be stacked
    as well, ``factors`` (month and a column for each factor). Where the green factor is among them and fewer
    than ``least`` months have all stacked factors, it is dropped from every market, so that no covariance rests
    on a handful of months. Of a firm in two markets the first counts. The mean and deviation of g are
    aggregated, so no task sees a whole market.
    """
    betas = g = factors = None
    for place, (market, part) in enumerate(parts.items()):
        b = part["betas"].select("firm_id", F.concat(F.lit(market + "_"), "factor").alias("factor"), "beta", F.lit(place).alias("_p"))
        m = part["g"].agg(F.avg("g"), F.stddev_pop("g")).first()
        z = (F.col("g") - F.lit(m[0])) / F.lit(m[1]) if m[1] else F.lit(0.0)
        x = part["g"].withColumns({"z": F.coalesce(z, F.lit(0.0)), "market": F.lit(market), "_p": F.lit(place)})
        betas, g = (b, x) if betas is None else (betas.unionByName(b), g.unionByName(x))
        if "factors" in part:
            f = part["factors"].select("month", *(F.col(c).alias(f"{market}_{c}") for c in part["factors"].columns if c != "month"))
            factors = f if factors is None else factors.join(f, "month", "full")
    if factors is not None and (named := [c for c in factors.columns if c.endswith(f"_{green}")]):
        if factors.dropna().count() < least:
            factors, betas = factors.drop(*named), betas.filter(~F.col("factor").isin(*named))
    first = g.groupBy("firm_id").agg(F.min("_p").alias("_first"))
    keep = lambda df: df.join(first, "firm_id").filter("_p = _first").drop("_p", "_first")
    return {"betas": keep(betas), "g": keep(g)} | ({} if factors is None else {"factors": factors})


def performance(returns: DataFrame, benchmark: DataFrame | None = None, by: str = "portfolio_id", factors: DataFrame | None = None, names: list[str] | None = None, least: int = 24, lags: int = 6) -> DataFrame:
    """Annual return, volatility and Sharpe ratio of monthly net returns, and ``n_months``.

    With a benchmark active return, tracking error and information ratio; with factors the ratio is of returns
    above ``rf``, and there are alpha, its t, r2, n, idio_var and the betas of :func:`exposures` (a green factor
    among ``names`` gives ``b_gmb``), null below ``least`` months.
    """
    df = returns if benchmark is None else returns.join(F.broadcast(benchmark.select("month", F.col("ret").alias("bench"))), "month", "left")
    df = df.withColumn("_over", F.col("ret")) if factors is None else df.join(F.broadcast(factors.select("month", F.col("rf").alias("_rf"))), "month", "left").withColumn("_over", F.col("ret") - F.col("_rf"))
    months, annual = F.count("ret"), F.pow(F.product(1 + F.col("ret")), 12 / F.count("ret")) - 1
    vol, spread = F.stddev_samp("ret") * math.sqrt(12), F.stddev_samp("_over")
    out = [annual.alias("ann_ret"), vol.alias("ann_vol"), F.when(spread > 0, F.avg("_over") / spread * math.sqrt(12)).alias("sharpe"), months.alias("n_months")]
    if benchmark is not None:
        active = F.col("ret") - F.col("bench")
        te = F.stddev_samp(active) * math.sqrt(12)
        out += [(F.avg(active) * 12).alias("active"), te.alias("tracking_error"), F.when(te > 0, F.avg(active) * 12 / te).alias("information_ratio")]
    out = df.groupBy(by).agg(*out)
    return out if factors is None else out.join(exposures(returns.select(by, "month", "ret"), factors, names or [], by, least, lags), by, "left")


def market_inputs(prices: DataFrame, factors: DataFrame, annual: DataFrame, names: list[str], least: int = 24) -> dict[str, DataFrame]:
    """Model inputs of one market: long betas (GMB among them where it has months enough), idiosyncratic variance, latest g, factors.

    Only months that both tables have count; g is known as of each month. Inputs and fits are used several times, so they are tables:
    each is worked out once.
    """
    prices, factors = panels.common_months(written(prices, "prices"), written(factors, "factors"))
    green = written(panels.annual_to_months(annual, prices.select("month").distinct()).select("firm_id", "month", "g"), "green")
    panel = prices.join(green, ["firm_id", "month"], "left")
    gmb = written(gmb_regression(panel, factors, least=5), "gmb")
    with_gmb = gmb.count() >= least
    if with_gmb:
        factors = factors.join(F.broadcast(gmb.select("month", "gmb")), "month")
        names = [*names, "gmb"]
    fits = written(exposures(prices, factors, names, least=least), "fits")
    betas = fits.unpivot(["firm_id"], [f"b_{n}" for n in names], "factor", "beta").withColumn("factor", F.substring("factor", 3, 50))
    last = green.join(F.broadcast(green.agg(F.max("month").alias("month"))), "month").select("firm_id", "g")
    return {"betas": betas, "idio": fits.select("firm_id", "idio_var"), "g": fits.select("firm_id").join(last, "firm_id", "left"), "factors": factors, "moments": panels.factor_moments(factors, names)}


def covariances(betas: DataFrame, factor_cov: DataFrame, idio: DataFrame, most: int = 5000) -> DataFrame:
    """``firm_a, firm_b, cov`` of the firms given: B F B' + D in long form, for a screened candidate set.

    The result has a row for each two firms, so they are counted first: more than ``most`` raise ValueError.
    """
    n = betas.select("firm_id").distinct().count()
    if n > most:
        raise ValueError(f"{n} firms; screen them to {most}")
    c = F.broadcast(factor_cov.select("factor_a", "factor_b", "cov"))
    loaded = betas.withColumnRenamed("factor", "factor_a").join(c, "factor_a").groupBy("firm_id", "factor_b").agg(F.sum(F.col("beta") * F.col("cov")).alias("l"))
    right = betas.select(F.col("firm_id").alias("firm_b"), F.col("factor").alias("factor_b"), "beta")
    out = loaded.join(right, "factor_b").groupBy(F.col("firm_id").alias("firm_a"), "firm_b").agg(F.sum(F.col("l") * F.col("beta")).alias("cov"))
    own = idio.select(F.col("firm_id").alias("firm_a"), F.col("firm_id").alias("firm_b"), "idio_var")
    return out.join(own, ["firm_a", "firm_b"], "left").select("firm_a", "firm_b", (F.col("cov") + F.coalesce("idio_var", F.lit(0.0))).alias("cov"))
