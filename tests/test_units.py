"""Operators on small frames with expectations worked out by hand."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdantflow import schema
from verdantflow.functions import numbers, ranks, text
from verdantflow.operators import documents, factors, panel, portfolio, solver, scores, selection
from verdantflow.quality import rules
from verdantflow.sources import tables
from verdantflow.streaming import incremental


def day(y, m, d=1):
    return dt.date(y, m, d)


def months(first, n):
    return [day(first + k // 12, k % 12 + 1) for k in range(n)]


def test_percent_score_bounds_single_member_and_null_group(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (9.0, "b"), (None, "a"), (4.0, None), (5.0, None)], "x double, g string")
    got = {(r.x, r.g): r.s for r in df.select("x", "g", ranks.percent_score(F.col("x"), "g", higher_is_better=False).alias("s")).collect()}
    assert got == {(1.0, "a"): 10.0, (2.0, "a"): 5.0, (3.0, "a"): 0.0, (9.0, "b"): 5.0, (None, "a"): None, (4.0, None): 5.0, (5.0, None): 5.0}


def test_ranks_and_z_match_pandas(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 2.0, 3.0, rng.random()])) for _ in range(80)] + [("c", 2.0), ("c", 2.0), ("c", None), ("d", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, x double")
    got = df.select("i", ranks.percent_rank(F.col("x"), "g").alias("p"), ranks.z_score(F.col("x"), "g").alias("z")).toPandas().sort_values("i")
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    want = pdf.groupby("g")["x"].rank(pct=True)
    assert np.allclose(got["p"].astype(float), want.astype(float), equal_nan=True)
    z = pdf.groupby("g")["x"].transform(lambda x: (x - x.mean()) / x.std() if x.std() > 0 else (0 if x.count() > 1 else np.nan))
    assert np.allclose(got["z"].astype(float), z.astype(float), equal_nan=True)


def test_greenness_pairs_and_weighted_mean(spark):
    df = spark.createDataFrame([(4.2, 48.0), (4.1, 11.0), (10.0, 48.0)], "e double, w double")
    assert [round(r.g, 2) for r in df.select(numbers.greenness(F.col("e"), F.col("w")).alias("g")).collect()] == [-2.78, -0.65, 0.0]
    df = spark.createDataFrame([(9.0, None, 2.0), (None, None, None)], "a double, b double, c double")
    pairs = [(F.col("a"), 0.5), (F.col("b"), 0.4), (F.col("c"), 0.5)]
    assert [r.m for r in df.select(numbers.weighted_available_mean(pairs).alias("m")).collect()] == [5.5, None]


def firm_years(spark):
    rows = [(f"F{i}", y, 100.0 * (i + 1) * (0.8 + 0.08 * i) ** (y - 2022), 0.0, True) for i in range(6) for y in (2022, 2023)]
    e = spark.createDataFrame(rows, "firm_id string, year int, scope1 double, scope2 double, matched boolean")
    f = e.select("firm_id", "year", F.lit(1000.0).alias("revenue"))
    firms = spark.createDataFrame([(f"F{i}", f"Firm {i}", "s") for i in range(6)], "firm_id string, name string, sector string")
    return e, f, firms


def test_walk_is_ten_for_the_cleanest(spark):
    e, f, firms = firm_years(spark)
    walk = scores.walk_score(scores.carbon_intensity(e, f), firms).toPandas().sort_values(["year", "firm_id"])
    last = walk[walk["year"] == 2023]
    assert last["walk"].tolist()[0] == 10 and last["walk"].tolist()[-1] == 0 and last["walk"].is_monotonic_decreasing
    assert (walk[walk["year"] == 2022]["walk_n_components"] == 1).all() and (last["walk_n_components"] == 3).all()
    green = scores.greenness_table(scores.scores_from_walk(scores.walk_score(scores.carbon_intensity(e, f), firms)), firms).toPandas()
    assert np.allclose(green["g"], green["g_across"] + green["g_within"]) and abs(green.groupby("year")["g_within"].sum()).max() < 1e-9


def test_custom_score_flips_negative_weights(spark):
    df = spark.createDataFrame([("a", 2023, 9.0, 10.0, 1.0), ("b", 2023, None, None, None)], "firm_id string, year int, carbon double, walk double, gap double")
    w = df.select("firm_id", "year", F.lit(20.0).alias("e_weight"))
    got = {r.firm_id: r.e_score for r in scores.combine_pillars(df, w).collect()}
    assert math.isclose(got["a"], 0.5 * 9 + 0.4 * 10 + 0.1 * 9) and got["b"] is None
    with pytest.raises(ValueError):
        scores.combine_pillars(df, w, {"carbon": -1.0})


def test_talk_follows_rate_not_length_and_flags_stay_null_when_unmeasured(spark):
    rows = [(f"F{i}", 2023, f"d{i}", 1000 * (6 - i), 9, 5, i * (6 - i)) for i in range(6)] + [("F0", 2023, "empty", 0, 5, 5, 5)]
    counts = spark.createDataFrame(rows, "firm_id string, year int, accession string, n_words long, n_green long, n_claim_all long, n_claim long")
    firms = spark.createDataFrame([(f"F{i}", "s") for i in range(6)], "firm_id string, sector string")
    talk = scores.talk_score(scores.firm_year_intensity(counts), firms)
    assert [r.talk for r in talk.orderBy("firm_id").collect()] == [0, 2, 4, 6, 8, 10]
    combined = scores.combine_talk(talk, None, firms)
    assert {r.talk_source for r in combined.collect()} == {"dict"}
    assert [r.talk_combined for r in combined.orderBy("firm_id").collect()] == [0, 2, 4, 6, 8, 10]
    walk = firms.select("firm_id", F.lit(2023).alias("year"), "sector", F.lit(1.0).alias("intensity"), F.lit(0.0).alias("walk"))
    out = scores.greenwashing_variants(combined, walk).toPandas().sort_values("firm_id")
    assert out["greenwasher_dict"].tolist() == [0, 0, 0, 0, 1, 1] and out["greenwasher_llm"].isna().all()


def test_residual_gap_finds_the_overtalker(spark):
    rng = random.Random(2)
    rows = [(f"F{i}", 2023, w + rng.gauss(0, 0.3) + (6 if i < 2 else 0), w) for i, w in ((i, rng.random() * 6) for i in range(40))]
    df = spark.createDataFrame(rows, "firm_id string, year int, talk double, walk double")
    firms = spark.createDataFrame([(f"F{i}", "s") for i in range(40)], "firm_id string, sector string")
    out = scores.gap_variants(df, firms).toPandas()
    assert set(out.nlargest(2, "gap_resid")["firm_id"]) == {"F0", "F1"} and abs(out["gap_resid"].sum()) < 1e-8
    assert abs(out["talk_z"].mean()) < 1e-9 and abs(out["talk_z"].std() - 1) < 1e-9


def test_annual_values_are_known_from_july_or_the_month_after_a_date(spark):
    annual = spark.createDataFrame([("a", 2021, 1.0, None), ("a", 2022, 2.0, None), ("b", 2022, 5.0, day(2023, 10, 15)), ("b", 2023, None, None)], "firm_id string, year int, g double, available_date date")
    m = spark.createDataFrame([(x,) for x in months(2022, 36)], "month date")
    got = {(r.firm_id, r.month): r.g for r in panel.annual_to_months(annual, m).collect()}
    assert min(k[1] for k in got if k[0] == "a") == day(2022, 7) and got["a", day(2023, 6)] == 1.0 and got["a", day(2023, 7)] == 2.0
    assert min(k[1] for k in got if k[0] == "b") == day(2023, 11) and got["b", day(2024, 6)] == 5.0
    assert got["b", day(2024, 7)] is None  # the latest row counts, its null too


def test_fx_gap_breaks_the_return(spark):
    fx = spark.createDataFrame([(day(2020, 1), "USDHKD", 8.0), (day(2020, 2), "USDHKD", 8.4), (day(2020, 4), "USDHKD", 8.0)], "month date, pair string, rate double")
    prices = spark.createDataFrame([("a", day(2020, k), 0.1, 1.0) for k in (2, 3, 4)], "firm_id string, month date, ret double, mktcap double")
    [r] = panel.in_base_currency(prices, fx, "USDHKD").collect()
    assert r.month == day(2020, 2) and math.isclose(r.ret, 1.1 * 1.05 - 1)
    two = fx.unionByName(fx.withColumns({"pair": F.lit("TWDHKD"), "rate": F.lit(0.25)}))
    assert math.isclose(panel.cross_rate(two, "TWDHKD", "USDHKD").orderBy("month").first().rate, 0.25 / 8)


def known_panel(spark):
    rng = np.random.default_rng(0)
    m = months(2015, 72)
    f = pd.DataFrame({"month": m, "mkt_rf": rng.normal(0.005, 0.04, 72), "gmb": rng.normal(0, 0.03, 72), "rf": 0.001})
    rows = [(f"F{i}", t, float(0.001 + f["mkt_rf"][k] + 0.5 * i * f["gmb"][k] + rng.normal(0, 0.004)), 1.0) for i in range(5) for k, t in enumerate(m)]
    return spark.createDataFrame(rows, "firm_id string, month date, ret double, mktcap double"), spark.createDataFrame(f.astype({"month": object})), f


def test_betas_are_recovered_and_use_no_later_month(spark):
    p, f, _ = known_panel(spark)
    fits = {r.firm_id: r for r in factors.exposures(p, f, ["mkt_rf", "gmb"]).collect()}
    assert all(abs(fits[f"F{i}"].b_gmb - 0.5 * i) < 0.1 for i in range(5)) and all(abs(r.alpha) < 0.005 for r in fits.values())
    rolled = panel.rolling_betas(p, f, ["mkt_rf", "gmb"], 36, 36).toPandas()
    own = rolled[rolled["firm_id"] == "F3"].sort_values("month")
    assert own["b_gmb"].notna().sum() == 36 and abs(own["b_gmb"].iloc[-1] - 1.5) < 0.1
    x = p.filter("firm_id = 'F3'").join(f, "month").orderBy("month").toPandas()
    a = np.column_stack([np.ones(36), x[["mkt_rf", "gmb"]].to_numpy()[35:71]])
    want = np.linalg.lstsq(a, (x["ret"] - x["rf"]).to_numpy()[35:71], rcond=None)[0]
    assert np.allclose(own[["b_mkt_rf", "b_gmb"]].iloc[-1].astype(float), want[1:])


def test_alphas_match_plain_formulas_without_python_by_firm(spark):
    p, f, plain = known_panel(spark)
    short = p.filter("firm_id = 'F1'").orderBy("month").limit(23).withColumn("firm_id", F.lit("short"))
    flat = f.select(F.lit("flat").alias("firm_id"), "month", F.col("rf").alias("ret"), F.lit(1.0).alias("mktcap"))
    odd = p.filter("firm_id = 'F2'").withColumn("firm_id", F.lit(None).cast("string"))
    holes = p.filter("firm_id = 'F4'").withColumns({"firm_id": F.lit("holes"), "ret": F.when(F.month("month") != 3, F.col("ret"))})
    alike = f.withColumn("again", F.col("mkt_rf"))  # a factor twice: least squares of least norm
    table = factors.exposures(p.unionByName(short).unionByName(flat).unionByName(odd).unionByName(holes), alike, ["mkt_rf", "gmb", "again"])
    fits = {r.firm_id: r for r in table.collect()}
    assert set(fits) == {f"F{i}" for i in range(5)} | {"flat", "holes"} and fits["holes"].n == 66
    for name in ("F0", "F3", "holes"):
        x = p.filter(F.col("firm_id") == (name if name != "holes" else "F4")).toPandas().merge(plain, on="month").sort_values("month")
        x = x if name != "holes" else x[[m.month != 3 for m in x["month"]]]
        a, y = np.column_stack([np.ones(len(x)), x[["mkt_rf", "gmb", "mkt_rf"]].to_numpy()]), (x["ret"] - x["rf"]).to_numpy()
        inverse = np.linalg.pinv(a.T @ a)
        beta = inverse @ a.T @ y
        e = y - a @ beta
        s = a * e[:, None]
        meat = s.T @ s + sum((1 - lag / 7) * (c + c.T) for lag in range(1, 7) for c in [s[lag:].T @ s[:-lag]])
        own = fits[name]
        assert np.allclose([own.alpha, own.b_mkt_rf, own.b_gmb, own.b_again], beta) and math.isclose(own.alpha_t, beta[0] / math.sqrt((inverse @ meat @ inverse)[0, 0]), rel_tol=1e-6)
        assert math.isclose(own.idio_var, e @ e / (len(y) - 4)) and math.isclose(own.r2, 1 - e @ e / ((y - y.mean()) ** 2).sum())
    assert fits["flat"].r2 is None and fits["flat"].n == 72
    assert factors.exposures(p.limit(0), f, ["gmb"]).count() == 0 and factors.exposures(p.limit(30), f, [], least=40).count() == 0
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_newey_west_and_fixed_effects_match_plain_formulas(spark):
    v = [0.1, 0.3, -0.2, 0.4, 0.25, 0.1]
    df = spark.createDataFrame([(2000 + i, x) for i, x in enumerate(v)], "year int, v double")
    r = factors.mean_with_newey_west(df, "v", "year", 2).first()
    e = np.array(v) - np.mean(v)
    s = e @ e + 2 * (2 / 3 * (e[1:] @ e[:-1]) + 1 / 3 * (e[2:] @ e[:-2]))
    assert math.isclose(r.t, np.mean(v) / math.sqrt(s / 36)) and r.n == 6
    rng = np.random.default_rng(3)
    rows = [(f"F{i}", y, "ab"[i % 2], float(x := rng.normal()), float(0.15 * x + (i % 2) + y / 7 + rng.normal(0, 0.1))) for i in range(40) for y in (1, 2)]
    out, fit = factors.fixed_effects(spark.createDataFrame(rows, "firm_id string, year int, sector string, x double, y double"), "y", ["x"], ["sector", "year"], "firm_id")
    pdf = pd.DataFrame(rows, columns=["f", "year", "s", "x", "y"])
    d = pd.get_dummies(pdf["s"] + pdf["year"].astype(str), dtype=float).to_numpy()
    a = np.column_stack([pdf["x"], d])
    beta = np.linalg.lstsq(a, pdf["y"], rcond=None)[0]
    res = pdf["y"] - a @ beta
    bread = np.linalg.inv(a.T @ a)
    score = np.array([(a[pdf["f"] == g] * res[pdf["f"] == g].to_numpy()[:, None]).sum(0) for g in pdf["f"].unique()])
    cov = 40 / 39 * 79 / (80 - 5) * bread @ score.T @ score @ bread
    assert math.isclose(fit["vars"]["x"]["coef"], beta[0], rel_tol=1e-9) and math.isclose(fit["vars"]["x"]["t"], beta[0] / math.sqrt(cov[0, 0]), rel_tol=1e-9)
    assert abs(out.agg(F.corr("residual", "x")).first()[0]) < 0.2
    with pytest.raises(ValueError):
        factors.fixed_effects(spark.createDataFrame(rows[:5], "firm_id string, year int, sector string, x double, y double"), "y", ["x"], ["sector", "year"], "firm_id")


def test_gmb_has_the_sign_of_the_slope(spark):
    rng = np.random.default_rng(4)
    rows = [(f"F{i:03}", t, float(0.01 * g + rng.normal(0, 0.02)), 1.0, g) for t in months(2015, 12) for i, g in ((i, float(i / 120)) for i in range(120))]
    df = spark.createDataFrame(rows, "firm_id string, month date, ret double, mktcap double, g double")
    out = factors.gmb_sorted(df).toPandas()
    assert len(out) == 12 and out["gmb"].mean() > 0 and (out["n"] == 120).all()
    equal = factors.gmb_sorted(df, weight="ew").toPandas()
    assert np.allclose(out.sort_values("month")["gmb"], equal.sort_values("month")["gmb"])
    assert factors.gmb_sorted(df.filter("firm_id < 'F020'")).count() == 0


def test_caps_match_the_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        for i in range(rng.randrange(3, 40)):
            rows.append((k, f"F{i}", rng.choice([1.0, rng.random(), rng.random() * 20])))
    got = portfolio.capped_weights(spark.createDataFrame(rows, "p int, firm_id string, w double"), "w", 0.1, "p").toPandas()
    for k, own in got.groupby("p"):
        w = own["w"].to_numpy() / own["w"].sum()
        if len(w) * 0.1 < 1 - 1e-9:
            assert own["w_capped"].isna().all()
            continue
        full = np.zeros(len(w), bool)
        for _ in range(len(w)):
            scaled = np.where(full, 0.1, w * (1 - 0.1 * full.sum()) / max(w[~full].sum(), 1e-300))
            if not (scaled > 0.1 + 1e-12)[~full].any():
                break
            full |= scaled > 0.1 + 1e-12
        assert np.allclose(own["w_capped"], np.minimum(scaled, 0.1), atol=1e-9) and abs(own["w_capped"].sum() - 1) < 1e-9


def test_tilt_ladder_is_greener_and_starts_at_the_base(spark):
    base = spark.createDataFrame([(f"F{i}", 1.0, float(i) if i >= 5 else None) for i in range(40)], "firm_id string, w double, g double")
    out = portfolio.tilt_ladder(base).orderBy("lam").collect()
    assert out[0].turnover < 1e-12 and [r.g_avg for r in out] == sorted(r.g_avg for r in out) and all(r.w_max <= 0.05 + 1e-12 for r in out)
    assert portfolio.green_tilt(base, 0.5, drop_unscored=True).count() == 35


def test_panel_returns_turnover_and_cost(spark):
    m = months(2020, 3)
    w = spark.createDataFrame([(m[0], "a", 1.0), (m[1], "a", 0.5), (m[1], "b", 0.5), (m[2], "a", 0.5), (m[2], "b", 0.5)], "month date, firm_id string, w double")
    r = spark.createDataFrame([(m[0], "a", 0.03), (m[1], "a", 0.02), (m[1], "b", 0.02)], "month date, firm_id string, ret double")
    out = portfolio.panel_returns(w, r, 100).orderBy("month").collect()
    assert [round(x.gross, 9) for x in out] == [0.03, 0.02, 0] and [x.turnover for x in out] == [0.5, 0.5, 0] and [round(x.cost, 9) for x in out] == [0.005, 0.005, 0]


def test_rebalancing_meets_constraints_and_the_analytic_optimum(spark):
    mu = np.array([0.02, 0.01, 0.0])
    market = solver.Market(mu, np.zeros((3, 1)), np.eye(1), np.full(3, 0.25), np.zeros(3))
    alone = solver.Accounts(np.zeros((1, 3)), np.ones(1), np.ones(1), np.full(1, -np.inf), 0.0)
    w, gap = solver.solve(market, alone, np.ones(1))
    assert np.allclose(w[0], 1 / 3 + (mu - mu.mean()) / 0.25, atol=1e-9) and abs(gap[0]) < 1e-12
    rng = np.random.default_rng(6)
    ids = [f"F{i}" for i in range(30)]
    model = {
        "betas": pd.DataFrame(rng.normal(1, 0.3, (30, 2)), index=ids), "factor_cov": pd.DataFrame(np.diag([0.002, 0.001])),
        "firms": pd.DataFrame({"mu": rng.normal(0.006, 0.003, 30), "idio_var": rng.uniform(0.002, 0.01, 30), "g": np.arange(30.0)}, index=ids),
    }
    books = spark.createDataFrame([(k, f"F{i}", float(10 + i)) for k in range(3) for i in range(k, 12)], "portfolio_id int, firm_id string, capital double")
    out = portfolio.rebalance(books, model, 0.16, cap=0.1, g_floor=20.0).toPandas()
    assert set(out["sleeve"]) == {"modeled"} and out["gap"].abs().max() < 1e-6
    for _, own in out.groupby("portfolio_id"):
        assert abs(own["w"].sum() - 1) < 1e-6 and own["w"].max() <= 0.1 + 1e-6 and own["w"].min() >= -1e-9
        assert (own["w"] * own["firm_id"].str[1:].astype(float)).sum() >= 20 - 0.05


def test_holdings_without_a_model_are_frozen_and_candidates_are_bounded(spark):
    ids = [f"F{i}" for i in range(4)]
    firms = spark.createDataFrame([(i, 0.01, 0.004, float(k)) for k, i in enumerate(ids)], "firm_id string, mu double, idio_var double, g double")
    betas = spark.createDataFrame([(i, f, 1.0) for i in ids for f in ("x", "y")], "firm_id string, factor string, beta double")
    cov = spark.createDataFrame([(a, b, 0.001 if a == b else 0.0) for a in ("x", "y") for b in ("x", "y")], "factor_a string, factor_b string, cov double")
    model = portfolio.solver_model(firms, betas, cov)
    with pytest.raises(ValueError):
        portfolio.solver_model(firms, betas, cov, most=3)
    books = spark.createDataFrame([(1, "F0", 60.0), (1, "cash", 40.0), (2, "cash", 5.0), (3, "F1", 10.0)], "portfolio_id int, firm_id string, capital double")
    out = portfolio.rebalance(books, model, 0.3, cap=0.5, g_floor=1.5).toPandas()
    assert all(abs(own["w"].sum() - 1) < 1e-6 and abs(own["w_before"].sum() - 1) < 1e-9 for _, own in out.groupby("portfolio_id"))
    cash = out[out["firm_id"] == "cash"]
    assert sorted(cash["portfolio_id"]) == [1, 2] and (cash["sleeve"] == "frozen").all() and (cash["w"] == cash["w_before"]).all() and set(cash["w"]) == {0.4, 1.0}
    first = out[(out["portfolio_id"] == 1) & (out["sleeve"] == "modeled")]
    assert (first["w"] * first["firm_id"].str[1:].astype(float)).sum() >= 1.5 * 0.6 - 0.01


def test_ranks_by_counts_match_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else float(rng.integers(0, 9)), None if i % 13 == 0 else f"g{i % 4}", float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, g string, y double")
    told = {r.k: r for r in df.select("k", ranks.average_rank(F.col("x"), "g").alias("x"), ranks.percent_score(F.col("y"), "g").alias("y")).collect()}
    got = ranks.with_scores(ranks.with_ranks(df, {"rx": "x"}, "g"), {"sy": ("y", True)}, "g").collect()
    assert len(got) == 400 and all(told[r.k].x == r.rx and (told[r.k].y is None) == (r.sy is None) and abs((told[r.k].y or 0) - (r.sy or 0)) < 1e-9 for r in got)
    pooled = {r.k: (r.a, r.b) for r in ranks.with_pooled_group(df, "a", "g", 95).withColumn("b", ranks.pooled_group(F.col("g"), 95)).collect()}
    assert all(a == b for a, b in pooled.values()) and "_all" in {a for a, _ in pooled.values()}
    assert sorted(r._place for r in ranks.placed(df, "k").collect()) == list(range(400))


def test_dot_segments_and_queries_of_links(spark):
    html = "".join(f"<a href='{h}'>t</a>" for h in ("../x", "./y", "?q=1", "a/../../z/.", "/r/./s/../t?u#v", "../../../w"))
    page = spark.createDataFrame([(1, "http://site.com/a/b/c.html?k=1", html)], "page_id long, url string, html string")
    assert sorted(r.url for r in documents.site_links(page).collect()) == sorted("http://site.com" + u for u in ("/a/x", "/a/b/y", "/a/b/c.html?q=1", "/a/z/", "/r/t?u", "/w"))


def test_statistics_in_factor_form_match_the_full_matrix(spark):
    rng = np.random.default_rng(7)
    b, f, d, mu, w = rng.normal(1, 0.3, (6, 2)), np.array([[0.002, 0.0003], [0.0003, 0.001]]), rng.uniform(0.001, 0.01, 6), rng.normal(0, 0.01, 6), rng.dirichlet(np.ones(6))
    ids = [f"F{i}" for i in range(6)]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    betas = make([(i, n, float(b[k, j])) for k, i in enumerate(ids) for j, n in enumerate("xy")], "firm_id string, factor string, beta double")
    cov = make([(p, q, float(f[i, j])) for i, p in enumerate("xy") for j, q in enumerate("xy")], "factor_a string, factor_b string, cov double")
    idio = make([(i, float(v)) for i, v in zip(ids, d)], "firm_id string, idio_var double")
    r = portfolio.portfolio_stats(make([(1, i, float(v)) for i, v in zip(ids, w)], "portfolio_id int, firm_id string, w double"), make([(i, float(v)) for i, v in zip(ids, mu)], "firm_id string, mu double"), betas, cov, idio, make([(i, 1.0) for i in ids], "firm_id string, g double")).first()
    s = b @ f @ b.T + np.diag(d)
    assert math.isclose(r.ann_vol, math.sqrt(12 * w @ s @ w)) and math.isclose(r.ann_ret, 12 * w @ mu) and math.isclose(r.n_effective, 1 / (w @ w), rel_tol=1e-6)
    assert math.isclose(r.exposures["x"], w @ b[:, 0])
    odd = make([(1, "F0", 0.5), (1, "none", 0.5), (2, "none", 1.0), (3, None, None)], "portfolio_id int, firm_id string, w double")  # firms without a model, null weights
    more = betas.unionByName(make([("F0", "no moments", 2.0)], "firm_id string, factor string, beta double"))
    got = {r.portfolio_id: r for r in portfolio.portfolio_stats(odd, make([("F0", 0.01)], "firm_id string, mu double"), more, cov, idio, make([], "firm_id string, g double")).collect()}
    assert math.isclose(got[1].exposures["no moments"], 1.0) and math.isclose(got[1].ann_vol, math.sqrt(12 * 0.25 * s[0, 0])) and math.isclose(got[1].ann_ret, 0.06) and got[1].g_avg is None
    assert got[2].exposures is None and got[2].ann_vol == 0 and got[2].ann_ret is None and got[3].n_positions == 0
    got = factors.covariances(betas, cov, idio).toPandas().pivot(index="firm_a", columns="firm_b", values="cov").loc[ids, ids].to_numpy()
    assert np.allclose(got, s)


def test_hits_start_words_take_the_longest_term_and_know_their_context(spark):
    body = "We cut carbon emissions. The soil is rich. Carbon capture is planned; climate risk may rise " + "word " * 30 + "renewable power."
    hits = {r.term: (r.hits, r.clean_hits) for r in documents.term_hits(spark.createDataFrame([("d", body), ("e", None)], "accession string, text string")).filter("term is not null").collect()}
    assert hits["carbon capture"] == (1, 0) and hits["climate"] == (1, 0) and "oil" not in hits and hits["renewable"] == (1, 1)
    assert hits["carbon"][0] == 1 and hits["emission"][0] == 1


def test_text_measures(spark):
    glossy = "We will invest in solar power and expect strong progress.\n\nOur climate target brings excellent benefits to all of us.\n\nShort."
    df = spark.createDataFrame([("a", glossy), ("b", ""), ("c", "Nothing of the kind is said here. A second sentence of some length follows it!")], "accession string, text string")
    t = F.col("text")
    out = {r.accession: r for r in df.select("accession", text.keyword_share(t, ("solar", "climate")).alias("k"), text.windowed_sentiment(t).alias("s"), text.context_share(t, ("will", "expect")).alias("f"), F.size(text.segments(t)).alias("n")).collect()}
    assert out["a"].k > 0 and out["a"].s > 0 and out["a"].f == 1.0 and out["a"].n == 2
    assert out["b"].k == out["b"].s == out["b"].f == 0.0 and out["c"].n == 2
    g = {r.accession: r for r in documents.glossiness(df, {"solar": 1.0, "climate": 1.0}).collect()}
    assert g["a"].glossiness > 0 and g["b"].glossiness == 0 and g["c"].share == 0
    kept, share = text.climate_passages(F.col("text"), separator="\n", least=10)
    p = spark.createDataFrame([("first paragraph here\nsecond about climate\nthird paragraph\nfourth paragraph\nx", )], "text string").select(kept.alias("k"), share.alias("s")).first()
    assert p.k == "first paragraph here\n\nsecond about climate\n\nthird paragraph" and p.s == 0.25


def test_titles_and_codes(spark):
    rows = [("Annual Report 2023/24", "annual_report", 2024), ("Environmental, Social and Governance Report 2022", "esg_report", 2022), ("Interim Report", "interim_report", 2022), ("First-quarter results 2021", "quarterly_report", 2021), ("Annual Report and Sustainability Report 2023", "annual_report", 2023), ("Notice", None, 2022)]
    df = spark.createDataFrame(rows, "t string, k string, y int")
    for r in df.select("k", "y", text.title_kind(F.col("t")).alias("kind"), text.fiscal_year(F.col("t"), F.lit(day(2023, 4))).alias("fy")).collect():
        assert (r.kind, r.fy) == (r.k, r.y)
    c = spark.createDataFrame([("SEHK: 5", "1,234.5%", "Acme Holdings Ltd.")], "c string, n string, name string")
    r = c.select(numbers.ticker(numbers.listed_code(F.col("c"))).alias("t"), numbers.clean_number(F.col("n")).alias("n"), text.news_query(F.col("name")).alias("q"), text.initials(F.col("name")).alias("i"), numbers.ticker(F.lit(89988)).alias("long")).first()
    assert (r.t, r.n, r.q, r.i, r.long) == ("0005.HK", 1234.5, '"Acme Holdings"', "AC", "89988.HK")


def test_html_links_and_about_page(spark):
    html = "<html><head><title>t</title></head><body><script>var x='<a>';</script><p>One&nbsp;&amp; two</p><a href='/about'>About <b>us</b></a><a href='mailto:x@y'>m</a><a href=\"http://www.site.com/news#top\">News</a><a href='news'>News</a><a href='https://other.com/'>o</a></body></html>"
    pages = spark.createDataFrame([(1, "http://site.com/home/index.html", html)], "page_id long, url string, html string")
    links = documents.site_links(pages)
    assert [(r.url, r.text) for r in links.orderBy("pos").collect()] == [("http://site.com/about", "About us"), ("http://www.site.com/news", "News"), ("http://site.com/home/news", "News")]
    assert documents.about_page(links).first().url == "http://site.com/about"
    assert pages.select(text.html_text(F.col("html")).alias("t")).first().t.startswith("One & two")


def test_kpi_pages_prefer_later_pages_and_reports_are_picked(spark):
    p = spark.createDataFrame([("r", 1, "scope 1 emissions 5 tCO2e"), ("r", 2, "story"), ("r", 3, "scope 1 emissions 7 tCO2e")], "id string, page int, text string")
    assert [r.page for r in documents.kpi_pages(p, 1).filter("category = 'ghg'").collect()] == [3]
    assert [r.page for r in documents.candidate_pages(p).collect()] == [1, 3]
    reports = spark.createDataFrame([("a", 2023, "annual_report", day(2024, 5), "u1"), ("a", 2023, "esg_report", day(2024, 3), "u2"), ("a", 2023, "esg_report", None, "u3"), ("a", 2022, None, None, "u4")], "firm_id string, fiscal_year int, doc_type string, filing_date date, url string")
    assert sorted(r.url for r in documents.pick_reports(reports).collect()) == ["u2", "u4"]


def test_extraction_cache_and_review(spark):
    body = '{"found": true, "series": [{"fiscal_year": 2023, "scope1_tco2e": 110.0}, {"fiscal_year": 2022}], "evidence": [{"page": 9, "quote": "q"}, {"page": 3}], "confidence": 0.8, "third_party_assured": true}'
    [r] = documents.flatten_extraction(spark.createDataFrame([("a", body), ("b", "broken")], "firm_id string, json string")).collect()
    assert (r.firm_id, r.year, r.scope1, r.pages, r.quote, r.assured) == ("a", 2023, 110.0, "3,9", "q", True)
    docs = spark.createDataFrame([("x", "t" * 400), ("y", "short"), ("z", "u" * 400)], "accession string, text string")
    cache = docs.filter("accession = 'x'").select(F.substring(F.sha1(F.concat_ws("|", F.lit("v"), "text")), 1, 20).alias("key"), F.lit("{}").alias("answer"))
    assert {r.accession: r.status for r in documents.cached_scores(docs, cache, F.lit("v")).collect()} == {"x": "hit", "y": "too_short", "z": "cache_miss"}


def test_screens(spark):
    u = spark.createDataFrame([("1", "Green Power", "Energy", "Solar", "HK"), ("2", "Old Coal", "Energy", "Coal", "HK"), ("3", "Big Bank", "Finance", "Banks", "CN"), ("4", None, None, None, None)], "firm_id string, name string, sector string, industry string, country string")
    caps = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0)], "firm_id string, mktcap double")
    pick = lambda **k: sorted(r.firm_id for r in selection.preferred(u, selection.Preference(**k), caps).collect())
    assert pick() == ["1", "2", "3", "4"] and pick(include={"sector": ("Energy",)}, exclude={"industry": ("Coal",)}) == ["1"]
    assert pick(sizes=("large",)) == ["3"] and pick(keywords=("bank", "coal")) == ["2", "3"] and pick(exclude_keywords=("coal",)) == ["1", "3", "4"]
    asked = spark.createDataFrame([(1, "No coal please, only energy and banks")], "request_id int, text string")
    values = spark.createDataFrame([("industry", "Coal"), ("industry", "Banks"), ("sector", "Energy"), ("sector", "Finance")], "dimension string, value string")
    assert {(r.value, r.negated) for r in selection.keyword_screen(asked, values).collect()} == {("Coal", True), ("Banks", False), ("Energy", False)}


def test_round_robin_and_eligibility(spark):
    firms = spark.createDataFrame([(f"{s}{k}", s) for s in "ABC" for k in range(1, 4)], "firm_id string, sector string")
    caps = firms.select("firm_id", (F.lit(100.0) - 10 * F.substring("firm_id", 2, 1).cast("double") - F.ascii("firm_id") + 65).alias("mktcap"))
    keep = spark.createDataFrame([("C3",), ("A1",)], "firm_id string")
    assert [r.firm_id for r in portfolio.round_robin(firms, caps, 4, keep).collect()] == ["A1", "B1", "C1", "A2", "C3"]


def test_rules_find_each_mutation(spark):
    g = spark.createDataFrame([("a", 2023, 4.2, 48.0, -2.784), ("b", 2023, 4.1, 11.0, 1.0), ("b", 2023, 4.1, 11.0, float("nan"))], "firm_id string, year int, e_score double, e_weight double, g double")
    assert {r.key for r in rules.greenness_formula(g.filter("not isnan(g)")).collect()} == {"b|2023"} and rules.unique(g, "g", ["firm_id", "year"]).first().message == "2 rows"
    assert rules.finite(g, "g", ["firm_id"], ["g", "e_score"]).first().message == "g" and rules.ranges(g, "g", ["firm_id"], {"e_score": (0, 4.15)}).first().key == "a"
    d = spark.createDataFrame([("2023-01-31", "[1]", "0005.HK"), ("2023-02-30", "x", "5"), ("2031-01-01", '["a"]', None)], "d string, j string, t string")
    assert [r.message for r in rules.dates(d, "t", ["t"], "d", "2026-01-01").collect()] == ["not a date", "in the future"]
    assert rules.tickers(d, "t", "t").count() == 2 and rules.json_lists(d, "t", ["d"], "j").count() == 1
    assert {r.key for r in rules.columns(d, "t", ["d", "z"], ["d", "j"]).collect()} == {"z", "t"} and rules.row_count(d.limit(0), "t").first().message == "too few rows"
    with pytest.raises(ValueError):
        schema.require_columns(d, "firms")


def test_factor_file_and_uploads(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("Header text\n\n,Mkt-RF,SMB,RF\n202001, 1.50, -0.25, 0.10\n202002, 2.00, x, 0.10\n\nAnnual\n,Mkt-RF,SMB,RF\n2020, 9, 9, 9\n202101, 5, 5, 5\n")
    rows = tables.read_factor_file(spark, str(path)).orderBy("month").collect()
    assert [(r.month, r.mkt_rf, r.smb) for r in rows] == [(day(2020, 1), 0.015, -0.0025), (day(2020, 2), 0.02, None)]
    up = spark.createDataFrame([(1, 1, "5", "33.3%"), (1, 2, "700", "33.3"), (1, 3, "2330.TW", "33.3"), (1, 4, "x", "-1"), (1, 5, "", "5")], "portfolio_id int, line int, ticker string, weight string")
    assert [(r.firm_id, r.weight) for r in tables.uploaded_holdings(up).orderBy("line").collect()] == [("0005.HK", 33.4), ("0700.HK", 33.3), ("2330.TW", 33.3)]
    assert tables.read_table(spark, str(tmp_path / "none.parquet"), "a int").count() == 0
    part = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(1, 2023), (2, 2024)], "a int, year int"), part)
    assert sorted(r.a for r in tables.read_parts(spark, part, str(tmp_path / "old.csv"), schema="a int, year int").collect()) == [1, 2]


def test_stream_skips_what_it_saw_and_keeps_failures_apart(spark, tmp_path):
    land, out, bad, point = (str(tmp_path / x) for x in ("land", "out", "bad", "point"))
    schema_ = "url string, text string"

    def run():
        s = incremental.landed(spark, land, schema_)
        incremental.ingest(s, lambda b: b.withColumn("error", F.when(F.col("text") == "broken", "unreadable")), out, bad, point, "url").awaitTermination()

    spark.createDataFrame([("a", "x"), ("b", "broken"), ("a", "x")], schema_).write.parquet(land)
    run()
    spark.createDataFrame([("a", "again"), ("c", "y")], schema_).write.mode("append").parquet(land)
    run()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "c"] and [r.url for r in spark.read.parquet(bad).collect()] == ["b"]
    docs = spark.createDataFrame([("a",), ("b",)], "accession string")
    assert [r.accession for r in incremental.outdated(docs, docs.limit(1).withColumn("version", F.lit("2")), "2").collect()] == ["b"]


def test_order_statistics_by_counts_of_ranges(spark, tmp_path):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1.0, 1.0, 2.5, rng.random()]), i) for i in range(400)] + [("lone", 4.0, 1), ("none", None, 2)]
    spark.createDataFrame(rows, "g string, x double, i int").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    groups = {g: [x for k, x, _ in rows if k == g and x is not None] for g, *_ in rows}
    for r in ranks.with_medians_filled(df, {"m": "x"}, "g").collect():
        want = r.x if r.x is not None else statistics.median(groups[r.g]) if groups[r.g] else None
        assert r.m == want or math.isclose(r.m, want)
    quantile = {r.g: r.q for r in ranks.group_quantiles(df, {"q": ("x", 0.7)}, "g").collect()}
    assert set(quantile) == {"a", "b", None, "lone"} and all(math.isclose(q, np.quantile(groups[g], 0.7)) for g, q in quantile.items())
    assert math.isclose(ranks.group_quantiles(df, {"q": ("x", 0.3)}).first().q, np.quantile([x for v in groups.values() for x in v], 0.3))
    sides = ranks.with_terciles(df, "side", "x", "i", "g").collect()
    for g in groups:
        own = sorted((r for r in sides if r.g == g), key=lambda r: (r.x is not None, r.x or 0, r.i))
        assert [r.side for r in own] == ["green" if (k + 1) / len(own) > 2 / 3 else "brown" if (k + 1) / len(own) <= 1 / 3 else "mid" for k in range(len(own))]
    z = ranks.with_z_scores(df, {"z": "x"}, "g").collect()
    for r in z:
        v = groups[r.g]
        assert (r.z is None) if len(v) < 2 or r.x is None else math.isclose(r.z, (r.x - statistics.mean(v)) / statistics.stdev(v), abs_tol=1e-9)
    alike = spark.createDataFrame([("a", 1)] * 700, "g string, x int").repartition(3)
    alike.write.parquet(str(tmp_path / "alike"))
    assert sorted(r.place for r in ranks.with_places(spark.read.parquet(str(tmp_path / "alike")), ["g"], ["x"]).collect()) == list(range(700))
