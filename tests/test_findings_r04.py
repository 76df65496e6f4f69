"""What the fourth review found."""

import pytest

import __spark_entry__ as entry
from verdantflow.operators import portfolio


@pytest.mark.parametrize(("name", "shuffles"), [("recommendations", 1), ("portfolio_stats", 2)])
def test_books_that_meet_firms_stay_where_they_are(spark, name, shuffles):
    """they met firms, totals and targets by shuffles of their own, which grew faster than the lines. Statistics sum books by portfolio and firm first."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be broadcast unasked
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(portfolio_id") == shuffles and "Exchange hashpartitioning(firm_id" not in plan


@pytest.mark.parametrize("most", [0, 100])
def test_a_record_from_holdings_and_targets(spark, most):
    """firms broadcast or joined by a shuffle; 4 has no model, 2 is frozen, 3 is new; no record without a target or a portfolio."""
    make = spark.createDataFrame
    held = make([(1, "1", 60.0, False), (1, "2", 20.0, True), (1, "4", 20.0, False), (2, "1", 5.0, False), (None, "1", 5.0, False), (3, None, 8.0, False), (3, "1", 8.0, False)], "portfolio_id int, firm_id string, capital double, frozen boolean")
    targets = make([(1, "1", 0.5, 200.0), (1, "3", 0.5, 200.0), (None, "1", 1.0, 5.0), (3, "1", 1.0, 16.0)], "portfolio_id int, firm_id string, w double, total double")
    mu = make([("1", 0.01), ("2", 0.02), ("3", 0.03)], "firm_id string, mu double")
    betas = make([(f, "m", b) for f, b in (("1", 1.0), ("2", 2.0), ("3", 3.0))], "firm_id string, factor string, beta double")
    idio = make([("1", 0.1), ("2", 0.2), ("3", 0.3)], "firm_id string, idio_var double")
    g = make([("1", 4.0), ("4", 9.0)], "firm_id string, g double")
    model = {"mu": mu, "betas": betas, "factor_cov": make([("m", "m", 0.5)], "factor_a string, factor_b string, cov double"), "idio": idio, "g": g}
    closes, period = make([("1", 7.0), ("3", 9.0)], "firm_id string, close double"), make([(1, 2, 3)], "first int, last int, n int")
    books = portfolio.side_by_side(held, targets)
    got = {r.portfolio_id: r for r in portfolio.recommendations(books, closes, model, g, (0.15, None, 0.5), period, most).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r.total_capital, r.target_capital, r.new_capital, r.coverage_pct) == (100.0, 200.0, 100.0, 50.0)
    assert [(t.firm_id, t.side, t.label, t.d_capital, t.shares) for t in r.trades] == [("4", "sell", "Sell all", -20.0, None), ("2", "frozen", "Kept, not modeled", 0.0, None), ("1", "buy", "Buy more", pytest.approx(40.0), 5), ("3", "buy", "New", 100.0, 11)]
    assert r.turnover == pytest.approx((0.1 + 0.2 + 0.5) / 2) and [tuple(x) for x in r.unmodeled] == [("4", 20.0, 0.2)]
    assert (r.before.ann_ret, r.before.ann_vol, r.before.g_avg, r.before.n_positions, r.before.exposures) == (pytest.approx(12 * 0.01), pytest.approx((12 * (0.5 + 0.36 * 0.1 + 0.04 * 0.2)) ** 0.5), 4.0, 2, {"m": pytest.approx(1.0)})
    assert (r.after.ann_ret, r.after.ann_vol, r.after.g_avg, r.after.n_positions, r.after.top_w) == (pytest.approx(12 * 0.02), pytest.approx((12 * (0.5 * 4 + 0.25 * 0.4)) ** 0.5), 4.0, 2, 0.5)
    assert [tuple(x) for x in got[3].unmodeled] == [(None, 8.0, 0.5)] and got[3].before.n_positions == 1 and got[3].turnover == pytest.approx(0.5)
    told = portfolio.trades(held, targets).filter("portfolio_id = 1").orderBy("firm_id").collect()
    assert [(t.firm_id, t.side) for t in told] == [("1", "buy"), ("2", "frozen"), ("3", "buy"), ("4", "sell")]
