"""Queries of readers, sinks, labels, records and model inputs, with SQL for the same rows.

Readers and sinks go through files that are written from the given tables to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdantflow.functions import numbers, ranks, text
from verdantflow.operators import documents, factors, panel, portfolio, scores, selection
from verdantflow.plans import bridge, regression_sql
from verdantflow.plans.more_queries import KINDS, _reports
from verdantflow.plans.panel_queries import ANNUAL, BASE, BOOKS, FACTORS, MODEL, SCORED, STATS, TARGETS, _base, _model, _scored, _side_by_side, annual, green_panel, r6
from verdantflow.plans.panel_queries import BETA, PANEL_CTES
from verdantflow.plans.score_queries import rounded
from verdantflow.plans.text_queries import SEPARATOR
from verdantflow.shared import new_path, written
from verdantflow.sources import tables

LINES_A_TASK = 500_000

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Readers and sinks
@query("select o_orderkey, o_totalprice, cast(o_orderdate as date) as day, cast(year(o_orderdate) as integer) as year from orders")
def written_and_read(spark, d):
    """Orders through a Parquet folder by year, a CSV and a JSON file, each a third of the keys, read back as parts."""
    o = bridge.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"), F.year("o_orderdate").alias("year"))
    base, third = new_path(spark, "parts"), F.col("o_orderkey") % 3
    tables.write_table(o.filter(third == 0), f"{base}/new")
    tables.write_table(o.filter(third == 1), f"{base}/old.csv")
    o.filter(third == 2).write.json(f"{base}/older.json")
    schema = "o_orderkey long, o_totalprice double, day date, year int"
    return tables.read_parts(spark, f"{base}/new", f"{base}/old.csv", f"{base}/older.json", f"{base}/none.parquet", schema=schema)


def _factor_file(spark, d, columns: dict[str, str], label: str) -> str:
    """A published-style file of monthly factors in percent, from the given lines: heading, block, then a yearly block."""
    f = bridge.factors(spark, d)
    cells = F.concat_ws(",", F.date_format("month", "yyyyMM"), *(F.format_string("%.10f", F.col(c) * 100) for c in columns.values()))
    lines = f.orderBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", cells.alias("line")))), lambda x: x["line"]), "\n").alias("block"))
    head = "This file was made from lines\n\n," + ",".join(columns)
    path = f"{new_path(spark, label)}"
    lines.select(F.concat(F.lit(head + "\n"), "block", F.lit("\n\n Annual Factors\n,x\n  1996, 1.0\n"))).coalesce(1).write.text(path)
    return path


@query(bridge.sql(f"select month, {r6('mkt_rf', 'smb', 'rf')}, round(hml, 6) + 0.0::double as mom from factors", "factors"))
def factor_files(spark, d):
    """Five-factor and momentum files, parsed and joined by month."""
    five = tables.read_factor_file(spark, _factor_file(spark, d, {"Mkt-RF": "mkt_rf", "SMB": "smb", "RF": "rf"}, "five"))
    momentum = tables.read_factor_file(spark, _factor_file(spark, d, {"Mom": "hml"}, "momentum"))
    return rounded(tables.factor_set(five, momentum))


@query("select cast(s_suppkey as varchar) as firm_id, s_name as name, case when s_suppkey % 3 = 0 then 'known' else coalesce(n_name, '?') end as sector, n_name as industry from supplier left join (select * from nation where n_nationkey % 2 = 0) on n_nationkey = s_nationkey")
def index_universe(spark, d):
    s, n = bridge.table(spark, d, "supplier"), bridge.table(spark, d, "nation").filter("n_nationkey % 2 = 0")
    key = F.col("s_suppkey").cast("string").alias("firm_id")
    members = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left").select(key, F.col("n_name").alias("sub_index"))
    info = s.select(key, F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "known").alias("sector"))
    out = tables.index_universe(members, info, s.select(key, F.lit(None).cast("string").alias("industry")))
    return out.select("firm_id", "name", F.coalesce("sector", F.lit("?")).alias("sector"), "industry")


@query("select o_custkey, round(avg(o_totalprice), 6) as mean, round(sum(cast(o_totalprice as decimal(18,4)))::double, 2) as total from orders group by 1")
def rounded_export(spark, d):
    o = bridge.table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.sum(F.col("o_totalprice").cast(bridge.DEC)).cast("double").alias("total"))
    return tables.rounded_export(o, ("total",))


# Ranks, labels and records
@query("select c_custkey from (select c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as n from customer) where n <= 3")
def top_in_group(spark, d):
    c = bridge.table(spark, d, "customer")
    return c.withColumn("top", ranks.top_in_group([F.desc("c_acctbal"), F.col("c_custkey")], 3, "c_mktsegment")).filter("top").select("c_custkey")


@query("select o_orderkey, round(rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0::double, 1) as rank, count(*) over (partition by o_orderpriority) as n from orders")
def ranks_of_large_groups(spark, d):
    o = bridge.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranks.with_ranks(o, {"rank": "o_totalprice"}, "o_orderpriority").select("o_orderkey", F.round("rank", 1).alias("rank"), F.col("rank_n").alias("n"))


@query(bridge.sql("select firm_id, cast((row_number() over (order by firm_id) - 1) % 4 as integer) as shard from firms", "firms"))
def shards_of_firms(spark, d):
    f = written(bridge.firms(spark, d), "firms")
    out = None
    for i in range(4):
        part = selection.shard(f, 4, i).select("firm_id", F.lit(i).alias("shard"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select page_id, contains(t, w) as about, contains(t, 'the') or contains(t, 'under') as esg, 5.0::double * (contains(t, w))::integer + 5.0::double * (contains(t, 'the') or contains(t, 'under'))::integer as relevance from (select page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) as t, ['the', 'der', 'las'][page_id % 3 + 1] as w from pages)")
def news_labels(spark, d):
    p = bridge.table(spark, d, "pages")
    firm = F.element_at(F.array(F.lit("The Firm"), F.lit("Der Verein"), F.lit("Las Casas")), (F.col("page_id") % 3 + 1).cast("int"))
    about, esg, relevance = text.news_labels(F.regexp_extract("html", "<title>([^<]*)</title>", 1), firm, ("the", "under"))
    return p.select("page_id", about.alias("about"), esg.alias("esg"), relevance.alias("relevance"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'CU' when c_custkey % 3 = 1 then 'TO' else upper(left(cast(c_custkey as varchar), 2)) end as initials, case when c_custkey % 2 = 0 then len(['a', 'b']) else 0 end as n_parts,
    cast(round(greatest(0, least(cast(c_acctbal as decimal(18,4)) * cast(0.05 as decimal(9,4)), 100)), 2) as double) as fresh, case when c_custkey % 3 < 2 then cast(c_custkey % 3 as integer) end as flag, case when c_custkey % 5 = 0 then 'New' when c_custkey % 5 = 1 then 'Buy more' when c_custkey % 5 = 2 then 'Sell all' when c_custkey % 5 = 3 then 'Kept, not modeled' else 'Hold' end as label from customer""")
def small_labels(spark, d):
    c = bridge.table(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "Customer Ltd").when(k % 3 == 1, "The Old, Holdings Group").otherwise(" Inc. ")
    lists = F.when(k % 2 == 0, F.lit('["a", "b"]')).otherwise(F.lit("not a list"))
    side = F.element_at(F.array(*map(F.lit, ("buy", "buy", "sell", "frozen (outside)", "hold"))), (k % 5 + 1).cast("int"))
    weight = F.when(k % 5 == 1, 0.1).otherwise(0.0)
    return c.select(
        "c_custkey", text.initials(name, k.cast("string")).alias("initials"), F.size(text.string_list(lists)).cast("long").alias("n_parts"), numbers.new_capital(F.col("c_acctbal"), F.lit(5.0), F.lit(100.0)).alias("fresh"),
        numbers.flag_or_null(k % 3).alias("flag"), text.trade_label(side, weight, F.lit(0.0)).alias("label"),
    )


@query("select s_suppkey, case when s_acctbal is null then null else round(10 * (1 - r) + 10 / n::double, 6) end as brown, round(10 * r, 6) as green from (select s_suppkey, s_acctbal, rank() over (order by s_acctbal) / count(*) over ()::double as r, count(*) over () as n from supplier)")
def rank_pillars(spark, d):
    s = ranks.with_ranks(bridge.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), {"r": "s_acctbal"})
    share = F.col("r") / F.col("r_n")
    return s.select("s_suppkey", F.round(numbers.rank_pillar(share, F.col("r_n"), False), 6).alias("brown"), F.round(numbers.rank_pillar(share, F.col("r_n"), True), 6).alias("green"))


@query("""select firm_id, replace(lower(firm_id), '.', '-') as id, name, ticker, 'General' as sector, initials, exchange, market, currency, proxy, round(a / 1000, 1) as score, 30::bigint as materiality, round(k % 10 + 0.26, 1)::double as walk, round((k % 7) + 0.14, 1)::double as talk,
    round(round((k % 7) + 0.14, 1) - round(k % 10 + 0.26, 1), 1)::double as gap, case when k % 3 < 2 then k % 3 = 1 end as greenwasher, case when k % 3 < 2 then false end as greenhusher, case when k % 3 < 2 then 'assessed' else 'insufficient_data' end as assessment, region
    from (select s_suppkey as k, s_acctbal as a, s_name as name, upper(left(s_name, 1)) || left(split_part(s_name, '#', 2), 1) as initials, cast(s_suppkey as varchar) || ['.HK', '.TW', '.TWO', ''][s_suppkey % 4 + 1] as firm_id, cast(s_suppkey as varchar) || ['.HK', '.TW', '.TWO', ''][s_suppkey % 4 + 1] as ticker,
        ['HKEX', 'TWSE', 'TPEx', 'Unknown'][s_suppkey % 4 + 1] as exchange, ['hk', 'tw', 'tw', null][s_suppkey % 4 + 1] as market, ['HKD', 'TWD', 'TWD', null][s_suppkey % 4 + 1] as currency,
        ['Asia Pacific ex Japan regional factor proxy (USD)', 'Emerging regional factor proxy (USD)', 'Emerging regional factor proxy (USD)', null][s_suppkey % 4 + 1] as proxy, case when s_nationkey % 3 = 0 then 'China' else ['Hong Kong', 'Taiwan', 'Taiwan', null][s_suppkey % 4 + 1] end as region from supplier)""")
def company_records(spark, d):
    s = bridge.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    firm = F.concat(k.cast("string"), F.element_at(F.array(*map(F.lit, (".HK", ".TW", ".TWO", ""))), (k % 4 + 1).cast("int")))
    view = s.select(
        firm.alias("firm_id"), F.lit(2024).alias("year"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("sector"), (k % 10 + 0.26).alias("walk"), (k % 7 + 0.14).alias("talk"), (F.col("s_acctbal") / 1000).alias("e_score"), (k % 3).cast("int").alias("greenwasher"), F.lit(0).alias("greenhusher"),
    )
    home = s.select(firm.alias("firm_id"), F.when(F.col("s_nationkey") % 3 == 0, "China").otherwise("Mars").alias("domicile"))
    region = selection.region_of(F.col("domicile"), F.col("market"), ("China", "Hong Kong"), {"hk": "Hong Kong", "tw": "Taiwan"})
    return selection.company_records(view).join(home, "firm_id").withColumn("region", region).drop("domicile")


@query("select doc_id, len(list_filter(range(0, doc_id % 5), lambda i: true)) as n_commitments, len(list_filter(range(0, doc_id % 5), lambda i: i % 2 = 0)) as n_quantified from documents")
def commitments(spark, d):
    docs = bridge.table(spark, d, "documents")
    given = F.when(F.col("doc_id") % 5 > 0, F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 5 - 1).cast("int")), lambda i: F.struct((i % 2 == 0).alias("quantified"))))
    five = F.lit(5.0)
    r = text.rubric_rollup({k: five for k in ("ambition", "forward_looking_share", "promotional_tone")}, {k: five for k in text.words.RUBRIC_WALK}, F.length("text"), given)
    return docs.select("doc_id", r["n_commitments"].alias("n_commitments"), r["n_quantified"].alias("n_quantified"))


@query("""select firm_id, year, 'talk_ambition=' || cast(round(avg(doc_id % 7), 4)::double as varchar) as dimensions, string_agg(cast(doc_id as varchar) || ':' || cast((doc_id % 7)::double as varchar), ',' order by cast(doc_id as varchar)) as documents
    from (select 'F' || cast(doc_id % 50 as varchar) as firm_id, cast(2020 + doc_id % 4 as integer) as year, doc_id from documents) group by 1, 2""")
def evidence_with_dimensions(spark, d):
    """Firm-years with the dimensions of their scores and, in order, of their documents."""
    r = _reports(spark, d)
    own = (F.col("url").cast("long") % 7).cast("double")
    docs = r.select("firm_id", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period"), F.col("url").alias("accession"), F.lit("full_report").alias("section"), "title", own.alias("talk_ambition"), F.lit(None).cast("double").alias("walk_composite"))
    years = r.groupBy("firm_id", F.col("fiscal_year").alias("year")).agg(F.round(F.avg(own), 4).alias("talk_ambition"), F.lit(1.0).alias("talk_unfiltered"))
    out = documents.evidence_by_year(years, docs)
    flat = F.array_join(F.transform(F.map_entries("dimensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    each = F.array_join(F.transform("documents", lambda x: F.concat(x["accession"], F.lit(":"), x["dimensions"][0]["value"].cast("string"))), ",")
    return out.select("firm_id", "year", flat.alias("dimensions"), each.alias("documents"))


# Model inputs
COVERED = MODEL | {"annual": ANNUAL, "base": BASE} | {
    "pick": "select firm_id from (select *, row_number() over (order by place, w desc, firm_id) as n from (select firm_id, w, row_number() over (partition by cast(firm_id as bigint) % 5 order by w desc, firm_id) as place from base join exposed using (firm_id))) where n <= 20",
}


@query(bridge.sql("""select a.firm_id as firm_a, b.firm_id as firm_b, round(sum(a.beta * cov * b.beta) + case when a.firm_id = b.firm_id then max(idio_var) else 0 end, 9) + 0.0::double as cov
    from loads a join moments on fa = a.factor join loads b on b.factor = fb join exposed e on e.firm_id = a.firm_id where a.firm_id in (select firm_id from pick) and b.firm_id in (select firm_id from pick) group by 1, 2""", "prices", "factors", **COVERED))
def candidate_covariances(spark, d):
    e, betas, moments = _model(spark, d)
    pick = portfolio.round_robin(e.select("firm_id", (F.col("firm_id").cast("long") % 5).alias("sector")), _base(spark, d).select("firm_id", F.col("w").alias("mktcap")), 20)
    return rounded(factors.covariances(betas.join(F.broadcast(pick), "firm_id"), moments, e.select("firm_id", "idio_var")), 9)


POOLED = """select firm_id, market || '_' || factor as factor, round(beta, 6) + 0.0::double as beta, market, round(coalesce(case when stddev_pop(g) over m > 0 then (g - avg(g) over m) / stddev_pop(g) over m end, 0), 6) + 0.0::double as z from (select firm_id, g, case when cast(firm_id as bigint) % 2 = 1 then 'hk' else 'tw' end as market from scored)
    join (select firm_id, factor, beta from loads) using (firm_id) window m as (partition by market, factor)"""


@query(bridge.sql("select * from (" + POOLED.replace("over m", "over (partition by market)").replace(" window m as (partition by market, factor)", "").replace("from (select firm_id, g,", "from (select *, avg(g) over (partition by market) as ga, stddev_pop(g) over (partition by market) as gs from (select firm_id, g,").replace("from scored)", "from scored))").replace("case when stddev_pop(g) over (partition by market) > 0 then (g - avg(g) over (partition by market)) / stddev_pop(g) over (partition by market) end", "case when gs > 0 then (g - ga) / gs end") + ")", "prices", "factors", **MODEL, annual=ANNUAL, scored=SCORED))
def pooled_markets(spark, d):
    _, betas, _ = _model(spark, d)
    g = _scored(spark, d).select("firm_id", "g")
    odd = F.col("firm_id").cast("long") % 2 == 1
    pooled = factors.pool_markets({"hk": {"betas": betas.filter(odd), "g": g.filter(odd)}, "tw": {"betas": betas.filter(~odd), "g": g.filter(~odd)}})
    return rounded(pooled["betas"].join(pooled["g"].select("firm_id", "z", "market"), "firm_id"))


SHORT = "select month from factors order by month limit 10"


@query(bridge.sql("select a.firm_id, a.market || '_mkt_rf' as factor, round(a.beta, 6) + 0.0::double as beta from (select firm_id, case when cast(firm_id as bigint) % 2 = 1 then 'hk' else 'tw' end as market, beta from loads where factor = 'mkt_rf') a where firm_id in (select firm_id from scored)", "prices", "factors", **MODEL, annual=ANNUAL, scored=SCORED))
def pooled_without_green_factor(spark, d):
    """Two markets whose green factors share ten months: they are dropped from both."""
    _, betas, _ = _model(spark, d)
    betas = betas.filter("factor in ('mkt_rf', 'smb')").withColumn("factor", F.when(F.col("factor") == "smb", "gmb").otherwise("mkt_rf"))
    f = bridge.factors(spark, d).select("month", "mkt_rf", F.col("smb").alias("gmb"))
    short = f.orderBy("month").limit(10)
    odd, g = F.col("firm_id").cast("long") % 2 == 1, _scored(spark, d).select("firm_id", "g")
    pooled = factors.pool_markets({"hk": {"betas": betas.filter(odd), "g": g.filter(odd), "factors": f}, "tw": {"betas": betas.filter(~odd), "g": g.filter(~odd), "factors": short}})
    assert "tw_gmb" not in pooled["factors"].columns
    return rounded(pooled["betas"].join(pooled["g"].select("firm_id"), "firm_id"))


GREEN_FACTOR = {
    "usable": "select month from prices intersect select month from factors",
    "panel0": "select p.*, k.g from prices p left join known k using (firm_id, month) where month in (select month from usable)",
    "beta": BETA.replace("from panel p", "from panel0 p"),
    "gmbs": "select month, sum(g * a) / nullif(sum(g * g), 0) as gmb from (select month, g, exret - beta_m * mkt_rf as a from beta) where a is not null and g is not null group by month having count(*) >= 5",
    "excess5": "select p.firm_id, p.month, 1.0::double as one, ret - rf as y, mkt_rf, smb, hml, gmb from prices p join factors using (month) join gmbs using (month) where ret is not null and gmb is not null",
    **regression_sql.alphas("excess5", "firm_id", "month", [*FACTORS, "gmb"], "y", "greened"),
    "last_g": "select firm_id, g from known where month = (select max(month) from known where month in (select month from usable))",
}


@query(bridge.sql("select firm_id, factor, round(beta, 6) + 0.0::double as beta, round(idio_var, 6) + 0.0::double as idio_var, round(g, 6) + 0.0::double as g from (" + " union all ".join(f"select firm_id, '{f}' as factor, b_{f} as beta, idio_var from greened" for f in [*FACTORS, "gmb"]) + ") left join last_g using (firm_id)", "prices", "factors", annual=ANNUAL, known=PANEL_CTES["known"], **GREEN_FACTOR))
def market_inputs(spark, d):
    m = factors.market_inputs(bridge.prices(spark, d), bridge.factors(spark, d), annual(spark, d), FACTORS)
    return rounded(m["betas"].join(m["idio"], "firm_id").join(m["g"], "firm_id"))


def _stats_ctes(weights: str, end: str) -> dict[str, str]:
    """The tables of ``portfolio_stats`` over another table of weights."""
    names = {"sums": f"sums_{end}", "common": f"common_{end}", "own": f"own_{end}"}
    out = {}
    for k, v in STATS.items():
        if k in names:
            for a, b in names.items():
                v = v.replace(f" {a} ", f" {b} ")
            out[names[k]] = v.replace("from books", f"from {weights}").replace(" sums a", f" sums_{end} a").replace(" sums b", f" sums_{end} b")
    return out


RECOMMENDED = {
    "modeled": "select firm_id from mus",
    "old_w": "select portfolio_id, firm_id, w from books where firm_id in (select firm_id from modeled)",
    "new_w": "select portfolio_id, firm_id, w from targets where firm_id in (select firm_id from modeled)",
    **_stats_ctes("old_w", "old"), **_stats_ctes("new_w", "new"),
    "moves": """select portfolio_id, sum(abs(wa - wb)) / 2 as turnover, count(*) filter (abs(wa - wb) >= 0.005::double) as n_trades, count(*) filter (wa - wb >= 0.005::double and wb < 0.0005::double) as n_new from (
        select portfolio_id, firm_id, coalesce(b.capital / t.total, 0) as wb, coalesce(a.w, 0) as wa from holdings b full join targets a using (portfolio_id, firm_id) join (select portfolio_id, max(total) as total from targets group by 1) t using (portfolio_id)) group by 1""",
    "cover": "select portfolio_id, 100 * coalesce(sum(w) filter (g is not null), 0) / sum(w) as coverage_pct from targets left join scored using (firm_id) group by 1",
    "capital": "select portfolio_id, max(total) as total from books group by 1",
    "sized": "select portfolio_id, max(total) as total from targets group by 1",
}


@query(bridge.sql("""select portfolio_id, round(turnover, 6) + 0.0::double as turnover, n_trades, n_new, round(c.total, 4) as total_capital, round(t.total, 4) as target_capital, round(t.total - c.total, 4) + 0.0::double as new_capital, round(coverage_pct, 6) + 0.0::double as coverage_pct,
        round(o.ann_ret, 6) + 0.0::double as before_ret, round(sqrt(greatest(12 * (coalesce(co.v, 0) + coalesce(o.special, 0)), 0)), 6) + 0.0::double as before_vol, round(n.ann_ret, 6) + 0.0::double as after_ret, round(sqrt(greatest(12 * (coalesce(cn.v, 0) + coalesce(n.special, 0)), 0)), 6) + 0.0::double as after_vol,
        round(n.g_avg, 6) + 0.0::double as after_g, 0 as n_unmodeled, 0.15::double as vol_target, (select min(month) from factors) as first, (select max(month) from factors) as last
    from moves join capital c using (portfolio_id) join sized t using (portfolio_id) join cover using (portfolio_id) left join own_old o using (portfolio_id) left join common_old co using (portfolio_id) left join own_new n using (portfolio_id) left join common_new cn using (portfolio_id)""",
    "prices", "factors", "holdings", **MODEL, annual=ANNUAL, books=BOOKS, targets=TARGETS, scored=SCORED, **RECOMMENDED))
def recommendations(spark, d):
    closes = bridge.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("firm_id"), (10.0 + F.col("s_suppkey") % 17).alias("close"))
    # lines are passed once for each table; of greenness only this year is asked for, so only its lines are summed
    monthly, known = written(bridge.factors(spark, d), "factors"), written(annual(spark, d).filter("year = 1998"), "annual")
    scored = _scored(spark, d, known)
    e, betas, moments = _model(spark, d, monthly=monthly)
    mu = factors.expected_returns(betas, moments.select(F.col("factor_a").alias("factor"), F.col("mean_a").alias("mean")).distinct())
    model = {"mu": mu, "betas": betas, "factor_cov": moments, "idio": e.select("firm_id", "idio_var"), "g": scored.select("firm_id", "g")}
    wish = portfolio.anchors(known, 3, 3).first()
    # dealt by portfolio once: sums, windows and records follow in place, in tasks of a bounded number of lines
    lines = written(bridge.book_lines(spark, d).filter("portfolio_id is not null"), "lines", "zstd")
    dealt = lines.repartition(max(spark.sparkContext.defaultParallelism, lines.count() // LINES_A_TASK + 1), "portfolio_id")
    books = _side_by_side(spark, d, bridge.holdings(spark, d, dealt))
    r = portfolio.recommendations(books, closes, model, scored, tuple(wish), panel.model_period(monthly, FACTORS))
    new = F.filter("trades", lambda t: t["label"] == "New")
    out = r.select(
        "portfolio_id", "turnover", F.size("trades").cast("long").alias("n_trades"), F.size(new).cast("long").alias("n_new"), "coverage_pct", F.col("before.ann_ret").alias("before_ret"), F.col("before.ann_vol").alias("before_vol"), F.col("after.ann_ret").alias("after_ret"),
        F.col("after.ann_vol").alias("after_vol"), F.col("after.g_avg").alias("after_g"), F.size("unmodeled").alias("n_unmodeled"), F.col("preference.vol_target").alias("vol_target"), F.col("period.first").alias("first"), F.col("period.last").alias("last"), "total_capital", "target_capital", "new_capital",
    )
    return rounded(out).withColumns({c: F.round(c, 4) + 0.0 for c in ("total_capital", "target_capital", "new_capital")})


@query("""with mu as (select s_nationkey as k, avg(s_acctbal) / 1e7::double as mu from supplier group by 1), a as (
        select c_custkey, c_nationkey, abs(c_acctbal) + 1 as capital, (abs(c_acctbal) + 1) * (c_custkey % 5) / 4.0::double as cash from customer), b as (
        select c_custkey, case when c_nationkey in (select k from mu) then capital else 0.0::double end as own, case when c_nationkey in (select k from mu) then cash else capital + cash end as outside from a)
    select c_custkey, cast(k as varchar) as firm_id, round(own / (own + outside) / count(*) over (partition by c_custkey) + (mu - avg(mu) over (partition by c_custkey)) / 0.05::double, 7) + 0.0::double as w from b, mu where own > 0""")
def rebalanced_in_closed_form(spark, d):
    """Without costs, and where no bound is met, weights are known: an even share and what a firm is expected to do better, over aversion times variance."""
    s = bridge.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("firm_id")).agg((F.avg("s_acctbal") / 1e7).alias("mu"), F.lit(1.0).alias("idio_var"), F.lit(0.0).alias("g"))
    betas = s.select("firm_id", F.lit("none").alias("factor"), F.lit(0.0).alias("beta"))
    flat = spark.range(1).select(F.lit("none").alias("factor_a"), F.lit("none").alias("factor_b"), F.lit(1.0).alias("cov"))
    c, capital = bridge.table(spark, d, "customer"), F.abs("c_acctbal") + 1
    own = c.select(F.col("c_custkey").alias("portfolio_id"), F.col("c_nationkey").cast("string").alias("firm_id"), capital.alias("capital"))
    cash = c.select(F.col("c_custkey").alias("portfolio_id"), F.lit("cash").alias("firm_id"), (capital * (F.col("c_custkey") % 5) / 4.0).alias("capital"))
    out = portfolio.rebalance(own.unionByName(cash), portfolio.solver_model(s, betas, flat), vol_target=10.0, cost=0.0, cap=1.0)
    return out.filter("sleeve = 'modeled'").select(F.col("portfolio_id").alias("c_custkey"), "firm_id", (F.round("w", 7) + 0.0).alias("w"))


@query()
def rebalanced_accounts(spark, d):
    """The last book of every account to a target volatility and a floor on greenness, over the largest suppliers by sector."""
    prices = written(bridge.prices(spark, d), "prices")  # each used several times
    e, betas, moments = _model(spark, d, prices)
    base = written(_base(spark, d, prices), "base")
    mu = factors.expected_returns(betas, moments.select(F.col("factor_a").alias("factor"), F.col("mean_a").alias("mean")).distinct())
    pick = portfolio.round_robin(e.select("firm_id", (F.col("firm_id").cast("long") % 5).alias("sector")), base.select("firm_id", F.col("w").alias("mktcap")), 30)
    firms = written(e.select("firm_id", "idio_var").join(pick, "firm_id").join(mu, "firm_id").join(base.select("firm_id", "g"), "firm_id"), "candidates")
    books = written(bridge.holdings(spark, d), "books").withColumn("account", F.floor(F.col("portfolio_id") / 10000))
    last = books.groupBy("account").agg(F.max("portfolio_id").alias("portfolio_id")).select("portfolio_id")
    return rounded(portfolio.rebalance(books.drop("account").join(last, "portfolio_id", "left_semi"), portfolio.solver_model(firms, betas, moments), vol_target=0.12, green_weight=0.001, g_floor=5.0))
