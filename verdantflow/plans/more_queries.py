"""Queries of the remaining operators: picks, extractions, evidence, model inputs and reference checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdantflow.functions import numbers, text
from verdantflow.operators import documents, factors, panel, portfolio, scores, selection
from verdantflow.plans import bridge
from verdantflow.plans.panel_queries import ANNUAL, FACTORS, _base, _books, _model, _scored, _targets, annual
from verdantflow.plans.score_queries import carbon, rounded
from verdantflow.plans.text_queries import DRY_RUN, KPI, MARKS, PAGES, PATTERNS, SEPARATOR, TERMS, _docs, _pages
from verdantflow.plans.text_sql import claims, hit_ctes
from verdantflow.quality import rules
from verdantflow.sources import tables
from verdantflow.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KINDS = ("esg_report", "annual_report", "interim_report")


def _reports(spark, d):
    """The documents as filed reports of firms."""
    docs = bridge.table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(
        F.concat(F.lit("F"), (F.col("doc_id") % 50).cast("string")).alias("firm_id"), F.col("doc_id").cast("string").alias("url"), kind.alias("doc_type"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 7 % 900).cast("int")).alias("filing_date"),
        (2020 + F.col("doc_id") % 4).cast("int").alias("fiscal_year"), F.concat(F.lit("Report "), F.col("doc_id").cast("string")).alias("title"), F.col("n_chars").alias("confidence"), "text",
    )


REPORTS = "select 'F' || cast(doc_id % 50 as varchar) as firm_id, cast(doc_id as varchar) as url, doc_id % 3 as kind, date '2020-01-01' + cast(doc_id * 7 % 900 as integer) as filed, cast(2020 + doc_id % 4 as integer) as fiscal_year, n_chars from documents"


@query(bridge.sql("select firm_id, fiscal_year, url from (select *, row_number() over (partition by firm_id, fiscal_year order by kind, filed desc, url) as n from filings) where n = 1", filings=REPORTS))
def picked_reports(spark, d):
    return documents.pick_reports(_reports(spark, d)).select("firm_id", "fiscal_year", "url")


@query(bridge.sql("select firm_id, fiscal_year as year, url from (select *, row_number() over (partition by firm_id, fiscal_year order by filed desc, kind, n_chars desc, url) as n from filings) where n = 1", filings=REPORTS))
def consolidated_emissions(spark, d):
    r = _reports(spark, d).select("firm_id", F.col("fiscal_year").alias("year"), "doc_type", F.col("filing_date").alias("document_year"), F.struct("confidence", F.negative(F.col("url").cast("long"))).alias("confidence"), "url")
    return documents.consolidate_emissions(r).select("firm_id", "year", "url")


@query(bridge.sql("select firm_id, url as accession, make_date(fiscal_year, 12, 31) as period, length(text) + len(string_split(text, chr(10))) - 1 as n_chars from (select *, row_number() over (partition by firm_id, fiscal_year order by kind, filed desc, url) as n from filings) join (select cast(doc_id as varchar) as url, text from documents where text is not null) using (url) where n = 1", filings=REPORTS))
def score_ready_documents(spark, d):
    r = _reports(spark, d)
    pages = _pages(spark, d).withColumn("id", F.col("id").cast("string"))
    return documents.score_ready(pages, documents.pick_reports(r)).select("firm_id", "accession", "period", F.length("text").cast("long").alias("n_chars"))


KPI_TEXT = KPI.replace("category, page, score from", "category, page, score, text from", 1).replace("select id, page,", "select id, page, text,")


@query(bridge.sql("select * from kpi where category = 'a'", pages2=PAGES, kpi=KPI_TEXT))
def candidate_pages(spark, d):
    return documents.candidate_pages(_pages(spark, d), "a", patterns=PATTERNS).withColumn("page", F.col("page").cast("long"))


@query(bridge.sql("select id, string_agg(text, chr(10) || chr(10) order by page) as text from kpi where category = 'a' group by id", pages2=PAGES, kpi=KPI_TEXT))
def kpi_pages_of_a_report(spark, d):
    kpi = documents.kpi_pages(_pages(spark, d), patterns=PATTERNS)
    return documents.pages_of(kpi, "a")


@query("select doc_id as accession from documents where doc_id % 50 = 3 and (['ghg', 'water'])[doc_id % 2 + 1] = 'water' and n_chars >= 500")
def filtered_documents(spark, d):
    docs = bridge.table(spark, d, "documents")
    df = docs.select(F.concat(F.lit("F"), (F.col("doc_id") % 50).cast("string")).alias("firm_id"), F.element_at(F.array(F.lit("ghg"), F.lit("water")), (F.col("doc_id") % 2 + 1).cast("int")).alias("section"), F.col("n_chars").alias("relevance"), F.col("doc_id").alias("accession"))
    return documents.filtered_documents(df, "F3", ("water",), 500, "accession").select("accession")


SHARE = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 40)"


@query(f"select round(avg(case when len(p) > 0 then len(list_filter(p, lambda x: regexp_matches(x, '(?i)tion|here|rein|that'))) / len(p)::double else 0 end), 6) as share from (select {SHARE} as p from documents)")
def mean_climate_share(spark, d):
    return rounded(documents.mean_climate_share(_docs(spark, d), terms=TERMS, separator=SEPARATOR))


@query(bridge.sql("""select firm_id, year, round(gap, 6) + 0.0::double as gap, n_docs, (year - 2021)::double as scope12_change_pct, concat_ws('; ', case when gap > 2 then 'talk exceeds walk' end, case when year > 2021 then 'emissions rose' end) as memo
    from (select firm_id, year, avg(talk - walk) as gap, count(*) as n_docs from dry where not n_chars < 300 group by 1, 2)""", dry=DRY_RUN))
def review_flags(spark, d):
    s = text.dry_run_scores(F.col("text"))
    scored = _docs(spark, d).select("firm_id", "year", (s["talk"] - s["walk"]).alias("gap"), (F.length("text") < 300).alias("skipped"))
    hard = _docs(spark, d).select("firm_id", "year").distinct().withColumn("scope12_change_pct", (F.col("year") - 2021).cast("double"))
    return rounded(documents.review_flags(scored, hard).drop("flags"))


@query(bridge.sql("select (select count(*) from firm_years) as firm_years, (select count(*) from firm_years a where exists (select 1 from firm_years b where b.firm_id = a.firm_id and b.year <= a.year and b.matched)) as with_scope12", "firm_years"))
def hard_data_status(spark, d):
    e = bridge.emissions(spark, d)
    return documents.hard_data_status(scores.hard_data(e, bridge.fundamentals(spark, d), e))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def largest_orders(spark, d):
    return documents.largest(bridge.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10)


@query("select cast(doc_id as varchar) as id, cast(2020 + doc_id % 4 as integer) as year, doc_id * 2.0::double as scope1, '3,5' as pages from documents where doc_id % 2 = 0")
def flattened_extractions(spark, d):
    docs = bridge.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    point = lambda y, v: F.struct(y.alias("fiscal_year"), v.alias("scope1_tco2e"), F.lit(None).cast("double").alias("scope2_tco2e"), F.lit("location").alias("scope2_basis"))
    page = lambda p: F.struct(F.lit(p).alias("page"), F.lit("quoted").alias("quote"))
    value = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 2.0)
    body = F.to_json(F.struct(F.lit(True).alias("found"), F.array(point((2020 + F.col("doc_id") % 4).cast("int"), value)).alias("series"), F.array(page(5), page(3), page(5)).alias("evidence"), F.lit(0.9).alias("confidence")))
    return documents.flatten_extraction(docs.select("id", body.alias("json"))).select("id", "year", "scope1", "pages")


@query(bridge.sql("select firm_id, year, count(*) as n from reports group by 1, 2", "reports"))
def evidence_by_year(spark, d):
    r = _reports(spark, d)
    docs = r.select("firm_id", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period"), F.col("url").alias("accession"), F.lit("full_report").alias("section"), "title")
    years = r.select("firm_id", F.col("fiscal_year").alias("year")).distinct()
    return documents.evidence_by_year(years, docs).select("firm_id", "year", F.size("documents").cast("long").alias("n"))


@query("select c_custkey as firm_id, count(distinct u) as n from (select c_custkey, c_nationkey % 3 as u from customer union all select c_custkey, 1 from customer) group by 1")
def source_catalogue(spark, d):
    c = bridge.table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("firm_id"), (F.col("c_nationkey") % 3).cast("string").alias("url"), F.lit("report").alias("source_type"), F.col("c_name").alias("title"))
    b = c.select(F.col("c_custkey").alias("firm_id"), F.lit("1").alias("url"), F.lit("news").alias("source_type"), F.col("c_name").alias("title"))
    return documents.catalogue(a, b).groupBy("firm_id").agg(F.count("*").alias("n"))


@query(bridge.sql("select sector as value from firms where sector in ('BUILDING', 'HOUSEHOLD') group by 1", "firms"))
def known_values(spark, d):
    asked = spark.createDataFrame([("BUILDING",), ("HOUSEHOLD",), ("NOWHERE",)], "value string")
    return selection.known_values(asked, bridge.firms(spark, d), "sector")


@query(bridge.sql("select firm_id, year from firm_years where year = (select max(year) from firm_years)", "firm_years"))
def latest_year(spark, d):
    e = bridge.emissions(spark, d).withColumn("provider", F.lit("a"))
    return selection.latest_year(e).select("firm_id", "year")


@query("select s_suppkey as k, case when s_suppkey % 3 = 0 then 'tw' else 'hk' end as market from supplier")
def markets(spark, d):
    s = bridge.table(spark, d, "supplier")
    code = F.concat(F.col("s_suppkey").cast("string"), F.when(s["s_suppkey"] % 3 == 0, ".TW").otherwise(".HK"))
    return s.select(F.col("s_suppkey").alias("k"), selection.market_of(code).alias("market"))


@query(bridge.sql("select count(*) as n, count(distinct firm_id) as firms from firms", "firms"))
def firm_shards(spark, d):
    """Four shards, which together hold every firm once."""
    f = bridge.firms(spark, d)
    parts = [selection.shard(f, 4, i) for i in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).agg(F.count("*").alias("n"), F.count_distinct("firm_id").alias("firms"))


PRICED = "select cast(s_suppkey as varchar) as firm_id, s_nationkey % 4 as sector, n, mktcap from supplier join (select firm_id, count(ret) as n, arg_max(mktcap, month) as mktcap from prices group by 1) p on p.firm_id = cast(s_suppkey as varchar) where n >= 24"
PICKED = "select firm_id from (select *, row_number() over (order by place, mktcap desc, firm_id) as n_th from (select *, row_number() over (partition by sector order by mktcap desc, firm_id) as place from {table})) where n_th <= {n}"


@query(bridge.sql(PICKED.format(table="priced", n="3 * (select count(distinct sector) from priced)"), "prices", priced=PRICED))
def quote_firms(spark, d):
    s, n = bridge.table(spark, d, "supplier"), bridge.table(spark, d, "nation")
    universe = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("string").alias("firm_id"), (F.col("n_nationkey") % 4).alias("sector"))
    return selection.quote_firms(bridge.prices(spark, d), universe, "tw")


@query(bridge.sql("select firm_id from caps where k % 5 = 0 union all " + PICKED.format(table="(select * from caps where k % 5 <> 0)", n="(select count(*) from caps where k % 5 = 0)"), caps="select cast(s_suppkey as varchar) as firm_id, s_suppkey as k, s_nationkey % 4 as sector, s_acctbal as mktcap from supplier"))
def balanced_pool(spark, d):
    s = bridge.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("firm_id"), (F.col("s_nationkey") % 4).alias("sector"), F.col("s_acctbal").alias("mktcap"))
    return selection.balanced_pool(s.filter("cast(firm_id as long) % 5 = 0"), s.filter("cast(firm_id as long) % 5 <> 0"), s)


@query("""select cast(s_suppkey as varchar) as firm_id, cast(2024 - (s_suppkey % 2 = 0)::integer as integer) as year, round(case when s_suppkey % 2 = 0 then 1200 else round(abs(s_acctbal), 2) * 12 / 8 end * 1000 / 32 / 1e6::double, 9) as revenue,
    case when s_suppkey % 2 = 0 then 'last year' else 'annualised from month 8' end as basis, 1234.5::double as scope1, null::double as scope2, null::double as scope3, true as matched, s_suppkey % 3 = 0 as verified from supplier""")
def loaded_fundamentals_and_emissions(spark, d):
    s = bridge.table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").cast("string").alias("firm_id"), F.lit("113").alias("local_year"), F.lit("8").alias("month"), F.format_number(F.abs("s_acctbal"), 2).alias("year_to_date"), F.when(s["s_suppkey"] % 2 == 0, F.lit("1,200")).alias("last_year_total"))
    e = s.select(F.col("s_suppkey").cast("string").alias("firm_id"), F.lit("113").alias("local_year"), F.lit("1,234.5").alias("scope1"), F.lit("n/a").alias("scope2"), F.lit(None).cast("string").alias("scope3"), F.lit("Y").alias("verified1"), F.when(s["s_suppkey"] % 3 == 0, "Y").otherwise("N").alias("verified2"))
    return rounded(tables.annualised_revenue(rows).join(tables.exchange_emissions(e).drop("year"), "firm_id"), 9)


@query("select o_orderkey as id from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'F'")
def listed_equities(spark, d):
    o = bridge.table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", " Equity").when(F.col("o_orderpriority") == "2-HIGH", "Real Estate Investment Trusts").otherwise("Bond").alias("category"), F.lit("Y ").alias("vcm"), F.when(F.col("o_orderstatus") == "F", "HKD").otherwise("USD").alias("currency"))
    return tables.listed_equities(rows).select("id")


@query("select cast(doc_id as varchar) || '.pdf' as url, cast(doc_id as varchar) as stock_code, 2023 as fiscal_year from documents where doc_id % 2 = 0")
def report_listing(spark, d):
    docs = bridge.table(spark, d, "documents")
    rows = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("<br/>8"), F.col("doc_id").cast("string")).alias("stock_code"), F.when(docs["doc_id"] % 2 == 0, "ESG Report 2022/23").otherwise("Notice").alias("title"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"), F.lit("03/04/2024").alias("filed"))
    return tables.report_listing(rows).select("url", "stock_code", "fiscal_year")


@query(bridge.sql("select firm_id, count(*) as n from (select firm_id, year from firm_years where cast(firm_id as bigint) % 10 <> 3 union all select distinct firm_id, year from firm_years where cast(firm_id as bigint) % 10 = 3) group by 1", "firm_years"))
def merged_restatements(spark, d):
    e = bridge.emissions(spark, d).select("firm_id", "year", "scope1")
    with_keys = e.withColumns({"doc_type": F.lit("esg_report"), "document_year": F.col("year"), "confidence": F.lit(0.5)})
    new = with_keys.filter("cast(firm_id as long) % 10 = 3")
    return incremental.merged(with_keys, new.unionByName(new.withColumn("confidence", F.lit(0.4)))).groupBy("firm_id").agg(F.count("*").alias("n"))


@query(bridge.sql("""select 'greenness' as "table", 'flags' as rule, firm_id || '|' || year as key, 'flag' as message from annual where g > 5
    union all select 'greenness', 'texts', firm_id || '|' || year, 'note' from annual where year - 1990 > 6
    union all select 'prices_monthly', 'within_month', firm_id || '|' || month, cast(cast(month + cast(cast(firm_id as bigint) % 45 as integer) as date) as varchar) from prices where date_trunc('month', month + cast(cast(firm_id as bigint) % 45 as integer)) <> month
    union all values ('prices_monthly', 'contract', 'currency', 'USD is not HKD'), ('prices_monthly', 'columns', 'close', 'missing')""", "prices", annual=ANNUAL))
def quality_of_uploads(spark, d):
    """Flags, texts, months and contracts over derived tables."""
    g = annual(spark, d).withColumns({"flag": (F.col("g") > 5).cast("int") * 2, "note": F.repeat(F.lit("x"), (F.col("year") - 1990).cast("int"))})
    p = bridge.prices(spark, d).withColumn("observed", F.date_add("month", (F.col("firm_id").cast("long") % 45).cast("int")))
    return rules.all_of(
        rules.audit(g, "greenness", ["firm_id", "year"], rules.flag_test(["flag"]), rules.text_test(["note"], 6)), rules.within_month(p, "prices_monthly", ["firm_id", "month"], "observed"),
        rules.contract({"currency": "USD"}, {"currency": "HKD"}, "prices_monthly", spark), rules.columns(p, "prices_monthly", ["firm_id", "close"], None),
    )


@query(bridge.sql(f"select *, round(case when n_words > 0 then 1000 * n_claim / n_words::double end, 6) as rate from ({claims(TERMS[:2])})", **hit_ctes(TERMS, MARKS)))
def metric_versions(spark, d):
    hits = documents.term_hits(_docs(spark, d), TERMS, MARKS)
    return documents.dictionary_counts(hits, TERMS[:2]).withColumn("rate", F.round(numbers.ratio(1000 * F.col("n_claim"), F.col("n_words")), 6))


OUTLIERS = """select firm_id, year, coalesce(abs(e / sqrt(spread)) > 2, false) as outlier from (select *, case when s > 1e-18 then s end as spread from (select *, s2 * (1 - 1 / n::double - (x - m) * (x - m) / sxx) as s from (
    select *, case when n > 2 then sum(e * e) over (partition by year) / (n - 2) end as s2 from (select firm_id, year, revenue as x, count(*) over g as n, regr_sxx(scope1, revenue) over g as sxx, avg(revenue) over g as m,
        scope1 - regr_intercept(scope1, revenue) over g - regr_slope(scope1, revenue) over g * revenue as e from firm_years where revenue > 0 and scope1 is not null window g as (partition by year)))))"""


@query(bridge.sql(OUTLIERS, "firm_years"))
def emissions_with_flags(spark, d):
    return rounded(selection.outlier_flags(carbon(spark, d).filter("intensity is not null"), "level", "revenue", "year").select("firm_id", "year", "outlier"))


@query(bridge.sql("select portfolio_id, max(capital / total) as top from books group by 1", "holdings", books="select *, cast(sum(cast(capital as decimal(18,4))) over (partition by portfolio_id) as double) as total from holdings"))
def top_weights(spark, d):
    return _books(spark, d).groupBy("portfolio_id").agg(F.max("w").alias("top"))
