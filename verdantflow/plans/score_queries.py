"""Queries of the score tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdantflow.functions import numbers, ranks
from verdantflow.operators import scores
from verdantflow.plans import bridge
from verdantflow.shared import written
from verdantflow.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as in the SQL, a negative zero made zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_rank(x: str, *group: str) -> str:
    """Average rank of x in its group, null for a null x."""
    by = ", ".join(group)
    return f"(case when {x} is not null then rank() over (partition by {by}, {x} is null order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0::double end)"


def sql_score(x: str, *group: str, high: bool = True) -> str:
    by = ", ".join(group)
    n = f"count({x}) over (partition by {by})"
    share = f"(case when {' or '.join(g + ' is null' for g in group)} then 0.5::double when {n} > 1 then ({sql_rank(x, *group)} - 1) / ({n} - 1) else 0.5::double end)"
    return f"(case when {x} is not null then 10 * {share if high else f'(1 - {share})'} end)"


def sql_z(x: str, *group: str) -> str:
    w = f"over (partition by {', '.join(group)})"
    return f"(case when count({x}) {w} < 2 then null when stddev_samp({x}) {w} > 0 then ({x} - avg({x}) {w}) / stddev_samp({x}) {w} else 0 end)"


def sql_round(select: str, columns: list[str], doubles: list[str]) -> str:
    return "select " + ", ".join(f"round({c}, 6) + 0.0::double as {c}" if c in doubles else c for c in columns) + f" from ({select})"


CARBON = """select f.*, scope1 as level, case when revenue > 0 then scope1 / revenue end as intensity, sector from firm_years f left join firms using (firm_id)"""
WALKED = f"""select *, {sql_score('intensity', 'year', 'rank_group', high=False)} as walk_intensity_level, {sql_score('d_log_intensity', 'year', 'rank_group', high=False)} as walk_intensity_trend,
    {sql_score('d_log_level', 'year', 'rank_group', high=False)} as walk_emission_trend from (
    select *, case when sector is not null and count(*) over (partition by year, sector) >= 5 then sector else '_all' end as rank_group,
        case when year - lag(year) over w = 1 then ln(case when intensity > 0 then intensity end) - lag(ln(case when intensity > 0 then intensity end)) over w end as d_log_intensity,
        case when year - lag(year) over w = 1 then ln(case when level > 0 then level end) - lag(ln(case when level > 0 then level end)) over w end as d_log_level
    from carbon where matched and intensity is not null window w as (partition by firm_id order by year))"""
WALK = """select *, walk_intensity_level as walk, (walk_intensity_level is not null)::int + (walk_intensity_trend is not null)::int + (walk_emission_trend is not null)::int as walk_n_components,
    (coalesce(walk_intensity_level * 0.5::double, 0) + coalesce(walk_intensity_trend * 0.3::double, 0) + coalesce(walk_emission_trend * 0.2::double, 0))
    / (case when walk_intensity_level is null then 0 else 0.5::double end + case when walk_intensity_trend is null then 0 else 0.3::double end + case when walk_emission_trend is null then 0 else 0.2::double end) as walk_composite
    from walked"""
REVENUE = "select *, coalesce(case when intensity > 0 then level / intensity end, median(case when intensity > 0 then level / intensity end) over (partition by year, sector)) as rev from walk where walk is not null and sector is not null"
WEIGHT = f"""select year, sector, 5 + 45 * {sql_rank('ii', 'year')} / count(ii) over (partition by year) as e_weight from (
    select year, sector, case when sum(rev) > 0 then sum(level) / sum(rev) end as ii from revenue group by 1, 2)"""
SCORES = "select firm_id, year, sector, walk as e_score, e_weight from revenue join weight using (year, sector)"
GREEN = "select *, avg(g) over (partition by year, sector) as g_across, g - avg(g) over (partition by year, sector) as g_within from (select *, -(10 - e_score) * e_weight / 100 as g from scores)"
WALK_CTES = {"carbon": CARBON, "walked": WALKED, "walk": WALK}
GREEN_CTES = WALK_CTES | {"revenue": REVENUE, "weight": WEIGHT, "scores": SCORES, "green": GREEN}


def firm_years(spark, d) -> DataFrame:
    """The firm-years of orders and lines as a table: emissions and fundamentals of a query come from one pass over the lines."""
    return written(bridge.firm_years(spark, d), "firm-years")


def carbon(spark, d, years: DataFrame | None = None) -> DataFrame:
    years = firm_years(spark, d) if years is None else years
    return scores.carbon_intensity(years.drop("revenue"), years.select("firm_id", "year", "revenue"))


def walk(spark, d, years: DataFrame | None = None) -> DataFrame:
    return scores.walk_score(carbon(spark, d, years), bridge.firms(spark, d))


def green(spark, d) -> DataFrame:
    return scores.greenness_table(scores.scores_from_walk(walk(spark, d)), bridge.firms(spark, d))


def with_ctes(select: str, ctes: dict[str, str]) -> str:
    return bridge.sql(select, "firms", "firm_years", **ctes)


@query(with_ctes(sql_round("select *, ln(1 + level) as log_level, ln(1 + intensity) as log_intensity, ln(1 + level) - lag(ln(1 + level)) over (partition by firm_id order by year) as d_log_level from carbon",
       ["firm_id", "year", "level", "intensity", "log_level", "log_intensity", "d_log_level"], ["level", "intensity", "log_level", "log_intensity", "d_log_level"]), {"carbon": CARBON}))
def carbon_intensity(spark, d):
    return rounded(carbon(spark, d).select("firm_id", "year", "level", "intensity", "log_level", "log_intensity", "d_log_level"))


#: Buckets of the tables that queries write by firm and year.
BUCKETS = 32


@query(ORACLE_SQL["carbon_intensity"])
def bucketed_carbon_intensity(spark, d):
    """The same table from emissions and fundamentals in buckets of firm and year, which meet without a shuffle."""
    e, f = (tables.write_bucketed(t, ["firm_id", "year"], BUCKETS) for t in (bridge.emissions(spark, d), bridge.fundamentals(spark, d)))
    return rounded(scores.carbon_intensity(e, f).select("firm_id", "year", "level", "intensity", "log_level", "log_intensity", "d_log_level"))


_WALK = ["firm_id", "year", "sector", "rank_group", "walk_intensity_level", "walk_intensity_trend", "walk_emission_trend", "walk_n_components", "walk_composite", "walk"]


@query(with_ctes(sql_round("select * from walk", _WALK, [c for c in _WALK if c.startswith("walk") and c != "walk_n_components"]), WALK_CTES))
def walk_score(spark, d):
    return rounded(walk(spark, d).select(*_WALK))


@query(with_ctes(sql_round("select * from green", ["firm_id", "year", "e_score", "e_weight", "g", "g_across", "g_within"], ["e_score", "e_weight", "g", "g_across", "g_within"]), GREEN_CTES))
def greenness_table(spark, d):
    return rounded(green(spark, d).drop("provider"))


@query(with_ctes("select sector, round(avg(g), 6) + 0.0::double as g_mean, round(avg(g_across), 6) + 0.0::double as g_across_mean, count(*) as n from green group by sector", GREEN_CTES))
def greenness_by_sector(spark, d):
    return rounded(scores.sector_means(green(spark, d), bridge.firms(spark, d)))


@query(with_ctes("select year, sector, round(e_weight, 6) as e_weight from weight", GREEN_CTES))
def industry_weights(spark, d):
    w = walk(spark, d).filter("walk is not null and sector is not null")
    w = written(w.withColumn("_revenue", numbers.ratio(F.col("level"), F.col("intensity"))), "revenue")
    w = ranks.with_medians_filled(w, {"revenue": "_revenue"}, "year", "sector")
    return rounded(scores.industry_weight(w, industry="sector"))


PILLARS = f"""select *, {sql_score('wm', 'year', 'rank_group', high=False)} as pillar_water, {sql_score('sm', 'year', 'rank_group', high=False)} as pillar_waste, {sql_score('rm', 'year', 'rank_group')} as pillar_energy
    from (select w.*, case when revenue > 0 then water / revenue end as wm, case when revenue > 0 then waste / revenue end as sm, share as rm, s3 from walk w join extra using (firm_id, year))"""
EXTRA = "select firm_id, year, case when cast(firm_id as bigint) % 3 <> 0 then scope2 * 2 end as water, case when cast(firm_id as bigint) % 4 <> 0 then scope1 + scope2 end as waste, case when cast(firm_id as bigint) % 5 <> 0 then (year * 7 + cast(firm_id as bigint)) % 101 end::double as share, case when cast(firm_id as bigint) % 2 = 0 then scope1 end as s3 from firm_years"


def pillar_emissions(years: DataFrame) -> DataFrame:
    """Emissions with the other pillars' columns, some left out for some firms."""
    number = F.col("firm_id").cast("long")
    return years.drop("revenue").withColumns(
        {
            "water_tonnes": F.when(number % 3 != 0, F.col("scope2") * 2), "waste_tonnes": F.when(number % 4 != 0, F.col("scope1") + F.col("scope2")),
            "renewable_share_pct": F.when(number % 5 != 0, ((F.col("year") * 7 + number) % 101).cast("double")), "scope3": F.when(number % 2 == 0, F.col("scope1")),
        }
    )


@query(with_ctes(sql_round("""select *, (coalesce(walk, 0) + coalesce(pillar_water, 0) + coalesce(pillar_waste, 0) + coalesce(pillar_energy, 0)) / walk_n_pillars as walk_multi from (
    select *, (walk is not null)::int + (pillar_water is not null)::int + (pillar_waste is not null)::int + (pillar_energy is not null)::int as walk_n_pillars, coalesce(s3 > 0, false) as scope3_reported from pillars)""",
       ["firm_id", "year", "pillar_water", "pillar_waste", "pillar_energy", "walk_multi", "walk_n_pillars", "scope3_reported"], ["pillar_water", "pillar_waste", "pillar_energy", "walk_multi"]), WALK_CTES | {"extra": EXTRA, "pillars": PILLARS}))
def walk_pillars(spark, d):
    years = firm_years(spark, d)
    # of carbon the pillars take the revenue alone
    out = scores.walk_pillars(walk(spark, d, years), pillar_emissions(years), years)
    return rounded(out.select("firm_id", "year", "pillar_water", "pillar_waste", "pillar_energy", "walk_multi", "walk_n_pillars", "scope3_reported"))


# Talk from plain counts of pseudo-words in the documents: the dictionary is a parameter of the real measure.
GREEN_WORD, CLAIM_WORD = "tion", "here"
COUNTS = f"""select firm_id, year, accession, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) as n_words, len(regexp_extract_all(text, '{GREEN_WORD}')) as n_green,
    len(regexp_extract_all(text, '{CLAIM_WORD}')) as n_claim_all, len(regexp_extract_all(text, '{CLAIM_WORD} ')) as n_claim from reports"""
TALKFIRMS = "select 'F' || cast(k as varchar) as firm_id, 'S' || cast(k % 7 as varchar) as sector from range(50) t(k)"
INTENSITY = """select firm_id, year, count(distinct accession) as n_docs, sum(n_words)::bigint as n_words, 1000 * sum(n_claim)::double / sum(n_words)::double as claim_per_1000, 1000 * sum(n_green)::double / sum(n_words)::double as green_per_1000,
    case when sum(n_claim_all) > 0 then 1 - sum(n_claim)::double / sum(n_claim_all)::double end as risk_context_share from counts where n_words > 0 group by 1, 2"""
TALK = f"""select *, {sql_score('claim_per_1000', 'year', 'rank_group')} as talk, {sql_score('claim_per_1000', 'year')} as talk_universe, {sql_score('green_per_1000', 'year', 'rank_group')} as talk_unfiltered
    from (select i.*, sector, case when count(*) over (partition by year, sector) >= 5 then sector else '_all' end as rank_group from intensity i join talkfirms using (firm_id))"""
TALK_CTES = {"counts": COUNTS, "talkfirms": TALKFIRMS, "intensity": INTENSITY, "talk": TALK}


def document_counts(spark, d) -> DataFrame:
    r = bridge.documents(spark, d)
    return r.select(
        "firm_id", "year", "accession", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long").alias("n_words"), F.regexp_count("text", F.lit(GREEN_WORD)).cast("long").alias("n_green"),
        F.regexp_count("text", F.lit(CLAIM_WORD)).cast("long").alias("n_claim_all"), F.regexp_count("text", F.lit(CLAIM_WORD + " ")).cast("long").alias("n_claim"),
    )


def talk_firms(spark, d) -> DataFrame:
    """The firms that the documents belong to, with an industry."""
    ids = bridge.documents(spark, d).select("firm_id").distinct()
    return ids.withColumn("sector", F.concat(F.lit("S"), (F.substring("firm_id", 2, 9).cast("long") % 7).cast("string")))


def talk(spark, d) -> DataFrame:
    return scores.talk_score(scores.firm_year_intensity(document_counts(spark, d)), talk_firms(spark, d))


@query(bridge.sql(sql_round("select * from intensity", ["firm_id", "year", "n_docs", "n_words", "claim_per_1000", "green_per_1000", "risk_context_share"], ["claim_per_1000", "green_per_1000", "risk_context_share"]), "reports", **TALK_CTES))
def firm_year_intensity(spark, d):
    return rounded(scores.firm_year_intensity(document_counts(spark, d)).select("firm_id", "year", "n_docs", "n_words", "claim_per_1000", "green_per_1000", "risk_context_share"))


@query(bridge.sql(sql_round("select * from talk", ["firm_id", "year", "sector", "rank_group", "talk", "talk_universe", "talk_unfiltered"], ["talk", "talk_universe", "talk_unfiltered"]), "reports", **TALK_CTES))
def talk_score(spark, d):
    return rounded(talk(spark, d).select("firm_id", "year", "sector", "rank_group", "talk", "talk_universe", "talk_unfiltered"))


# Walk of the firms with documents: a customer's walk under the firm's name.
PAIRED = "select 'F' || cast(cast(firm_id as bigint) % 50 as varchar) as firm_id, cast(2020 + year % 4 as integer) as year, avg(intensity) as intensity, round(avg(walk), 9) as walk from walk group by 1, 2"
WASH = """select t.firm_id, t.year, talk, talk_unfiltered, walk, talk - walk as gap, (coalesce(talk >= 8 and walk <= 10 / 3::double, false))::int as greenwasher, (coalesce(talk <= 2 and walk >= 20 / 3::double, false))::int as greenhusher
    from talk t join paired using (firm_id, year)"""
WASH_CTES = WALK_CTES | TALK_CTES | {"paired": PAIRED, "wash": WASH}


def all_sql(select: str, ctes: dict[str, str]) -> str:
    return bridge.sql(select, "firms", "firm_years", "reports", **ctes)


def paired_walk(spark, d) -> DataFrame:
    firm = F.concat(F.lit("F"), (F.col("firm_id").cast("long") % 50).cast("string"))
    w = walk(spark, d).groupBy(firm.alias("firm_id"), (2020 + F.col("year") % 4).cast("int").alias("year"))
    return w.agg(F.avg("intensity").alias("intensity"), F.round(F.avg("walk"), 9).alias("walk"))


@query(all_sql(sql_round("select * from wash", ["firm_id", "year", "talk", "walk", "gap", "greenwasher", "greenhusher"], ["talk", "walk", "gap"]), WASH_CTES))
def greenwashing_table(spark, d):
    return rounded(scores.greenwashing_table(talk(spark, d), paired_walk(spark, d)).select("firm_id", "year", "talk", "walk", "gap", "greenwasher", "greenhusher"))


@query(all_sql(f"""select year, count(*) as n, round(corr(rt, rw), 6) as spearman_talk, round(corr(ru, rw), 6) as spearman_talk_unfiltered, sum(greenwasher)::bigint as greenwashers, sum(greenhusher)::bigint as greenhushers from (
    select *, {sql_rank('talk', 'year')} as rt, {sql_rank('talk_unfiltered', 'year')} as ru, {sql_rank('walk', 'year')} as rw from wash) group by year""", WASH_CTES))
def greenwashing_diagnostics(spark, d):
    return rounded(scores.diagnostics(scores.greenwashing_table(talk(spark, d), paired_walk(spark, d))))


_GAPS = ["firm_id", "year", "gap_raw", "gap_z", "gap_resid", "talk_rank", "walk_rank", "greenwasher"]


@query(all_sql(sql_round(f"""select *, (coalesce(talk_rank >= 0.8::double and walk_rank <= 1 / 3::double, false))::int as greenwasher from (
    select firm_id, year, talk - walk as gap_raw, {sql_z('talk', 'year', 'sector')} - {sql_z('walk', 'year', 'sector')} as gap_z,
        case when count(*) over g >= 3 and stddev_samp(walk) over g > 0 then talk - (regr_intercept(talk, walk) over g + regr_slope(talk, walk) over g * walk) end as gap_resid,
        {sql_rank('talk', 'year')} / count(talk) over (partition by year) as talk_rank, {sql_rank('walk', 'year')} / count(walk) over (partition by year) as walk_rank
    from wash join talkfirms using (firm_id) window g as (partition by year, sector))""", _GAPS, _GAPS[2:7]), WASH_CTES))
def gap_variants(spark, d):
    both = scores.greenwashing_table(talk(spark, d), paired_walk(spark, d)).select("firm_id", "year", "talk", "walk")
    return rounded(scores.gap_variants(both, talk_firms(spark, d)).select(*_GAPS))


MODEL = "select firm_id, year, ((sum(n_green) * 7 + year) % 101)::double / 10 as talk from counts where (substring(firm_id, 2)::bigint + year) % 3 = 0 group by firm_id, year"
COMBINED = f"""select *, {sql_score('talk_combined_z', 'year', 'rank_group')} as talk_combined from (select *, round((coalesce(talk_dict_z, 0) + coalesce(talk_llm_z, 0)) / nullif((talk_dict_z is not null)::int + (talk_llm_z is not null)::int, 0), 9) as talk_combined_z,
    (talk_dict_z is not null)::int + (talk_llm_z is not null)::int as n_sources,
    case when talk_dict_z is not null and talk_llm_z is not null then 'both' when talk_dict_z is not null then 'dict' when talk_llm_z is not null then 'llm' else 'none' end as talk_source from (
    select *, {sql_z('talk_dict', 'year', 'rank_group')} as talk_dict_z, {sql_z('talk_llm', 'year')} as talk_llm_z from (
        select firm_id, year, sector, t.talk as talk_dict, m.talk as talk_llm, case when count(*) over (partition by year, sector) >= 5 then sector else '_all' end as rank_group
        from talk t full join model m using (firm_id, year) join talkfirms f using (firm_id))))"""


def model_talk(spark, d) -> DataFrame:
    """Talk scores of another scorer for a third of the firm-years."""
    c = document_counts(spark, d).filter((F.substring("firm_id", 2, 9).cast("long") + F.col("year")) % 3 == 0)
    return c.groupBy("firm_id", "year").agg(F.sum("n_green").alias("s")).select("firm_id", "year", (((F.col("s") * 7 + F.col("year")) % 101).cast("double") / 10).alias("talk"))


@query(all_sql(sql_round("select * from greenwashed", ["firm_id", "year", "gap_dict", "gap_llm", "greenwasher_dict", "greenwasher_llm", "talk_source"], ["gap_dict", "gap_llm"]), WASH_CTES | {
    "model": MODEL, "combined": COMBINED.replace("from talk t full", "from (select firm_id, year, talk from talk) t full"),
    "greenwashed": """select c.firm_id, c.year, talk_dict - walk as gap_dict, talk_llm - walk as gap_llm, case when talk_dict is not null then (coalesce(talk_dict >= 8 and walk <= 10 / 3::double, false))::int end as greenwasher_dict,
        case when talk_llm is not null then (coalesce(talk_llm >= 8 and walk <= 10 / 3::double, false))::int end as greenwasher_llm, talk_source from combined c join paired using (firm_id, year)"""}))
def greenwashing_variants(spark, d):
    firms = talk_firms(spark, d)
    combined = scores.combine_talk(talk(spark, d), model_talk(spark, d), firms)
    out = scores.greenwashing_variants(combined, scores.with_firm(paired_walk(spark, d), firms, "sector"))
    return rounded(out.select("firm_id", "year", "gap_dict", "gap_llm", "greenwasher_dict", "greenwasher_llm", "talk_source"))


@query(with_ctes(sql_round("select firm_id, year, greatest(0, least(10, (coalesce(walk * 0.5::double, 0) + coalesce(walk_intensity_trend * 0.4::double, 0) + coalesce((10 - walk_emission_trend) * 0.1::double, 0)) / (case when walk is null then 0 else 0.5::double end + case when walk_intensity_trend is null then 0 else 0.4::double end + case when walk_emission_trend is null then 0 else 0.1::double end))) as e_score from walk",
       ["firm_id", "year", "e_score"], ["e_score"]), WALK_CTES))
def custom_score(spark, d):
    w = walk(spark, d)
    pillars = w.select("firm_id", "year", F.col("walk").alias("carbon"), F.col("walk_intensity_trend").alias("walk"), F.col("walk_emission_trend").alias("gap"))
    return rounded(scores.combine_pillars(pillars, w.select("firm_id", "year", F.lit(1.0).alias("e_weight"))).select("firm_id", "year", "e_score"))


@query(bridge.sql("select firm_id, year, round(coalesce(scope1, 0) + coalesce(scope2, 0), 6) as scope12, matched, round(revenue, 6) as revenue, round(case when revenue > 0 then (scope1 + scope2) / revenue end, 6) as intensity from firm_years", "firm_years"))
def emissions_view(spark, d):
    v = scores.emissions_view(bridge.emissions(spark, d), bridge.fundamentals(spark, d))
    return v.select("firm_id", "year", F.round("scope12", 6).alias("scope12"), "matched", F.round("revenue", 6).alias("revenue"), F.round("intensity", 6).alias("intensity"))


@query(bridge.sql("""select firm_id, year, round(lead(a) over w - a, 6) + 0.0::double as d_log_scope1_next, round(lead(b) over w - b, 6) + 0.0::double as d_log_intensity_next
    from (select *, ln(1 + scope1) as a, ln(1 + case when revenue > 0 then scope1 / revenue end) as b from firm_years where matched) window w as (partition by firm_id order by year)""", "firm_years"))
def emission_outcomes(spark, d):
    return rounded(scores.emission_outcomes(bridge.emissions(spark, d), bridge.fundamentals(spark, d)).select("firm_id", "year", "d_log_scope1_next", "d_log_intensity_next"))


@query(bridge.sql("""select firm_id, year, cast(len(r) as integer) as n_years, array_to_string(list_transform(r, lambda x: cast(x.year as varchar) || ': ' || cast(cast(round_even(x.scope12, 0) as bigint) as varchar)), ', ') as scope12, array_to_string(list_transform(r, lambda x: cast(cast(round_even(x.revenue, 0) as bigint) as varchar)), ', ') as revenue,
    case when r[1].scope12 <> 0 then round_even(100 * (r[-1].scope12 - r[1].scope12) / r[1].scope12, 1) + 0.0::double end as scope12_change_pct, coalesce(list_aggregate(list_transform(r, lambda x: x.assured), 'bool_or'), false) as assured
    from (select a.firm_id, a.year, coalesce(list({'year': b.year, 'scope12': b.scope1 + b.scope2, 'revenue': b.revenue, 'assured': b.year % 2 = 0} order by b.year) filter (b.year is not null), []) [-4:] as r
        from firm_years a left join firm_years b on a.firm_id = b.firm_id and b.year <= a.year and b.matched group by 1, 2)""", "firm_years"))
def hard_data_block(spark, d):
    years, e = bridge.firm_years(spark, d), bridge.emissions(spark, d).withColumn("assured", F.col("year") % 2 == 0)
    block = scores.hard_data(e, bridge.fundamentals(spark, d), years)
    return block.select("firm_id", "year", "n_years", F.array_join(F.transform("series", lambda r: F.concat(r["year"].cast("string"), F.lit(": "), r["scope12"].cast("string"))), ", ").alias("scope12"), F.array_join(F.transform("series", lambda r: r["revenue"].cast("string")), ", ").alias("revenue"), (F.col("scope12_change_pct") + 0.0).alias("scope12_change_pct"), "assured")
