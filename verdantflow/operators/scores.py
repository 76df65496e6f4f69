"""Firm-year score tables: carbon, walk, greenness, talk, gaps and flags.

All are windows and equi-joins on (firm_id, year). A table of firms has one row for each firm where the
reports say so; ``one_per_firm`` picks it by an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.functions import numbers, ranks
from verdantflow.shared import written

WALK_WEIGHTS = {"intensity_level": 0.5, "intensity_trend": 0.3, "emission_trend": 0.2}
PILLARS = {"water": ("water_tonnes", True, False), "waste": ("waste_tonnes", True, False), "energy": ("renewable_share_pct", False, True)}
CUSTOM_WEIGHTS = {"carbon": 0.5, "walk": 0.4, "gap": -0.1}
HIGH_TALK, LOW_TALK, LOW_WALK, HIGH_WALK = 8.0, 2.0, 10 / 3, 20 / 3
FIRM_YEAR = ["firm_id", "year"]


def one_per_firm(firms: DataFrame, *columns: str) -> DataFrame:
    """``firm_id`` and ``columns``, the first row of each firm in the order of the columns."""
    order = Window.partitionBy("firm_id").orderBy(*columns)
    return firms.select("firm_id", *columns).withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")


def with_firm(df: DataFrame, firms: DataFrame, *columns: str) -> DataFrame:
    """Left join of firm attributes; columns that ``df`` has already stay as they are."""
    new = [c for c in columns if c not in df.columns]
    return df.join(one_per_firm(firms, *new), "firm_id", "left") if new else df


def log_change(x: Column, consecutive_years: bool = True) -> Column:
    """Change of ln(x > 0) since the firm's last row; null unless that row is of the year before."""
    w = Window.partitionBy("firm_id").orderBy("year")
    change = numbers.log_positive(x) - F.lag(numbers.log_positive(x)).over(w)
    return F.when(F.col("year") - F.lag("year").over(w) == 1, change) if consecutive_years else change


def carbon_intensity(emissions: DataFrame, fundamentals: DataFrame, scope: str = "scope1") -> DataFrame:
    """Emissions with revenue: level, intensity (level / positive revenue), their log1p, and the change of log1p level."""
    df = emissions.join(fundamentals.select(*FIRM_YEAR, "revenue"), FIRM_YEAR, "left").withColumn("level", F.col(scope))
    df = df.withColumn("intensity", numbers.ratio(F.col("level"), F.col("revenue")))
    w = Window.partitionBy("firm_id").orderBy("year")
    df = df.withColumns({"log_level": F.log1p("level"), "log_intensity": F.log1p("intensity")})
    return df.withColumn("d_log_level", F.col("log_level") - F.lag("log_level").over(w))


def walk_score(carbon: DataFrame, firms: DataFrame, weights: dict[str, float] | None = None, industry: str = "sector", min_group: int = 5) -> DataFrame:
    """``walk``: 0 to 10 by intensity within year and industry, lower is greener; trends and a weighted composite.

    Rows that aren't matched, or have no intensity, aren't scored. Industries of fewer than ``min_group``
    rows a year, and firms without one, are ranked among each other.
    """
    weights = weights or WALK_WEIGHTS
    df = with_firm(carbon.drop("d_log_level", "d_log_intensity").filter("matched and intensity is not null"), firms, industry)
    df = df.withColumns({"d_log_intensity": log_change(F.col("intensity")), "d_log_level": log_change(F.col("level"))})
    source = {"intensity_level": "intensity", "intensity_trend": "d_log_intensity", "emission_trend": "d_log_level"}
    parts = {f"walk_{c}": (source[c], False) for c in weights}
    df = written(ranks.with_pooled_group(written(df, "walk"), "rank_group", industry, min_group, "year"), "walk")
    df = ranks.with_scores(df, parts, "year", "rank_group")
    pairs = [(F.col(f"walk_{c}"), w) for c, w in weights.items()]
    df = df.withColumns({"walk_n_components": numbers.present(*(c for c, _ in pairs)), "walk_composite": numbers.weighted_available_mean(pairs), "walk": F.col("walk_intensity_level")})
    return df.select(*FIRM_YEAR, industry, "rank_group", "level", "intensity", "d_log_intensity", "d_log_level", *parts, "walk_n_components", "walk_composite", "walk")


def walk_pillars(walk: DataFrame, emissions: DataFrame, carbon: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Water, waste and energy pillars beside carbon; a pillar that a firm doesn't report is left out of the mean."""
    weights = weights or {"carbon": 1.0, **dict.fromkeys(PILLARS, 1.0)}
    there = [c for c, *_ in PILLARS.values() if c in emissions.columns] + (["scope3"] if "scope3" in emissions.columns else [])
    df = walk.join(emissions.select(*FIRM_YEAR, *there), FIRM_YEAR, "left").join(carbon.select(*FIRM_YEAR, "revenue"), FIRM_YEAR, "left")
    df = df.withColumn("pillar_carbon", F.col("walk"))
    for name, (column, per_revenue, better) in PILLARS.items():
        x = F.col(column) if column in there else F.lit(None).cast("double")
        df = df.withColumn(f"{name}_metric", numbers.ratio(x, F.col("revenue")) if per_revenue else x)
    df = ranks.with_scores(written(df, "pillars"), {f"pillar_{name}": (f"{name}_metric", better) for name, (_, _, better) in PILLARS.items()}, "year", "rank_group")
    pairs = [(F.col(f"pillar_{p}"), w) for p, w in weights.items()]
    reported = F.coalesce(F.col("scope3") > 0, F.lit(False)) if "scope3" in there else F.lit(False)
    return df.withColumns({"walk_multi": numbers.weighted_available_mean(pairs), "walk_n_pillars": numbers.present(*(c for c, _ in pairs)), "scope3_reported": reported}).drop("revenue")


def industry_weight(df: DataFrame, emissions: str = "level", industry: str = "industry_grp", low: float = 5.0, high: float = 50.0) -> DataFrame:
    """``year, industry, e_weight``: aggregate intensity of an industry, its percentile rank in the year mapped to a range."""
    total = df.filter(F.col(industry).isNotNull()).groupBy("year", industry).agg(F.sum(emissions).alias("em"), F.sum("revenue").alias("rev"))
    total = total.withColumn("industry_intensity", numbers.ratio(F.col("em"), F.col("rev")))
    return total.withColumn("e_weight", low + (high - low) * ranks.percent_rank(F.col("industry_intensity"), "year")).select("year", industry, "e_weight")


def scores_from_walk(walk: DataFrame, industry: str = "sector", provider: str = "walk_hard") -> DataFrame:
    """``firm_id, year, provider, e_score, e_weight``; revenue is level / intensity, else its group's median."""
    df = walk.filter(F.col("walk").isNotNull() & F.col(industry).isNotNull()).withColumn("industry_grp", F.col(industry))
    df = written(df.withColumn("_revenue", numbers.ratio(F.col("level"), F.col("intensity"))), "revenue")
    df = ranks.with_medians_filled(df, {"revenue": "_revenue"}, "year", "industry_grp")
    weight = industry_weight(df)
    return df.join(weight, ["year", "industry_grp"], "left").select(*FIRM_YEAR, F.lit(provider).alias("provider"), F.col("walk").alias("e_score"), "e_weight")


def greenness_table(scores: DataFrame, firms: DataFrame, industry: str = "sector") -> DataFrame:
    """g = -(10 - E) * weight / 100 with its mean across the industry and the rest within it."""
    df = with_firm(scores.withColumn("g", numbers.greenness(F.col("e_score"), F.col("e_weight"))), firms, industry)
    across, within = ranks.group_mean_and_deviation(F.col("g"), "year", industry)
    return df.select(*FIRM_YEAR, "provider", "e_score", "e_weight", "g", across.alias("g_across"), within.alias("g_within"))


def sector_means(green: DataFrame, firms: DataFrame, industry: str = "sector") -> DataFrame:
    """Mean greenness of each industry; firms without one are left out."""
    df = with_firm(green, firms, industry).filter(F.col(industry).isNotNull())
    return df.groupBy(industry).agg(F.avg("g").alias("g_mean"), F.avg("g_across").alias("g_across_mean"), F.count("*").alias("n"))


def firm_year_intensity(counts: DataFrame) -> DataFrame:
    """Documents pooled to firm-years: distinct documents, summed counts and rates per 1,000 words; no words, no row."""
    extra = [c for c in ("env_sentiment", "forward_looking_share", "glossiness") if c in counts.columns]
    words = F.sum("n_words")
    return (
        counts.filter("n_words > 0")
        .groupBy(*FIRM_YEAR)
        .agg(
            F.count_distinct("accession").alias("n_docs"), words.alias("n_words"), *(F.sum(c).alias(c) for c in ("n_green", "n_claim_all", "n_claim")),
            *((F.sum(F.col(c) * F.col("n_words")) / words).alias(c) for c in extra),
        )
        .withColumns(
            {
                "claim_per_1000": 1000 * F.col("n_claim") / F.col("n_words"),
                "green_per_1000": 1000 * F.col("n_green") / F.col("n_words"),
                "risk_context_share": F.when(F.col("n_claim_all") > 0, 1 - F.col("n_claim") / F.col("n_claim_all")),
            }
        )
    )


def talk_score(intensity: DataFrame, firms: DataFrame, industry: str = "sector", min_group: int = 5) -> DataFrame:
    """``talk`` (claim rate within year and industry), ``talk_universe`` (within the year), ``talk_unfiltered`` (all terms)."""
    df = written(with_firm(intensity, firms, industry), "talk")
    df = written(ranks.with_pooled_group(df, "rank_group", industry, min_group, "year"), "talk")
    df = ranks.with_scores(df, {"talk": ("claim_per_1000", True), "talk_unfiltered": ("green_per_1000", True)}, "year", "rank_group")
    return ranks.with_scores(df, {"talk_universe": ("claim_per_1000", True)}, "year")


def _flag(condition: Column) -> Column:
    """1 or 0; 0 too where a score is missing."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def greenwashing_table(talk: DataFrame, walk: DataFrame) -> DataFrame:
    """Firm-years with both scores: gap, and flags for much talk with little walk and the reverse."""
    df = talk.select(*FIRM_YEAR, "talk", *[c for c in ("talk_unfiltered",) if c in talk.columns]).join(walk.select(*FIRM_YEAR, "walk"), FIRM_YEAR)
    t, w = F.col("talk"), F.col("walk")
    return df.withColumns({"gap": t - w, "greenwasher": _flag((t >= HIGH_TALK) & (w <= LOW_WALK)), "greenhusher": _flag((t <= LOW_TALK) & (w >= HIGH_WALK))})


def diagnostics(table: DataFrame) -> DataFrame:
    """For each year: rows, rank correlations of talk and of unfiltered talk with walk, and flag counts."""

    pairs = ("talk", "talk_unfiltered")
    known = {f"_{x}_{k}": F.when(F.col(x).isNotNull() & F.col("walk").isNotNull(), F.col(c)) for x in pairs for k, c in enumerate((x, "walk"))}
    df = written(table.select("year", "greenwasher", "greenhusher", *(c.alias(n) for n, c in known.items())), "pairs")
    df = ranks.with_ranks(df, {f"{n}_rank": n for n in known}, "year")
    return df.groupBy("year").agg(
        F.count("*").alias("n"), *(F.corr(f"_{x}_0_rank", f"_{x}_1_rank").alias(f"spearman_{x}") for x in pairs), F.sum("greenwasher").alias("greenwashers"), F.sum("greenhusher").alias("greenhushers")
    )


def with_residual(df: DataFrame, name: str, y: str, x: str, *group: str) -> DataFrame:
    """``df`` with the residual of the line of y on x in each group; null below three complete rows or without spread in x."""
    known = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(known, F.col(y)), F.when(known, F.col(x))
    lines = df.groupBy(*group).agg(F.regr_slope(a, b).alias("_slope"), F.regr_intercept(a, b).alias("_intercept"), ((F.count(a) >= 3) & (F.stddev_samp(b) > 0)).alias("_enough"))
    found = ranks.join_back(df, lines, *group)
    return found.withColumn(name, F.when(known & F.col("_enough"), F.col(y) - (F.col("_intercept") + F.col("_slope") * F.col(x)))).drop("_slope", "_intercept", "_enough")


def gap_variants(firm_year: DataFrame, firms: DataFrame, industry: str = "sector", talk_cut: float = 0.8, walk_cut: float = 1 / 3) -> DataFrame:
    """Raw, standardised and residual gaps, ranks within the year, and the flag of high talk with low walk."""
    df = written(with_firm(firm_year, firms, industry), "gaps")
    df = ranks.with_percent_ranks(df, {"talk_rank": "talk", "walk_rank": "walk"}, "year")
    df = ranks.with_z_scores(df, {"talk_z": "talk", "walk_z": "walk"}, "year", industry)
    df = with_residual(df, "gap_resid", "talk", "walk", "year", industry)
    df = df.withColumns({"gap_raw": F.col("talk") - F.col("walk"), "gap_z": F.col("talk_z") - F.col("walk_z")})
    return df.withColumn("greenwasher", _flag((F.col("talk_rank") >= talk_cut) & (F.col("walk_rank") <= walk_cut)))


def combine_talk(dictionary: DataFrame, model: DataFrame | None, firms: DataFrame, industry: str = "sector", min_group: int = 5) -> DataFrame:
    """Dictionary talk and model talk of a firm-year as one: the mean of the z-scores that exist, scored again."""
    extra = [c for c in ("claim_per_1000", "risk_context_share") if c in dictionary.columns]
    d = dictionary.select(*FIRM_YEAR, F.col("talk").alias("talk_dict"), *extra)
    m = model.select(*FIRM_YEAR, F.col("talk").alias("talk_llm")) if model is not None else d.select(*FIRM_YEAR, F.lit(None).cast("double").alias("talk_llm")).limit(0)
    df = written(with_firm(d.join(m, FIRM_YEAR, "full"), firms, industry), "talk")
    df = written(ranks.with_pooled_group(df, "rank_group", industry, min_group, "year"), "talk")
    df = ranks.with_z_scores(ranks.with_z_scores(df, {"talk_dict_z": "talk_dict"}, "year", "rank_group"), {"talk_llm_z": "talk_llm"}, "year")
    z = [(F.col("talk_dict_z"), 1.0), (F.col("talk_llm_z"), 1.0)]
    has_d, has_m = (c.isNotNull() for c, _ in z)
    source = F.when(has_d & has_m, "both").when(has_d, "dict").when(has_m, "llm").otherwise("none")
    df = df.withColumns({"talk_combined_z": numbers.weighted_available_mean(z), "n_sources": numbers.present(*(c for c, _ in z)), "talk_source": source})
    return ranks.with_scores(written(df, "combined"), {"talk_combined": ("talk_combined_z", True)}, "year", "rank_group")


def greenwashing_variants(combined: DataFrame, walk: DataFrame, industry: str = "sector") -> DataFrame:
    """Gap and flag for each kind of talk; a flag is null where that talk wasn't measured."""
    df = walk.select(*FIRM_YEAR, industry, "intensity", "walk").join(combined.drop(industry, "rank_group"), FIRM_YEAR)
    for kind in ("dict", "llm", "combined"):
        t = F.col(f"talk_{kind}")
        df = df.withColumns({f"gap_{kind}": t - F.col("walk"), f"greenwasher_{kind}": F.when(t.isNotNull(), _flag((t >= HIGH_TALK) & (F.col("walk") <= LOW_WALK)))})
    return df


def combine_pillars(pillars: DataFrame, e_weight: DataFrame, weights: dict[str, float] | None = None, provider: str = "custom") -> DataFrame:
    """Custom E score from pillars of 0 to 10; a pillar of negative weight counts turned round."""
    weights = weights or CUSTOM_WEIGHTS
    if not any(w > 0 for w in weights.values()):
        raise ValueError("at least one pillar needs a positive weight")
    there = {c: w for c, w in weights.items() if c in pillars.columns}
    if not there:
        raise ValueError(f"none of the pillars {', '.join(weights)} is a column")
    score = numbers.weighted_available_mean([(numbers.signed_score(F.col(c), w), w) for c, w in there.items()])
    df = pillars.select(*FIRM_YEAR, F.lit(provider).alias("provider"), numbers.clip(score, 0.0, 10.0).alias("e_score"))
    return df.join(e_weight.select(*FIRM_YEAR, "e_weight"), FIRM_YEAR, "left")


def weighted_firm_year(scores: DataFrame, columns: list[str], form_weights: dict[str, float] | None = None) -> DataFrame:
    """Document scores to firm-years, weighted by relevance (0.5 at least) and form; a null counts as 0."""
    form = F.lit(1.0)
    for name, w in (form_weights or {}).items():
        form = F.when(F.col("form") == name, float(w)).otherwise(form)
    df = scores.filter("not skipped").withColumns({"year": F.year("period"), "_w": F.greatest(F.col("climate_relevance"), F.lit(0.5)) * form})
    return df.groupBy(*FIRM_YEAR).agg(*((F.coalesce(F.sum(F.col(c) * F.col("_w")), F.lit(0.0)) / F.sum("_w")).alias(c) for c in columns), F.count("*").alias("n_docs"))


def emissions_view(emissions: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Emissions for display: scope 1 and 2 added with nulls as 0, revenue and intensity; matched unless told otherwise."""
    total = F.coalesce("scope1", F.lit(0.0)) + F.coalesce("scope2", F.lit(0.0))
    matched = F.coalesce(F.col("matched"), F.lit(True)) if "matched" in emissions.columns else F.lit(True)
    df = emissions.join(fundamentals.select(*FIRM_YEAR, "revenue"), FIRM_YEAR, "left").withColumns({"scope12": total, "matched": matched})
    return df.withColumn("intensity", numbers.ratio(F.col("scope12"), F.col("revenue")))


def emission_outcomes(emissions: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Logs of scope 1, intensity and revenue of matched rows, and their change to the firm's next row."""
    df = emissions.filter("matched").join(fundamentals.select(*FIRM_YEAR, "revenue"), FIRM_YEAR, "left")
    df = df.withColumns({"log_scope1": F.log1p("scope1"), "log_intensity": F.log1p(numbers.ratio(F.col("scope1"), F.col("revenue"))), "log_revenue": F.log1p("revenue")})
    w = Window.partitionBy("firm_id").orderBy("year")
    return df.select(*FIRM_YEAR, "log_scope1", "log_intensity", "log_revenue", *((F.lead(c).over(w) - F.col(c)).alias(f"d_{c}_next") for c in ("log_scope1", "log_intensity")))


def hard_data(emissions: DataFrame, fundamentals: DataFrame, years: DataFrame, reach: int = 4) -> DataFrame:
    """For each firm-year of ``years`` the firm's last ``reach`` matched rows up to that year: ``n_years, scope12, series,
    scope12_change_pct, assured``.

    ``scope12`` holds whole tonnes; ``series`` has ``year, scope12, revenue`` for each row, rounded, and ``assured``
    tells whether a third party assured any of them (false without such a column). A firm's years are few, so
    they are looked up in an array of the firm and nothing is ranged over.
    """
    emissions = emissions if "assured" in emissions.columns else emissions.withColumn("assured", F.lit(False))
    e = emissions.filter("matched").join(fundamentals.select(*FIRM_YEAR, "revenue"), FIRM_YEAR, "left")
    total = F.coalesce("scope1", F.lit(0.0)) + F.coalesce("scope2", F.lit(0.0))
    firm = e.groupBy("firm_id").agg(F.array_sort(F.collect_list(F.struct("year", total.alias("scope12"), "revenue", F.coalesce("assured", F.lit(False)).alias("assured")))).alias("rows"))
    df = years.select(*FIRM_YEAR).distinct().join(firm, "firm_id", "left")
    known = F.filter("rows", lambda r: r["year"] <= F.col("year"))
    df = df.withColumn("rows", F.coalesce(known, F.array().cast("array<struct<year:int,scope12:double,revenue:double,assured:boolean>>")))
    df = df.withColumn("rows", F.slice("rows", F.greatest(F.size("rows") - (reach - 1), F.lit(1)), reach))
    first, last = F.try_element_at("rows", F.lit(1))["scope12"], F.try_element_at("rows", F.lit(-1))["scope12"]
    change = F.when(first != 0, F.bround(100 * (last - first) / first, 1))
    whole = lambda x: F.bround(x).cast("long")
    series = F.transform("rows", lambda r: F.struct(r["year"].alias("year"), whole(r["scope12"]).alias("scope12"), whole(r["revenue"]).alias("revenue")))
    return df.select(*FIRM_YEAR, F.size("rows").alias("n_years"), F.transform("rows", lambda r: whole(r["scope12"])).alias("scope12"), series.alias("series"), change.alias("scope12_change_pct"), F.exists("rows", lambda r: r["assured"]).alias("assured"))
