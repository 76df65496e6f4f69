"""Filters, searches, picks and joins over universes of firms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.functions import dictionaries as words
from verdantflow.functions import numbers, ranks, text
from verdantflow.operators.documents import first_of

SIZES = {"small": (0.0, 1 / 3), "mid": (1 / 3, 2 / 3), "large": (2 / 3, 1.0)}
#: Values of a screen that are broadcast, more of them are joined by a shuffle.
MOST_VALUES = 100_000


@dataclass(frozen=True)
class Preference:
    """Lists are alternatives within a dimension; dimensions must all hold; exclusions win."""

    include: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exclude: dict[str, tuple[str, ...]] = field(default_factory=dict)
    sizes: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()


def preferred(universe: DataFrame, wish: Preference, caps: DataFrame) -> DataFrame:
    """``firm_id`` of the firms that a preference keeps; sizes are terciles of the whole universe's latest cap."""
    df = first_of(universe, ["firm_id"], ["name"]).join(caps.select("firm_id", "mktcap"), "firm_id", "left")
    df = ranks.with_ranks(df, {"_rank": "mktcap"}).withColumn("share", F.col("_rank") / F.col("_rank_n"))

    def named(keys) -> Column:
        return sum((F.contains(F.lower("name"), F.lit(k.lower())).cast("int") for k in keys), F.lit(0)) > 0

    keep = F.lit(True)
    for c, values in wish.include.items():
        keep &= F.coalesce(F.col(c).isin(*values), F.lit(False))
    for c, values in wish.exclude.items():
        keep &= ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    if wish.sizes:
        fits = F.lit(False)
        for s in wish.sizes:
            low, high = SIZES[s]
            fits |= (F.col("share") > low) & (F.col("share") <= high)
        keep &= F.coalesce(fits, F.lit(False))
    if wish.keywords:
        keep &= F.coalesce(named(wish.keywords), F.lit(False))
    if wish.exclude_keywords:
        keep &= ~F.coalesce(named(wish.exclude_keywords), F.lit(False))
    return df.filter(keep).select("firm_id")


def known_values(requested: DataFrame, universe: DataFrame, column: str) -> DataFrame:
    """Requested values (``value``) that the universe has."""
    return requested.join(universe.select(F.col(column).alias("value")).distinct(), "value", "left_semi")


def keyword_screen(requests: DataFrame, values: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """``request_id, dimension, value, negated`` for each value that a free text names by whole words.

    ``values``: the distinct values of a universe by dimension. A value is negated if the words before it say so. Words of the text
    meet first words of the values by a hash join, and whole values are checked after. Up to ``most`` values (counted first) are
    broadcast; more are met by a shuffle of words without their texts. Texts, which the planner takes for no larger than
    their files, are never broadcast.
    """

    def split(c: str) -> Column:
        return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def padded(c: str) -> Column:
        return F.concat(F.lit(" "), F.array_join(split(c), " "), F.lit(" "))

    word = F.explode(F.array_distinct(split("text"))).alias("word")
    named = values.select("dimension", "value", padded("value").alias("v"), F.try_element_at(split("value"), F.lit(1)).alias("word")).filter("word is not null")
    if named.limit(most + 1).count() <= most:
        met = requests.select("request_id", "text", word).join(F.broadcast(named), "word")
    else:
        ids = requests.select("request_id", word).distinct().join(named.hint("merge"), "word").drop("word")
        texts = requests.select(F.col("request_id").alias("_id"), "text").filter("text is not null")
        met = ids.join(texts.hint("merge"), F.col("request_id").eqNullSafe(F.col("_id"))).drop("_id")
    found = met.withColumn("p", padded("text")).filter(F.contains("p", F.col("v")))
    before = F.expr("substring(p, 1, instr(p, v) - 1)")
    return found.select("request_id", "dimension", "value", before.rlike(r"\b(no|not|without|avoid|exclude|excluding)( \w+)?$").alias("negated")).distinct()


def industry_tree(universe: DataFrame) -> DataFrame:
    """``sector, n, industries array<struct>`` over distinct firms, nulls left out, sorted."""
    df = first_of(universe, ["firm_id"], ["name"]).filter("sector is not null and industry is not null")
    counts = df.groupBy("sector", "industry").agg(F.count("*").alias("n"))
    return counts.groupBy("sector").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("industry", "n"))).alias("industries"))


def search(universe: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Firms whose id or name contains the text, in order of the id."""
    found = F.contains(F.lower("firm_id"), F.lit(q.lower())) | F.contains(F.lower("name"), F.lit(q.lower()))
    return universe.filter(found).orderBy("firm_id").limit(limit)


def search_all_words(universe: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """Firms whose columns together contain every word."""
    text, keep = F.lower(F.concat_ws(" ", *columns)), F.lit(True)
    for w in q.lower().split():
        keep &= F.contains(text, F.lit(w))
    return universe.filter(keep)


def market_of(firm_id: Column) -> Column:
    return F.when(F.upper(firm_id).endswith(".TW") | F.upper(firm_id).endswith(".TWO"), "tw").otherwise("hk")


def listing(ticker: Column) -> dict[str, Column]:
    """``exchange, market, currency, proxy`` by the end of a ticker; ``Unknown`` and nulls for any other."""
    out = {}
    for k, name in enumerate(("exchange", "market", "currency", "proxy")):
        value = F.lit(None).cast("string") if k else F.lit("Unknown")
        for end, row in words.LISTINGS.items():
            value = F.when(F.upper(ticker).endswith(end), row[k]).otherwise(value)
        out[name] = F.when(ticker.isNotNull(), value).otherwise(F.lit(None) if k else F.lit("Unknown"))
    return out


def region_of(domicile: Column, market: Column, scope: tuple[str, ...], defaults: dict[str, str]) -> Column:
    """The domicile if it is in scope, else the region of the market."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.when(domicile.isin(*scope), domicile).otherwise(F.try_element_at(known, market))


def latest_year(df: DataFrame, provider: str | None = None) -> DataFrame:
    """Rows of the last year, of one provider (the first by name unless told)."""
    df = df.join(F.broadcast(df.agg(F.max("year").alias("year"))), "year")
    return df.filter(F.col("provider") == provider) if provider else df.join(F.broadcast(df.agg(F.min("provider").alias("provider"))), "provider")


def with_flags(universe: DataFrame, **tables: DataFrame) -> DataFrame:
    """A boolean ``has_<name>`` for each table: whether the firm is in it."""
    for name, df in tables.items():
        universe = universe.join(df.select("firm_id").distinct().withColumn(f"has_{name}", F.lit(True)), "firm_id", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return universe


def replace_firms(old: DataFrame, new: DataFrame, key: str = "firm_id") -> DataFrame:
    """Old rows of the firms that have no new ones, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(rows: DataFrame, *done: DataFrame, key: str = "url") -> DataFrame:
    for d in done:
        rows = rows.join(d.select(key).distinct(), key, "left_anti")
    return rows


def next_year(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of the firm's next calendar year as ``<column>_next``."""
    ahead = df.select("firm_id", (F.col("year") - 1).alias("year"), *(F.col(c).alias(f"{c}_next") for c in columns))
    return df.join(ahead, ["firm_id", "year"], "left")


def first_market_wins(*universes: DataFrame) -> DataFrame:
    """Universes by name, a firm of several kept where it comes first."""
    out = None
    for place, df in enumerate(universes):
        df = df.withColumn("_p", F.lit(place))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_of(out, ["firm_id"], ["_p"]).drop("_p")


def latest_per_firm(df: DataFrame, order: str = "year") -> DataFrame:
    return first_of(df, ["firm_id"], [F.desc_nulls_last(order)])


def company_view(washing: DataFrame, green: DataFrame, walk: DataFrame, universe: DataFrame) -> DataFrame:
    """Firm-years of both score tables, walk filled in from its own table, with the firm's attributes and a note."""
    keys = ["firm_id", "year"]
    df = washing.join(green, keys, "full").join(walk.select(*keys, F.col("walk").alias("_walk")), keys, "left").withColumn("walk", F.coalesce("walk", "_walk")).drop("_walk")
    df = df.join(first_of(universe, ["firm_id"], ["name"]).select("firm_id", "name", "sector"), "firm_id", "left")
    gap = F.col("talk") - F.col("walk")
    note = F.when(F.col("greenwasher") == 1, "talks more than it does").when(gap > 3, "more talk than walk").when(gap < -2, "does more than it says").otherwise("in line")
    status = F.when(F.col("talk").isNotNull() & F.col("walk").isNotNull(), "assessed").when(F.col("walk").isNotNull(), "walk only").when(F.col("talk").isNotNull(), "talk only").otherwise("none")
    return df.withColumns({"note": note, "status": status, "market": market_of(F.col("firm_id"))})


def company_records(view: DataFrame) -> DataFrame:
    """A record for each firm of :func:`company_view`, its last year: id, initials, listing, scores of one decimal, gap, status.

    A gap is talk less walk where none is told; flags count only where both are told and talk and walk are
    known (``assessed``). ``ticker`` and ``e_weight`` (30 unless told) are optional columns.
    """
    df = latest_per_firm(view)
    for c, kind in (("ticker", "string"), ("e_weight", "double"), ("e_score", "double"), ("gap", "double"), ("greenwasher", "int"), ("greenhusher", "int")):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast(kind))
    ticker = F.coalesce(F.nullif(F.trim("ticker"), F.lit("")), F.col("firm_id"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("firm_id"))
    flags = {c: numbers.flag_or_null(F.col(c)) for c in ("greenwasher", "greenhusher")}
    sound = flags["greenwasher"].isNotNull() & flags["greenhusher"].isNotNull() & F.col("talk").isNotNull() & F.col("walk").isNotNull()
    one = lambda c: F.round(c, 1)
    return df.select(
        "firm_id", F.replace(F.lower("firm_id"), F.lit("."), F.lit("-")).alias("id"), name.alias("name"), ticker.alias("ticker"), F.coalesce("sector", F.lit("General")).alias("sector"), text.initials(name, ticker).alias("initials"),
        *(c.alias(n) for n, c in listing(ticker).items()), one("e_score").alias("score"), F.coalesce(F.round("e_weight"), F.lit(30.0)).cast("long").alias("materiality"), one("walk").alias("walk"), one("talk").alias("talk"),
        F.coalesce(one("gap"), one(one("talk") - one("walk"))).alias("gap"), *(F.when(sound, c == 1).alias(n) for n, c in flags.items()), F.when(sound, "assessed").otherwise("insufficient_data").alias("assessment"),
    )


def shard(firms: DataFrame, n: int, i: int, order: str = "firm_id") -> DataFrame:
    """Firms ``i, i + n, i + 2 n ...`` (from 0) in order of ``order``, so shards are equal to one firm.

    Places come from counts of range partitions and places within them, so no task sees all firms.
    """
    return ranks.placed(firms, order).filter(F.pmod(F.col("_place"), F.lit(n)) == i).drop("_place")


def outlier_flags(df: DataFrame, y: str, x: str, *group: str, limit: float = 2.0) -> DataFrame:
    """Studentised residual of the line of y on x in each group, and whether it is beyond the limit."""
    w = Window.partitionBy(*group)
    known = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(known, F.col(y)), F.when(known, F.col(x))
    n, sxx = F.count(a).over(w), F.regr_sxx(a, b).over(w)
    df = df.withColumns({"beta": F.regr_slope(a, b).over(w), "intercept": F.regr_intercept(a, b).over(w), "corr": F.corr(a, b).over(w), "_n": n, "_sxx": sxx, "_mean": F.avg(b).over(w)})
    df = df.withColumn("_e", F.when(known, F.col(y) - F.col("intercept") - F.col("beta") * F.col(x)))
    df = df.withColumn("_s2", F.when(F.col("_n") > 2, F.sum(F.col("_e") ** 2).over(w) / (F.col("_n") - 2)))
    spread = F.col("_s2") * (1 - 1 / F.col("_n") - F.try_divide((F.col(x) - F.col("_mean")) ** 2, F.col("_sxx")))
    df = df.withColumn("student", F.when(spread > 1e-18, F.col("_e") / F.sqrt(spread)))
    return df.withColumn("outlier", F.coalesce(F.abs("student") > limit, F.lit(False))).drop("_n", "_sxx", "_mean", "_e", "_s2")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``bin, low, high, n`` of equal width, the maximum in the last bin, empty bins included."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / F.col("w")))
    counts = df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.filter("lo is not null").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def coverage(df: DataFrame, *by: str, **columns: str) -> DataFrame:
    """Counts of rows and of non-null values by group, with a total row."""
    return df.rollup(*by).agg(F.count("*").alias("n"), *(F.count(c).alias(name) for name, c in columns.items()))


def date_ranges(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table, first, last, n`` of a date column of each table."""
    out = None
    for name, (df, c) in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.min(F.col(c).cast("date")).alias("first"), F.max(F.col(c).cast("date")).alias("last"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def quote_firms(prices: DataFrame, universe: DataFrame, market: str, home: str = "hk", each: int = 3) -> DataFrame:
    """Firms to fetch closes for: all that have prices in the home market; elsewhere three a sector, by turns."""
    from verdantflow.operators.portfolio import round_robin

    priced = prices.select("firm_id").distinct()
    if market == home:
        return priced
    known = universe.join(prices.groupBy("firm_id").agg(F.count("ret").alias("n"), F.max_by("mktcap", "month").alias("mktcap")).filter("n >= 24"), "firm_id")
    n = each * known.select("sector").distinct().count()
    return round_robin(known, known, n)


def balanced_pool(home: DataFrame, added: DataFrame, caps: DataFrame) -> DataFrame:
    """All eligible home firms, and as many of the added market, picked by turns over its sectors."""
    from verdantflow.operators.portfolio import round_robin

    n = home.count()
    return home.select("firm_id").unionByName(round_robin(added, caps, n))
