"""Canonical tables from the given star schema, as DataFrames and as SQL common table expressions.

Money is summed as decimals, so sums don't depend on the order of rows; ratios follow in doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdantflow import schema

DEC = "decimal(18,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A firm for each customer; the few nations and regions are broadcast."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    n = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").cast("string").alias("firm_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("industry"), F.col("r_name").alias("country")
    )


def firm_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions and revenue for each firm and year: ``firm_id, year, scope1, scope2, revenue, matched``."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    price, discount, tax = (F.col(f"l_{c}").cast(DEC) for c in ("extendedprice", "discount", "tax"))
    # lines are summed for each order before orders are joined: one shuffle of far fewer rows
    lines = i.groupBy("l_orderkey").agg(F.sum(price * discount).alias("s1"), F.sum(price * tax).alias("s2"), F.sum(price).alias("s0"), F.count("*").alias("n"))
    joined = lines.join(o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), lines["l_orderkey"] == F.col("o_orderkey"))
    total = joined.groupBy(F.col("o_custkey").cast("string").alias("firm_id"), "year").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("s0").alias("s0"), F.sum("n").alias("n"))
    return total.select("firm_id", "year", F.col("s1").cast("double").alias("scope1"), F.col("s2").cast("double").alias("scope2"), (F.col("s0").cast("double") / 1000).alias("revenue"), (F.col("n") > 1).alias("matched"))


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firm_years(spark, sf_dir).drop("revenue")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firm_years(spark, sf_dir).select("firm_id", "year", "revenue")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``firm_id, month, ret, mktcap`` for each supplier and month of shipping."""
    i = table(spark, sf_dir, "lineitem")
    sums = i.groupBy("l_suppkey", schema.month(F.col("l_shipdate")).alias("month")).agg(
        F.sum(F.col("l_discount").cast(DEC)).alias("d"), F.sum(F.col("l_tax").cast(DEC)).alias("t"), F.sum(F.col("l_extendedprice").cast(DEC)).alias("p"), F.count("*").alias("n")
    )
    return sums.select(F.col("l_suppkey").cast("string").alias("firm_id"), "month", ((F.col("d") - F.col("t")).cast("double") / F.col("n") - 0.01).alias("ret"), F.col("p").cast("double").alias("mktcap"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market and style factors for each month, from groups of lines; a line counts in one sum for its month and both flags."""
    i = table(spark, sf_dir, "lineitem")
    value = F.col("l_discount").cast(DEC) - F.col("l_tax").cast(DEC)
    flags = {"a": F.col("l_returnflag") == "A", "n": F.col("l_returnflag") == "N", "r": F.col("l_returnflag") == "R", "o": F.col("l_linestatus") == "O", "f": F.col("l_linestatus") == "F"}
    parts = i.groupBy(schema.month(F.col("l_shipdate")).alias("month"), "l_returnflag", "l_linestatus").agg(F.sum(value).alias("v"), F.count("*").alias("n"))
    sums = parts.groupBy("month").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"), *(F.sum(F.when(c, F.col("v"))).alias(f"v_{k}") for k, c in flags.items()), *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, c in flags.items())
    )
    mean = {k: F.when(F.col(f"n_{k}") > 0, F.col(f"v_{k}").cast("double") / F.col(f"n_{k}")).otherwise(0.0) for k in flags}
    return sums.select(
        "month", (F.col("v").cast("double") / F.col("n") - 0.01).alias("mkt_rf"), (mean["a"] - mean["n"]).alias("smb"), (mean["r"] - mean["a"]).alias("hml"), (mean["o"] - mean["f"]).alias("rmw"), F.lit(0.002).alias("rf")
    )


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USDHKD and TWDHKD for each month of orders but one: ``month, pair, rate``."""
    months = table(spark, sf_dir, "orders").select(schema.month(F.col("o_orderdate")).alias("month")).distinct().filter("month <> date'1996-05-01'")
    number = schema.month_number(F.col("month"))
    pairs = F.explode(F.map_from_arrays(F.array(F.lit("USDHKD"), F.lit("TWDHKD")), F.array(7.8 * (1 + (number % 13) / 1000), 0.25 * (1 + (number % 7) / 1000))))
    return months.select("month", pairs.alias("pair", "rate"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports: ``firm_id, year, accession, text``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("F"), (F.col("doc_id") % 50).cast("string")).alias("firm_id"), (2020 + F.col("doc_id") % 4).cast("int").alias("year"), F.col("doc_id").alias("accession"), "text")


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line adds to a book: ``portfolio_id, l_suppkey, price``."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o = o.select("o_orderkey", (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("portfolio_id"))
    i = i.select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast(DEC).alias("price"))
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select("portfolio_id", "l_suppkey", "price")


def holdings(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """A book for each account and year of orders: ``portfolio_id, firm_id, capital``."""
    lines = book_lines(spark, sf_dir) if lines is None else lines
    sums = lines.groupBy("portfolio_id", "l_suppkey").agg(F.sum("price").cast("double").alias("capital"))
    return sums.select("portfolio_id", F.col("l_suppkey").cast("string").alias("firm_id"), "capital")


SQL: dict[str, str] = {
    "firms": """select cast(c_custkey as varchar) as firm_id, c_name as name, c_mktsegment as sector, n_name as industry, r_name as country
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "firm_years": """select cast(o_custkey as varchar) as firm_id, cast(year(o_orderdate) as integer) as year,
            cast(sum(cast(l_extendedprice as decimal(18,4)) * cast(l_discount as decimal(18,4))) as double) as scope1,
            cast(sum(cast(l_extendedprice as decimal(18,4)) * cast(l_tax as decimal(18,4))) as double) as scope2,
            cast(sum(cast(l_extendedprice as decimal(18,4))) as double) / 1000 as revenue, count(*) > 1 as matched
        from orders join lineitem on l_orderkey = o_orderkey group by all""",
    "prices": """select cast(l_suppkey as varchar) as firm_id, cast(date_trunc('month', l_shipdate) as date) as month,
            cast(sum(cast(l_discount as decimal(18,4))) - sum(cast(l_tax as decimal(18,4))) as double) / count(*) - 0.01::double as ret,
            cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as mktcap
        from lineitem group by all""",
    "factors": """select month, v / n - 0.01::double as mkt_rf, a - nn as smb, r - a as hml, o - f as rmw, 0.002::double as rf from (
        select cast(date_trunc('month', l_shipdate) as date) as month, cast(sum(x) as double) as v, count(*) as n,
            coalesce(cast(sum(x) filter (l_returnflag = 'A') as double) / nullif(count(*) filter (l_returnflag = 'A'), 0), 0) as a,
            coalesce(cast(sum(x) filter (l_returnflag = 'N') as double) / nullif(count(*) filter (l_returnflag = 'N'), 0), 0) as nn,
            coalesce(cast(sum(x) filter (l_returnflag = 'R') as double) / nullif(count(*) filter (l_returnflag = 'R'), 0), 0) as r,
            coalesce(cast(sum(x) filter (l_linestatus = 'O') as double) / nullif(count(*) filter (l_linestatus = 'O'), 0), 0) as o,
            coalesce(cast(sum(x) filter (l_linestatus = 'F') as double) / nullif(count(*) filter (l_linestatus = 'F'), 0), 0) as f
        from (select *, cast(l_discount as decimal(18,4)) - cast(l_tax as decimal(18,4)) as x from lineitem) group by 1)""",
    "fx": """select month, pair, case pair when 'USDHKD' then 7.8::double * (1 + (k % 13) / 1000::double) else 0.25::double * (1 + (k % 7) / 1000::double) end as rate
        from (select distinct cast(date_trunc('month', o_orderdate) as date) as month, year(o_orderdate) * 12 + month(o_orderdate) as k from orders) m,
            (values ('USDHKD'), ('TWDHKD')) p(pair) where month <> date '1996-05-01'""",
    "reports": """select 'F' || cast(doc_id % 50 as varchar) as firm_id, cast(2020 + doc_id % 4 as integer) as year, doc_id as accession, text from documents""",
    "holdings": """select o_custkey * 10000 + year(o_orderdate) as portfolio_id, cast(l_suppkey as varchar) as firm_id, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as capital
        from orders join lineitem on l_orderkey = o_orderkey group by all""",
}


def sql(select: str, *tables: str, **more: str) -> str:
    """``select`` with the named tables, then ``more``, as common table expressions."""
    parts = {t: SQL[t] for t in tables} | more
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in parts.items()) + "\n" + select
