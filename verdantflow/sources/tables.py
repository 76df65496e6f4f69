"""Readers and sinks: tables by suffix, part files, factor files, holdings uploads, normalisers of landed tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.functions import numbers, text
from verdantflow.operators.documents import first_of
from verdantflow.shared import new_path


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, CSV or JSON by suffix with a given schema; a missing path is an empty table."""
    reader = spark.read.schema(schema)
    try:
        if path.endswith(".csv"):
            return reader.option("header", True).csv(path)
        return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_parts(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """Part folders and older single files as one table by name."""
    out = None
    for p in paths:
        df = read_table(spark, p, schema)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, by: str | None = "year", mode: str = "overwrite") -> None:
    """Parquet or CSV by suffix, Parquet partitioned by a column where the table has it; a large partition takes several files and tasks."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    elif by and by in df.columns:
        df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, by: str | None = None, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` buckets of its keys (in each value of ``by``, if given), read back.

    Tables with the same keys and number of buckets meet in a join on the keys, and are grouped by them, without a
    shuffle: what is joined again and again is shuffled once, here. A bucket is one file (of each ``by``), so a year is split over
    ``buckets`` files, and takes as many tasks as it has buckets; choose them so that a bucket fits a task. All rows of one
    key are in one bucket, so keys should not be hot by themselves: a firm and its year rather than a firm. Null keys are values like any other.
    ``name`` is the table's in the session's catalogue, ``path`` its folder (one in the shared folder unless given).
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (dealt.partitionBy(by) if by else dealt).option("path", path or new_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int, by: str | None = None, name: str | None = None) -> DataFrame:
    """A table that ``write_bucketed`` wrote, in a session whose catalogue doesn't know it; the arguments are those of the write."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    named = ", ".join(f"`{k}`" for k in keys)
    split = f"partitioned by (`{by}`) " if by else ""
    place = path.replace("'", "\\'")
    spark.sql(f"create table `{name}` ({schema}) using parquet {split}clustered by ({named}) sorted by ({named}) into {buckets} buckets location '{place}'")
    if by:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def read_factor_file(spark: SparkSession, path: str) -> DataFrame:
    """Monthly block of a published factor file: ``month`` and the factors as decimals.

    The block is the first run of lines that begin with six digits; its names are on the last line before it
    that begins with a comma. A file of one table is small and ordered, so one window numbers its lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    lines = lines.withColumn("data", F.col("line").rlike(r"^\s*\d{6}\s*,"))
    w = Window.orderBy("n")
    lines = lines.withColumn("run", F.sum((~F.col("data")).cast("int")).over(w))
    first = lines.filter("data").agg(F.min("run").alias("run"), F.min("n").alias("begin")).first()
    if first["run"] is None:
        raise ValueError(f"no monthly block in {path}")
    head = lines.filter((F.col("n") < first["begin"]) & F.col("line").startswith(",")).orderBy(F.desc("n")).select("line").first()
    names = [x.strip().lower().replace("-", "_") for x in head["line"].split(",")[1:]]
    cells = F.split("line", ",")
    block = lines.filter((F.col("run") == first["run"]) & F.col("data"))
    return block.select(F.to_date(F.concat(F.trim(cells[0]), F.lit("01")), "yyyyMMdd").alias("month"), *((F.trim(cells[i + 1]).try_cast("double") / 100).alias(n) for i, n in enumerate(names)))


def factor_set(five: DataFrame, momentum: DataFrame) -> DataFrame:
    return five.join(momentum.select("month", "mom"), "month")


def fundamentals(items: DataFrame, rates: dict[str, float], preferred: list[str]) -> DataFrame:
    """Revenue in USD millions from ``firm_id, year, item, value, currency``: the first available item of a preference list."""
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col("item"))
    best = first_of(items.filter((rank > 0) & F.col("value").isNotNull()), ["firm_id", "year"], [rank, "currency"])
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    return best.select("firm_id", "year", (F.col("value") * F.try_element_at(rate, F.col("currency")) / 1e6).alias("revenue"), F.when(F.try_element_at(rate, F.col("currency")).isNull(), F.concat(F.lit("no rate for "), "currency")).alias("fx_note"))


def exchange_universe(rows: DataFrame, industries: DataFrame, suffix: str) -> DataFrame:
    """Exchange listing to firms: code and suffix, English name else the local one, industry name else Other."""
    name = F.coalesce(F.nullif(F.trim("name_en"), F.lit("")), F.col("name_local"))
    df = rows.join(industries.select("industry_code", "industry"), "industry_code", "left")
    return df.select(F.concat("code", F.lit(suffix)).alias("firm_id"), name.alias("name"), F.coalesce("industry", F.lit("Other")).alias("sector"), numbers.clean_number(F.col("capital")).alias("capital"))


def exchange_emissions(rows: DataFrame, *topics: DataFrame) -> DataFrame:
    """Exchange disclosures to emissions: local calendar years, numbers cleaned, other topics joined once per firm."""
    out = rows.select(
        "firm_id", (F.col("local_year").cast("int") + 1911).alias("year"), *(numbers.clean_number(F.col(c)).alias(c) for c in ("scope1", "scope2", "scope3")),
        (F.col("verified1") == "Y").alias("_v1"), (F.col("verified2") == "Y").alias("_v2"),
    )
    out = out.withColumns({"matched": F.col("scope1").isNotNull(), "verified": F.coalesce(F.col("_v1") & F.col("_v2"), F.lit(False))}).drop("_v1", "_v2")
    for t in topics:
        out = out.join(first_of(t, ["firm_id"], [c for c in t.columns if c != "firm_id"]), "firm_id", "left")
    return out


def annualised_revenue(rows: DataFrame, rate: float = 32.0) -> DataFrame:
    """Year to date x 12 / month, from thousands of local currency to USD millions; the last full year where it is told."""
    month = F.col("month").cast("int")
    full = numbers.clean_number(F.col("last_year_total"))
    value = F.coalesce(full, numbers.clean_number(F.col("year_to_date")) * 12 / month)
    year = F.col("local_year").cast("int") + 1911 - F.when(full.isNotNull(), 1).otherwise(0)
    return rows.select("firm_id", year.alias("year"), (value * 1000 / rate / 1e6).alias("revenue"), F.when(full.isNotNull(), "last year").otherwise(F.concat(F.lit("annualised from month "), month.cast("string"))).alias("basis"))


def index_universe(constituents: DataFrame, info: DataFrame, stock_map: DataFrame) -> DataFrame:
    df = constituents.join(info, "firm_id", "left").join(stock_map, "firm_id", "left")
    return first_of(df.withColumns({"sector": F.coalesce("sector", "sub_index"), "industry": F.coalesce("industry", "sub_index")}), ["firm_id"], ["name"])


def listed_equities(rows: DataFrame) -> DataFrame:
    return rows.filter(F.trim("category").isin("Equity", "Real Estate Investment Trusts") & (F.trim("vcm") == "Y") & (F.trim("currency") == "HKD"))


def report_listing(rows: DataFrame, kinds: tuple[str, ...] = ("annual_report", "esg_report")) -> DataFrame:
    """Exchange listing to reports: first code of dual counters, type and fiscal year by title, PDF files only."""
    filed = F.try_to_date(F.col("filed"), "dd/MM/yyyy")
    df = rows.filter(F.lower("url").endswith(".pdf")).select(F.trim(F.split_part("stock_code", F.lit("<"), F.lit(1))).alias("stock_code"), "title", "url", filed.alias("filing_date"), text.title_kind(F.col("title")).alias("doc_type"), text.fiscal_year(F.col("title"), filed).alias("fiscal_year"))
    return df.filter(F.col("doc_type").isin(*kinds))


def uploaded_holdings(rows: DataFrame) -> DataFrame:
    """Uploaded weights (``portfolio_id, line, ticker, weight`` as text) to percentages of one decimal that add up to 100.

    Percent signs and separators are stripped; bad and non-positive rows are left out; the first row takes
    what rounding leaves.
    """
    weight = numbers.clean_number(F.col("weight"))
    ok = rows.withColumn("weight", weight).filter("weight > 0 and trim(ticker) <> ''")
    w = Window.partitionBy("portfolio_id")
    ok = ok.withColumn("pct", F.round(100 * F.col("weight") / F.sum("weight").over(w), 1))
    first = F.row_number().over(w.orderBy("line")) == 1
    left = F.round(100 - F.sum("pct").over(w), 1)
    code = F.upper(F.trim("ticker"))
    return ok.select("portfolio_id", "line", F.when(code.rlike(r"^\d{1,5}$"), numbers.ticker(code.try_cast("long"))).otherwise(code).alias("firm_id"), F.round(F.when(first, F.col("pct") + left).otherwise(F.col("pct")), 1).alias("weight"))


def checked_holdings(rows: DataFrame) -> DataFrame:
    """Rows of ``portfolio_id, ticker, units, price, value, currency, date`` as text, with an ``error`` instead of an exception."""
    value, units, price = (numbers.clean_number(F.col(c)) for c in ("value", "units", "price"))
    day = F.try_to_date(F.col("date"), "yyyy-MM-dd")
    w = Window.partitionBy("portfolio_id")
    error = (
        F.when(F.coalesce(F.trim("ticker"), F.lit("")) == "", "no ticker")
        .when(value.isNull() | (value <= 0), "bad value")
        .when(~F.col("currency").rlike("^[A-Z]{3}$"), "bad currency")
        .when(F.col("date").isNotNull() & day.isNull(), "bad date")
        .when(F.min(day).over(w) != F.max(day).over(w), "several valuation dates")
        .when(units.isNotNull() & price.isNotNull() & (F.abs(units * price - value) > 0.01), "units times price isn't the value")
    )
    return rows.select("portfolio_id", "ticker", value.alias("value"), "currency", day.alias("date"), error.alias("error"))


def rounded_export(df: DataFrame, money: tuple[str, ...] = ()) -> DataFrame:
    """Doubles with 6 digits, money with 2."""
    return df.select(*(F.round(c, 2 if c in money else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def month_end_pairs(daily: DataFrame, market_currency: dict[str, str], base: str = "HKD") -> DataFrame:
    """``month, pair, rate`` from ``market, date, close``: pair named by the market's currency, none for the base."""
    pair = F.create_map(*[F.lit(x) for m, c in market_currency.items() if c != base for x in (m, c + base)])
    df = daily.filter("close is not null").withColumn("pair", F.try_element_at(pair, F.col("market"))).filter("pair is not null")
    return df.groupBy(F.trunc("date", "MM").cast("date").alias("month"), "pair").agg(F.max_by("close", "date").alias("rate"))
