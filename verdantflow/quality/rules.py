"""Data-quality rules: each gives rows ``table, rule, key, message``; a bundle is sound when there are none.

Rules of single rows are ``Test`` values (``null_test``, ``range_test``, ...): a message, null where the row is fine. ``audit``
applies any number of them, and the rules over a whole table, in one scan; ``observed`` counts what they find while
the table is on its way to somewhere else. The functions that are named after a rule are audits of that rule alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from verdantflow.functions import numbers
from verdantflow.operators.panel import fx_returns

SCHEMA = "table string, rule string, key string, message string"


def _found(df: DataFrame, table: str, rule: str, key: Column, message) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _key(keys) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys))


def columns(df: DataFrame, table: str, required: list[str], allowed: list[str] | None = None, most: int = 100) -> DataFrame:
    """Missing, unknown and too many columns; the schema alone is looked at."""
    rows = [(table, "columns", c, "missing") for c in required if c not in df.columns]
    rows += [(table, "columns", c, "unknown") for c in df.columns if allowed is not None and c not in allowed]
    rows += [(table, "columns", str(len(df.columns)), "too many")] if len(df.columns) > most else []
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def row_count(df: DataFrame, table: str, least: int = 1, most: int = 500_000) -> DataFrame:
    n = df.agg(F.count("*").alias("n")).filter((F.col("n") < least) | (F.col("n") > most))
    return _found(n, table, "row_count", F.col("n"), F.when(F.col("n") < least, "too few rows").otherwise("too many rows"))


def unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return _found(twice, table, "unique", _key(keys), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def _names(bad: dict[str, Column]) -> Column:
    """The names of the columns for which a condition holds, or null."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in bad.items())))
    return F.when(F.size(found) > 0, F.array_join(found, ","))


class Test(NamedTuple):
    """A rule of single rows: its message, null where the row is fine; its own key, if it has one."""

    rule: str
    message: Column
    key: Column | None = None


def null_test(names: list[str]) -> Test:
    return Test("not_null", _names({c: F.col(c).isNull() for c in names}))


def range_test(bounds: dict[str, tuple[float | None, float | None]], exclusive: bool = False) -> Test:
    bad = {}
    for c, (low, high) in bounds.items():
        x = F.col(c)
        bad[c] = F.lit(False)
        if low is not None:
            bad[c] |= (x <= low) if exclusive else (x < low)
        if high is not None:
            bad[c] |= x > high
    return Test("ranges", _names(bad))


def flag_test(names: list[str]) -> Test:
    return Test("flags", _names({c: ~F.col(c).isin(0, 1) for c in names}))


def finite_test(names: list[str]) -> Test:
    return Test("finite", _names({c: F.isnan(c) | (F.abs(c) == float("inf")) for c in names}))


def date_test(column: str, as_of: str) -> Test:
    day = F.try_to_date(F.col(column), "yyyy-MM-dd")
    wrong = F.when(~F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$") | day.isNull(), "not a date").when(day > F.lit(as_of).cast("date"), "in the future")
    return Test("dates", F.when(F.col(column).isNotNull(), wrong))


def month_test(observed: str, month: str = "month") -> Test:
    return Test("within_month", F.when(F.trunc(observed, "MM") != F.trunc(month, "MM"), F.col(observed).cast("string")))


def ticker_test(column: str, pattern: str = r"^[0-9A-Z]{1,6}\.(HK|TW|TWO)$") -> Test:
    return Test("tickers", F.when(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), "not a ticker"), F.col(column))


def text_test(names: list[str], most: int = 100_000) -> Test:
    return Test("texts", _names({c: F.length(c) > most for c in names}))


def json_test(column: str) -> Test:
    bad = F.col(column).isNotNull() & (~F.trim(column).startswith("[") | F.from_json(column, "array<string>").isNull())
    return Test("json_lists", F.when(bad, F.lit(column)))


def audit(df: DataFrame, table: str, keys: list[str], *tests: Test, unique: list[str] | None = None, count: tuple[int, int] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """All findings of one table from one scan of it: tests of rows, repeated keys (``unique``), the number of rows
    (``count``: least, most) and firms that aren't in ``universe``.

    A row becomes one entry for each finding and one for each rule over the whole table, and entries are counted
    by what they say; each task counts its own first, so the number of rows is one row of a task and a key that many rows have is
    no hot one. Findings of rows alike come back as often as they occur. Without rules over the whole table there
    is no shuffle. Null keys are shown as ``?``; an empty table has 0 rows, and so too few.
    """
    own = _key(keys) if keys else F.lit("")

    def entry(rule: str, key: Column, message: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), message.cast("string").alias("message"))

    rows = [F.when(t.message.isNotNull(), entry(t.rule, own if t.key is None else t.key, t.message)) for t in tests]
    none = F.lit(None)
    whole = []
    if unique is not None:
        whole.append(entry("unique", _key(unique), none))
    if count is not None:
        whole.append(entry("row_count", none, none))
    if universe is not None:
        whole.append(entry("known_firms", F.col("firm_id"), none))
    tagged = df.select(F.inline(F.array_compact(F.array(*rows, *whole))))
    if not whole:
        return tagged.select(F.lit(table).alias("table"), "rule", "key", "message")
    n = tagged.withColumn("n", F.lit(1).cast("long"))
    if count is not None:
        n = n.unionByName(df.sparkSession.range(1).select(F.lit("row_count").alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("message"), F.lit(0).cast("long").alias("n")))
    n = n.groupBy("rule", "key", "message").agg(F.sum("n").alias("n"))
    over = F.col("message").isNull()  # tests of rows always have a message
    found = {"unique": F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" rows")))}
    if count is not None:
        found["row_count"] = F.when(F.col("n") < count[0], "too few rows").when(F.col("n") > count[1], "too many rows")
    if universe is not None:
        known = universe.select(F.lit("known_firms").alias("rule"), F.col("firm_id").cast("string").alias("key")).distinct().withColumn("_known", F.lit(True))
        n = n.join(known, ["rule", "key"], "left")
        found["known_firms"] = F.when(F.col("_known").isNull(), "not in the universe")
    message = F.when(~over, F.col("message"))
    for rule, told in found.items():
        message = message.when(over & (F.col("rule") == rule), told)
    key = F.when(over & (F.col("rule") == "row_count"), F.col("n").cast("string")).otherwise(F.col("key"))
    times = F.when(over, F.lit(1).cast("long")).otherwise(F.col("n"))
    told = n.select("rule", key.alias("key"), message.alias("message"), times.alias("n")).filter("message is not null")
    return told.select(F.lit(table).alias("table"), "rule", "key", "message", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")


def observed(df: DataFrame, table: str, *tests: Test) -> tuple[DataFrame, Observation]:
    """``df`` itself, and an observation that holds ``rows`` and the number of findings of each rule (of the same rules together)
    once an action, such as the write of the table, has run over it: no scan of its own."""
    seen: dict[str, Column] = {}
    for t in tests:
        hit = F.when(t.message.isNotNull(), 1).otherwise(0)
        seen[t.rule] = seen[t.rule] + hit if t.rule in seen else hit
    watch = Observation(table)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(rule) for rule, c in seen.items())), watch


def not_null(df: DataFrame, table: str, keys: list[str], names: list[str]) -> DataFrame:
    return audit(df, table, keys, null_test(names))


def ranges(df: DataFrame, table: str, keys: list[str], bounds: dict[str, tuple[float | None, float | None]], exclusive: bool = False) -> DataFrame:
    """Values outside [low, high], or not above low if ``exclusive``; nulls pass."""
    return audit(df, table, keys, range_test(bounds, exclusive))


def flags(df: DataFrame, table: str, keys: list[str], names: list[str]) -> DataFrame:
    return audit(df, table, keys, flag_test(names))


def finite(df: DataFrame, table: str, keys: list[str], names: list[str]) -> DataFrame:
    return audit(df, table, keys, finite_test(names))


def dates(df: DataFrame, table: str, keys: list[str], column: str, as_of: str) -> DataFrame:
    """Text dates that aren't ISO dates, or lie after ``as_of``."""
    return audit(df, table, keys, date_test(column, as_of))


def within_month(df: DataFrame, table: str, keys: list[str], observed: str, month: str = "month") -> DataFrame:
    return audit(df, table, keys, month_test(observed, month))


def tickers(df: DataFrame, table: str, column: str, pattern: str = r"^[0-9A-Z]{1,6}\.(HK|TW|TWO)$") -> DataFrame:
    return audit(df, table, [], ticker_test(column, pattern))


def texts(df: DataFrame, table: str, keys: list[str], names: list[str], most: int = 100_000) -> DataFrame:
    return audit(df, table, keys, text_test(names, most))


def json_lists(df: DataFrame, table: str, keys: list[str], column: str) -> DataFrame:
    return audit(df, table, keys, json_test(column))


def known_firms(df: DataFrame, table: str, universe: DataFrame) -> DataFrame:
    missing = df.select("firm_id").distinct().join(universe.select("firm_id"), "firm_id", "left_anti")
    return _found(missing, table, "known_firms", F.col("firm_id"), "not in the universe")


def greenness_formula(df: DataFrame, table: str = "greenness", tolerance: float = 1e-5) -> DataFrame:
    told = numbers.greenness(F.col("e_score"), F.col("e_weight"))
    return _found(df.filter(F.abs(F.col("g") - told) > tolerance), table, "greenness_formula", _key(["firm_id", "year"]), "g isn't its formula")


def fx_overlap(prices: DataFrame, factors: DataFrame, fx: DataFrame, pairs: list[str], least: int = 24) -> DataFrame:
    """Pairs without ``least`` months of returns, factors and consecutive rates; pairs without any month count 0."""
    months = prices.filter("ret is not null").select("month").intersect(factors.select("month"))
    ready = fx_returns(fx).filter("fx_ret is not null").join(months, "month", "left_semi").groupBy("pair").agg(F.count("*").alias("n"))
    wanted = prices.sparkSession.createDataFrame([(p,) for p in pairs], "pair string").join(ready, "pair", "left").filter(F.coalesce("n", F.lit(0)) < least)
    return _found(wanted, "fx_monthly", "fx_overlap", F.col("pair"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" months")))


def contract(told: dict, expected: dict, table: str, spark) -> DataFrame:
    """Units, currencies and markets that differ from what is expected."""
    rows = [(table, "contract", str(k), f"{told.get(k)} is not {v}") for k, v in expected.items() if told.get(k) != v]
    return spark.createDataFrame(rows, SCHEMA)


def all_of(*rules: DataFrame) -> DataFrame:
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
