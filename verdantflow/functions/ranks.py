"""Rank and standardisation expressions over groups; null values and null groups have defined results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.shared import written


def average_rank(x: Column, *group: Column | str) -> Column:
    """Rank of ``x`` in its group, ties sharing the mean of their places; null for a null ``x``."""
    known = x.isNotNull()
    place = F.rank().over(Window.partitionBy(*group, known).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, known, x))
    return F.when(known, place + (ties - 1) / F.lit(2.0))


def placed(df: DataFrame, order: str, name: str = "_place") -> DataFrame:
    """Rows with their place (from 0) in the order of a column without repeats, nulls last.

    Rows are dealt to ranges of the column; a place is that within its range and the rows of the ranges before.
    """
    dealt = df.repartitionByRange(F.col(order).asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_last())) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def with_places(table: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``table`` with ``place`` (long, from 0) of each row in its group and ``total``, the group's number of rows.

    Rows are dealt to ranges of group and order, equal ones by a number of their own, so no task gets a whole
    group; a place is that within the range and the group's rows of the ranges before. Groups are compared
    null-safe; nulls of ``order`` come first; rows alike in both are interchangeable. ``table`` has to be a
    written table, whose rows a lost task reads again in the same order.
    """
    numbered = table.withColumn("_row", F.monotonically_increasing_id())
    dealt = written(numbered.repartitionByRange(*(F.col(c).asc_nulls_first() for c in (*group, *order)), "_row").withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("count").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*group, "_range").count().select(*group, "_range", before.alias("_before"), F.sum("count").over(own).alias("total"))
    within = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*(F.col(c).asc_nulls_first() for c in order), "_row"))
    rows = join_back(dealt.withColumn("_within", within), sums, "_range", *group)
    return rows.withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_row", "_range", "_before", "_within")


def join_back(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the columns of a ``table`` that has one row for each value of the keys, which are compared null-safe."""
    own = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in table.columns if c not in keys))
    if not keys:
        return df.crossJoin(F.broadcast(own))  # one row
    match = F.lit(True)
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(own, match, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def _value_counts(df: DataFrame, columns: dict[str, str], keys: list[str], group: tuple[str, ...]) -> DataFrame:
    """``_k`` (the name), group ``keys``, ``_v, _c``: each non-null value with its count, and ``_upto``, ``_n``: values up to it and in all of its group.

    Values are counted and dealt to ranges; counts of ranges give what lies before each, so no task sorts a group.
    """
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("k"), F.col(c).cast("double").alias("v")) for n, c in columns.items())))
    flat = df.select(*(F.col(g).alias(k) for g, k in zip(group, keys)), values.alias("_s")).filter("_s.v is not null")
    counts = flat.groupBy(*keys, F.col("_s.k").alias("_k"), F.col("_s.v").alias("_v")).agg(F.count("*").alias("_c"))
    dealt = written(counts.repartitionByRange("_k", *keys, "_v").withColumn("_range", F.spark_partition_id()), "values")
    w = Window.partitionBy("_k", *keys)
    total = dealt.groupBy("_k", *keys, "_range").agg(F.sum("_c").alias("_t"))
    sums = total.select("_k", *keys, "_range", F.coalesce(F.sum("_t").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(w).alias("_n"))
    at = dealt.withColumn("_within", F.sum("_c").over(Window.partitionBy("_k", *keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    at = at.alias("a").join(sums.alias("b"), [F.col("a._range") == F.col("b._range"), F.col("a._k") == F.col("b._k"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)])
    return at.select("a._k", *(F.col(f"a.{k}").alias(k) for k in keys), "_v", "_c", (F.col("_before") + F.col("_within")).alias("_upto"), "_n")


def with_ranks(df: DataFrame, columns: dict[str, str], *group: str) -> DataFrame:
    """``df`` with average ranks: for each ``name: column`` the rank ``name``, and ``name_n``, the non-null values of the group.

    :func:`average_rank` for groups that may be as large as the table (see :func:`_value_counts`); ranks are joined
    back by value. Groups are compared null-safe; a null value has a null rank. ``df`` is used several times: give a table.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    at = _value_counts(df, columns, keys, group).select("_k", *keys, "_v", (F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0)).alias("_rank"), "_n")
    at = written(at, "ranks") if len(columns) > 1 else at
    for name, column in columns.items():
        own = at.filter(F.col("_k") == name).select(*keys, "_v", F.col("_rank").alias(name), F.col("_n").alias(f"{name}_n"))
        match = F.col(column).cast("double") == F.col("_v")
        for g, k in zip(group, keys):
            match &= F.col(g).eqNullSafe(F.col(k))
        df = df.join(own, match, "left").drop("_v", *keys)
    return df


def with_percent_ranks(df: DataFrame, columns: dict[str, str], *group: str) -> DataFrame:
    """``df`` with :func:`percent_rank` of ``name: column``, for groups of any size. ``df`` should be a table."""
    ranked = with_ranks(df, {f"_r_{n}": c for n, c in columns.items()}, *group)
    return ranked.withColumns({n: F.col(f"_r_{n}") / F.col(f"_r_{n}_n") for n in columns}).drop(*(f"_r_{n}{end}" for n in columns for end in ("", "_n")))


def group_quantiles(df: DataFrame, columns: dict[str, tuple[str, float]], *group: str) -> DataFrame:
    """Quantiles of ``name: (column, share)`` over the non-null values of each group, between two values in proportion.

    The two values are selected by the counts of ranges before them (see :func:`_value_counts`), not by sorting a
    group in a task. One row for each group with a value; without groups, one row.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    at = _value_counts(df, {n: c for n, (c, _) in columns.items()}, keys, group)
    found = []
    for name, (_, share) in columns.items():
        place = F.lit(share) * (F.col("_n") - 1)
        covers = lambda p: (F.col("_k") == name) & (F.col("_upto") > p) & (F.col("_upto") - F.col("_c") <= p)
        low, high = (F.max(F.when(covers(f(place)), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.max(F.when(F.col("_k") == name, place - F.floor(place)))
        found.append(((1 - part) * low + part * high).alias(name))
    return at.groupBy(*keys).agg(*found).select(*(F.col(k).alias(g) for k, g in zip(keys, group)), *columns)


def with_medians_filled(df: DataFrame, columns: dict[str, str], *group: str) -> DataFrame:
    """``df`` with ``name``: the column, or where it is null the median of its group. ``df`` should be a table."""
    medians = group_quantiles(df, {f"_m_{n}": (c, 0.5) for n, c in columns.items()}, *group)
    return join_back(df, medians, *group).withColumns({n: F.coalesce(c, f"_m_{n}") for n, c in columns.items()}).drop(*(f"_m_{n}" for n in columns))


def with_z_scores(df: DataFrame, columns: dict[str, str], *group: str) -> DataFrame:
    """``df`` with :func:`z_score` of ``name: column``, from aggregates that are joined back, for groups of any size."""
    stats = [f(c).alias(f"_{k}_{n}") for n, c in columns.items() for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]
    score = lambda n, c: F.when(F.col(f"_n_{n}") >= 2, F.when(F.col(f"_s_{n}") > 0, (F.col(c) - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).otherwise(0.0))
    found = join_back(df, df.groupBy(*group).agg(*stats), *group)
    return found.withColumns({n: score(n, c) for n, c in columns.items()}).drop(*(f"_{k}_{n}" for n in columns for k in "nms"))


def with_terciles(df: DataFrame, name: str, x: str, tie: str, *group: str) -> DataFrame:
    """``df`` with ``green`` for the top third of the group by x, ``brown`` for the bottom third, else ``mid``; ties by ``tie``. ``df`` should be a table."""
    share = (F.col("place") + 1) / F.col("total")
    return with_places(df, list(group), [x, tie]).withColumn(name, F.when(share > 2 / 3, "green").when(share <= 1 / 3, "brown").otherwise("mid")).drop("place", "total")


def with_scores(df: DataFrame, columns: dict[str, tuple[str, bool]], *group: str) -> DataFrame:
    """``df`` with :func:`percent_score` of ``name: (column, higher is better)``, for groups of any size. ``df`` should be a table."""
    ranked = with_ranks(df, {f"_r_{n}": c for n, (c, _) in columns.items()}, *group)
    scores = {}
    for name, (column, better) in columns.items():
        rank, n = F.col(f"_r_{name}"), F.col(f"_r_{name}_n")
        share = F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.5)
        for key in group:
            share = F.when(F.col(key).isNull(), 0.5).otherwise(share)
        scores[name] = F.when(F.col(column).isNotNull(), 10 * (share if better else 1 - share))
    return ranked.withColumns(scores).drop(*(f"_r_{n}{end}" for n in columns for end in ("", "_n")))


def with_pooled_group(df: DataFrame, name: str, key: str, least: int, *within: str) -> DataFrame:
    """``df`` with :func:`pooled_group` as ``name``, from counts that are joined back, for groups of any size."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(*within, key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return df.join(counts, [*within, key], "left").withColumn(name, F.when(F.col("_n").isNotNull(), F.col(key)).otherwise(F.lit("_all"))).drop("_n")


def percent_rank(x: Column, *group: Column | str) -> Column:
    """Average rank over the number of non-null values of the group, in (0, 1]."""
    return average_rank(x, *group) / F.count(x).over(Window.partitionBy(*group))


def percent_score(x: Column, *group: Column | str, higher_is_better: bool = True) -> Column:
    """0 to 10 by average rank in the group; 5 for the only value of a group, and where a group key is null."""
    n = F.count(x).over(Window.partitionBy(*group))
    share = F.when(n > 1, (average_rank(x, *group) - 1) / (n - 1)).otherwise(0.5)
    for key in group:
        share = F.when((F.col(key) if isinstance(key, str) else key).isNull(), 0.5).otherwise(share)
    return F.when(x.isNotNull(), 10 * (share if higher_is_better else 1 - share))


def z_score(x: Column, *group: Column | str) -> Column:
    """Sample z in the group, null groups included; 0 (for nulls too) without spread; null below two values."""
    w = Window.partitionBy(*group)
    n, mean, sd = F.count(x).over(w), F.avg(x).over(w), F.stddev_samp(x).over(w)
    return F.when(n < 2, None).when(sd > 0, (x - mean) / sd).otherwise(0.0)


def population_z(x: Column, *group: Column | str) -> Column:
    """z with the population deviation; a null, and a group without spread, is 0."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(x).over(w)
    return F.coalesce(F.when(sd > 0, (x - F.avg(x).over(w)) / sd), F.lit(0.0))


def pooled_group(key: Column, least: int, *within: Column | str) -> Column:
    """The key where its group has ``least`` rows, else ``_all``; a null key is pooled as well."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*within, key))
    return F.when(key.isNotNull() & (n >= least), key).otherwise(F.lit("_all"))


def top_in_group(key_order: list[Column], k: int, *group: Column | str) -> Column:
    """Whether a row is among the first ``k`` of its group in this order."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*key_order)) <= k


def group_mean_and_deviation(x: Column, *group: Column | str) -> tuple[Column, Column]:
    """Mean of the group and the distance from it; both null where a group key is null."""
    mean = F.avg(x).over(Window.partitionBy(*group))
    for key in group:
        mean = F.when((F.col(key) if isinstance(key, str) else key).isNotNull(), mean)
    return mean, x - mean
