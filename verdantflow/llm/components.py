"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.shared import written

HEAVY = 1000
BROADCAST_NODES = 200_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to a ``table`` of one row for each key, whose column ``count`` tells how many rows have it.

    Rows of keys with more than ``HEAVY`` rows stay where they are: these keys are broadcast, if a count shows
    that they are few, so the rows of one key don't meet in one task. Beyond that bound all are joined by a
    shuffle, whose large partitions adaptive execution can split.
    """
    heavy = table.filter(F.col(count) > HEAVY)
    some = heavy.count()
    if not 0 < some <= BROADCAST_NODES:
        return rows.join(table, keys, how)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table, keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(a long, b long)`` links to ``(node long, component long)``: the smallest node that links reach.

    Links with a null end and loops are ignored; repeated links count once; nodes without links don't appear.
    Each round is written to the shared folder, so the plan stays short and a lost executor costs one round.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree")), "least")
        large = join_counted(both.filter("b > a"), least, ["a"], "degree").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        # a node that is its own minimum's neighbour keeps its link to that minimum
        large = written(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")), "low")
        small = join_counted(large, low, ["a"], "degree").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
