"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of the mix go to sources by highest quotients, then to the shards of a source in the same way, so
each shard has an integer quota of words. A shard is cut into blocks of an equal number of words, the same at
any input size; a seeded order picks them, and the last one picked is taken in part, so quotas are met to the
word. Only sizes are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.shared import written

BLOCK_WORDS = 256
SHARD_WORDS = 8_000_000
SHARD_BLOCKS = (64, 8192)
BROADCAST_SOURCES = 50_000


def word_count(text):
    """Runs of bytes other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), at most ``most`` each; ties go to the earlier party."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    got = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return got

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most).astype(np.int64)

    low, high = 0.0, 4 * votes.max()  # at a divisor of low all quotas are full, at high none has a seat
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = at(high)
    while (short := seats - int(got.sum())) > 0:  # equal quotients at the last divisor
        quotient = np.where(got < most, votes / (2 * got + 1), -1)
        got[np.argsort(-quotient, kind="stable")[:short]] += quotient[np.argsort(-quotient, kind="stable")[:short]] > 0
    return got


def capped_targets(size: np.ndarray, weight: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares of ``total`` by weight; what a share has above ``cap`` * size goes to the others by weight."""
    size, weight = np.asarray(size, float), np.asarray(weight, float)
    out, most = np.zeros(len(size)), cap * size
    full = np.zeros(len(size), bool)
    while not full.all():
        rest = total - most[full].sum()
        share = np.where(full, most, weight * (rest / weight[~full].sum()))
        over = ~full & (share > most)
        out = np.where(full | over, most, share)
        if not over.any():
            break
        full |= over
    return out


def mix_sources(docs: DataFrame, weights: Callable[[int], float], total_share: float = 1.5, most_repeats: int = 2, seed: int = 0, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``id, size, source, source_size, target, taken`` (words, repeats counted).

    ``weights(i)`` is the weight of the i-th source by code point, a null source last. The sources share
    ``total_share`` of all words; a target stops at ``most_repeats`` times its source's words, and what is
    above goes to the others. Null, empty and blank texts have size 0 and take 0. The order within a shard
    depends on seed, id and size only, so equal input gives equal output; rows alike in both are
    interchangeable. The table of sources is configuration (each has a weight), and is held by one task.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    # a key without nulls, in the order of the sources: UTF-8 sorts as code points, "1" comes before "2"
    key = F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), F.hex(F.encode(source, "utf-8"))))
    base = written(docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), key.alias("key"), word_count(F.col(text_col).cast("string")).alias("size")), "sizes")

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        size = frame["source_size"].to_numpy(np.int64)
        all_words = int(size.sum())
        target = capped_targets(size, [weights(i) for i in range(len(size))], total_share * all_words, most_repeats)
        words = min(max(shard_words, SHARD_BLOCKS[0] * block), SHARD_BLOCKS[1] * block)  # so neither words nor blocks of a shard pile up
        shards = np.maximum(1, -(-size // words))
        quota = sainte_lague(target, round(float(target.sum())), most_repeats * size)
        return frame.assign(target=target, block=block, shards=shards, quota=quota)

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard", ignore_index=True)
        words, block = frame["words"].to_numpy(np.int64), int(frame["block"].iloc[0])
        got = sainte_lague(words, int(frame["quota"].iloc[0]), most_repeats * words)
        return frame.assign(number=-(-words // block), passes=got // np.maximum(words, 1), extra=got % np.maximum(words, 1))[["key", "shard", "words", "block", "number", "passes", "extra"]]

    planned = base.groupBy("key").agg(F.sum("size").alias("source_size")).groupBy().applyInPandas(plan, "key string, source_size long, target double, block long, shards long, quota long")
    planned = written(planned, "sources")
    small = planned.count() <= BROADCAST_SOURCES
    every = base.join(F.broadcast(planned) if small else planned, "key")
    rows = every.filter("size > 0").withColumn("shard", F.pmod(F.xxhash64("id", "size", F.lit(seed)), "shards")).repartition("key", "shard")
    placed = Window.partitionBy("key", "shard").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("begin", F.coalesce(F.sum("size").over(placed), F.lit(0))), "placed")
    cells = rows.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("quota").alias("quota"))
    cells = written(cells.groupBy("key").applyInPandas(deal, "key string, shard long, words long, block long, number long, passes long, extra long"), "cells")

    # blocks of a cell in a seeded order: the first ``extra`` words of them are taken once more
    spans = cells.filter("extra > 0").select("key", "shard", "extra", "words", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)).alias("k"))
    spans = spans.select("key", "shard", "extra", "k", F.least("block", F.col("words") - F.col("k") * F.col("block")).alias("length"))
    drawn = Window.partitionBy("key", "shard").orderBy(F.xxhash64("key", "shard", "k", F.lit(seed + 2)), "k").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("rest", F.col("extra") - F.coalesce(F.sum("length").over(drawn), F.lit(0))).filter("rest > 0")
    chosen = spans.select("key", "shard", "k", F.least("length", "rest").alias("given"))
    cut = rows.select("key", "shard", "begin", "size", "block", F.explode(F.expr("sequence(begin div block, (begin + size - 1) div block)")).alias("k"))
    overlap = F.least(F.col("begin") + F.col("size"), F.col("k") * F.col("block") + F.col("given")) - F.greatest(F.col("begin"), F.col("k") * F.col("block"))
    more = cut.join(chosen, ["key", "shard", "k"]).groupBy("key", "shard", "begin", "size").agg(F.sum(F.greatest(overlap, F.lit(0))).alias("more"))
    rows = rows.join(cells.select("key", "shard", "passes"), ["key", "shard"]).join(more, ["key", "shard", "begin", "size"], "left")
    columns = ["id", "size", "source", "source_size", "target"]
    taken = rows.select(*columns, (F.col("passes") * F.col("size") + F.coalesce("more", F.lit(0))).alias("taken"))
    return taken.unionByName(every.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
