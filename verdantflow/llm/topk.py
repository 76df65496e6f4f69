"""Exact top-k by inner product with vector-approximation files.

Each vector is stored twice: as one small cell number a dimension, in blocks, and exact. Queries meet only the
blocks of cells: cells bound every score from both sides, and a candidate stays if its upper bound reaches the
k-th lower bound of its query so far. The k-th lower bound over all blocks then leaves few candidates, whose exact
vectors alone are fetched; for each query they are read in the order of their bounds until the k-th result is
certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.shared import written

QUERIES, CANDIDATES, TILE = 512, 4096, 16
BROADCAST_ROWS = 200_000


def _cells(exact: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value, cell width and cell numbers: component x of dimension d lies in least + cell * step + [0, step)."""
    least = exact.min(0)
    step = ((exact.max(0) - least) >> bits) + 1
    return least, step, ((exact - least) // step).astype(np.uint8)


def _blocks(batches, size: int, bits: int | None) -> Iterator[pa.RecordBatch]:
    """Numbered vectors of one width to blocks: numbers, ids, and cells with their grid, or (no ``bits``) exact components."""
    waiting: dict[int, list[tuple[int, int, bytes]]] = {}
    number = TaskContext.get().partitionId() << 33

    def out(width: int) -> pa.RecordBatch:
        nonlocal number
        rows, ids, raw = zip(*waiting.pop(width))
        exact = np.frombuffer(b"".join(raw), "<i8").reshape(len(ids), width)
        data = [x.tobytes() for x in (_cells(exact, bits) if bits else (exact[:0], exact[:0], exact))]
        block, number = number, number + 1
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(rows, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), *data))], names=["width", "block", "rows", "ids", "least", "step", "cells"])

    for batch in batches:
        for n, i, v in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "vector"))):
            rows = waiting.setdefault(len(v), [])
            rows.append((n, i, np.array(v, "<i8").tobytes()))
            if len(rows) == size:
                yield out(len(v))
    for width in list(waiting):
        yield out(width)


def _scan(batches, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tile, queries first): candidates of a tile whose upper bound reaches the k-th lower bound of a query in it.    """

    class Query:
        def __init__(self, row: int, own: int):
            self.row, self.own = row, own
            self.floor, self.best, self.kept = None, np.zeros(0), []

    def out(queries: list) -> Iterator[pa.RecordBatch]:
        made = []
        for q, block in ((q, b) for _, members in queries for q in members for b in q.kept):
            rows, low, high = block
            stays = np.ones(len(rows), bool) if q.floor is None else high >= q.floor
            made.append((np.full(int(stays.sum()), q.row), rows[stays], low[stays], high[stays]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(m[c], np.int64 if c < 2 else float) for m in made])) for c in range(4)], names=["query", "row", "low", "high"])

    tile, queries = None, []
    for batch in batches:
        for width, own, kind, rows, ids, *grid in zip(*(batch.column(c).to_pylist() for c in ("width", "tile", "kind", "rows", "ids", "least", "step", "cells"))):
            if own != tile:
                yield from out(queries)
                tile, queries = own, []
            row, i = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
            if kind == 0:
                exact = np.frombuffer(grid[2], "<i8").reshape(len(i), width)
                queries.append((exact, [Query(int(n), int(x)) for n, x in zip(row, i)]))
                continue
            least, step, cells = np.frombuffer(grid[0], "<i8"), np.frombuffer(grid[1], "<i8"), np.frombuffer(grid[2], np.uint8).reshape(len(i), width)
            base_c, wide = least.astype(float), (step - 1).astype(float)
            scaled = cells * step.astype(float) + base_c
            for exact, members in queries:
                q = exact.astype(float)
                base = q @ scaled.T
                # doubles round: a bound is moved outwards by more than the rounding of a sum of so many terms
                slack = (np.abs(q) @ (np.abs(base_c) + 256.0 * step))[:, None] * (width + 4) * 2.0**-51
                high = base + (np.maximum(q, 0) @ wide)[:, None] + slack
                low = base + (np.minimum(q, 0) @ wide)[:, None] - slack
                for j, m in enumerate(members):
                    able = i != m.own
                    mine, top = low[j][able], high[j][able]
                    if not len(mine):
                        continue
                    best = np.concatenate([m.best, np.partition(mine, -k)[-k:] if len(mine) > k else mine])
                    m.best = np.sort(best)[-k:]
                    if len(m.best) == k:
                        m.floor = m.best[0]
                    stays = np.ones(len(top), bool) if m.floor is None else top >= m.floor
                    m.kept.append((row[able][stays], mine[stays], top[stays]))
    yield from out(queries)


def _certain(batches, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (query, low descending): those whose upper bound reaches the k-th lower bound of their query."""
    query, seen, floor = None, 0, 0.0
    for batch in batches:
        q, row, low, high = (batch.column(c).to_numpy() for c in ("query", "row", "low", "high"))
        keep = np.zeros(len(q), bool)
        cuts = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if q[a] != query:
                query, seen, floor = q[a], 0, -np.inf
            if seen < k <= seen + b - a:
                floor = low[a + k - seen - 1]
            seen += b - a
            keep[a:b] = high[a:b] >= floor if seen >= k else True
        yield batch.filter(pa.array(keep)).select(["query", "row", "high"])


def _read(batches, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (query, high descending), each with both exact vectors: read until the k-th result is certain.

    Rows that could only tie are read too, so ties go to the smaller id.
    """
    names = ["query_id", "rank", "id", "score", "exact_read"]
    query, query_id, best, read, done = None, None, [], 0, False

    def out() -> Iterator[pa.RecordBatch]:
        if best:
            rows = [(query_id, r + 1, i, -s, read) for r, (s, i) in enumerate(best)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    for batch in batches:
        for q, q_id, high, i, own, other in zip(*(batch.column(c).to_pylist() for c in ("query", "query_id", "high", "id", "q_vector", "vector"))):
            if q != query:
                yield from out()
                query, query_id, best, read, done = q, q_id, [], 0, False
            done = done or len(best) == k and high < -best[-1][0]
            if not done:
                read += 1
                best = sorted([*best, (-sum(x * y for x, y in zip(own, other)), i)])[:k]
    yield from out()


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, vector array<long>`` with floor(scale * x); vectors that are null, or hold null or non-finite components, are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vector"))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, cell_bits: int = 8) -> DataFrame:
    """``query_id, rank, id, score, exact_read`` for tables of ``id, vector array<long>``.

    A query never meets rows of its own id. Scores are inner products of vectors of one width; rows of other
    widths don't meet. Ties go to the smaller id; an id that repeats among the candidates counts each time, and
    one that repeats among the queries gets results for each of its rows. Fewer than k candidates give fewer
    rows; empty tables give none. ``exact_read``: exact vectors that the query has read.

    Copies of a vector tie, so all but the first few of them by id are left out before queries meet them.
    Cells (one byte a component) and blocks of queries meet in tiles of equal size, so no key is hot and what
    is sent grows with the work. Of exact vectors only those that may be among the first k move.
    """
    schema = "width int, block long, rows binary, ids binary, least binary, step binary, cells binary"
    # of equal vectors only the rows of the k + 1 smallest ids, k of each, can be a result of any query
    alike = candidates.select("id", "vector", F.row_number().over(Window.partitionBy("vector", "id").orderBy("id")).alias("copy")).filter(F.col("copy") <= k)
    alike = alike.select("id", "vector", F.dense_rank().over(Window.partitionBy("vector").orderBy("id")).alias("place")).filter(F.col("place") <= k + 1)
    numbered = [written(x.select("id", "vector"), "vectors").select(F.monotonically_increasing_id().alias("row"), "id", "vector") for x in (queries, alike)]
    q = written(numbered[0].mapInArrow(lambda b: _blocks(b, QUERIES, None), schema), "queries")
    c = written(numbered[1].mapInArrow(lambda b: _blocks(b, CANDIDATES, cell_bits), schema), "cells")
    across = [max(1, -(-n // TILE)) for n in (q.count(), c.count())]  # tiles by side
    side = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["width", "kind", "rows", "ids", "least", "step", "cells"]
    sent = q.withColumn("kind", F.lit(0)).withColumn("a", side(across[0])).withColumn("b", every(across[1]))
    sent = sent.unionByName(c.withColumn("kind", F.lit(1)).withColumn("b", side(across[1])).withColumn("a", every(across[0])))
    tiled = sent.select(F.concat_ws(" ", "width", "a", "b").alias("tile"), *columns).repartition("tile").sortWithinPartitions("tile", "kind")
    met = tiled.mapInArrow(lambda b: _scan(b, k), "query long, row long, low double, high double")
    bounded = met.repartition("query").sortWithinPartitions("query", F.desc("low"))
    left = written(bounded.mapInArrow(lambda b: _certain(b, k), "query long, row long, high double"), "survivors")
    few = left.count() <= BROADCAST_ROWS
    found = numbered[1].join(F.broadcast(left) if few else left, "row")
    found = numbered[0].select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("vector").alias("q_vector")).join(found, "query")
    ordered = found.select("query", "query_id", "high", "id", "q_vector", "vector").repartition("query").sortWithinPartitions("query", F.desc("high"), "id")
    return ordered.mapInArrow(lambda b: _read(b, k), "query_id long, rank int, id long, score long, exact_read long")
