"""Places of rows in the order of their group, for groups of any size, and runs of sorted rows in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.shared import written


def placed(table: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``table`` with ``place`` (long, from 0) of each row in its group and ``total``, the group's number of rows.

    Rows are dealt to ranges of group and order, equal ones by a number of their own, so no task gets a whole
    group; a place is that within the range and the group's rows of the ranges before. ``group`` columns have no
    nulls; nulls of ``order`` come first; rows alike in both are interchangeable. ``table`` has to be a written
    table, whose rows a lost task reads again in the same order.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    numbered = table.withColumn("_row", F.monotonically_increasing_id())
    dealt = written(numbered.repartitionByRange(*keys, "_row").withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("count").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*group, "_range").count().select(*group, "_range", before.alias("_before"), F.sum("count").over(own).alias("total"))
    within = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*(F.col(c).asc_nulls_first() for c in order), "_row"))
    rows = dealt.withColumn("_within", within).join(sums, ["_range", *group])
    return rows.withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_row", "_range", "_before", "_within")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Key and rows of each run of equal keys (numbers without nulls) in sorted batches, also across batches."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(v[a].item() for v in values)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)
