"""Exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.shared import slices, written
from verdantflow.llm.tokens import encoder

SPAN = 512


def _lengths(batches, tokenizer: str, kind: str, end: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer, kind)
    for batch in slices(batches, "text", 2 << 20, hold=True):
        length, docs = np.unique(np.diff(encode.ids(batch.column("text"))[1]) + end, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs.astype(np.int64))], names=["length", "docs"])


def length_histogram(docs: DataFrame, tokenizer: str, kind: str = "byte", end: bool = True, text_col: str = "text") -> DataFrame:
    """``length long, docs long``: documents by encoded length (with the end token if ``end``).

    Null and empty texts have no ids of their own; repeated rows count each time; an empty table has no rows.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _lengths(b, tokenizer, kind, end), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """Answers for each length of the histogram as a context limit.

    ``docs_above`` and ``tokens_above`` are suffix sums over longer documents; ``tokens_kept`` is the total
    when every document is cut at the limit, ``tokens_cut`` what that loses, ``quantile`` the share of
    documents that fit whole. Between two lengths the answers follow from the row below:
    ``tokens_kept(limit) = tokens_kept(row) + (limit - row.length) * docs_above(row)``.

    Sums run in spans of lengths first, then over the spans, so no task sees the whole histogram. It is written
    to the shared folder first, as it is used twice. An empty histogram has no answers.
    """
    h = written(histogram.select("length", "docs"), "histogram").withColumns({"span": F.floor(F.col("length") / SPAN), "tokens": F.col("length") * F.col("docs")})
    spans = h.groupBy("span").agg(F.sum("docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "span",
        *(F.coalesce(F.sum(f"span_{c}").over(later), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")),
        *(F.sum(f"span_{c}").over(every).alias(f"all_{c}") for c in ("docs", "tokens")),
    )
    longer = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(spans, "span")
    for c in ("docs", "tokens"):
        out = out.withColumn(f"{c}_above", F.col(f"later_{c}") + F.coalesce(F.sum(c).over(longer), F.lit(0)))
    kept = F.col("all_tokens") - F.col("tokens_above") + F.col("length") * F.col("docs_above")
    return out.select(
        "length", "docs", "docs_above", "tokens_above", kept.alias("tokens_kept"), (F.col("all_tokens") - kept).alias("tokens_cut"),
        ((F.col("all_docs") - F.col("docs_above")) / F.col("all_docs")).alias("quantile"),
    )
