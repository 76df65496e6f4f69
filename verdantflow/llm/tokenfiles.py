"""Token ids in Parquet: list columns, dictionary or delta encoding, set row groups and page indexes.

Files hold ``doc_id, at, n_tokens, ids`` in ascending order of doc_id, one file for each range of ids; ``at``
counts the file's ids before the row. Small pages with an index let a reader fetch the ids of a few documents,
or the lengths alone, without reading the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdantflow.llm.shared import slices
from verdantflow.llm.tokens import encoder

SCHEMA = "doc_id long, at long, n_tokens long, ids array<int>"


def _encode(batches, tokenizer: str, kind: str, end: int) -> Iterator[pa.RecordBatch]:
    encode, at = encoder(tokenizer, kind), 0
    for batch in slices(batches, "text", 2 << 20, hold=True):
        ids, cuts = encode.ids(batch.column("text"))
        ends = cuts[1:] + np.arange(1, len(cuts))
        begins = np.concatenate(([0], ends[:-1]))
        with_end = np.full(int(ends[-1]), end, np.int32)
        own = np.ones(len(with_end), bool)
        own[ends - 1] = False
        with_end[own] = ids.view(np.int32)
        values = pa.array(with_end)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(begins + at), pa.array(ends - begins), lists], names=["doc_id", "at", "n_tokens", "ids"])
        at += int(ends[-1])


def _checksums(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("at"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000) -> None:
    """Encode whole texts, append ``end_id`` and write them in order of the id, nulls first.

    Null and empty texts have the end id only. Repeated ids are written next to each other, each in full, and may
    take several files, also where their texts are equal; rows alike in both are interchangeable. ``docs`` should be
    a table, whose rows a lost task reads again in the same order.
    ``encoding``: ``dictionary``, or ``delta`` (delta binary packed ids).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # parts a null id, or one that repeats, over files; a row's number does so for equal texts
    salted = rows.withColumns({"salt": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = salted.repartitionByRange("id", "salt", "row").sortWithinPartitions("id", "salt", "row").select("id", "text")
    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "compression": "zstd",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0", "maxRecordsPerFile": 0,
    }
    ordered.mapInArrow(lambda b: _encode(b, tokenizer, kind, end_id), SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as written, with ``start``: ids of all documents before a row, over all files in order."""
    files = spark.read.schema(SCHEMA).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return files.join(_file_starts(files), "file").withColumn("start", F.col("file_start") + F.col("at")).drop("file_start")


def _file_starts(files: DataFrame) -> DataFrame:
    """A row for each file; only the column of lengths is read. The numbers in the names of files are in order of the ids."""
    total = files.groupBy("file").agg(F.sum("n_tokens").alias("tokens")).withColumn("number", F.regexp_extract("file", r"\Apart-(\d+)", 1).cast("long"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("file_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each row, all from the ids read back."""
    files = spark.read.schema(SCHEMA).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    sums = files.select("file", "doc_id", "at", "ids").mapInArrow(_checksums, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return sums.join(_file_starts(files), "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
