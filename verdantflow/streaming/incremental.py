"""Incremental ingestion: skip what was seen, try failures again, merge restatements.

What was seen, and what waits to be tried again, is state of the stream (RocksDB, partitioned by key), so the cost
of a batch depends on the batch and not on what earlier ones wrote.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructType

from verdantflow.operators.documents import consolidate_emissions
from verdantflow.operators.selection import replace_firms
from verdantflow.shared import written

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ATTEMPTS = 5
#: Groups that wait for a timer of their own, for each file of failures, and rows that are handed to state at once.
GROUPS, AT_ONCE = 32, 1_000


def outdated(docs: DataFrame, metrics: DataFrame, version: str, key: str = "accession") -> DataFrame:
    """Documents without metrics of this version."""
    return docs.join(metrics.filter(F.col("version") == version).select(key), key, "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extracted rows of a run merged into the table: one row a firm-year of the new, which replace the firm's old rows."""
    return replace_firms(old, consolidate_emissions(new))


def new_events(spark: SparkSession, folder: str, schema: str, key: str, time: str, late: str = "1 day") -> DataFrame:
    """A stream of the files that land in a folder, each key once while its event is within the watermark."""
    return landed(spark, folder, schema).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files that land in a folder of Parquet files, or of the one file at ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


class RetryQueue(StatefulProcessor):
    """Rows that failed wait in state until their timer: ``pause`` seconds, twice as long after each further failure.

    Rows of a group came in one file of failures, after as many attempts (the last column of the group's key), and share a timer, so
    state is asked a few times for a group and not for a row. A row that failed ``most`` times is given up; it stays among the failures.
    """

    def __init__(self, schema: StructType, pause: float, most: int) -> None:
        self.schema, self.pause, self.most = schema, pause, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempts = key[-1]
        if attempts < self.most:
            values = (tuple(r[c] for c in self.schema.names) for r in rows)
            while some := list(islice(values, AT_ONCE)):
                self.waiting.appendList(some)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.pause * 2 ** (attempts - 1)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            for values in self.waiting.get():
                yield Row(**dict(zip(self.schema.names, values)))
            self.waiting.clear()

    def close(self) -> None:
        pass


def retried(failed: DataFrame, key: str, pause: float, most: int = ATTEMPTS) -> DataFrame:
    """A stream of files of failed rows (with ``attempts``, how often) as a stream of the rows that are due to be tried again."""
    schema = StructType([f for f in failed.schema if f.name != "error"])
    group = {"_file": F.col("_metadata.file_path"), "_group": F.pmod(F.xxhash64(key), F.lit(GROUPS))}
    return failed.withColumns(group).drop("error").groupBy("_file", "_group", "attempts").transformWithState(RetryQueue(schema, pause, most), schema, "append", "processingTime")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, failures: str, checkpoint: str, key: str | None = None, pause: float | None = None, most: int = ATTEMPTS, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch: rows whose ``error`` is null to ``out``, the others to ``failures``.

    With a ``key`` each key is written once and for all; the keys that were seen are state. With a ``pause`` (in
    seconds, which needs a key) the rows of ``failures``, as they came in, are read by the same query: they wait
    in state and are transformed again when their timer has run out (see :class:`RetryQueue`), so a rerun touches
    new and failed keys only. ``failures`` then has their number of ``attempts``, and keeps a row for each.

    A batch is transformed and written once, as a table, and split from there. Sinks are folders by batch, written
    over if a batch is run again, so a restart repeats no rows; no batch reads what another wrote to ``out``.
    ``trigger`` is that of the stream. By default it takes all that is available and stops; with a ``pause`` it runs
    until it is stopped, as timers run out only while it does (see :func:`settle`).
    """
    spark, columns = stream.sparkSession, stream.columns
    if pause is not None and key is None:
        raise ValueError("trying again needs a key")
    if key is not None:
        stream = stream.dropDuplicates([key])
    if pause is not None:
        schema = StructType([*stream.schema]).add("error", StringType()).add("attempts", IntegerType())
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(failures)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        failed = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(failures)
        stream = stream.withColumn("attempts", F.lit(0)).unionByName(retried(failed, key, pause, most))

    def write(batch: DataFrame, number: int) -> None:
        if pause is None:
            rows = written(transform(batch), "batch")
            bad = rows.filter("error is not null")
        else:
            # a failed row is kept as it came in, to be transformed once more
            came = batch.withColumn("_came", F.struct(*columns, (F.col("attempts") + 1).alias("attempts"))).drop("attempts")
            rows = written(transform(came), "batch")
            bad = rows.filter("error is not null").select("_came.*", "error")
            rows = rows.drop("_came")
        rows.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{failures}/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a stream starts with a copy of the session's settings
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or ({"availableNow": True} if pause is None else {"processingTime": "0 seconds"}))).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def settle(query: StreamingQuery, seconds: float = float("inf")) -> bool:
    """Stop a query of :func:`ingest` when all that landed is read and no failed row waits, or when the time is over; whether it settled.

    Without a time it settles or fails at last, as rows are given up after some attempts.
    """
    end, done = time.monotonic() + seconds, False
    while not done and query.isActive and time.monotonic() < end:
        time.sleep(0.2)
        last = query.lastProgress
        done = last is not None and not last.numInputRows and not any(s.numRowsTotal for s in last.stateOperators if s.operatorName.startswith("transformWithState"))
    query.stop()
    if query.exception():
        raise query.exception()
    return done


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "1 day", late: str = "2 days", *by: str) -> DataFrame:
    """Counts and sums in windows of event time; works on a stream (with a watermark) and on a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *by, "n", "value")
