"""Keyed ingestion: restarts, failed keys that are tried again, batches that read no earlier output."""

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdantflow.streaming import incremental

SCHEMA = "url string, text string"


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def paths(tmp_path):
    return [str(tmp_path / x) for x in ("land", "out", "failed", "point")]


def told(spark, path):
    return sorted(r.url for r in spark.read.schema(SCHEMA).parquet(path).collect())


def test_a_failed_key_is_tried_again_after_its_pause(spark, tmp_path):
    land_, out, bad, point = paths(tmp_path)
    land(spark, land_, ("a", "x"), ("b", "broken once"), ("c", "broken"), ("a", "x"))
    tries = []

    def transform(b):
        tries.append(sorted(r.url for r in b.select("url").collect()))
        again = F.col("_came.attempts") > 1
        return b.withColumn("error", F.when((F.col("text") == "broken") | ((F.col("text") == "broken once") & ~again), "unreadable"))

    def run():
        query = incremental.ingest(incremental.landed(spark, land_, SCHEMA), transform, out, bad, point, "url", pause=0.05, most=3)
        assert incremental.settle(query, 120)

    run()
    land(spark, land_, ("b", "broken once"), ("d", "new"))
    run()
    assert told(spark, out) == ["a", "b", "d"]
    assert sum("a" in t for t in tries) == 1 and sum("b" in t for t in tries) == 2 and sum("c" in t for t in tries) == 3
    kept = sorted((r.url, r.attempts, r.error, r.text) for r in spark.read.schema(f"{SCHEMA}, attempts int, error string").parquet(bad).collect())
    assert kept == [("b", 1, "unreadable", "broken once"), *(("c", k, "unreadable", "broken") for k in (1, 2, 3))]


def test_a_restart_goes_on_where_it_stopped_without_earlier_output(spark, tmp_path):
    land_, out, bad, point = paths(tmp_path)

    def run():
        stream = incremental.landed(spark, land_, SCHEMA)
        incremental.ingest(stream, lambda b: b.withColumn("error", F.when(F.col("text") == "broken", "bad")), out, bad, point, "url").awaitTermination()

    land(spark, land_, ("a", "x"), ("b", "broken"))
    run()
    moved = tmp_path / "moved"
    (tmp_path / "out").rename(moved)  # what was written isn't read again
    land(spark, land_, ("a", "again"), ("c", "y"), ("b", "again"))
    run()
    assert told(spark, str(moved)) == ["a"] and told(spark, out) == ["c"] and told(spark, bad) == ["b"]


def test_cost_of_a_batch_does_not_grow(spark, tmp_path):
    land_, out, bad, point = paths(tmp_path)
    for k in range(12):
        land(spark, land_, *((f"u{k}-{i}", "x") for i in range(20)), ("u0-0", "x"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(land_)
    query = incremental.ingest(stream, lambda b: b.withColumn("error", F.lit(None).cast("string")), out, bad, point, "url")
    query.awaitTermination()
    read = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert len(read) == 12 and max(read) <= 21 and len(told(spark, out)) == 240


class State:
    """What a processor asks of its state, counted."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, [], []

    def __getattr__(self, name):
        def asked(*given):
            self.calls += 1
            if name in ("getListState", "getValueState"):
                return self
            if name in ("appendList", "update"):
                self.held += given[0] if name == "appendList" else given
            if name == "registerTimer":
                self.timers += given
            if name == "clear":
                self.held = []
            return {"exists": bool(self.held), "get": list(self.held), "getCurrentProcessingTimeInMs": 1000, "listTimers": []}.get(name)

        return asked


def test_waiting_rows_ask_state_by_the_group(spark):
    schema = StructType.fromDDL(f"{SCHEMA}, attempts int")
    state, queue = State(), incremental.RetryQueue(schema, 2.0, 3)
    queue.init(state)
    rows = [Row(url=f"u{k}", text=None, attempts=2) for k in range(5_000)]
    assert not list(queue.handleInputRows(("file", 7, 2), iter(rows), state)) and state.timers == [5000]
    assert list(queue.handleExpiredTimer(("file", 7, 2), state, None)) == rows and not state.held
    assert state.calls < 20
    list(queue.handleInputRows(("file", 7, 3), iter(rows), state))
    assert not state.held and state.timers == [5000]  # given up


def test_many_rows_wait_for_their_pause(spark, tmp_path):
    land_, out, bad, point = paths(tmp_path)
    land(spark, land_, *((f"u{k}", "broken once" if k % 3 else "x") for k in range(3_000)))
    transform = lambda b: b.withColumn("error", F.when((F.col("text") == "broken once") & (F.col("_came.attempts") < 2), "unreadable"))
    query = incremental.ingest(incremental.landed(spark, land_, SCHEMA), transform, out, bad, point, "url", pause=4.0)
    assert incremental.settle(query)
    assert told(spark, out) == sorted(f"u{k}" for k in range(3_000)) and len(told(spark, bad)) == 2_000
