"""Results that don't depend on the size of Arrow batches, and repeated rows that don't meet in one task."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from verdantflow.llm import lm, shared, tokenfiles


def test_slices_have_at_most_so_many_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x"] * 200_000})
    sizes = [b.num_rows for b in shared.slices(iter([batch]), "text")]
    assert sum(sizes) == 200_000 and max(sizes) <= 1 << 16


def test_scores_are_equal_for_any_batch_size(spark, tmp_path):
    rng = random.Random(8)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(2))) for i in range(90_000)], "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path).withColumn("target", F.col("doc_id") % 3 == 0)
    found = []
    for size in ("10000", "200000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(lm.cross_entropy_difference(docs, F.col("target")).toPandas().sort_values("id", ignore_index=True))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0].equals(found[1]) and len(found[0]) == 90_000


def test_equal_rows_are_parted_over_token_files(spark, tmp_path):
    spark.createDataFrame([(5, "same text here")] * 4000 + [(i, "x") for i in range(5)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    tokenfiles.write_tokens(spark.read.parquet(str(tmp_path / "docs")).repartition(4), str(tmp_path / "out"), "word_bpe_49k.json", kind="word", end_id=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfiles.write_tokens(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "parted"), "word_bpe_49k.json", kind="word", end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {r.f: r["count"] for r in spark.read.parquet(str(tmp_path / "parted")).groupBy(F.input_file_name().alias("f")).count().collect()}
    assert sum(files.values()) == 4005 and len(files) > 3 and max(files.values()) < 2000
    got = [tuple(r) for r in tokenfiles.token_digests(spark, str(tmp_path / "parted")).orderBy("start").collect()]
    at = 0
    for i, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_copies_of_a_vector_leave_few_survivors(spark, monkeypatch):
    from verdantflow.llm import topk

    rng = random.Random(4)
    rows = [(i, [rng.randrange(-100, 100) for _ in range(6)]) for i in range(300)] + [(1000 + i, [90] * 6) for i in range(4000)] + [(50, [90] * 6)] * 9
    seen = []
    monkeypatch.setattr(topk, "written", lambda df, label, *a, f=topk.written: seen.append((label, f(df, label, *a))) or seen[-1][1])
    schema = "id long, vector array<long>"
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk.exact_top_k(spark.createDataFrame(queries, schema), spark.createDataFrame(rows, schema), 3).collect()
    want = sorted((q, r + 1, i, -s) for q, v in queries for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, e)), i) for i, e in rows if i != q)[:3]))
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == want
    survivors = dict(seen)["survivors"].count()
    assert survivors <= len(queries) * (300 + 4 + 3)


def test_empty_texts_meet_in_no_window(spark, tmp_path):
    from verdantflow.llm.mixing import mix_sources

    rows = [(i, "", "empty") for i in range(3000)] + [(9000 + i, "a b c " * (i % 40), "full") for i in range(200)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    mixed = mix_sources(spark.read.parquet(str(tmp_path / "docs")), lambda i: 1).collect()
    assert len(mixed) == len(rows) and all(r.taken == 0 for r in mixed if r.size == 0)
    assert abs(sum(r.taken for r in mixed) - max(r.target for r in mixed if r.source == "full")) <= 1
