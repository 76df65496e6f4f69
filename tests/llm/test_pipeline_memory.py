"""What executors and their Python workers hold while the pipeline runs."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from verdantflow.llm import shared, tokens


def test_stages_send_texts_in_small_batches(spark):
    """batches of up to 64 MB were held by the executor and by each worker at once."""
    text = F.repeat(F.concat(F.lit("some words of number "), F.col("id").cast("string"), F.lit(" ")), 400)
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in cp.STAGES:
        spark.conf.unset(name)
        stage(spark, docs.limit(0), "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in sizes) == 3000 and sum(r.size for r in sizes) > 25_000_000
        assert max(r.size for r in sizes) < 2 * cp.BATCH_BYTES
    spark.conf.unset(name)


def test_a_worker_drops_the_tokenizer_of_earlier_tasks():
    """a stage's tokenizer and known units stayed in the workers while the other stages ran."""
    batch = pa.RecordBatch.from_pydict({"text": ["some words"]})
    first = tokens.encoder("byte_bpe_50k.json", "byte")
    assert list(shared.slices(iter([batch]), "text", hold=True)) == [batch]
    assert tokens.encoder("byte_bpe_50k.json", "byte") is first
    assert list(shared.slices(iter([batch]), "text")) == [batch]
    assert tokens.encoder("byte_bpe_50k.json", "byte") is not first
