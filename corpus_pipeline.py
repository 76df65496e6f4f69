"""A corpus pipeline: language ID, near-duplicate removal, source mixing and packing, in this order.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last
return the columns of ``documents``; the last returns the packed pieces. Rows go to Python in batches of about
``BATCH_BYTES``: Spark's own bound of 64 MB is held several times, by an executor and by each of its workers. It is a
setting of the session and stays, as a stage's result may be lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdantflow.llm import jaccard, language, mixing, packing
from verdantflow.llm.queries import MIX_WEIGHTS
from verdantflow.llm.shared import written

BROADCAST_IDS = 500_000
BATCH_BYTES = 4 << 20
SEED = 7


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _few(df: DataFrame) -> DataFrame:
    """A table of ids, broadcast if a count shows that it is small."""
    df = written(df, "ids")
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, a missing ``lang`` filled in; null texts and texts without a letter go.

    The model learns from four fifths of the labelled documents. Without any label no language is known, and
    only texts without a letter go. Columns of any name beyond those of ``documents`` stay as they are.
    """
    teach = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = language.train(teach)
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    predicted, certainty = _unused(docs, "predicted"), _unused(docs, "certainty")
    found = language.identify(docs, model, lang=predicted, score=certainty).filter(F.col(predicted) != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", predicted)).select(docs.columns)


@_in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; of rows that repeat an id and its text, one.

    Different texts that share the smallest id of a class all stay, as an id alone can't tell them apart; so do
    documents with a null id: nothing tells which of them would stay.
    """
    joined = written(jaccard.ngram_jaccard_join(docs).select("id", "component"), "classes")
    others = _few(joined.filter("id != component").select(F.col("id").alias("doc_id")).distinct())
    kept = docs.join(others, "doc_id", "left_anti")
    repeated = joined.filter("id = component").groupBy("id").count().filter("count > 1").select(F.col("id").alias("doc_id"))
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    digest = _unused(docs, "digest")
    once = kept.join(repeated, "doc_id", "left_semi").withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", digest])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none to two copies each, so that each source comes near its target in words.

    The mix takes a number of words of a document; its copies are that share of its size, rounded up or down
    by a seeded number of its own. Documents with a null id stay as they are.
    """
    mixed = mixing.mix_sources(docs, lambda i: MIX_WEIGHTS[i % len(MIX_WEIGHTS)], seed=SEED)
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.coalesce(F.try_divide(F.col("taken"), F.col("size")), F.lit(0.0)) + draw).cast("int")
    number, copy = _unused(docs, "copies"), _unused(docs, "copy")
    changed = mixed.filter("id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.max(copies).alias(number)).filter(F.col(number) != 1)
    rows = docs.join(_few(changed), "doc_id", "left")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.coalesce(number, F.lit(1))))).select(docs.columns)


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1024 tokens; copies of a document are packed like any other."""
    return packing.best_fit_packing(docs, "byte_bpe_50k.json", kind="byte", end_id=2, capacity=1024)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
