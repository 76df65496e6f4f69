"""Substring search by an index of trigrams: tables of postings, of counts, and of the rows themselves.

Every place of a row's text begins a gram of three characters (fewer at its end). A row that contains a text contains
each of its grams, so the postings of the rarest of them hold all rows that can match, and these alone are
compared with the text. A text of one or two characters is met by all grams that begin with it.

Postings are rows ``gram, id`` in order of both: a file and a row group hold a narrow range of grams, so a filter
on grams is pushed to the scan and skips the rest, and a gram that most rows have is spread over many files and tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdantflow.shared import new_path, written

GRAM = 3
#: Between the columns of a row, so that no gram of a text without it spans two of them.
BETWEEN = "\u0001"
#: Candidates up to this number are looked up in the table of rows by a pushed filter, more of them by a join.
LOOKED_UP = 1_000
#: Grams, postings or pairs that one task sorts or tells apart: more rows make more tasks, not larger ones.
PIECE = 1_000_000
#: Up to so many partitions Spark's shuffle writes rows to their files at once, beyond it holds them in memory first.
MOST = 200


@dataclass(frozen=True)
class Index:
    """``rows``: the table itself; ``postings``: ``gram, id``; ``counts``: ``gram, n`` rows that have it, in order of the gram."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame
    columns: tuple[str, ...]
    id_col: str


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // PIECE))


def _text(columns) -> Column:
    return F.lower(F.concat_ws(BETWEEN, *(F.col(c).cast("string") for c in columns)))


def _grams(text: Column) -> Column:
    """Distinct grams of a text, one for each place, in one pass over its characters."""

    def at(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.array_join(F.slice(chars, i + 1, GRAM), ""))

    return F.when(F.length(text) > 0, F.array_distinct(F.element_at(F.transform(F.array(F.split(text, "")), at), 1)))


def build(df: DataFrame, columns: list[str], id_col: str = "firm_id", folder: str | None = None) -> Index:
    """Write the index of ``columns`` to ``folder`` (one in the shared folder unless given).

    Null columns hold no text; rows without text have no postings and match nothing; rows without an id are kept in ``rows`` but aren't
    found. Repeated ids share postings, and every one of their rows is compared by itself. Rows of an id come together before their
    texts are cut, so their grams are told apart within tasks of about ``PIECE`` places.
    """
    spark, path = df.sparkSession, folder or new_path(df.sparkSession, "trigrams")
    df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    texts = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _text(columns).alias("text"))
    places = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = texts.repartition(_tasks(spark, places), "id")
    texts.select(F.explode(_grams(F.col("text"))).alias("gram"), "id").distinct().write.mode("overwrite").parquet(f"{path}/grams")
    grams = spark.read.parquet(f"{path}/grams")  # cut once, though ranges are sampled first
    grams.repartitionByRange(min(MOST, _tasks(spark, grams.count())), "gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")
    unsorted = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/grams")
    unsorted.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(unsorted, True)
    return read(df, columns, path, id_col)


def read(df: DataFrame, columns: list[str], folder: str, id_col: str = "firm_id") -> Index:
    """An index that ``build`` wrote; counts are written by the first reader. ``df`` gives the schema."""
    spark = df.sparkSession
    postings = spark.read.parquet(f"{folder}/postings")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts/_SUCCESS")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.schema("gram string, n long").parquet(f"{folder}/counts")
    return Index(spark.read.schema(df.schema).parquet(f"{folder}/rows"), postings, counts, tuple(columns), id_col)


def _own_grams(q: str) -> list[str]:
    return sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})


def candidates(index: Index, *words: str) -> tuple[DataFrame, int]:
    """``id`` of the rows that can contain all of the words (in lower case), and a bound on their number.

    Reads the counts of the words' own grams, then the postings of the rarest gram of the rarest word. A word shorter than a gram
    has no gram of its own, and is used only if there is no longer one.
    """
    grams = sorted({g for w in words for g in _own_grams(w)})
    if grams:
        told = {r["gram"]: r["n"] for r in index.counts.filter(F.col("gram").isin(grams)).collect()}  # one row a gram of the words
        rarest = min(grams, key=lambda g: (told.get(g, 0), g))
        return index.postings.filter(F.col("gram") == rarest).select("id"), told.get(rarest, 0)
    longest = max(words, key=len)
    begins = F.col("gram").startswith(longest)
    n = index.counts.filter(begins).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return index.postings.filter(begins).select("id").distinct(), n


def _rows(index: Index, *words: str) -> DataFrame:
    """The rows of the candidates: by a pushed filter on ids in order if they are few, else by a semi join."""
    ids, n = candidates(index, *words)
    if n <= LOOKED_UP:
        return index.rows.filter(F.col(index.id_col).isin([r["id"] for r in ids.collect()]))
    return index.rows.join(ids.withColumnRenamed("id", index.id_col), index.id_col, "left_semi")


def search(index: Index, q: str, limit: int = 20) -> DataFrame:
    """As ``selection.search`` over the indexed columns: rows of which one column contains the text, in order of the id; the empty
    text is in every row that has a column that isn't null."""
    q, held = q.lower(), F.lit(False)
    for c in index.columns:
        held |= F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
    return (_rows(index, q) if q else index.rows).filter(held).orderBy(index.id_col).limit(limit)


def search_all_words(index: Index, q: str) -> DataFrame:
    """As ``selection.search_all_words``: rows whose indexed columns together contain every word; without words, all rows."""
    words = q.lower().split()
    if not words:
        return index.rows
    text, keep = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in index.columns))), F.lit(True)
    for w in words:
        keep &= F.contains(text, F.lit(w))
    return _rows(index, *words).filter(keep)


def search_many(index: Index, queries: DataFrame, query_id: str = "query_id", query: str = "q") -> DataFrame:
    """``query_id, id`` for each query and row of which one column contains the query's text: a table of searches at once.

    Each query looks up the counts of its grams, keeps the rarest (all grams that begin with it, if it is shorter than one), and
    meets the postings of that gram alone; the pairs are then compared with the texts. Null and empty queries find
    nothing. A gram that many queries and rows share is split by adaptive skew handling, as its postings are rows. Equal texts
    are searched once. Counts tell how many pairs there will be, and so the number of tasks that compare them.
    """
    q = F.lower(F.col(query))
    asked = queries.filter(F.length(q) > 0).select(F.col(query_id).alias("query_id"), q.alias("q"))
    texts = asked.select("q").distinct()
    long = texts.filter(F.length("q") >= GRAM)
    # grams at the end of the text are shorter, and no row needs to have them
    own = long.select("q", F.explode(F.filter(_grams(F.col("q")), lambda g: F.length(g) == GRAM)).alias("gram"))
    rarest = own.join(index.counts, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("q", "r.gram", "r.n")
    begins = index.counts.select("gram", "n", F.explode(F.array(*(F.substring("gram", 1, k) for k in range(1, GRAM)))).alias("q")).distinct()
    short = texts.filter(F.length("q") < GRAM).join(begins, "q")
    sought = written(rarest.unionByName(short.select("q", "gram", "n")), "sought")  # its size is known, so if small it is sent to the postings
    pairs = sought.agg(F.sum("n")).first()[0] or 0
    tasks = min(MOST, _tasks(queries.sparkSession, pairs + index.rows.count()))
    met = sought.join(index.postings, "gram").select("q", "id").repartition(tasks, "id")
    parts = index.rows.select(F.col(index.id_col).alias("id"), F.array(*(F.lower(F.col(c).cast("string")) for c in index.columns)).alias("parts")).repartition(tasks, "id")
    # several grams of a short text, and several rows of an id, meet in one task: it keeps each pair once
    found = met.join(parts.hint("merge"), "id").filter(F.exists("parts", lambda p: F.contains(p, F.col("q")))).select("q", "id").distinct()
    return asked.join(found, "q").select("query_id", "id")
