"""Searches by the trigram index find what a scan of all texts finds."""

import itertools
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verdantflow.operators import selection, trigrams

NAMES = ["Green Power", "green powder", "Grüne Energie", "力新國際科技股份有限公司", "a", "ab", "", None, "aaa", "x😀y", "GREEN  HOUSE", "50% [water].*", "ab"]
COLUMNS = ["firm_id", "name"]


@pytest.fixture(scope="module")
def firms(spark):
    rows = [(f"{n:04d}.HK", name, "z") for n, name in enumerate(NAMES)] + [("0001.HK", "another row of an id", "z"), (None, "green without an id", "z")]
    return spark.createDataFrame(rows, "firm_id string, name string, gram string")


@pytest.fixture(scope="module")
def index(firms):
    return trigrams.build(firms, COLUMNS)


QUERIES = ["green", "GREEN p", "pow", "en", "a", "😀", "國際", "國際科", ".hk", "0001", "zzz", "q", "% [", "  h", "aaaa", "hkg", "k"]


def test_search_agrees_with_a_scan(firms, index):
    known = firms.filter("firm_id is not null")
    for q in QUERIES:
        assert trigrams.search(index, q, 100).collect() == selection.search(known, q, 100).collect() or sorted(trigrams.search(index, q, 100).collect()) == sorted(selection.search(known, q, 100).collect()), q
    for q in ("green hk", "a b", "po 00", "none green"):
        assert sorted(map(str, trigrams.search_all_words(index, q).collect())) == sorted(map(str, selection.search_all_words(known, q, COLUMNS).collect())), q
    assert trigrams.search_all_words(index, " ").count() == len(NAMES) + 2


def test_many_searches_at_once(spark, firms, index):
    asked = spark.createDataFrame([*enumerate(QUERIES), (90, ""), (91, None), (92, "green"), (93, "Green")], "query_id int, q string")
    found = sorted(map(tuple, trigrams.search_many(index, asked).collect()))
    rows = [r for r in firms.collect() if r.firm_id]
    want = {(i, r.firm_id) for (i, q), r in itertools.product([*enumerate(QUERIES), (92, "green"), (93, "green")], rows) if any(q.lower() in (x or "").lower() for x in (r.firm_id, r.name))}
    assert found == sorted(want)


def test_an_empty_table(spark, firms):
    index = trigrams.build(firms.limit(0), COLUMNS)
    assert trigrams.search(index, "green").count() == 0 and trigrams.search(index, "g").count() == 0
    assert trigrams.search_many(index, spark.createDataFrame([(1, "green")], "query_id int, q string")).count() == 0


def test_a_search_reads_the_postings_of_its_gram(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("firm_id"), F.concat(F.lit("common "), F.md5(F.col("id").cast("string"))).alias("name"))
    index = trigrams.build(df, ["name"], folder=str(tmp_path))
    ids, n = trigrams.candidates(index, "common 1a2b")
    assert 0 < n < 2_000 and ids.count() == n  # rarest gram, not one that all rows have
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(gram" in plan
    files = [pq.ParquetFile(f) for f in tmp_path.glob("postings/*.parquet")]
    ranges = sorted((s.min, s.max) for f in files for k in range(f.num_row_groups) for s in [f.metadata.row_group(k).column(0).statistics])
    assert len(files) > 1 and all(a[1] <= b[0] for a, b in itertools.pairwise(ranges))  # each file holds a range of grams of its own
    assert trigrams.read(df, ["name"], str(tmp_path)).counts.count() == index.counts.count()
    q = df.filter("firm_id = '777'").first().name[10:16]
    assert "777" in [r.firm_id for r in trigrams.search(index, q).collect()]


def test_many_candidates_are_joined(monkeypatch, firms, index):
    few = sorted(map(str, trigrams.search(index, "hk", 100).collect()))
    monkeypatch.setattr(trigrams, "LOOKED_UP", 0)
    assert sorted(map(str, trigrams.search(index, "hk", 100).collect())) == few and len(few) == len(NAMES) + 1


def test_more_rows_make_more_tasks_not_larger_ones(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(trigrams, "PIECE", 2_000, raising=False)
    ids = spark.range(2_000).select((F.col("id") % 1_900).cast("string").alias("firm_id"), F.concat(F.lit("all "), F.md5(F.col("id").cast("string"))).alias("name"))
    index = trigrams.build(ids, ["name"], folder=str(tmp_path))
    n = index.postings.count()
    assert n == index.postings.distinct().count() and len(list(tmp_path.glob("postings/*.parquet"))) >= n // 4_000  # some ids are repeated
    assert not (tmp_path / "grams").exists()
    asked = spark.createDataFrame([(k, f"{k:02x}") for k in range(256)] + [(k, "all") for k in range(300, 310)], "query_id int, q string")
    found = trigrams.search_many(index, asked)
    parts = [int(k) for k in re.findall(r"hashpartitioning\(id#\d+, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())]
    assert max(parts) >= 20  # some 60,000 pairs
    want = ids.crossJoin(asked).filter(F.contains("name", "q")).select("query_id", F.col("firm_id").alias("id")).distinct()
    assert found.count() == want.count() and found.exceptAll(want).count() == 0
