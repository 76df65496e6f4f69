"""What the third review found."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdantflow.functions import text
from verdantflow.operators import documents, selection
from verdantflow.plans import bridge


def test_a_screen_never_broadcasts_texts(spark, tmp_path):
    """exploded texts look no larger than their file, which made them the side that is broadcast."""
    spark.range(300).select(F.col("id").alias("request_id"), F.concat(F.repeat(F.lit("some more words "), 50), F.lit("no Coal but Oil & Gas")).alias("text")).write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame([("sector", "Coal"), ("sector", "Oil & Gas"), ("sector", "Oil"), ("sector", "--"), ("sector", None)], "dimension string, value string").write.parquet(f"{tmp_path}/values")
    asked, values = spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/values")
    rows = []
    for most in (100, 0):
        found = selection.keyword_screen(asked, values.distinct(), most)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next((i for i, line in enumerate(plan) if "BroadcastExchange" in line), None)
        depth = len(plan[at]) - len(plan[at].lstrip(" :+-")) if at is not None else 0
        below = [] if at is None else [line for line in plan[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
        assert (at is None) == (most == 0) and not any("Generate" in line for line in below), plan
        rows.append(sorted(map(tuple, found.collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 900 and {r[2:] for r in rows[0]} == {("Coal", True), ("Oil", False), ("Oil & Gas", False)}


def test_references_without_their_semicolon_stay_if_told(spark):
    """a title that was cut within a reference."""
    df = spark.createDataFrame([("<p>a &amp; b &amp</p><p>&#39;c&#39 &ltd</p>",)], "h string")
    strict, lines, open_ = df.select(text.html_text(F.col("h"), unclosed=False), text.page_lines(F.col("h"), unclosed=False), text.html_text(F.col("h"))).first()
    assert strict.strip() == lines == "a & b &amp\n'c&#39 &ltd" and open_.strip() == "a & b &\n'c' &ltd"


@pytest.mark.parametrize(("name", "scans"), [("recommendations", 4), ("company_view", 1), ("market_inputs", 3), ("validation_table", 1), ("walk_pillars", 1), ("rebalanced_accounts", 4), ("trade_list", 1)])
def test_lines_are_passed_once_for_each_table(spark, monkeypatch, name, scans):
    """tables that a query uses several times are worked out once, and results read them."""
    read, table = [], bridge.table
    monkeypatch.setattr(bridge, "table", lambda s, d, t: read.append(t) or table(s, d, t))
    out = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert read.count("lineitem") == scans and "lineitem.parquet" not in out._jdf.queryExecution().executedPlan().toString()


def test_glossiness_shuffles_no_tokens(spark):
    """F8: and texts without segments, or null, are 0."""
    docs = spark.createDataFrame([(1, "green tokens here and tion there\nnothing of the kind, whatsoever\ngreen green green green wind"), (2, ""), (3, None)], "accession long, text string")
    out = documents.glossiness(docs, {"green": 1.0, "wind": 1.0}, "\n", terms=("green",), positive=("wind",), negative=("kind",))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.accession: (r.n_segments, round(r.share, 6), r.tone) for r in out.collect()}
    assert got == {1: (3, 0.666667, 1.0), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    both = docs.select("accession", text.cosine(F.col("text"), {"green": 1.0, "wind": 2.0, "two words": 1.0}).alias("c")).join(documents.vocabulary_cosine(docs, {"green": 1.0, "wind": 2.0, "two words": 1.0}), F.col("id") == F.col("accession"))
    assert all(abs(r.c - r.cosine) < 1e-12 for r in both.collect()) and both.count() == 3


def test_contexts_of_a_document_are_cut_once(spark):
    """tone and both shares stand on the same contexts."""
    docs = spark.createDataFrame([(1, "we will cut carbon emissions and improve"), (2, "no such thing"), (3, None)], "accession long, text string")
    one = docs.select(text.context_measures(F.col("text"), forward=("will",), realised=("achieved",)).alias("m"))
    assert one._jdf.queryExecution().executedPlan().toString().count("split(") == 1
    assert [tuple(r.m)[1:] for r in one.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    plan = documents.document_metrics(docs).select("tone.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower") + plan.count("split(namedlambda") + plan.count("split(lambda") == 1
