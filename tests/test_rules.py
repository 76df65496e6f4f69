"""All rules of a table from one scan."""

from pyspark.sql import functions as F

from verdantflow.quality import rules

KEYS = ["firm_id", "year"]
ROWS = [("a", 2020, 1.0, 0), ("a", 2020, 1.0, 0), ("b", 2021, -1.0, 3), ("b", 2021, -1.0, 3), (None, 2022, None, 1), ("c", None, float("nan"), None)]
SCHEMA = "firm_id string, year int, x double, flag int"


def _audited(df, universe):
    return rules.audit(df, "t", KEYS, rules.null_test(["x", "flag"]), rules.range_test({"x": (0.0, 10.0)}), rules.flag_test(["flag"]), rules.finite_test(["x"]), unique=KEYS, count=(1, 5), universe=universe)


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("table", "rule", "key", "message").collect())


def test_audit_is_the_union_of_its_rules(spark):
    df, universe = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "firm_id string")
    found = _rows(_audited(df, universe))
    one_by_one = rules.all_of(
        rules.not_null(df, "t", KEYS, ["x", "flag"]), rules.ranges(df, "t", KEYS, {"x": (0.0, 10.0)}), rules.flags(df, "t", KEYS, ["flag"]), rules.finite(df, "t", KEYS, ["x"]),
        rules.unique(df, "t", KEYS), rules.row_count(df, "t", 1, 5), rules.known_firms(df, "t", universe),
    )
    assert found == _rows(one_by_one)
    assert found.count(("t", "ranges", "b|2021", "x")) == 2  # findings of repeated rows stay
    assert ("t", "unique", "a|2020", "2 rows") in found and ("t", "row_count", "6", "too many rows") in found
    assert ("t", "known_firms", "None", "not in the universe") in found and ("t", "not_null", "c|?", "flag") in found


def test_audit_of_an_empty_table(spark):
    df, universe = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "firm_id string")
    assert _rows(_audited(df, universe)) == [("t", "row_count", "0", "too few rows")]


def test_audit_scans_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    universe = spark.createDataFrame([("a",)], "firm_id string")
    plan = _audited(spark.read.parquet(path), universe)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    rows_only = rules.audit(spark.read.parquet(path), "t", KEYS, rules.null_test(["x"]), rules.range_test({"x": (0.0, None)}))._jdf.queryExecution().executedPlan().toString()
    assert rows_only.count("FileScan parquet") == 1 and "Exchange" not in rows_only


def test_findings_are_counted_on_the_way(spark, tmp_path):
    df, seen = rules.observed(spark.createDataFrame(ROWS, SCHEMA), "t", rules.null_test(["x"]), rules.range_test({"x": (0.0, None)}), rules.null_test(["flag"]))
    df.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"rows": 6, "not_null": 2, "ranges": 2}
    empty, seen = rules.observed(df.limit(0).select(F.col("x")), "u", rules.finite_test(["x"]))
    empty.write.parquet(str(tmp_path / "u"))
    assert seen.get == {"rows": 0, "finite": 0}
