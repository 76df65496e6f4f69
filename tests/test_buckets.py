"""Tables in buckets of their keys meet without a shuffle."""

import uuid

import pytest

from verdantflow.sources import tables

KEYS = ["firm_id", "year"]
LEFT = [(f"f{k % 7}", 2000 + k % 5, float(k)) for k in range(200)] + [(None, 2000, 1.0), ("f1", None, 2.0)]
RIGHT = [(f"f{k}", 2000 + y, f"n{k}") for k in range(7) for y in range(5)]


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_joins_and_groups_of_buckets_have_no_exchange(plain, tmp_path):
    left, right = plain.createDataFrame(LEFT, "firm_id string, year int, x double"), plain.createDataFrame(RIGHT, "firm_id string, year int, name string")
    a, b = tables.write_bucketed(left, KEYS, 8, path=str(tmp_path / "a")), tables.write_bucketed(right, KEYS, 8, path=str(tmp_path / "b"))
    joined = a.join(b, KEYS)
    assert _exchanges(joined) == 0 and _exchanges(left.join(right, KEYS)) > 0
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, KEYS).collect()))
    assert _exchanges(joined.groupBy(*KEYS).count()) == 0
    assert _exchanges(a.join(right, KEYS)) == 1  # the side in buckets stays where it is
    assert a.filter("firm_id is null or year is null").count() == 2
    again = tables.open_bucketed(plain, str(tmp_path / "a"), "firm_id string, year int, x double", KEYS, 8)
    assert _exchanges(again.join(b, KEYS)) == 0 and again.count() == len(LEFT)


def test_a_year_is_split_over_files(plain, tmp_path):
    left = plain.createDataFrame([(f"f{k}", 2000 + k % 2, float(k)) for k in range(400)], "firm_id string, year int, x double")
    path, name = str(tmp_path / "it's"), f"named_{uuid.uuid4().hex}"
    t = tables.write_bucketed(left, ["firm_id"], 8, by="year", name=name, path=path)
    for year in (2000, 2001):
        assert len(list((tmp_path / "it's" / f"year={year}").glob("*.parquet"))) == 8
    one = t.filter("year = 2001")
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 200
    again = tables.open_bucketed(plain, path, "firm_id string, x double, year int", ["firm_id"], 8, by="year")
    assert _exchanges(again.join(t, "firm_id")) == 0 and again.count() == 400
    assert plain.table(name).count() == 400


def test_an_empty_table(plain):
    t = tables.write_bucketed(plain.createDataFrame([], "firm_id string, year int, x double"), KEYS, 4)
    assert t.count() == 0 and t.columns == ["firm_id", "year", "x"]
