"""Sources, sinks and the entry module."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from plinth.sources import tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "x int, s string, target int")
    tables.write_csv(df, f"{tmp_path}/c", "target")
    features, target = tables.read_csv(spark, f"{tmp_path}/c", target="target")
    assert features.columns == ["x", "s"] and sorted(r[0] for r in target.collect()) == [0, 1]
    with pytest.raises(ValueError):
        tables.read_csv(spark, f"{tmp_path}/c", target="nope")


def test_experiments_flatten_and_skip_bad_files(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    tables.log_experiment(spark, folder, "one", {"depth": "3"}, {"accuracy": 0.9})
    tables.log_experiment(spark, folder, "two", {"depth": "4"}, {"accuracy": 0.8, "auc": 0.7})
    (tmp_path / "runs" / "bad.json").write_text("{not json")
    rows = {r["name"]: r for r in tables.read_experiments(spark, folder).collect()}
    assert rows["one"]["param_depth"] == "3" and rows["one"]["metric_auc"] is None and rows["two"]["metric_accuracy"] == 0.8 and len(rows) == 2


def test_latest_interactions(spark):
    df = spark.createDataFrame([(1, 1, 5, 1), (1, 1, 7, 2), (1, 2, 1, 3)], "u int, i int, t int, k int")
    assert sorted(tuple(r) for r in tables.latest_interactions(df, "u", "i", "t", "k").collect()) == [(1, 1, 7, 2), (1, 2, 1, 3)]


def test_durable_tables(spark):
    df = tables.durable(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()


def test_entry_module_loads_without_a_session():
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[-1]) > 200
