"""Versions: what readers see while writers come, are killed, or race."""

import pytest
from pyspark.sql import functions as F

from sparkspec.config import Clustering
from sparkspec.plans.analyze import analyze
from sparkspec.sources.versions import MANIFEST, Versions, write_analysis


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/runs")
    with pytest.raises(FileNotFoundError):
        store.read("A")
    assert store.write({"A": spark.range(3), "B": spark.range(1)}, run="first") == 1
    broken = spark.range(5).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("killed"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        store.write({"A": spark.range(9), "B": broken})
    assert store.committed() == [1] and _ids(store.read("A")) == [0, 1, 2] and store.manifest()["run"] == "first"
    assert store.write({"A": spark.range(4)}) == 3
    assert _ids(store.read("A")) == [0, 1, 2, 3] and _ids(store.read("A", 1)) == [0, 1, 2]
    assert _ids(store.read("B")) == [0]  # the newest version that holds it
    with pytest.raises(FileNotFoundError):
        store.read("A", 2)
    assert store.manifest(3)["tables"] == {"A": {"rows": 4, "columns": ["id"]}}
    assert sorted(tuple(r) for r in store.history("A").groupBy("version").count().collect()) == [(1, 3), (3, 4)]
    assert store.sweep(3600) == [] and store.sweep(0) == [2] and store.committed() == [1, 3]


def test_two_writers_get_numbers_of_their_own(spark, tmp_path):
    a, b = Versions(spark, f"{tmp_path}/runs"), Versions(spark, f"{tmp_path}/runs")
    seen = a._numbers
    first = a.claim()
    b._numbers = lambda: []  # as if it had listed before the other claimed
    assert {first, b.claim()} == {1, 2} and seen() == [1, 2] and a.committed() == []
    assert not (tmp_path / "runs/v=1" / MANIFEST).exists()


def test_an_analysis_as_a_version(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")
    rows = [("a", i, {"Fe": 0.5 + i / 1000, "O": 0.5 - i / 1000}, 0 if i < 8 else 5, 0.0) for i in range(10)] + [("b", i, {"Fe": 0.4 + i / 1000, "O": 0.6 - i / 1000}, 0, 0.0) for i in range(8)]
    df = spark.createDataFrame([(s, i, f, f, q, e) for s, i, f, q, e in rows], "sample_id string, spectrum_id long, at_fr map<string,double>, w_fr map<string,double>, quant_flag int, an_err double")
    store = Versions(spark, f"{tmp_path}/runs")
    done = analyze(df, ["Fe", "O"], Clustering(k=1, ref_formulae=("FeO",)))
    n = write_analysis(store, done, ["Fe", "O"], settings="one cluster")
    assert store.read("Data").count() == 18 and store.read("Clusters").count() == 2 and store.read("Failed").count() == 0
    assert {(r.sample_id, r["count"]) for r in store.read("Compositions").groupBy("sample_id").count().collect()} == {("a", 8)}
    assert store.manifest(n)["settings"] == "one cluster"
    write_analysis(store, analyze(df.where("sample_id = 'b'"), ["Fe", "O"], Clustering(k=1)), ["Fe", "O"])
    assert "Compositions" not in store.manifest()["tables"]
