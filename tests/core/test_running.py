"""The quota source and running state: rounds, restarts, stop rules and idle samples."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkspec.config import Clustering
from sparkspec.functions.chemistry import parse_formula
from sparkspec.operators import refs
from sparkspec.plans.analyze import analyze
from sparkspec.streaming.running import PHASES, QuotaReader, Rounds, _joined, enqueue, running_phases


def test_joined_statistics():
    rng = np.random.default_rng(0)
    x = rng.normal(5, 1, (40, 3))
    got = None
    for part in (x[:1], x[1:7], x[7:]):
        m = part.mean(axis=0)
        got = _joined(got, len(part), m, float(((part - m) ** 2).sum()))
    assert got[0] == 40 and np.allclose(got[1], x.mean(axis=0)) and got[2] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def _points(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s, (n, spread) in sizes.items():
        for i in range(n):
            c = int(rng.integers(0, 2))
            fr = rng.normal([0.4, 0.6] if c else [0.6, 0.4], spread).tolist()
            rows.append((s, i, c, fr))
    return spark.createDataFrame(rows, "sample_id string, spectrum_id long, cluster_id int, fr array<double>"), rows


def _expected(rows, least, most, step):
    """Rounds of each sample by the rules, from all its spectra at once."""
    out = set()
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])[:most]
        for turn in range(-(-len(mine) // step)):
            seen = mine[: (turn + 1) * step]
            rms = [np.sqrt(np.mean(((x - x.mean(axis=0)) ** 2).sum(axis=1))) for c in {r[2] for r in seen} for x in [np.array([r[3] for r in seen if r[2] == c])]]
            fine = max(rms) < 0.025
            done = (fine and len(seen) >= least) or len(seen) >= most or len(seen) == len(mine)
            out.add((s, turn, len(seen) - turn * step, len(seen), len(rms), round(max(rms), 9), done))
            if done:
                break
    return out


def _rows(rounds):
    return {(r.sample_id, r.round, r.admitted, r.n_results, r.n_clusters, round(r.max_rms, 9), r.done) for r in rounds.verdicts().collect()}


def test_rounds_and_restart(spark, tmp_path):
    sizes = {"tight": (60, 0.01), "wide": (60, 0.05), "short": (13, 0.05), "edge": (30, 0.05), "one": (1, 0.0)}
    df, rows = _points(spark, sizes)
    odd = spark.createDataFrame([(None, 1, 0, [0.5, 0.5]), ("wide", 99, 0, None), ("wide", 98, None, [0.5, 0.5])], df.schema)
    whole, parted = f"{tmp_path}/whole", f"file://{tmp_path}/parted"
    for at in (whole, parted):
        enqueue(df.unionAll(odd), at, quota=10, least=20, most=45)
    once = Rounds(spark, whole, least=20, most=45)
    once.run()
    want = _expected(rows, 20, 45, 10)
    assert _rows(once) == want and once.ended() and {r[0] for r in want if r[6]} == set(sizes)
    first = Rounds(spark, parted, least=20, most=45)
    first.run(most_rounds=2)
    assert 2 <= first.rounds and not first.ended()
    # offsets, state and open samples come back from the store
    again = Rounds(spark, parted, least=20, most=45)
    again.run()
    assert first.rounds + again.rounds == 5 and _rows(again) == want
    after = Rounds(spark, parted, least=20, most=45)
    after.run()
    assert after.rounds == 0 and _rows(after) == want


def test_quota_is_the_least(spark, tmp_path):
    df, rows = _points(spark, {"a": (9, 0.05), "b": (5, 0.05)})
    enqueue(df, f"{tmp_path}/q", quota=10, least=4, most=100)
    rounds = Rounds(spark, f"{tmp_path}/q", least=4, most=100)
    assert QuotaReader(f"{tmp_path}/q").latestOffset() == {"round": 1}
    rounds.run()
    assert _rows(rounds) == _expected(rows, 4, 100, 4)


def test_a_round_runs_again_with_the_same_rows(spark, tmp_path):
    """A round that was judged but not committed by Spark reads and writes what it did before."""
    df, _ = _points(spark, {"a": (60, 0.05), "b": (60, 0.01)})
    enqueue(df, f"{tmp_path}/q", least=10, most=50)
    rounds = Rounds(spark, f"{tmp_path}/q", least=10, most=50)
    rounds.run(most_rounds=2)
    reader = QuotaReader(f"{tmp_path}/q")
    read = lambda: sorted((r["sample_id"], r["spectrum_id"]) for p in reader.partitions({"round": 1}, {"round": 2}) for b in reader.read(p) for r in b.to_pylist())
    assert read() == [("a", i) for i in range(10, 20)] == read()  # b was done after its first round


def test_running_verdict_equals_the_analysis(spark, tmp_path):
    """Means, spreads, confidence and convergence from the state equal those that ``analyze`` finds in all results together."""
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")
    rng = np.random.default_rng(5)
    rows = [(s, i, {"Fe": 0.5 + d, "O": 0.5 - d} if i % 2 else {"Fe": 0.42 + d, "O": 0.58 - d}, i % 2) for s in "ab" for i in range(30) for d in [float(rng.normal(0, 0.004))]]
    results = spark.createDataFrame([(s, i, fr, fr, 0, 0.0) for s, i, fr, _ in rows], "sample_id string, spectrum_id long, at_fr map<string,double>, w_fr map<string,double>, quant_flag int, an_err double")
    labels = spark.createDataFrame([(s, i, c) for s, i, _, c in rows], "sample_id string, spectrum_id long, cluster_id int")
    settings = Clustering(ref_formulae=("FeO", "Fe3O4"))
    want = {r.sample_id: (r.n_clusters, r.max_rms, r.min_conf, r.converged) for r in analyze(results, ["Fe", "O"], settings, labels=labels).verdict.collect()}
    phases, _ = refs.reference_phases(spark, ["FeO", "Fe3O4"], ["Fe", "O"])
    points = results.join(labels, ["sample_id", "spectrum_id"]).select("sample_id", "spectrum_id", "cluster_id", F.array(F.col("at_fr")["Fe"], F.col("at_fr")["O"]).alias("fr"))
    enqueue(points, f"{tmp_path}/q", least=30, most=100)
    rounds = Rounds(spark, f"{tmp_path}/q", least=30, most=100, references=phases)
    rounds.run()
    got = {r.sample_id: (r.n_clusters, r.max_rms, r.min_conf, r.converged) for r in rounds.verdicts().where("round = 2").collect()}
    assert set(got) == set(want) == {"a", "b"} and parse_formula("FeO")
    for s in want:
        assert got[s][0] == want[s][0] and got[s][3] == want[s][3] and got[s][1:3] == pytest.approx(want[s][1:3])


def test_idle_sample_is_given_up(spark, tmp_path):
    schema = "sample_id string, spectrum_id long, cluster_id long, fr array<double>, last boolean, turn int"
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    put = lambda s: spark.createDataFrame([(s, 1, 0, [0.5, 0.5], False, 0), (s, 2, 0, [0.7, 0.3], False, 0)], schema).coalesce(1).write.mode("append").parquet(src)
    put("gone")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).parquet(src)
        query = running_phases(stream, idle_ms=1500).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", f"{tmp_path}/c").start()
        put("here")
        end = time.time() + 60  # with timers a stream never runs out of batches, so there is nothing to wait for but results
        ended = lambda: [r for r in spark.read.schema(PHASES + ", batch int").parquet(out).where("ended").collect() if r.sample_id == "gone"] if list(tmp_path.glob("out/*/_SUCCESS")) else []
        while time.time() < end and not ended():
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.set(name, before)
    (row,) = ended()
    assert row.n_results == 2 and row.rms == pytest.approx(np.sqrt(0.02)) and row.admitted == 0
