"""References and mixtures of long lists of phases, against all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkspec.operators import mixtures, refs


def _phases(rng, n, m=6, most=4):
    h = np.zeros((n, m))
    for row in h:
        some = rng.choice(m, int(rng.integers(1, most)), replace=False)
        row[some] = rng.dirichlet(np.ones(len(some)))
    return h


def _frame(spark, h):
    return spark.createDataFrame([(i, f"P{i}", x.tolist(), 1.0 + i % 3) for i, x in enumerate(h)], "ref_idx int, formula string, fr array<double>, mix_weight double")


def test_near_references_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    h = _phases(rng, 30_000)
    c = np.concatenate([_phases(rng, 30), h[:3] + 1e-9])
    rms = np.r_[rng.uniform(0, 0.01, 20), rng.uniform(0.02, 0.3, 12), [0.0]]
    centroids = spark.createDataFrame([(i, x.tolist(), float(r) if i != 5 else None) for i, (x, r) in enumerate(zip(c, rms))] + [(99, None, 0.1)], "cluster_id int, fr array<double>, rms double")
    phases = _frame(spark, h)
    near = refs.near_references(centroids, phases)
    got = {(r.cluster_id, r.ref_idx): r.distance for r in near.collect()}
    d = np.sqrt(((c[:, None] - h[None]) ** 2).sum(2))
    limit = np.maximum(0.1, 5 * np.where(np.arange(len(c)) == 5, 0, rms))
    assert set(got) == set(map(tuple, np.argwhere(d < limit[:, None]).tolist())) and len(got) > 1000
    assert all(got[k] == pytest.approx(d[k]) for k in list(got)[:500])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # bands bound what is compared: cells around the tight centroids hold a small part of all phases
    tight = centroids.where("rms < 0.02")
    looked = refs.near_references(tight.withColumn("fr", F.col("fr")), phases, reach=0.1)
    assert looked.count() < 0.2 * 30_000 * tight.count()
    assert refs.near_references(centroids, phases.limit(0)).count() == 0 == refs.near_references(centroids.limit(0), phases).count()


def _errors(points, h):
    """Mean error of each pair, from every point."""
    out = {}
    for i in range(len(h)):
        a, b = h[i], h[i + 1 :]
        d = a - b
        square = (d * d).sum(1)
        w = np.clip(((points[:, None] - b[None]) * d[None]).sum(2) / np.where(square > 0, square, 1), 0, 1)[..., None]
        e = (np.exp(15 * np.abs(points[:, None] - (a * w + b[None] * (1 - w)))) - 1).mean((0, 2))
        out |= {(i, i + 1 + j): float(e[j]) for j in np.flatnonzero((e < 2) & (square > 0))}
    return out


@pytest.mark.parametrize("signed", [False, True])
def test_pairs_are_pruned_but_none_is_lost(spark, signed):
    rng = np.random.default_rng(7)
    h = _phases(rng, 700 if not signed else 120, 8)
    if signed:
        h -= 0.05
    rows, want = [], {}
    for c in range(3):
        w = rng.uniform(0.1, 0.9, (12, 1))
        x = h[3 * c] * w + h[3 * c + 1] * (1 - w) + rng.normal(0, 0.004, (12, 8))
        x = x if signed else np.maximum(x, 0)
        rows += [(c, p.tolist()) for p in x]
        want |= {(c, *k): e for k, e in _errors(x, h).items()}
    points = spark.createDataFrame(rows, "cluster_id int, fr array<double>")
    phases = _frame(spark, h)
    got = {(r.cluster_id, r.ref1, r.ref2): r for r in mixtures.fit_pairs(points, phases, ["cluster_id"]).collect()}
    assert set(got) == set(want) and {(0, 0, 1), (1, 3, 4), (2, 6, 7)} <= set(got)
    assert all(got[k].error == pytest.approx(e) and got[k].n == 12 for k, e in want.items())
    pairs = mixtures.possible_pairs(points, phases, ["cluster_id"])
    whole = 3 * len(h) * (len(h) - 1) // 2
    assert len(want) <= pairs.count() < (0.1 if not signed else 0.9) * whole
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_of_few_phases(spark):
    points = spark.createDataFrame([(1, [0.5, 0.5]), (1, [0.4, 0.6])], "cluster_id int, fr array<double>")
    one = _frame(spark, np.array([[1.0, 0.0]]))
    assert mixtures.fit_pairs(points, one, ["cluster_id"]).count() == 0 == mixtures.fit_pairs(points, one.limit(0), ["cluster_id"]).count()
    same = _frame(spark, np.array([[0.5, 0.5], [0.5, 0.5], [0.0, 1.0], [1.0, 0.0]]))
    got = {(r.ref1, r.ref2) for r in mixtures.fit_pairs(points, same, ["cluster_id"]).collect()}
    assert (2, 3) in got and (0, 1) not in got
    assert len(mixtures.fit_pairs(points, same, ["cluster_id"], every=True).collect()) == 5
