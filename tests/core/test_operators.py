import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkspec.config import Clustering, Sample, dumps, loads
from sparkspec.functions import geometry, spectra, text
from sparkspec.operators import cluster, cluster_large, interpolate, mixtures, refs, select, standards, stats


def test_spectrum_flags(spark):
    axis = spectra.energy_axis(0, 30, 0.0, 0.1)
    rows = [(1, None), (2, [1.0] * 30), (3, [100.0] * 30), (4, [5.0] * 30), (5, [0.0] * 20 + [1000.0] * 10)]
    df = spark.createDataFrame(rows, "k int, counts array<double>")
    got = {r.k: r.f for r in df.select("k", select.spectrum_flag(F.col("counts"), axis, 100.0, 6.0).alias("f")).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 3, 5: 3}


def test_smoothing_pads_with_zeros(spark):
    assert spark.range(1).select(spectra.box_smooth(F.array(*[F.lit(x) for x in (3.0, 6.0, 9.0)])).alias("s")).first().s == [3.0, 6.0, 5.0]


def test_selection_limits(spark):
    rows = [(0, 0.05, True), (0, 0.0500001, True), (0, -0.07, True), (0, -0.0701, True), (4, 0.0, True), (0, 0.0, False), (None, 0.0, True), (0, float("nan"), True), (-1, 0.0, True)]
    df = spark.createDataFrame(rows, "flag int, err double, q boolean")
    reasons = [r.r for r in df.select(select.selection_reason(F.col("flag"), F.col("err"), F.col("q"), undetectable=0.02).alias("r")).collect()]
    assert reasons == ["good", "error", "good", "error", "flagged", "null", "flagged", "error", "good"]
    assert df.select(select.selection_reason(F.col("flag"), F.col("err"), F.col("q"), max_err=None).alias("r")).collect()[1].r == "good"


def test_cluster_of_one_has_no_deviation(spark):
    df = spark.createDataFrame([(0, 1, "Fe", 0.5), (0, 1, "O", 0.5), (1, 2, "Fe", 0.1), (1, 3, "Fe", 0.3), (1, 2, "O", 0.9), (1, 3, "O", 0.7)], "c int, spectrum_id long, element string, value double")
    features, rows = stats.cluster_statistics(df, ["c"])
    f = {(r.c, r.element): r for r in features.collect()}
    assert f[0, "Fe"].std is None and f[1, "Fe"].std == pytest.approx(0.1414213562)
    g = {r.c: r for r in rows.collect()}
    assert (g[0].n_points, g[0].wcss, g[0].rms) == (1, 0, 0) and g[1].n_points == 2 and g[1].wcss == pytest.approx(0.04) and g[1].rms == pytest.approx(math.sqrt(0.02))


def test_published_summary_numbers(spark):
    # mean Pb, Mo and O fractions of a lead molybdate sample against its formula: confidence near 0.97
    phases, bad = refs.reference_phases(spark, ["PbMoO4", "Nonsense(", "SiO2"], ["Pb", "Mo", "O"])
    assert bad == ["Nonsense("] and [r.formula for r in phases.orderBy("ref_idx").collect()] == ["PbMoO4", "SiO2"]
    centre = spark.createDataFrame([(0, [0.1689, 0.1609, 0.6702], 0.021)], "cluster_id int, fr array<double>, rms double")
    best = refs.ranked_references(refs.match_references(centre, phases, ["cluster_id"]), ["cluster_id"]).first()
    assert best.formula == "PbMoO4" and best.conf == pytest.approx(0.97, abs=0.005) and best["rank"] == 1


def test_mixture_share_matches_a_grid(spark):
    rng = np.random.default_rng(0)
    for _ in range(5):
        h1, h2, x = (rng.dirichlet(np.ones(4)) for _ in range(3))
        lit = lambda v: F.array(*[F.lit(float(a)) for a in v])
        got = spark.range(1).select(mixtures.mixing_share(lit(x), lit(h1), lit(h2)).alias("w")).first().w
        grid = np.linspace(0, 1, 20001)
        best = grid[((x - (grid[:, None] * h1 + (1 - grid[:, None]) * h2)) ** 2).sum(1).argmin()]
        assert abs(got - best) <= 2.6e-5
        assert spark.range(1).select(mixtures.mixing_share(lit(x), lit(h1), lit(h1)).alias("w")).first().w is None


def test_free_factorisation_recovers_two_phases():
    rng = np.random.default_rng(1)
    h = np.array([[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]])
    w = np.r_[[0.0, 1.0], rng.uniform(0, 1, 60)]
    x = w[:, None] * h[0] + (1 - w[:, None]) * h[1]
    shares, found = mixtures.factor_two(x, tol=1e-7)
    assert np.allclose(shares.sum(1), 1) and np.allclose(found.sum(1), 1) and np.abs(shares @ found - x).max() < 5e-3


def _blobs(spark, k, n=20, parts=3):
    rng = np.random.default_rng(7)
    centres = np.eye(4)[:k] * 0.5
    rows = [(s, s * 1000 + i, (centres[i % k] + rng.normal(0, 0.004, 4)).tolist()) for s in (1, 2) for i in range(n * k)]
    return spark.createDataFrame(rows, "sample_id long, spectrum_id long, fr array<double>").repartition(parts)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_clusters_are_found_and_stable(spark, k):
    one = sorted(map(tuple, cluster.cluster_samples(_blobs(spark, k), ["sample_id"]).collect()))
    two = sorted(map(tuple, cluster.cluster_samples(_blobs(spark, k, parts=1), ["sample_id"]).collect()))
    assert str(one) == str(two)
    assert {r[3] for r in one} == {k} and len({(r[1] % 1000 % k, r[2]) for r in one if r[0] == 1}) == k


def _inertia(rows, points):
    at = {}
    for r in rows:
        at.setdefault((r.sample_id, r.cluster_id), []).append(points[r.sample_id, r.spectrum_id])
    return sum(((np.array(x) - np.mean(x, axis=0)) ** 2).sum() for x in at.values())


def test_large_samples_are_clustered_over_all_partitions(spark):
    """The same points as one group and over partitions: inertia within a hundredth, k found alike, groups and large samples side by side."""
    rng = np.random.default_rng(1)
    centres = rng.uniform(0, 1, (4, 5))
    rows = [("big", i, (centres[i % 4] + rng.normal(0, 0.05, 5)).tolist()) for i in range(3000)] + [("small", i, (centres[i % 2] + rng.normal(0, 0.01, 5)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, spectrum_id long, fr array<double>").repartition(4)
    points = {(s, i): x for s, i, x in rows}
    one = cluster.cluster_samples(df, ["sample_id"], k=4).where("sample_id = 'big'").collect()
    two = cluster.cluster_samples(df, ["sample_id"], k=4, most=1000).collect()
    big = [r for r in two if r.sample_id == "big"]
    assert len(big) == 3000 and len(two) == 3040 and {r.k for r in big} == {4} and all(r.silhouette is None for r in big)
    assert _inertia(big, points) <= 1.01 * _inertia(one, points)
    found = {r.sample_id: r.k for r in cluster.cluster_samples(df, ["sample_id"], most=1000).select("sample_id", "k").distinct().collect()}
    assert found == {"big": 4, "small": 2}
    same = df.select("sample_id", "spectrum_id", F.array(F.lit(0.25), F.lit(0.75)).alias("fr"))
    assert {(r.cluster_id, r.k) for r in cluster_large.cluster_large(same, ["sample_id"], k=3).collect()} == {(0, 1)}
    assert cluster_large.cluster_large(df.limit(0), ["sample_id"]).count() == 0


def test_a_sample_of_many_points(spark):
    """Rounds are sums of partitions: a plan without a group of points, and a result near the true centres."""
    x = [F.when(F.col("id") % 3 == 0, 0.2).when(F.col("id") % 3 == 1, 0.5).otherwise(0.9) + (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) - 500) / 20000 for i in range(3)]
    df = spark.range(150_000).select(F.lit("s").alias("sample_id"), F.col("id").alias("spectrum_id"), F.array(*x).alias("fr"))
    got = cluster_large.cluster_large(df, ["sample_id"], k=3).groupBy("cluster_id", F.col("spectrum_id") % 3).count().collect()
    assert len(got) == 3 and {r["count"] for r in got} == {50_000}
    centres = spark.createDataFrame([("s", [[[0.2] * 3, [0.5] * 3]])], "sample_id string, tries array<array<array<double>>>")
    plan = cluster_large.lloyd_sums(df, centres, ["sample_id"], "spectrum_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "collect_list" not in plan


def test_rounds_over_blocks(spark):
    """Blocks of points give the sums that rows give, equal centres and points between two centres included; no block holds two samples."""
    rng = np.random.default_rng(8)
    rows = [(i % 3, i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "sample_id int, spectrum_id long, fr array<double>").repartition(5)
    tries = [[[0.0] * 5], [[1.0] * 5, [1.0] * 5, [-1.0] * 5, [0.5, 0.0, 0.0, 0.0, 0.0]]]
    centres = spark.createDataFrame([(s, tries) for s in range(3)], "sample_id int, tries array<array<array<double>>>")
    blocks = cluster_large.blocked(df, ["sample_id"], "spectrum_id")
    assert sorted((r.sample_id, p) for r in blocks.collect() for p in r._p) == sorted((r[0], r[1]) for r in rows) and blocks.count() < 200
    both = [{(r.sample_id, r.k, r.cluster): r for r in one.collect()} for one in (cluster_large.block_sums(blocks, centres, ["sample_id"], 5), cluster_large.lloyd_sums(df, centres, ["sample_id"], "spectrum_id", 5))]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 12
    for name, r in both[1].items():
        assert both[0][name].n == r.n and both[0][name].inertia == pytest.approx(r.inertia) and both[0][name].centre == pytest.approx(r.centre)


def test_samples_beside_a_large_one(spark):
    """A sample without a name is kept beside a large one, whatever its size, and a large one with a null is told as failed."""
    near = lambda i: [0.2 + 0.5 * (i % 2) + 0.001 * (i % 7), 0.3]
    rows = [(s, n + i, near(i)) for n, (s, size) in enumerate([(1, 60), (None, 20), (2, 60), (3, 20)]) for i in range(0, size * 10, 10)]
    rows = [(s, p, [None, 0.3] if s == 2 and p == 32 else x) for s, p, x in rows]
    df = spark.createDataFrame(rows, "sample_id int, spectrum_id long, fr array<double>")
    for most in (15, 40):
        got = cluster.cluster_samples(df, ["sample_id"], k=2, most=most).collect()
        assert sorted((str(r.sample_id), r.spectrum_id) for r in got if r.error is None) == sorted((str(s), p) for s, p, _ in rows if s != 2)
        failed = [(r.sample_id, r.spectrum_id, r.k) for r in got if r.error]
        assert failed == [(2, None, None)]


def test_profile_over_k(spark):
    """Inertia and score of each k equal those of the points themselves; more clusters never cost more on clear blobs."""
    df = _blobs(spark, 3)
    rows = {(r.sample_id, r.k): r for r in cluster_large.k_profile(df, ["sample_id"], max_k=4).collect()}
    x = np.array([r.fr for r in df.where("sample_id = 1").collect()])
    assert rows[1, 1].n == 60 and rows[1, 1].inertia == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) == pytest.approx(rows[1, 3].total)
    assert rows[1, 1].inertia > rows[1, 2].inertia > rows[1, 3].inertia and max((rows[1, k].calinski_harabasz, k) for k in (2, 3, 4))[1] == 3
    labels, _ = cluster.kmeans(x, 3, np.random.default_rng(0))
    assert rows[1, 3].inertia == pytest.approx(cluster.inertia(x, cluster.canonical(x, x.argmax(axis=1))), rel=1e-9) and labels.max() == 2


def test_sums_of_a_salted_side(spark):
    df = _blobs(spark, 2)
    side = df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    for most in (1 << 20, 0):
        assert {(r.sample_id, r.n) for r in cluster_large.with_sample(df, side, ["sample_id"], "spectrum_id", 1, most).collect()} == {(1, 40), (2, 40)}
        assert cluster_large.with_sample(df, side, ["sample_id"], "spectrum_id", 1, most).count() == 80


@pytest.mark.parametrize("block", [2048, 9])
def test_silhouettes_by_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = [(s, i, int(rng.integers(0, 3)) if s == "a" else 0 if i else 7, rng.normal(0, 1, 3).tolist()) for s, n in (("a", 60), ("b", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, p long, c int, v array<double>").repartition(3)
    got = {(r.sample_id, r.p): r.silhouette for r in cluster.exact_silhouettes(df, ["sample_id"], "p", "c", "v", block=block).collect()}
    for s in "ab":
        mine = [r for r in rows if r[0] == s]
        want = cluster.silhouettes(np.array([r[3] for r in mine]), np.array([r[2] for r in mine]))
        assert [got[s, r[1]] for r in mine] == pytest.approx(want.tolist(), abs=1e-7)
    assert len(got) == 65


def test_free_mixture_of_many_points(spark):
    """The same cluster as one group and by sums over partitions finds the same phases."""
    rng = np.random.default_rng(2)
    w = rng.uniform(0, 1, (400, 1))
    x = w * np.array([[0.6, 0.4, 0.0]]) + (1 - w) * np.array([[0.0, 0.3, 0.7]])
    df = spark.createDataFrame([(k, r.tolist()) for k in (1, 2) for r in (x if k == 1 else x[:30])], "cluster_id int, fr array<double>").repartition(4)
    one = {r.cluster_id: r for r in mixtures.free_mixture(df, ["cluster_id"], ["Fe", "O", "Si"]).collect()}
    two = {r.cluster_id: r for r in mixtures.free_mixture(df, ["cluster_id"], ["Fe", "O", "Si"], most=100).collect()}
    assert set(two) == {1, 2} and tuple(two[2]) == tuple(one[2])
    assert two[1].error < 0.2 and two[1].conf > 0.9 and one[1].error < 0.2
    assert two[1].share_mean == pytest.approx(float(w.mean()), abs=0.12) and two[1].formula1 != two[1].formula2


def test_a_bad_sample_is_reported(spark):
    df = _blobs(spark, 2).unionAll(spark.createDataFrame([(9, i, [0.5, None] if i else [0.5]) for i in range(8)], "sample_id long, spectrum_id long, fr array<double>"))
    rows = cluster.cluster_samples(df, ["sample_id"]).collect()
    (bad,) = [r for r in rows if r.error]
    assert bad.sample_id == 9 and bad.cluster_id is None and bad.spectrum_id is None and "ValueError" in bad.error
    assert len(rows) == 81 and {r.sample_id for r in rows if not r.error} == {1, 2}


def test_small_samples_drop_out(spark):
    assert cluster.cluster_samples(_blobs(spark, 1, n=4), ["sample_id"]).count() == 0


def test_vote_rules():
    assert cluster.vote([2, 2, 3], 1) == 2 and cluster.vote([2, 2, 3, 3, 3], 1) is None
    assert cluster.vote([4, 4, 4, 3, 3, 2], 5) == 3 and cluster.vote([5], 1) == 5


def test_silhouettes_agree_with_sql(spark):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(30, 3)), np.arange(30) % 3
    df = spark.createDataFrame([(0, i, int(labels[i]), x[i].tolist()) for i in range(30)], "s int, p int, c int, v array<double>")
    got = {r.p: r.silhouette for r in cluster.exact_silhouettes(df, ["s"], "p", "c", "v").collect()}
    assert np.allclose([got[i] for i in range(30)], cluster.silhouettes(x, labels)) and all(-1 <= v <= 1 for v in got.values())


def test_standards_and_upsert(spark):
    rows = [("Fe_Ka1", "a", 10.0, True), ("Fe_Ka1", "b", 20.0, True), ("Fe_Ka1", "c", 99.0, False), ("Fe_Ka1", "Mean", 50.0, True)]
    lib = spark.createDataFrame(rows, "el_line string, std_id string, corrected_pb double, use_for_mean boolean")
    m = standards.standard_means(lib, ["el_line"]).first()
    assert (m.mean_pb, m.std_pb, m.n_standards) == (15.0, 5.0, 2)
    new = spark.createDataFrame([("O_Ka1", "a", 7.0, True)], lib.schema)
    assert sorted(r.std_id for r in standards.upsert(lib, new).collect()) == ["Mean", "a", "b", "c"]


def test_line_statistics_ignore_nan_and_small(spark):
    df = spark.createDataFrame([("l", v) for v in (100.0, 200.0, float("nan"), None, 3.0)] + [("m", float("nan"))], "line string, pb double")
    rows = stats.standards_of_lines(df, ["line"]).collect()
    assert len(rows) == 1 and (rows[0].mean_pb, rows[0].std_pb, rows[0].n_spectra) == (150.0, 50.0, 2)


def test_interpolation_clamps(spark):
    curve = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 0.0)], "x double, y double")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate((-1.0, 0.0, 0.5, 1.0, 2.5, 4.0, 9.0))], "i int, at double")
    got = [r.value for r in interpolate.interpolate(rows, curve, at="at", bin_width=0.7).orderBy("i").collect()]
    assert got == pytest.approx(np.interp([-1, 0, 0.5, 1, 2.5, 4, 9], [0, 1, 4], [1, 3, 0]).tolist())


def test_labels_and_geometry(spark):
    names = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, -1)], "i int").select(text.excel_letters(F.col("i")).alias("l")).collect()
    assert [r.l for r in names] == ["A", "Z", "AA", "ZZ", "AAA", None]
    assert spark.sql("select ' -x1 y# ' a").select(text.clean_id(F.col("a")).alias("a")).first().a == "x1 y"
    inside = geometry.grid(spark, half_width=1.0, spacing=0.5).collect()
    assert all(r.x**2 + r.y**2 < 1 for r in inside) and len(inside) == 9


def test_config_round_trip():
    c = loads('{"datetime": "x", "sample_cfg": {"ID": "s", "elements": ["Fe", "O"], "type": "bulk", "note": 1}, "microscope_cfg": {"brightness": "3.5"}, "measurement_cfg": {"max_acquisition_time": Infinity}}')
    assert c.sample.id == "s" and c.microscope.brightness == 3.5 and c.metadata == {"datetime": "x", "sample_cfg": {"note": 1}} and c.measurement.max_acquisition_time == math.inf
    assert loads(dumps(c, "now")).sample == c.sample
    with pytest.raises(ValueError):
        Sample(elements=("Xx",))
    with pytest.raises(ValueError):
        Clustering(method="dbscan")


def test_missing_reference_in_one_exchange(spark):
    """Many lines, lines that are null, spectra without any and one whose id is null; counted once a spectrum."""
    names = [(f"E{i}", "Ka1") for i in range(70)]
    rows = [("all", e, l, 1.0) for e, l in names] + [("most", e, l, 1.0) for e, l in names[:-1]] + [("zero", e, l, float(e != "E3")) for e, l in names] + [("none", "X", "Ka1", 1.0)] + [(None, e, l, 1.0) for e, l in names]
    peaks = spark.createDataFrame(rows, "s string, element string, line string, area double")
    wanted = spark.createDataFrame(names + names[:2], "element string, line string")
    found = standards.missing_reference_flag(peaks, wanted, ["s"])
    assert {r.s: r.quant_flag for r in found.collect()} == {"all": 0, "most": 10, "zero": 10, "none": 10, None: 0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
    with_null = wanted.unionAll(spark.createDataFrame([(None, "Ka1")], wanted.schema))
    assert {r.quant_flag for r in standards.missing_reference_flag(peaks, with_null, ["s"]).collect()} == {10}
    assert {r.quant_flag for r in standards.missing_reference_flag(peaks, wanted.limit(0), ["s"]).collect()} == {0}


def test_grids_of_few_rows_are_many_tasks(spark):
    given = spark.createDataFrame([(i, 1.0, 0.5, 1.0, True, False, 0.0, 0.0) for i in range(64)], "k int, half_width double, spacing double, ratio double, circle boolean, margin boolean, cx double, cy double").coalesce(1)
    frames = geometry.grids(given, ["k"]).select("k", F.spark_partition_id().alias("p")).collect()
    assert len(frames) == 64 * 9 and len({r.p for r in frames}) > 4


def test_silhouettes_send_a_point_a_bounded_number_of_times(spark, monkeypatch):
    """Sixteen times at most, however many points there are (20 by blocks of 2,048 here); strips give the same."""
    sent = []
    monkeypatch.setattr(cluster, "spread", lambda df, key: sent.append(df) or df)
    df = spark.range(40_000).select(F.lit(1).alias("s"), "id", (F.col("id") % 3).alias("c"), F.array(F.sin("id")).alias("v"))
    cluster.exact_silhouettes(df, ["s"], "id", "c", "v")
    assert sent[0].count() == 16 * 40_000
    some = df.where("id < 700")
    one, two = (sorted(map(tuple, cluster.exact_silhouettes(some, ["s"], "id", "c", "v", strip=n).select("id", F.round("silhouette", 7)).collect())) for n in (50, 1024))
    assert one == two and len(one) == 700


def test_free_mixture_reads_its_points_once(spark):
    """However many rounds it takes: a checkpoint computes them twice at most."""
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    w = np.random.default_rng(2).uniform(0, 1, (300, 1))
    x = w * np.array([[0.6, 0.4, 0.0]]) + (1 - w) * np.array([[0.0, 0.3, 0.7]])
    df = spark.createDataFrame([(1, r.tolist()) for r in x], "cluster_id int, fr array<double>").mapInPandas(made, "cluster_id int, fr array<double>")
    assert mixtures.free_mixture(df, ["cluster_id"], ["Fe", "O", "Si"], most=100).count() == 1 and seen.value <= 600


def test_clusterings_are_judged_without_all_distances(monkeypatch):
    """The best of the runs is that of trying one by one, with copies among the points; no matrix of all distances is made."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (4, 5))[rng.integers(0, 4, 150)] + rng.normal(0, 0.5, (150, 5))
    x[:20] = x[20:40]
    for k, runs, tries in ((2, 10, 1), (3, 6, 8), (4, 6, 8)):
        draw, best, score = np.random.default_rng(0), None, -np.inf
        for _ in range(runs):
            for _ in range(tries):
                labels, _ = cluster.kmeans(x, k, draw)
                s = cluster.silhouettes(x, labels)
                if (s > 0).all():
                    break
            if s.mean() > score:
                best, score = labels, s.mean()
        with monkeypatch.context() as m:
            m.setattr(cluster, "distances", lambda x: pytest.fail("all distances at once"))
            got, mean = cluster.best_clustering(x, k, np.random.default_rng(0), runs, tries)
            cluster.k_once(x, 6, "silhouette", np.random.default_rng(1))
        assert (got == best).all() and mean == pytest.approx(score, abs=1e-9)
