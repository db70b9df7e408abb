import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkspec.config import Clustering
from sparkspec.operators import corrections, fitting
from sparkspec.physics import background as bg
from sparkspec.physics.fit import Instrument, simulate
from sparkspec.physics.peaks import charge_loss, find_peaks, gaussian, peak
from sparkspec.physics.solve import fit_bounded, nnls
from sparkspec.plans import oracles, queries
from sparkspec.plans.analyze import analyze, build_standards, quantify_and_analyze
from sparkspec.plans.queries import ELEMENTS, demo_tables
from sparkspec.streaming.acquisition import Acquisition, particles_until, spectra_stream

I, T = Instrument(), demo_tables()
STDS = {(e, "Ka1"): 3000.0 for e in ELEMENTS}


def test_least_squares():
    rng = np.random.default_rng(0)
    a = rng.uniform(size=(40, 5))
    x = np.array([1.0, 0, 2, 0, 0.5])
    assert np.allclose(nnls(a, a @ x), x, atol=1e-8) and (nnls(a, -np.ones(40)) == 0).all()
    e = np.linspace(0, 1, 200)
    y = gaussian(e, 3, 0.52, 0.05)
    p, ok = fit_bounded(lambda p: gaussian(e, *p) - y, np.array([1.0, 0.5, 0.04]), np.array([0, 0.4, 0.01]), np.array([10, 0.6, 0.2]), tol=1e-6)
    assert ok and np.allclose(p, [3, 0.52, 0.05], atol=1e-4)


def test_peak_shapes_keep_their_area():
    e = np.arange(0.0, 8, 0.01)
    assert gaussian(e, 5, 3, 0.05).sum() * 0.01 == pytest.approx(5, rel=1e-6)
    loss = charge_loss(2.0, 1000.0, 150e-7, 0.2)
    assert loss[1].sum() == pytest.approx(1) and loss[0].max() == 2.0
    smeared = peak(e, 5, 2.0, 0.05, loss=loss)
    assert smeared.sum() * 0.01 == pytest.approx(5, rel=1e-3) and (e * smeared).sum() / smeared.sum() <= 2.0
    tailed = peak(e, 5, 1.0, 0.04, gamma=3.0, f_tail=0.05)
    assert tailed.sum() * 0.01 == pytest.approx(5 * 1.05, rel=0.02)
    at, prominence = find_peaks(np.array([0, 1, 5, 1, 0, 0, 0, 3, 0.0]), 2)
    assert at.tolist() == [2, 7] and prominence.tolist() == [5, 3]


def test_sql_corrections_equal_the_numpy_ones(spark):
    w = {"Fe": 0.4, "Si": 0.25, "O": 0.35}
    kev = {"Fe": 6.4, "Si": 1.74, "O": 0.525}
    els = list(w)
    lines = spark.createDataFrame([(e, "Ka1", kev[e]) for e in els], "element string, line string, energy_kev double")
    mu = spark.createDataFrame([(e, "Ka1", a, float(T.mu(a, np.array([kev[e]]))[0])) for e in els for a in els], "element string, line string, absorber string, mu double")
    from sparkspec.functions.chemistry import MASS, Z

    ion = spark.createDataFrame([(Z[e], 1000 * T.j_kev(e)) for e in els], "z int, j_ev double")
    comp = spark.createDataFrame([(1, e, v) for e, v in w.items()], "k int, element string, w_fr double")
    got = {r.element: r.zaf for r in corrections.zaf_factors(comp, lines, mu, ion, ["k"], beam_kev=15.0, takeoff_deg=28.5, p="1.0", f="1.0", beta="0.0").collect()}
    want = bg.matrix_factors(np.array([kev[e] for e in els]), np.arange(3), np.array([[float(T.mu(a, np.array([kev[e]]))[0]) for a in els] for e in els]), np.array(list(w.values())), np.array([Z[e] for e in els], float), np.array([MASS[e] for e in els]), np.array([T.j_kev(e) for e in els]), 15.0, 28.5, I.of("p"), I.of("f"), I.of("beta"))
    assert [got[e] for e in els] == pytest.approx(want.tolist(), rel=1e-9)
    spark.sparkContext.setCheckpointDir("/tmp/sparkspec-checkpoints")
    ratios = spark.createDataFrame([(1, e, "Ka1", float(w[e] / z)) for e, z in zip(els, want)], "k int, element string, line string, k_ratio double")
    fixed = corrections.quantify_ratios(ratios.unionAll(spark.createDataFrame([(1, "Xx", "Ka1", 0.1), (1, "Mg", "Ka1", None), (2, "Fe", "Ka1", 1.0)], ratios.schema)), lines, mu, ion, ["k"], beam_kev=15.0, takeoff_deg=28.5, p=lambda z: F.lit(1.0), f=lambda z: F.lit(1.0), beta=lambda z: F.lit(0.0))
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    fixed, other = fixed.where("k = 1").collect(), fixed.where("k = 2").collect()
    alone = corrections.zaf_factors(spark.createDataFrame([(2, "Fe", 1.0)], "k int, element string, w_fr double"), lines, mu, ion, ["k"], beam_kev=15.0, takeoff_deg=28.5, p="1.0", f="1.0", beta="0.0").first().zaf
    assert [(r.element, r.w_fr) for r in other] == [("Fe", pytest.approx(alone))]
    assert {r.element: r.w_fr for r in fixed} == pytest.approx(w, abs=2e-4) and all(r.converged and r.rounds <= 20 for r in fixed)


def _spectra(spark, n=14):
    rng = np.random.default_rng(5)
    mixes = [{"Fe": 0.3, "Mg": 0.1, "Ca": 0.1, "Al": 0.1, "Si": 0.2, "O": 0.2}, {"Fe": 0.1, "Mg": 0.25, "Ca": 0.05, "Al": 0.05, "Si": 0.25, "O": 0.3}]
    made = [simulate(m, STDS, I, T, 50000.0) for m in mixes]
    rows = [("s1", i, (made[i % 2] * (1 + 0.01 * rng.uniform())).tolist()) for i in range(n)] + [("s1", 90, None), ("s1", 91, [1.0] * 2048), ("s1", 92, [0.0] * 10)]
    return spark.createDataFrame(rows, "sample_id string, spectrum_id long, counts array<double>"), mixes


def test_quantification_recovers_fractions_and_isolates_failures(spark):
    df, mixes = _spectra(spark, 4)
    out = {r.spectrum_id: r for r in fitting.quantified(df, ELEMENTS, I, T, STDS, key=["sample_id", "spectrum_id"], target=50000.0).collect()}
    for i in range(4):
        assert out[i].quant_flag == 0 and out[i].w_fr == pytest.approx(mixes[i % 2], abs=0.01) and abs(out[i].an_err) < 0.01 and out[i].r_squared > 0.999
    assert (out[90].quant_flag, out[91].quant_flag, out[92].quant_flag) == (1, 2, 2) and out[90].w_fr is None
    bad = fitting.quantified(df.where("spectrum_id < 2"), ELEMENTS, I, T, {("Fe", "Ka1"): 3000.0}, key=["sample_id", "spectrum_id"], target=50000.0).collect()
    assert all(r.quant_flag == 9 and "no positive standard" in r.comments for r in bad)


def test_fits_are_flagged(spark):
    mix = {"Fe": 0.3, "Mg": 0.1, "Ca": 0.1, "Al": 0.1, "Si": 0.2, "O": 0.2}
    counts = simulate(mix, STDS, I, T, 50000.0)
    silicon = simulate({"Fe": 0.1, "Mg": 0.1, "Ca": 0.05, "Al": 0.05, "Si": 0.5, "O": 0.2}, STDS, I, T, 50000.0)

    def fitted(y, stds=STDS, elements=ELEMENTS, **how):
        df = spark.createDataFrame([(1, y.tolist())], "spectrum_id long, counts array<double>")
        return fitting.quantified(df, elements, I, T, stds, key=["spectrum_id"], target=float(y.sum()), **how)

    assert fitted(counts, {k: v / 2 for k, v in STDS.items()}).first().quant_flag == 5
    assert fitted(silicon, elements=[e for e in ELEMENTS if e != "Si"], substrate=["Si"]).first().quant_flag == 7
    plain = spark.createDataFrame(fitted(counts).collect(), fitted(counts).schema)
    assert plain.first().quant_flag == 0 and fitting.judged(plain.withColumn("absorbed", F.lit(0.8)), I, 1.0).first().quant_flag == 6
    assert fitting.judged(plain.withColumn("redchi_sq", F.lit(101.0)), I, 1.0).first().quant_flag == 4
    low = fitting.judged(plain, I, 1e4).first()
    assert low.quant_flag == 8 and low.comments.endswith("min. ref. bckgrnd counts, too low")


def test_convergence_rules_by_hand(spark):
    from sparkspec.operators import refs

    centres = spark.createDataFrame([("near", 0, [0.5, 0.5], 0.01), ("none", 0, [0.9, 0.1], 0.02), ("several", 0, [0.5, 0.5], 0.01), ("edge", 0, [0.0, 0.0], 0.01)], "sample_id string, cluster_id int, fr array<double>, rms double")
    phases = spark.createDataFrame([(0, "A", [0.5, 0.51], 1.0), (1, "B", [0.51, 0.5], 1.0), (2, "C", [0.1, 0.0], 1.0)], "ref_idx int, formula string, fr array<double>, mix_weight double")
    key = ["sample_id", "cluster_id"]
    found = refs.match_references(centres.where("sample_id <> 'near'"), phases, key).unionAll(refs.match_references(centres.where("sample_id = 'near'"), phases.where("ref_idx = 0"), key))
    assert found.where("sample_id in ('none', 'edge')").count() == 0  # a reference at exactly the radius is not near
    best = {r.sample_id: r.min_conf for r in refs.assigned_confidence(found, ["cluster_id"], ["sample_id"]).collect()}
    raw = np.exp(-(0.01**2) / (2 * 0.03**2))
    assert best["near"] == pytest.approx(raw) and best["several"] == pytest.approx(raw / 2)
    rows = centres.join(spark.createDataFrame(list(best.items()), "sample_id string, min_conf double"), "sample_id", "left")
    assert {r.sample_id: r.c for r in rows.select("sample_id", refs.converged(F.col("rms"), F.col("min_conf")).alias("c")).collect()} == {"near": True, "none": True, "several": False, "edge": True}


def test_clusters_file_with_mixtures(spark):
    from sparkspec.operators import stats
    from sparkspec.sources.writers import clusters_table

    rows = [("a", i, {"Fe": f, "O": 1 - f}, {"Fe": f, "O": 1 - f}, 0, 0.0) for i, f in enumerate(np.linspace(0.36, 0.5, 30).tolist())]
    df = spark.createDataFrame(rows, "sample_id string, spectrum_id long, at_fr map<string,double>, w_fr map<string,double>, quant_flag int, an_err double")
    done = analyze(df, ["Fe", "O"], Clustering(k=1, ref_formulae=("FeO", "FeO2", "Fe2O3", "Fe3O4")))
    table = clusters_table(done.features, done.clusters, done.references, done.mixtures, ["Fe", "O"])
    row = table.first()
    assert "Mix6" in table.columns and row["Mix1"] in ("FeO, FeO2", "FeO2, Fe2O3", "FeO2, Fe3O4") and 0 < row["ConfMix1"] <= 1 and row["n_points"] == 30


def test_tables_too_large_are_an_error(spark):
    from sparkspec.operators.shared import small

    df = spark.range(40)
    with pytest.raises(ValueError):
        small(df, 10)


def test_spectra_to_phases(spark):
    df, _ = _spectra(spark)
    results, done = quantify_and_analyze(df, ELEMENTS, I, T, STDS, Clustering(k=2), target=50000.0)
    assert [r.n_points for r in done.clusters.collect()] == [7, 7]
    v = done.verdict.first()
    assert v.n_clusters == 2 and v.converged and results.count() == 17
    assert {r.reason: r.n for r in done.selected.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"good": 14, "null": 3}


def test_standards_from_spectra(spark):
    one = simulate({"Fe": 0.7773, "O": 0.2227}, STDS, I, T, 50000.0)
    df = spark.createDataFrame([("std", i, one.tolist()) for i in range(3)], "sample_id string, spectrum_id long, counts array<double>")
    lines = spark.createDataFrame([("Fe", "Ka1"), ("O", "Ka1")], "element string, line string")
    got = build_standards(df, "FeO", "FeO_1", lines, I, T, {("Fe", "Ka1"): 1.0, ("O", "Ka1"): 1.0}, mode="point", beam_kev=15.0, target=50000.0).collect()
    assert {r.el_line for r in got} == {"Fe_Ka1", "O_Ka1"} and all(r.n_spectra == 3 and r.measured_pb > 10 for r in got)


def test_many_standards_at_once(spark):
    """Two compounds in one call; one that cannot be read, and one without factors, are named and end nothing."""
    made = {"a": {"Fe": 0.7773, "O": 0.2227}, "b": {"Si": 0.4674, "O": 0.5326}}
    df = spark.createDataFrame([(s, i, simulate(m, STDS, I, T, 50000.0).tolist()) for s, m in made.items() for i in range(2)], "sample_id string, spectrum_id long, counts array<double>")
    lines = spark.createDataFrame([(e, "Ka1") for e in ("Fe", "O", "Si")], "element string, line string")
    one = lambda *es: {(e, "Ka1"): 1.0 for e in es}
    from sparkspec.operators.standards import library_for
    from sparkspec.plans.analyze import build_all_standards, fit_summary

    got, failed = build_all_standards(df, {"a": ("FeO", "FeO_1"), "b": ("SiO2", "SiO2_1"), "c": ("Fe(O", "bad"), "d": ("MgO", "MgO_1")}, lines, I, T, {"a": one("Fe", "O"), "b": one("Si", "O"), "c": one("Fe")}, mode="point", beam_kev=15.0, target=50000.0)
    rows = got.collect()
    assert {(r.sample_id, r.el_line, r.std_id) for r in rows} == {("a", "Fe_Ka1", "FeO_1"), ("a", "O_Ka1", "FeO_1"), ("b", "Si_Ka1", "SiO2_1"), ("b", "O_Ka1", "SiO2_1")}
    assert set(failed) == {"c", "d"} and "incomplete" in failed["c"]
    entries = spark.createDataFrame([(r.el_line, r.std_id, r.formula, r.corrected_pb, True) for r in rows], "el_line string, std_id string, formula string, corrected_pb double, use_for_mean boolean")
    every, mixed = library_for(entries), library_for(entries, ["O2Si"])
    by = {(r.std_id, r.el_line): r.corrected_pb for r in rows}
    assert every["O", "Ka1"] == pytest.approx((by["FeO_1", "O_Ka1"] + by["SiO2_1", "O_Ka1"]) / 2)
    assert mixed["O", "Ka1"] == pytest.approx(by["SiO2_1", "O_Ka1"]) and mixed["Fe", "Ka1"] == every["Fe", "Ka1"]
    fits = fitting.quantified(df.where("sample_id = 'a'"), ["Fe", "O"], I, T, None, key=["sample_id", "spectrum_id"], target=50000.0)
    summary = {r.spectrum_id: r for r in fit_summary(fits, ["sample_id"]).collect()}
    assert set(summary) == {"0", "1", "mean", "std"} and summary["mean"].Fe_Ka1_pb == pytest.approx((summary["0"].Fe_Ka1_pb + summary["1"].Fe_Ka1_pb) / 2)


def test_known_mixtures_and_settings_by_elements(spark, tmp_path):
    """Samples that are known mixtures rank all pairs of phases; without settings the elements choose them; a sample that fails is named."""
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    rng = np.random.default_rng(4)
    rows = [("m", i, {"Fe": 0.2 + 0.02 * i, "O": 0.5, "Si": 0.3 - 0.02 * i}) for i in range(12)] + [("x", i, {"Fe": float("nan") if i == 3 else 0.4, "O": 0.6, "Si": 0.0}) for i in range(6)]
    df = spark.createDataFrame([(s, i, f, f, 0, float(rng.normal(0, 0.001))) for s, i, f in rows], "sample_id string, spectrum_id long, at_fr map<string,double>, w_fr map<string,double>, quant_flag int, an_err double")
    plain = analyze(df, ["Fe", "O", "Si"], Clustering(k=1, ref_formulae=("Fe2O3", "SiO2", "FeO")))
    known = analyze(df, ["Fe", "O", "Si"], Clustering(k=1, ref_formulae=("Fe2O3", "SiO2", "FeO")), known_mixture=True)
    assert known.mixtures.where("sample_id = 'm'").count() == 3 >= plain.mixtures.where("sample_id = 'm'").count()
    (bad,) = plain.failed.collect()
    assert bad.sample_id == "x" and "non-finite" in bad.error and {r.sample_id for r in plain.verdict.collect()} == {"m"}
    assert analyze(df.where("sample_id = 'm'"), ["Fe", "O", "Si"]).clusters.count() >= 1


def _results(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in ("a", "b"):
        for i in range(24):
            fe = (0.3 if i % 2 else 0.5) + float(rng.normal(0, 0.004))
            rows.append((s, i, {"Fe": fe, "O": 1 - fe}, {"Fe": fe, "O": 1 - fe}, 0, 0.0))
    return spark.createDataFrame(rows, "sample_id string, spectrum_id long, at_fr map<string,double>, w_fr map<string,double>, quant_flag int, an_err double")


def test_two_samples_at_once_equal_two_jobs(spark):
    spark.sparkContext.setCheckpointDir("/tmp/sparkspec-checkpoints")
    df, settings = _results(spark), Clustering(k=2, ref_formulae=("FeO", "Fe3O4", "FeO2"))
    both = analyze(df, ["Fe", "O"], settings)
    rows = lambda a: sorted((r.sample_id, r.cluster_id, r.n_points, round(r.rms, 9)) for r in a.clusters.collect())
    assert rows(both) == sorted(rows(analyze(df.where("sample_id = 'a'"), ["Fe", "O"], settings)) + rows(analyze(df.where("sample_id = 'b'"), ["Fe", "O"], settings)))
    assert both.references.where("sample_id = 'a' and cluster_id = 0 and rank = 1").first().formula in ("FeO", "FeO2")
    assert both.mixtures is not None and both.free_mixtures is not None


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    df = _results(spark)
    src, store = f"file://{tmp_path}/src", f"file://{tmp_path}/store"
    df.where("spectrum_id < 12").repartition(2).write.parquet(src)
    schema = "sample_id string, spectrum_id long, at_fr map<string,double>, w_fr map<string,double>, quant_flag int, an_err double"
    make = lambda: Acquisition(spark, store, ["Fe", "O"], Clustering(k=2), least=20, most=100)
    make().run(spectra_stream(spark, src, schema, files_per_batch=1))
    df.where("spectrum_id >= 12").coalesce(1).write.mode("append").parquet(src)
    after = make()
    after.run(spectra_stream(spark, src, schema, files_per_batch=1))
    assert len(list((tmp_path / "store/verdicts").glob("batch=*"))) == 2  # the newest, and the one before it
    assert after.results().count() == 48 == after.results().select("sample_id", "spectrum_id").distinct().count()
    batch = {r.sample_id: (r.n_clusters, round(r.max_rms, 9)) for r in analyze(df, ["Fe", "O"], Clustering(k=2)).verdict.collect()}
    assert {r.sample_id: (r.n_clusters, round(r.max_rms, 9)) for r in after.verdicts().collect()} == batch and after.verdicts().where("done").count() == 2


def test_particles_until(spark):
    df = spark.createDataFrame([("A", i) for i in range(4)] + [("B", i) for i in range(4)], "frame_id string, particle_id long")
    assert sorted(tuple(r) for r in particles_until(df, 6).collect()) == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 0), ("B", 1)]


def test_detector_helpers():
    e = I.energies()
    flat = bg.respond(np.ones(len(e)), e, I.sigma)
    assert np.allclose(flat[20:-20], 1, atol=0.02)
    line = np.arange(10.0)
    assert np.allclose(bg.padded(line + 5, 3), np.arange(2.0, 18)) and bg.padded(line, 3).min() == 0
    assert bg.zero_strobe(np.array([0.0, 1.0]), 5.0)[0] == 5 and bg.zero_strobe(np.array([1.0]), 5.0)[0] < 1e-9
    from sparkspec.physics.fit import SpectrumFit

    fine, y = SpectrumFit(np.zeros(2048), ["Fe", "O"], I, T).fine_background({"Fe": 0.7, "O": 0.3})
    assert len(fine) > 20000 and (y >= 0).all() and np.isfinite(y).all()


def test_calibration_rows(spark):
    from sparkspec.operators import calibration as cal

    df = spark.createDataFrame([("d", e, float(np.sqrt(0.002 + 0.0004 * e))) for e in (1.0, 3.0, 6.4)], "k string, energy_kev double, sigma double")
    r = cal.width_calibration(df, ["k"]).first()
    assert r.p1 == pytest.approx(0.002) and r.p2 == pytest.approx(0.0004)
    x = np.linspace(-5, 5, 40)
    bins = spark.createDataFrame([(1, float(a), float(b), float(cal.lorentzian((a + b) / 2, 7, 0.4, 0.8))) for a, b in zip(x[:-1], x[1:])], "k int, lo double, hi double, n double")
    f = cal.lorentzian_of_histogram(bins, ["k"]).first()
    assert (f.height, f.center, f.width) == pytest.approx((7, 0.4, 0.8), rel=1e-3)
    frames = spark.createDataFrame([(f"A{i}",) for i in range(20)], "label string")
    one, two = ([r.label for r in cal.shuffled(frames.repartition(n), "label", 1).orderBy("place").collect()] for n in (1, 4))
    assert one == two != sorted(one)
    assert cal.calibration_of(spark.createDataFrame([("m", "point", 1, 0.1), ("m", "point", 2, 0.2)], "microscope string, mode string, valid_from int, scale double"), "m", "point").first().scale == 0.2


def test_spectra_hold_all_channels(spark, tmp_path):
    values = {1: [-15.0, 0.0, 605.0, 605.0, 1234.5] * 14, 2: [5.0, 15.0, 599.0]}
    spark.createDataFrame([(u, v) for u, vs in values.items() for v in vs], "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    seen = {(r.user_id, r.channel): r.n for r in queries.spectrum_histogram(spark, d).collect()}
    assert {r.user_id: r.total for r in queries.spectrum_total_counts(spark, d).collect()} == {1: 70.0, 2: 3.0}
    smooth = {(r.user_id, r.channel): r.value for r in queries.spectrum_smooth(spark, d).collect()}
    assert smooth.keys() == {(u, c) for u in values for c in range(-2, 124)}
    assert all(v == pytest.approx(sum(seen.get((u, c + i), 0) for i in (-1, 0, 1)) / 3, abs=1e-6) for (u, c), v in smooth.items())
    assert {r.user_id: r.flag for r in queries.spectrum_validity_flag(spark, d).collect()} == {1: 0, 2: 2}
    assert [r.particle_id for r in queries.first_spot_contaminated(spark, d).collect()] == [2]
    assert queries.particles_in_images(spark, d).where("image_id = '1'").count() == 4


def test_k_selection_reads_the_table(spark, tmp_path):
    """Two labels of points around two and three far centres."""
    rows = [(i, i % 2, [g * 0.3 + float(np.sin(i)) * 0.01, (g == 1) * 0.4 + float(np.cos(i)) * 0.01]) for i in range(120) for g in [i // 2 % (i % 2 + 2)]]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.k_selection(spark, str(tmp_path)).collect()
    assert sorted(r.spectrum_id for r in got) == list(range(120))
    assert all(r.sample_id == r.spectrum_id % 2 and r.k == r.sample_id + 2 for r in got)
    groups = {(r.sample_id, r.spectrum_id // 2 % (r.sample_id + 2), r.cluster_id) for r in got}
    assert len(groups) == 5 == len({(s, c) for s, _, c in groups})


def test_spectra_are_fitted_a_few_at_a_time(spark, monkeypatch):
    """A task never holds the results of a whole Arrow batch."""
    held = []
    df = spark.createDataFrame([(1, [0.0] * 2048)], "spectrum_id long, counts array<double>")
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: held.append(f) or spark.createDataFrame([], schema))
    fitting.quantified(df, queries.ELEMENTS, Instrument(), queries.demo_tables(), None, key=["spectrum_id"], target=1.0)
    rows = pd.DataFrame({"spectrum_id": range(200), "counts": [np.zeros(2048)] * 200, "quant_flag": 1.0})
    out = list(held[0](iter([rows, rows[:0]])))
    assert max(map(len, out)) <= 64 and [i for part in out for i in part["spectrum_id"]] == list(range(200))
    assert all((part["quant_flag"] == 1).all() for part in out)


@pytest.mark.parametrize(("depth", "offset", "slope"), [(1e-3, 0.0, 0.0), (2e-4, 1e-5, 0.4), (1e-1, 0.0, -0.5)])
def test_attenuation_is_its_sum_over_depth(depth, offset, slope):
    """Whether ionisation ends within the depth or not, the share is the sum over the nodes of each energy."""
    e, z, a, w, beam = np.arange(0.14, 11, 0.05), np.array([26.0, 8.0]), np.array([55.8, 16.0]), np.array([0.7, 0.3]), 15.0
    j, mu, room = z * 0.0115, 2000 / e**2.7, (beam - e)[:, None]
    u, at = beam / e, w / a / (w / a).sum()
    lift, back = u * np.log(u) / (u - 1), float((w * bg.eta(z, beam)).sum())
    alpha = (at * 2.14e5 * z**1.16 / (a * beam**1.25) * np.sqrt(np.log(1.166 * beam / j) / room)).sum(1)
    beta = (at * 1.1e5 * z**1.5 / (room * a)).sum(1)
    node, weight = np.polynomial.legendre.leggauss(48)
    rz = np.minimum(depth, 4 / alpha)[:, None] * (node + 1) / 2
    phi = weight * np.exp(-((alpha[:, None] * rz) ** 2)) * (((1 + back) * lift)[:, None] - ((1 + back) * lift - 1 - back * lift)[:, None] * np.exp(-beta[:, None] * rz))
    want = (phi * np.exp(-mu[:, None] * (rz * (1 + slope) + offset) / np.sin(np.deg2rad(28.5)))).sum(1) / phi.sum(1)
    got = bg.attenuation(e, mu, w, z, a, j, beam, 28.5, offset=offset, slope=slope, depth=depth)
    assert np.allclose(got, np.minimum(want, 1), rtol=0, atol=1e-13)


def _detected(energies, lines, continuum, rng, *, tail=(0.0, 1.0), loss=(0.0, 1.0, 1.0), escape=0.0, pileup=0.0, photons=400000):
    """Photons one by one, without code of the fit: charge lost near the face, exponential tails, escape, pile-up, resolution; then counted."""
    width, out = energies[1] - energies[0], []
    for kev, weight in lines:
        e = np.full(int(photons * weight), kev)
        depth = rng.exponential(1 / loss[2], len(e))
        radius, near = loss[1], depth < loss[1]
        cap = (radius - depth[near]) ** 2 * (2 * radius + depth[near]) / (4 * radius**3)
        if 1.18 <= kev <= 5:
            e[near] *= 1 - loss[0] * cap
        s = I.sigma(kev)
        if kev <= 1.839:
            late = rng.uniform(size=len(e)) < tail[0] / (1 + tail[0])
            e[late] -= rng.exponential(tail[1] * s, late.sum())
        lost = rng.uniform(size=len(e)) < escape
        e[lost] = kev - 1.74
        two = rng.uniform(size=len(e)) < pileup
        e[two] = 2 * kev
        out.append(e + rng.normal(size=len(e)) * I.sigma(np.maximum(e, 0.01)))
    edges = np.r_[energies - width / 2, energies[-1] + width / 2]
    return np.histogram(np.concatenate(out), edges)[0] + rng.poisson(continuum)


@pytest.mark.parametrize("detector", [{}, {"tail_share": 0.1, "tail_gamma": 3.0}, {"loss_share": 0.6, "loss_radius_um": 0.5}, {"tail_share": 0.1, "tail_gamma": 3.0, "loss_share": 0.6, "loss_radius_um": 0.5}])
def test_peaks_of_a_simulated_detector(detector):
    """Areas of tailed, smeared and overlapping lines within 2 %, with counting noise, escape and pile-up."""
    from dataclasses import replace

    from sparkspec.physics.fit import SpectrumFit, Tables

    grid = np.geomspace(0.05, 20, 60)
    tables = Tables({"O": {"Ka1": (0.525, 1.0)}, "Al": {"Ka1": (1.487, 1.0)}, "Si": {"Ka1": (1.74, 1.0)}, "Ca": {"Ka1": (3.69, 1.0), "Kb1": (4.01, 0.13)}, "Fe": {"Ka1": (6.4, 1.0)}}, {"Si": (grid.tolist(), (2000 / grid**2.7).tolist())})
    i, rng = replace(I, strobe_kev=0.06, **detector), np.random.default_rng(3)
    e, mu = I.energies(), lambda kev: 2.33e-4 * float(tables.mu("Si", np.array([kev]))[0])  # a micrometre
    shape = 60 * np.exp(-e / 4)
    truth = {"O": [(0.525, 1.0)], "Al": [(1.487, 0.5)], "Si": [(1.74, 0.25)], "Ca": [(3.69, 0.5), (4.01, 0.065)], "Fe": [(6.4, 1.0)]}
    got = sum(_detected(e, [line], shape * 0, rng, tail=(i.tail_share, i.tail_gamma), loss=(i.loss_share, i.loss_radius_um or 1.0, mu(line[0])), escape=0.01 if line[0] > 3 else 0.0, pileup=0.001 if 1.5 < line[0] < 5 else 0.0) for rows in truth.values() for line in rows)
    y = np.r_[np.zeros(I.start), got + rng.poisson(shape) + rng.poisson(bg.zero_strobe(e, 4000.0, sigma=0.06)), np.zeros(100)]
    fit = SpectrumFit(y, list(truth), i, tables)
    fit.reweigh(fit.solve(shape)["model"])
    done = fit.solve(shape)
    for (el, _, _), area in zip(fit.groups, done["areas"]):
        # escape and pile-up are peaks of their own
        kept = (0.99 if el in ("Ca", "Fe") else 1.0) * (0.999 if el in ("Si", "Ca") else 1.0)
        assert area == pytest.approx(truth[el][0][1] * 400000 * kept, rel=0.02), (el, area)
    # the continuum holds a fiftieth of all counts; a tail's width changes along it, which the fit leaves out (2.5 % of K over six seeds)
    assert done["k"] == pytest.approx(1, rel=0.05) and done["ok"]
    n = len(fit.groups)
    for c, share in zip(range(len(done["extra"])), done["extra"] / done["areas"][fit.parent]):
        assert -1e-12 <= share <= fit.most[c] * (1 + 1e-9)
    assert len(fit.mix) == n + len(fit.parent)


def test_fits_are_not_biased_by_counting_noise():
    from sparkspec.physics.fit import quantify

    mix, rng = {"Fe": 0.3, "Mg": 0.1, "Ca": 0.1, "Al": 0.1, "Si": 0.2, "O": 0.2}, np.random.default_rng(1)
    y = simulate(mix, STDS, I, T, 50000.0)
    done = [quantify(rng.poisson(y).astype(float), ELEMENTS, I, T, STDS) for _ in range(12)]
    for e, w in mix.items():
        assert np.mean([d["w_fr"][e] for d in done]) == pytest.approx(w, rel=0.03)
    assert all(d["quant_flag"] == 0 and 20 < d["redchi_sq"] < 100 for d in done)  # about the counts of a channel


def test_particles_have_a_way_out_of_their_own(spark):
    mix = {"Fe": 0.3, "Mg": 0.1, "Ca": 0.1, "Al": 0.1, "Si": 0.2, "O": 0.2}
    made = [simulate(mix, STDS, I, T, 50000.0, path=p) for p in ((0.0, 0.0), (2e-4, 0.8), (8e-4, 3.0))]
    df = spark.createDataFrame([(i, y.tolist(), p) for i, (y, p) in enumerate([(made[0], False), (made[1], True), (made[1], False), (made[2], True), (made[0], None)])], "spectrum_id long, counts array<double>, is_particle boolean")
    out = {r.spectrum_id: r for r in fitting.quantified(df, ELEMENTS, I, T, STDS, key=["spectrum_id"], target=50000.0, min_background=0.0).collect()}
    assert out[1].w_fr == pytest.approx(mix, abs=0.005) and 0.3 < out[1].absorbed < 0.7 and out[1].quant_flag == 0
    assert out[2].w_fr["O"] < 0.15 and out[2].absorbed is None and out[0].absorbed is None and out[4].absorbed is None
    assert out[3].absorbed > 0.7 and out[3].quant_flag == 6


def test_depth_integral_against_a_fine_sum():
    from sparkspec.physics.fit import SpectrumFit

    f = SpectrumFit(np.zeros(2048), ELEMENTS, I, T)
    els, fr, z, a, j = f._mixture({"Fe": 0.5, "O": 0.5})
    mu = sum(x * T.mu(e, f.e) for x, e in zip(fr, els))
    for path in ({}, {"offset": 2e-4, "slope": 1.5}):
        few, many = (bg.attenuation(f.e, mu, fr, z, a, j, 15.0, 28.5, points=n, **path) for n in (48, 600))
        assert np.allclose(few, many, rtol=1e-6, atol=1e-9) and (few <= 1).all()


def test_two_point_calibration_where_both_lines_meet(spark, tmp_path):
    """A supplier whose lines fall into one channel, and its neighbours, as DuckDB has them."""
    import duckdb

    spark.createDataFrame([(6600, 0), (6601, 0), (6599, 0), (6610, 1), (6839, 24), (3, 7)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    want = duckdb.sql(oracles.ORACLE_SQL["two_point_calibration"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in queries.two_point_calibration(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (6600, float("inf"), float("-inf")) in got


def test_slopes_of_a_fit_are_those_of_its_residual():
    """Derivatives by variable projection against differences, with escape peaks held at their limit and free; a shared model changes no result."""
    from sparkspec.physics.fit import SpectrumFit, quantify

    y = simulate({"Fe": 0.3, "Si": 0.3, "O": 0.4}, STDS, I, T, 50000.0)
    model = SpectrumFit(np.zeros(2048), ELEMENTS, I, T)
    fit = model.again(y)
    shape = fit.shape({e: 1 / 6 for e in ELEMENTS})
    at = lambda p: (a := fit.design(fit.columns(*p), shape), fit.linear(a))
    p = np.array([0.0005, 1.0003, 1.01])
    residual = lambda p: (lambda a, x: (a @ x - fit.y) * fit.weight)(*at(p))
    r, j = residual(p), fit.slopes(p, *at(p))
    numeric = np.stack([(residual(p + s) - residual(p - s)) / 2e-6 for s in np.eye(3) * 1e-6], 1)
    assert np.allclose(j.T @ r, numeric.T @ r, rtol=1e-3, atol=1e-3 * np.abs(numeric.T @ r).max())
    alone, shared = quantify(y, ELEMENTS, I, T, STDS), quantify(y, ELEMENTS, I, T, STDS, model=model)
    assert alone["w_fr"] == shared["w_fr"] and alone["peaks"] == shared["peaks"]


def test_smoothing_computes_its_values_once(spark):
    """The values that are smoothed may be an expression: it is bound, not computed again for each neighbour."""
    from sparkspec.functions.spectra import box_smooth

    df = spark.range(1).select(box_smooth(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i * 1.0)).alias("s"))
    assert df.first().s == pytest.approx([1, 2, 3, 7 / 3])
    assert spark.range(1).select(box_smooth(F.lit(None).cast("array<double>")).alias("s")).first().s is None
    plan = spark.range(1).select(box_smooth(F.filter(F.transform(F.sequence(F.lit(1), F.col("id") + 4), lambda i: i * 1.0), lambda x: x > 1)).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1


def test_images_are_drawn_by_many_tasks(spark, tmp_path, monkeypatch):
    """Each image is that of discs drawn one by one, and few bytes of events make many tasks."""
    spark.createDataFrame([(u, 10.0 * (u % 61)) for u in range(90) for _ in range(u % 14 + 1)], "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(queries, "segment_particles", lambda images, **how: seen.append(images) or images)
    rows = queries.particles_in_images(spark, str(tmp_path)).select("*", F.spark_partition_id().alias("task")).collect()
    y, x = np.mgrid[:196, :320]
    for r in rows:
        u, want = int(r.image_id), np.zeros((196, 320), np.uint8)
        for i in range(61):
            n = u % 14 + 1 if i == u % 61 else 0
            want[(x - 16 - 32 * (i % 10)) ** 2 + (y - 14 - 28 * (i // 10)) ** 2 <= min(11, n) ** 2] = 200
        assert (r.height, r.width) == (196, 320) and bytes(r.pixels) == want.tobytes()
    assert len(rows) == 90 and len({r.task for r in rows}) > 8
