"""Queries of the driver contract for the operators, on views over the driver's tables.

None of those tables holds spectra, so each operator runs on a view: ``events``
stand for spectra (users are spectra, value bands are channels) and particle
areas, ``lineitem`` for compositions (suppliers are samples, the six kinds of
line are elements), ``embeddings`` for clustered points.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import Clustering
from ..functions import chemistry, formulas, geometry, spectra, text
from ..operators import calibration, cluster, cluster_large, corrections, interpolate, lines, mixtures, refs, regions, select, standards, stats
from ..operators.fitting import quantified
from ..operators.images import segment_particles
from ..physics.fit import Instrument, SpectrumFit, Tables, simulate
from ..sources import formats, writers
from ..sources.versions import Versions
from ..operators.shared import shared_folder
from ..streaming.acquisition import particles_until as until
from ..streaming.running import Rounds, enqueue

ELEMENTS = ["Fe", "Mg", "Ca", "Al", "Si", "O"]
KINDS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, channel, n)."""
    return _t(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("value") / 10).cast("int").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def channel_range(spark: SparkSession, sf_dir: str, width: int = 60) -> tuple[int, int]:
    """First and end channel that hold every event of the table: 0 and ``width``, or beyond where values are."""
    low, high = channels(spark, sf_dir).agg(F.min("channel"), F.max("channel")).first()
    return (0, width) if low is None else (min(0, low), max(width, high + 1))


def spectra_view(spark: SparkSession, sf_dir: str, start: int, stop: int) -> DataFrame:
    """(user_id, counts): one array of the channels start .. stop - 1 a user."""
    rows = channels(spark, sf_dir).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "n"))).alias("m"))
    return rows.select("user_id", F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double")).alias("counts"))


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, element, w_fr)."""
    kind = F.concat("l_returnflag", "l_linestatus")
    element = F.element_at(F.create_map(*[F.lit(x) for p in zip(KINDS, ELEMENTS) for x in p]), kind)
    q = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", element.alias("element")).agg(F.sum("l_quantity").alias("q"))
    total = q.groupBy("l_suppkey").agg(F.sum("q").alias("t"))
    return q.join(total, "l_suppkey").select("l_suppkey", "element", (F.col("q") / F.col("t")).alias("w_fr"))


def points(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """(vec_id, label, fr) with all components, scaled."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * scale).alias("fr"))


def _phases(pts: DataFrame) -> DataFrame:
    """One reference phase for each label: its first vector."""
    return pts.groupBy("label").agg(F.min_by("fr", "vec_id").alias("fr")).select(F.col("label").alias("ref_idx"), F.concat(F.lit("R"), F.col("label").cast("string")).alias("formula"), "fr", (F.col("label") + 1).cast("double").alias("mix_weight"))


def _centroids(pts: DataFrame) -> DataFrame:
    """(label, fr, rms) of points."""
    long = pts.select("label", "vec_id", F.posexplode("fr").alias("i", "value"))
    features, rows = stats.cluster_statistics(long, ["label"], feature="i", point="vec_id")
    centre = features.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("i", "mean"))).alias("m"))
    return rows.join(centre, "label").select("label", "n_points", "rms", F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.element_at("m", i)).alias("fr"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quantification results: quant_flag, an_err and whether there is a composition."""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 11 - 1).cast("int").alias("quant_flag"), ((F.col("o_totalprice") % 100) / 500 - 0.1).alias("an_err"), (F.col("o_orderkey") % 13 != 0).alias("quantified"))


def json_prop_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def spectrum_histogram(spark, d):
    return channels(spark, d)


def spectrum_total_counts(spark, d):
    return spectra_view(spark, d, *channel_range(spark, d)).select("user_id", spectra.total_counts(F.col("counts")).alias("total"))


def spectrum_validity_flag(spark, d):
    start, stop = channel_range(spark, d)
    axis = spectra.energy_axis(start, stop, 0.0, 0.1)
    return spectra_view(spark, d, start, stop).select("user_id", F.coalesce(select.spectrum_flag(F.col("counts"), axis, 66.0, 1.4), F.lit(0)).alias("flag"))


def spectrum_smooth(spark, d):
    start, stop = channel_range(spark, d)
    smooth = spectra_view(spark, d, start, stop).select("user_id", F.posexplode(spectra.box_smooth(F.col("counts"))).alias("channel", "value"))
    return _round(smooth.withColumn("channel", F.col("channel") + start))


def composition_mass_fraction(spark, d):
    return _round(compositions(spark, d))


def mass_to_atomic(spark, d):
    return _round(chemistry.mass_to_atomic(compositions(spark, d), ["l_suppkey"]).select("l_suppkey", "element", "at_fr"))


def atomic_to_mass_roundtrip(spark, d):
    at = chemistry.mass_to_atomic(compositions(spark, d), ["l_suppkey"]).drop("w_fr")
    return _round(chemistry.atomic_to_mass(at, ["l_suppkey"]).select("l_suppkey", "element", "w_fr"))


def mean_atomic_number(spark, d):
    return _round(chemistry.mean_atomic_numbers(chemistry.mass_to_atomic(compositions(spark, d), ["l_suppkey"]), ["l_suppkey"]))


def normalise_mass_fractions(spark, d):
    off = compositions(spark, d).withColumn("w_fr", F.col("w_fr") * (0.8 + F.col("l_suppkey") % 5 * 0.1))
    return _round(chemistry.normalise_mass_fractions(off, ["l_suppkey"], undetectable=0.05))


def select_good(spark, d):
    reason = select.selection_reason(F.col("quant_flag"), F.col("an_err"), F.col("quantified"), undetectable=0.02)
    return _results(spark, d).select("o_orderkey", reason.alias("reason"))


def discard_report(spark, d):
    reason = select.selection_reason(F.col("quant_flag"), F.col("an_err"), F.col("quantified"), undetectable=0.02)
    return select.discard_report(_results(spark, d).withColumn("reason", reason), ["o_custkey"])


def post_fit_flag(spark, d):
    k = F.col("o_orderkey")
    flag = select.post_fit_flag(F.when(k % 7 < 3, (k % 7 + 1).cast("int")), k % 17 == 0, k % 5 == 0, (k % 30).cast("double"), 4.0, k % 19 != 0)
    return _t(spark, d, "orders").select("o_orderkey", flag.alias("flag"))


def first_spot_contaminated(spark, d):
    s = spectra_view(spark, d, *channel_range(spark, d)).select(F.lit("s").alias("sample_id"), (F.col("user_id") % 40).alias("particle_id"), F.col("user_id").alias("spectrum_id"), "counts")
    return select.first_spot_contaminated(s, 70.0)


def substrate_contamination(spark, d):
    rows = compositions(spark, d).select(F.lit("s").alias("sample_id"), F.col("l_suppkey").alias("spectrum_id"), "element", (F.col("w_fr") * 1000).alias("intensity"))
    totals = rows.groupBy("sample_id", "spectrum_id").agg(F.sum("intensity").alias("total"))
    return select.substrate_contamination(rows, totals, ["Al", "Si"], 0.17)


def fit_quality(spark, d):
    """Bad-fit codes over orders: reduced chi square, counts, error and absorbed share from their columns."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    code = select.fit_quality(price / 1000, price * (k % 5 + 1) / 4, (k % 40) / 50 - 0.2, (k % 100) / 100, k % 3 == 0)
    return _t(spark, d, "orders").select("o_orderkey", code.alias("code"))


def post_fit_flag_strict(spark, d):
    """As ``post_fit_flag``, where flags 4 to 9 stand though the fit did not converge."""
    k = F.col("o_orderkey")
    flag = select.post_fit_flag(F.when(k % 7 < 3, (k % 7 + 1).cast("int")), k % 17 == 0, k % 5 == 0, (k % 30).cast("double"), 4.0, k % 19 != 0, strict=True)
    return _t(spark, d, "orders").select("o_orderkey", flag.alias("flag"))


def _line_peaks(spark, d):
    """(user_id, element, line, is_reference, center, fwhm): the made-up lines for each user, moved by their id."""
    table = spark.createDataFrame(LINES, "element string, line string, energy_kev double, weight double")
    users = spectra_view(spark, d, *channel_range(spark, d)).select("user_id")
    return users.join(F.broadcast(table)).select("user_id", "element", "line", F.col("line").isin("Ka1", "La1").alias("is_reference"), (F.col("energy_kev") + F.col("user_id") % 7 * 0.03).alias("center"), (0.25 + F.col("energy_kev") * 0.02).alias("fwhm"))


def reference_background(spark, d):
    start, stop = channel_range(spark, d)
    ground = spectra_view(spark, d, start, stop).select("user_id", F.transform("counts", lambda c: c + 0.5).alias("background"))
    return _round(lines.least_reference_background(ground, _line_peaks(spark, d), ["user_id"], offset=start * 0.1, width=0.1))


def background_comments(spark, d):
    return reference_background(spark, d).select("user_id", select.background_comment(F.col("ref_background"), 1.0).alias("comment"))


def peak_windows(spark, d):
    first, n = lines.sample_windows(F.col("center"), F.col("fwhm"), 0.0, 0.1)
    return _line_peaks(spark, d).select("user_id", "element", "line", first.alias("first"), n.alias("n"))


def element_sets(spark, d):
    """Element lists of suppliers: what is detectable, and what a substrate adds."""
    c = compositions(spark, d).where("w_fr > 0.165").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("element")).alias("own"))
    both = F.concat("own", F.array(F.lit("He"), F.lit("Fe"), F.lit("H")))
    return c.select("l_suppkey", F.array_join(select.detectable(both), ",").alias("seen"), F.array_join(select.substrate_only(F.array(*[F.lit(e) for e in ("C", "Al", "O", "C")]), F.col("own")), ",").alias("substrate"))


def _long_points(spark, d):
    return points(spark, d).select("label", "vec_id", F.posexplode("fr").alias("component", "value"))


def cluster_stats(spark, d):
    return _round(stats.cluster_statistics(_long_points(spark, d), ["label"], feature="component", point="vec_id")[0])


def cluster_rms(spark, d):
    return _round(stats.cluster_statistics(_long_points(spark, d), ["label"], feature="component", point="vec_id")[1])


def _matches(spark, d):
    pts = points(spark, d, 0.03)
    return refs.match_references(_centroids(pts), _phases(pts), ["label"])


def cluster_reference_match(spark, d):
    return _round(_matches(spark, d).select("label", "ref_idx", "distance", "raw_conf", "conf"))


def cluster_reference_wide(spark, d):
    return _round(refs.wide_references(refs.ranked_references(_matches(spark, d), ["label"]), ["label"]))


def convergence(spark, d):
    pts = points(spark, d, 0.03)
    conf = refs.assigned_confidence(_matches(spark, d).withColumn("all_", F.lit(1)), ["label"], ["all_"])
    rms = _centroids(pts).agg(F.max("rms").alias("max_rms"), F.lit(1).alias("all_")).join(conf, "all_", "left")
    none = F.lit(None).cast("double")
    return _round(rms.select("max_rms", "min_conf", refs.converged(F.col("max_rms"), F.col("min_conf")).alias("with_refs"), refs.converged(F.col("max_rms"), none).alias("without_refs")))


def convergence_by_sample(spark, d):
    """As ``convergence``, each label a sample; only even labels have references, in pairs that are near each other, so some samples have none near."""
    pts = points(spark, d, 0.03)
    phases = _phases(pts).where("ref_idx % 2 = 0")
    twins = phases.select((F.col("ref_idx") + 100).alias("ref_idx"), F.concat(F.lit("T"), "formula").alias("formula"), F.transform("fr", lambda x: x * 1.01).alias("fr"), "mix_weight")
    centres = _centroids(pts).withColumn("rms", F.col("rms") / 5)
    found = refs.match_references(centres.withColumn("sample", F.col("label")), phases.unionAll(twins), ["label"], reach=0.036)
    conf = refs.assigned_confidence(found, ["label"], ["sample"])
    rows = centres.join(conf, F.col("label") == F.col("sample"), "left")
    return _round(rows.select("label", "rms", "min_conf", refs.converged(F.col("rms"), F.col("min_conf")).alias("converged")))


def pairwise_mixture_fit(spark, d):
    pts = points(spark, d, 0.03)
    fits = mixtures.fit_pairs(pts, _phases(pts), ["label"], every=True)
    return _round(fits.select("label", "ref1", "ref2", "n", "error", "conf", "molar_fr_mean", "molar_fr_std"), 5)


def mixture_ranking(spark, d):
    """Ranked mixtures of each label's points, with the names of both phases."""
    pts = points(spark, d, 0.03)
    fits = mixtures.fit_pairs(pts, _phases(pts).where("ref_idx < 5"), ["label"])
    return mixtures.ranked_mixtures(fits, ["label"]).select("label", "rank", "name", "conf")


def known_mixture(spark, d):
    """The confidence of a mixture that is known to be there: whatever its error."""
    pts = points(spark, d, 0.3)
    fits = mixtures.fit_pairs(pts, _phases(pts).where("ref_idx < 2"), ["label"], known=True)
    return _round(fits.select("label", "name", "error", "conf", "mol_ratio"), 4)


def single_phase(spark, d):
    best = _matches(spark, d).groupBy("label").agg(F.max("conf").alias("best"))
    rows = _centroids(points(spark, d, 0.03)).join(best, "label", "left")
    return rows.select("label", mixtures.is_single_phase(F.col("rms"), F.col("best"), F.col("n_points"), True).alias("with_refs"), mixtures.is_single_phase(F.col("rms"), F.col("best"), F.col("n_points"), False).alias("without_refs"))


def clusters_csv(spark, d):
    """The clusters file of suppliers by nation: percentages of mean, deviation and radius."""
    nation = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("cluster_id"))
    long = compositions(spark, d).join(nation, "l_suppkey").select("cluster_id", F.col("l_suppkey").alias("spectrum_id"), "element", F.col("w_fr").alias("value"))
    features, rows = stats.cluster_statistics(long, ["cluster_id"])
    wide = writers.clusters_table(features, rows, None, None, ELEMENTS[:2], feature="w")
    return wide.select("cluster_id", "n_points", *[F.round(f"`{c}`", 1).alias(a) for c, a in (("RMS_dist_w%", "rms_pct"), ("wcss_w%", "wcss_pct"), ("Fe_w%", "fe"), ("Fe_std_w%", "fe_std"), ("Mg_w%", "mg"), ("Mg_std_w%", "mg_std"))])


def spectra_csv(spark, d):
    """The data file of suppliers: percentages of fractions and error, flags, cluster ids."""
    c = compositions(spark, d).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("element", "w_fr"))).alias("w_fr"))
    rows = c.select(F.lit("s").alias("sample_id"), F.col("l_suppkey").alias("spectrum_id"), "w_fr", (F.col("l_suppkey") % 9 / 100).alias("an_err"), (F.col("l_suppkey") % 5).cast("int").alias("quant_flag"))
    labels = rows.where("quant_flag = 0").select("sample_id", "spectrum_id", (F.col("spectrum_id") % 3).cast("int").alias("cluster_id"))
    out = writers.spectra_table(rows, ["Fe", "O"], labels)
    return out.toDF(*["id", "fe", "o", "err", "cluster", "flag"][: len(out.columns)]).select("id", F.round("fe", 1).alias("fe"), F.round("o", 1).alias("o"), F.round("err", 1).alias("err"), "cluster", "flag")


def particle_table(spark, d):
    a = _areas(spark, d).select("particle_id", "frame_id", F.round("area", 6).alias("area_um2"), F.round("diameter", 6).alias("diameter_um"))
    return writers.particle_table(a).toDF("particle", "frame", "area", "diameter")


def silhouette_exact(spark, d):
    pts = points(spark, d).withColumn("sample", F.lit(1))
    return _round(cluster.exact_silhouettes(pts, ["sample"], "vec_id", "label", "fr").drop("sample"), 5)


def k_vote(spark, d):
    choices = _t(spark, d, "part").select(F.col("p_brand"), (F.col("p_size") % 6 + 1).alias("k"))
    return cluster.k_vote(choices, ["p_brand"], last_round=True)


def line_choice(spark, d):
    p = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("element"), F.element_at(F.array(*[F.lit(x) for x in ("Ka1", "La1", "Ma1", "Kb1")]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("line"), (F.col("l_quantity") / 5).alias("energy_kev"), F.col("l_extendedprice").alias("area"), F.col("l_partkey"), F.col("l_suppkey"))
    chosen = lines.quantification_line(p.withColumn("line", F.concat("line", F.lit(""))), ["l_orderkey"], beam_kev=15.0)
    return _round(chosen.select("l_orderkey", "element", "line", "energy_kev", "area"))


def _pb(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("el_line"), F.when(F.col("l_quantity") > 3, F.col("l_quantity") * 4).otherwise(F.lit(float("nan"))).alias("pb"))


def pb_stats(spark, d):
    return _round(stats.standards_of_lines(_pb(spark, d), ["el_line"]))


def _library(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_brand").alias("el_line"), F.concat(F.lit("std"), (F.col("p_partkey") % 300).cast("string")).alias("std_id"), F.col("p_retailprice").alias("corrected_pb"), (F.col("p_size") > 10).alias("use_for_mean"))


def standards_mean(spark, d):
    return _round(standards.standard_means(_library(spark, d), ["el_line"]))


def standards_upsert(spark, d):
    library = _library(spark, d)
    new = library.where(F.col("std_id").isin("std1", "std2", "std3")).where("use_for_mean").withColumn("corrected_pb", F.col("corrected_pb") + 1)
    return standards.upsert(library, new).select("el_line", "std_id", "corrected_pb", "use_for_mean")


def standard_results(spark, d):
    """The results table of standards: statistics of ratios with the matrix factor and mass fraction of each line."""
    factors = spark.range(19).select(F.col("id").alias("el_line"), (F.col("id") / 10 + 0.5).alias("zaf"), ((F.col("id") + 1) / 20).alias("w_fr"))
    return _round(standards.standard_results(stats.standards_of_lines(_pb(spark, d), ["el_line"]), factors, ["el_line"]))


def standards_for_formulas(spark, d):
    """Means over the standards of given formulas, which are compared when reduced, and the lines that have none."""
    formula = F.element_at(F.array(*[F.lit(f) for f in ("SiO2", "Si2O4", "Fe2O3", "FeO", "Al2O3")]), (F.col("p_size") % 5 + 1).cast("int"))
    library = _library(spark, d).withColumn("p_size", F.regexp_extract("std_id", r"\d+", 0).cast("int")).withColumn("formula", formula).where("el_line not like '%4' or formula = 'FeO'")
    means, missing = standards.means_for_formulas(library, ["O2Si", "Fe4O6"], ["el_line"])
    return _round(means.select("el_line", "mean_pb", "n_standards").unionAll(missing.select("el_line", F.lit(None).cast("double"), F.lit(0).cast("long"))))


def missing_reference(spark, d):
    """Spectra of standards that miss a reference line: orders with three kinds of lines."""
    peaks = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("element"), F.col("l_linestatus").alias("line"), (F.col("l_quantity") - 5).alias("area"))
    wanted = spark.createDataFrame([("N", "O"), ("R", "F"), ("N", "O")], "element string, line string")
    return standards.missing_reference_flag(peaks, wanted, ["l_orderkey"])


def k_ratio(spark, d):
    peaks = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("el_line"), F.col("p_size").cast("double").alias("pb"))
    means = standards.standard_means(_library(spark, d), ["el_line"]).where("el_line <> 'Brand#2'")
    return _round(standards.with_standard(peaks, means, ["el_line"]).select("p_partkey", "k_ratio", "error"))


def incremental_requantify_merge(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("an_err"))
    new = select.needs_quantification(o).withColumn("an_err", F.col("o_orderkey") * 0.5)
    return select.merge_requantified(o, new, ["o_orderkey"])


def _areas(spark, d):
    return _t(spark, d, "events").select(F.col("event_type").alias("frame_id"), F.col("event_id").alias("particle_id"), F.col("value").alias("area"), geometry.equivalent_diameter(F.col("value")).alias("diameter"))


def particle_stats(spark, d):
    return _round(stats.particle_statistics(_areas(spark, d), ["frame_id"]))


def particle_filter(spark, d):
    return _round(stats.drop_particles(_areas(spark, d), ids=[1, 3, 5], frames=["error"]).where(stats.area_in_range(F.col("area"), 0.5, 2.0, 25.0)))


def particle_histogram(spark, d):
    return _round(stats.histogram(_areas(spark, d), "diameter"))


def edge_particles(spark, d):
    """Parts as bounding boxes in a frame, and whether they come near its border."""
    x, y = F.col("p_partkey") % 997, F.col("p_size") * 15
    near = stats.touches_edge(x, y, x + F.col("p_size"), y + 10, F.lit(1000), F.lit(760))
    return _t(spark, d, "part").select("p_partkey", near.alias("near"))


def particles_until(spark, d):
    """Particles in order of frame and number until there are as many as wanted."""
    p = _t(spark, d, "events").select(F.col("user_id").alias("frame_id"), F.col("event_id").alias("particle_id"))
    return until(p, 321)


def stage_coordinates(spark, d):
    x, y = geometry.pixel_to_stage(F.col("p_size") * 10.0, F.col("p_partkey") % 700 * 1.0, 1024, 768, F.lit(0.25), F.col("p_partkey") % 11 * 1.0, F.lit(-2.0))
    return _round(_t(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y")))


def grid_offsets(spark, d):
    dx, dy = geometry.grid_offset(F.col("s_suppkey") % 40 - 2, 0.25, 2.5)
    return _round(_t(spark, d, "supplier").select("s_suppkey", dx.alias("dx"), dy.alias("dy")))


def fwhm_sigma(spark, d):
    return _round(_t(spark, d, "part").select("p_partkey", calibration.sigma_of_fwhm(F.col("p_size") / 100).alias("sigma")))


def grid_frames(spark, d):
    """Frames of the grid of each customer's sample: even ones are round with a margin, odd ones square, with sizes, spacings and centres of their own."""
    key = F.col("c_custkey")
    given = _t(spark, d, "customer").select("c_custkey", (F.lit(1.5) + key % 4 * 0.5).alias("half_width"), (F.lit(0.25) + key % 3 * 0.25).alias("spacing"), F.when(key % 2 == 0, 0.75).otherwise(1.0).alias("ratio"), (key % 2 == 0).alias("circle"), (key % 2 == 0).alias("margin"), (key % 10 * 1.0).alias("cx"), (key % 7 * -1.0).alias("cy"))
    return _round(geometry.grids(given, ["c_custkey"]))


def frame_coordinates(spark, d):
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("px"), (F.col("p_partkey") % 700 * 1.0).alias("py"))
    rx, ry = geometry.pixel_to_relative(F.col("px"), F.col("py"), 1024, 768)
    p = p.withColumns({"rx": rx, "ry": ry})
    bx, by = geometry.relative_to_pixel(F.col("rx"), F.col("ry"), 1024, 768)
    return _round(p.withColumns({"bx": bx, "by": by}))


def excel_letters(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", text.excel_letters(F.col("o_orderkey") % 20000).alias("letters"))


def clean_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey", text.clean_id(F.concat(F.lit(" -"), F.col("c_name"), F.lit("# . "))).alias("id"))


def line_keys(spark, d):
    return _t(spark, d, "part").select("p_partkey", *text.line_parts(F.regexp_replace("p_name", " ", "_")))


def two_point_calibration(spark, d):
    s = _t(spark, d, "supplier")
    of = lambda x: F.lit(Decimal(x))
    new = spectra.two_point_calibration(F.lit(0.01), of("0.02"), [of("1.4") + F.col("s_suppkey") * of("0.001"), of("8.0") + F.col("s_nationkey") * of("0.01")], [of("1.4866"), of("8.0478")])
    return s.select("s_suppkey", *[(F.round(c * 1e8) / 1e8).alias(n) for c, n in zip(new, ("width", "offset"))])


def latest_calibration(spark, d):
    e = _t(spark, d, "events").select("event_type", F.date_format("ts", "yyyyMMdd_HH'h'mm'm'ss").alias("stamp"), "event_id", F.col("value").alias("offset"), (F.col("value") / 100).alias("scale"), F.when(F.col("event_id") % 3 != 0, 4.3).alias("spot_size"))
    named = e.withColumn("file_name", F.concat("stamp", F.lit("_"), F.lpad(F.col("event_id").cast("string"), 9, "0")))
    return _round(standards.latest_calibration(named.drop("stamp", "event_id"), ["event_type"]))


def interp_lookup(spark, d):
    p = _t(spark, d, "part")
    curve = p.groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    rows = _t(spark, d, "events").select("event_id", (F.col("value") / 5).alias("at"))
    return _round(interpolate.interpolate(rows, curve, at="at", bin_width=4.0).select("event_id", "value"))


def trapezoid(spark, d):
    c = channels(spark, d).select("user_id", F.col("channel").cast("double").alias("x"), F.col("n").cast("double").alias("y"))
    return _round(interpolate.trapezoid(c, ["user_id"]))


def detector_sigma(spark, d):
    return _round(_t(spark, d, "events").select("event_id", spectra.detector_sigma(F.col("value") / 40, 0.00363, 8.0, 0.115).alias("sigma"), spectra.sigmoid_parameter(F.col("value") / 40, 1.0, 3.0, 0.9, 9.0).alias("gamma")))


def rdev_shares(spark, d):
    c = compositions(spark, d).withColumn("expected", F.lit(100 / 6)).withColumn("measured", F.col("w_fr") * 100)
    return _round(stats.deviation_shares(c, "measured", "expected"))


def element_frequency(spark, d):
    return stats.element_frequency(compositions(spark, d).where("w_fr > 0.167"))


def fit_summary_rows(spark, d):
    s = _t(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("row"), "s_acctbal")
    return _round(stats.with_summary_rows(s, ["s_nationkey"], "row", ["s_acctbal"]), 5)


#: A small, made-up line table: element, line, energy in keV, weight.
LINES = [("Fe", "Ka1", 6.4, 1.0), ("Fe", "Kb1", 7.06, 0.13), ("Fe", "La1", 0.7, 1.0), ("Mg", "Ka1", 1.25, 1.0), ("Ca", "Ka1", 3.69, 1.0), ("Ca", "Kb1", 4.01, 0.13), ("Al", "Ka1", 1.49, 1.0), ("Si", "Ka1", 1.74, 1.0), ("O", "Ka1", 0.525, 1.0)]


def eligible_lines(spark, d):
    table = spark.createDataFrame(LINES, "element string, line string, energy_kev double, weight double")
    return _round(lines.eligible_lines(compositions(spark, d), table, beam_kev=15.0, least_kev=0.3, most_kev=11.0, sigma_least=0.03))


def reference_lines(spark, d):
    """The line to which a part's line is tied, where parts name an element, a line and whether there is a La1."""
    of = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select("p_partkey", of(["Fe", "Pb", "Ba", "Ca", "Ce", "Pr"], k % 6).alias("element"), of(["Kb1", "Lb1", "Mb", "N4"], F.col("p_size") % 4).alias("line"), (k % 5 < 2).alias("has_la1"))
    return rows.select("*", lines.reference_line(F.col("element"), F.col("line"), F.col("has_la1")).alias("ref"))


def _line_tables(spark):
    """Made-up tables of main lines, absorption and ionisation potentials."""
    main = [x for x in LINES if x[1] == "Ka1"]
    table = spark.createDataFrame([(e, l, k) for e, l, k, _ in main], "element string, line string, energy_kev double")
    mu = spark.createDataFrame([(e, l, a, 3000.0 * chemistry.Z[a] ** 1.5 / 100 / k**2) for e, l, k, _ in main for a in ELEMENTS], "element string, line string, absorber string, mu double")
    ion = spark.createDataFrame([(chemistry.Z[e], 11.5 * chemistry.Z[e]) for e in ELEMENTS], "z int, j_ev double")
    return table, mu, ion


def zaf_factors(spark, d):
    return _round(corrections.zaf_factors(compositions(spark, d), *_line_tables(spark), ["l_suppkey"], beam_kev=15.0, takeoff_deg=28.5, p="1.0 + 0.001 * z", f="1.0 - 0.0005 * z", beta="0.05 + 0.001 * z"))


def zaf_fixed_point(spark, d):
    """Fractions from ratios that are off by up to a tenth, corrected until they stand."""
    ratios = compositions(spark, d).select("l_suppkey", "element", F.lit("Ka1").alias("line"), (F.col("w_fr") * (0.9 + F.col("l_suppkey") % 5 * 0.05)).alias("k_ratio"))
    return _round(corrections.quantify_ratios(ratios, *_line_tables(spark), ["l_suppkey"], beam_kev=15.0, takeoff_deg=28.5, p=lambda z: 1.0 + 0.001 * z, f=lambda z: 1.0 - 0.0005 * z, beta=lambda z: 0.05 + 0.001 * z))


def _part_formulas(spark, d):
    """A formula for each part, with nested brackets and decimal amounts; of every eleventh one bracket is missing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(e) for e in ELEMENTS])
    pick = lambda i: F.get(names, i.cast("int"))
    text = F.concat(pick(k % 6), (size % 4 + 1).cast("string"), F.lit("("), pick(F.floor(k / 6) % 6), F.lit("["), pick(size % 6), (k % 3 + 1).cast("string"), F.when(k % 11 == 0, "").otherwise("]"), F.lit("2 )"), ((k % 5 + 1) * 0.5).cast("decimal(3,1)").cast("string"))
    return _t(spark, d, "part").select("p_partkey", text.alias("formula"))


def formulas_read(spark, d):
    """Formulas of parts read as columns: reduced, as LaTeX, their mass and what share of it is oxygen."""
    amounts = formulas.formula_amounts(F.col("formula"))
    read = _part_formulas(spark, d).withColumn("amounts", amounts)
    share = F.coalesce(F.element_at(formulas.mass_fractions_of_amounts(F.col("amounts")), "O"), F.when(F.col("amounts").isNotNull(), 0.0))
    return _round(read.select("p_partkey", formulas.reduced_of(F.col("amounts")).alias("reduced"), formulas.latex_of(F.col("formula")).alias("latex"), formulas.formula_mass_of(F.col("amounts")).alias("mass"), share.alias("oxygen")), 4)


def pretty_formulas(spark, d):
    """A formula for each supplier's atomic fractions, of those over a sixth."""
    at = chemistry.mass_to_atomic(compositions(spark, d), ["l_suppkey"]).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("element", "at_fr"))).alias("m"))
    return at.select("l_suppkey", formulas.pretty_of(F.col("m"), 1 / 6).alias("formula"))


def width_calibration(spark, d):
    p = _t(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("energy_kev"), F.sqrt(F.col("p_retailprice")).alias("sigma"))
    return _round(calibration.width_calibration(p, ["p_brand"]), 5)


def calibration_lookup(spark, d):
    e = _t(spark, d, "events").select(F.lit("m1").alias("microscope"), F.col("event_type").alias("mode"), F.concat(F.col("ts").cast("string"), F.lit(" "), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("valid_from"), F.col("value").alias("scale"), "event_id")
    return _round(calibration.calibration_of(e.drop("valid_from").withColumn("valid_from", F.col("event_id")), "m1", "click"))


def sample_accuracy(spark, d):
    rows = compositions(spark, d).select("l_suppkey", (F.col("w_fr") * 100).alias("measured"), F.lit(100 / 6).alias("expected"), (F.col("l_suppkey") % 4 - 1).cast("int").alias("quant_flag"), F.lit(0.01).alias("an_err"))
    return _round(calibration.accuracy(rows, ["l_suppkey"]))


def shuffled_frames(spark, d):
    return calibration.shuffled(_t(spark, d, "customer").select("c_name"), "c_name", 3)


def histogram_fit(spark, d):
    """A Lorentzian through the histogram of all components of each label's vectors."""
    v = _t(spark, d, "embeddings").where("label is not null").select("label", F.explode("embedding").alias("x"))
    bins = v.where("x is not null and not isnan(x)").groupBy("label", F.floor(F.col("x").cast("double") * 50).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select("label", (F.col("i") / 50).alias("lo"), ((F.col("i") + 1) / 50).alias("hi"), "n")
    return _round(calibration.lorentzian_of_histogram(bins, ["label"]).drop("rounds"), 5)


def kmeans_labels(spark, d):
    pts = points(spark, d).select(F.col("label").alias("sample_id"), F.col("vec_id").alias("spectrum_id"), "fr")
    return cluster.cluster_samples(pts, ["sample_id"], k=3).drop("error")


def k_selection(spark, d):
    """As ``kmeans_labels``, with the k of each sample searched for."""
    pts = points(spark, d).select(F.col("label").alias("sample_id"), F.col("vec_id").alias("spectrum_id"), "fr")
    return cluster.cluster_samples(pts, ["sample_id"], method="silhouette").drop("error")


def kmeans_rounds(spark, d):
    """Four rounds over all vectors of even and of odd labels, for two and three clusters at once, from the first vectors as centres; with the Calinski-Harabasz score of each."""
    pts = points(spark, d).select((F.col("label") % 2).alias("sample_id"), F.col("vec_id").alias("spectrum_id"), "fr")
    dims = pts.select(F.size("fr")).first()[0]
    first = pts.withColumn("r", F.row_number().over(W.partitionBy("sample_id").orderBy("spectrum_id"))).where("r <= 3").groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "fr"))), lambda x: x["fr"]).alias("c"))
    start = first.select("sample_id", F.array(F.slice("c", 1, 2), F.slice("c", 1, 3)).alias("tries"))
    ended = cluster_large.lloyd(pts, start, ["sample_id"], "spectrum_id", dims, rounds=4)
    sums = cluster_large.lloyd_sums(pts, ended, ["sample_id"], "spectrum_id", dims)
    good = cluster_large.scores(sums, ["sample_id"]).select("sample_id", "k", "calinski_harabasz")
    return _round(sums.join(good, ["sample_id", "k"]).select("sample_id", "k", F.col("cluster").cast("int").alias("cluster"), "n", "inertia", "calinski_harabasz"))


def free_mixture(spark, d):
    c = compositions(spark, d)
    wide = c.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("element", "w_fr"))).alias("m"))
    pts = wide.select((F.col("l_suppkey") % 4).alias("cluster_id"), select.filled(F.col("m"), ELEMENTS).alias("fr"))
    return mixtures.free_mixture(pts, ["cluster_id"], ELEMENTS)


def demo_tables() -> Tables:
    """Made-up physics tables for demonstrations."""
    by: dict[str, dict] = {}
    for e, l, k, w in LINES:
        by.setdefault(e, {})[l] = (k, w)
    grid = np.geomspace(0.05, 20, 60)
    return Tables(by, {e: (grid.tolist(), (200 * chemistry.Z[e] ** 1.5 / grid**2.7 / 30).tolist()) for e in ELEMENTS})


def fit_peaks(spark, d):
    """Noiseless spectra of the suppliers' compositions, fitted and quantified."""
    c = compositions(spark, d).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("element", "w_fr"))).alias("m"))
    c = cluster.spread(c, ["l_suppkey"])
    instrument, tables, stds = Instrument(), demo_tables(), {(e, "Ka1"): 3000.0 for e in ELEMENTS}

    def made(batches):
        models = {}  # what fits of one list of elements share
        for rows in batches:
            for at in range(0, len(rows), 64):  # 64 spectra at a time
                some, out = rows.iloc[at : at + 64], []
                for m in some["m"]:
                    w = dict(sorted(dict(m).items()))
                    if tuple(w) not in models:
                        models[tuple(w)] = SpectrumFit(np.zeros(2048), list(w), instrument, tables)
                    out.append(simulate(w, stds, instrument, tables, 50000.0, model=models[tuple(w)]))
                yield some.assign(counts=out)[["l_suppkey", "counts"]]

    s = c.mapInPandas(made, "l_suppkey long, counts array<double>")
    out = quantified(s, ELEMENTS, instrument, tables, stds, key=["l_suppkey"], target=50000.0)
    return out.select("l_suppkey", "quant_flag", F.explode("w_fr").alias("element", "w_fr"))


def particles_in_images(spark, d):
    """Discs drawn from the users' spectra, one for each channel, segmented."""

    def drawn(batches):
        import pandas as pd

        y, x = np.mgrid[:28, :32]
        discs = np.array([((x - 16) ** 2 + (y - 14) ** 2 <= r * r) * 200 for r in range(12)] + [0 * x], np.uint8)  # by radius; the last is blank
        high = -(-(stop - start) // 10)
        for rows in batches:
            for at in range(0, len(rows), 64):  # 64 images at a time
                some = rows.iloc[at : at + 64]
                radius = np.full((len(some), high * 10), 12)
                radius[:, : stop - start] = np.minimum(np.array(some["counts"].tolist()), 11)
                images = discs[radius].reshape(-1, high, 10, 28, 32).transpose(0, 1, 3, 2, 4)
                yield pd.DataFrame({"image_id": some["user_id"].astype(str).to_numpy(), "height": 28 * high, "width": 320, "pixel_size_um": 0.5, "pixels": [i.tobytes() for i in images]})

    start, stop = channel_range(spark, d)
    images = cluster.spread(spectra_view(spark, d, start, stop), ["user_id"]).mapInPandas(drawn, "image_id string, height int, width int, pixel_size_um double, pixels binary")
    return segment_particles(images, least_um2=1.0)


def spectra_source(spark, d):
    """Vectors as spectra tables, a directory for each label, read back by their format with a filter that opens the directories of three labels."""
    v = _t(spark, d, "embeddings").where("label is not null")
    counts = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("double"))
    rows = v.select(F.col("label").cast("string").alias("sample_id"), F.col("vec_id").alias("spectrum_id"), (F.col("vec_id") % 7 - 1).cast("int").alias("quant_flag"), F.create_map(F.lit("Fe"), (F.col("vec_id") % 100) / 100).alias("w_fr"), counts.alias("counts"))
    at = shared_folder(spark, "spectra")
    keyed = rows.select("sample_id", F.col("spectrum_id").alias("Spectrum #"), F.bround(F.element_at("w_fr", "Fe") * 100, 2).alias("Fe_w%"), F.col("quant_flag").alias("Quant_flag"), F.concat(F.lit("["), F.array_join(F.transform("counts", lambda x: x.cast("string")), ","), F.lit("]")).alias("Spectrum"))
    keyed.write.partitionBy("sample_id").option("header", True).option("escape", '"').csv(f"{at}/tables")
    read = formats.load(spark, "spectra_csv", f"{at}/tables", "sample_id string, spectrum_id long, quant_flag int, w_fr map<string,double>, counts array<double>")
    some = read.where(F.col("sample_id").isin("1", "4", "7"))
    return _round(some.select("sample_id", "spectrum_id", "quant_flag", F.element_at("w_fr", "Fe").alias("fe"), F.aggregate("counts", F.lit(0.0), lambda s, x: s + x).alias("total")))


def latest_version(spark, d):
    """Quality labels written as three versions, the last of them cut off before its manifest: what a reader sees, with the number of rows that the manifest states."""
    rows = _t(spark, d, "labels").where("doc_id is not null")
    store = Versions(spark, shared_folder(spark, "versions"))
    store.write({"Labels": rows.where("doc_id % 2 = 0")})
    store.write({"Labels": rows.withColumn("quality", 1 - F.col("quality"))})
    killed = store.claim()
    rows.limit(1).write.parquet(f"{store.root}/v={killed}/Labels")
    return store.read("Labels").select("doc_id", "quality", F.lit(store.manifest()["tables"]["Labels"]["rows"]).cast("long").alias("n_rows"))


def image_regions(spark, d):
    """Sixty-four vectors are the rows of an image, large components its foreground: its regions with area, box and centroid."""
    v = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image"), (F.col("vec_id") % 64).alias("y"), F.posexplode("embedding").alias("x", "value"))
    runs = regions.regions_of(v.where("value > 0.08"), ["image"])
    return _round(regions.region_statistics(runs, ["image"]))


def acquisition_rounds(spark, d):
    """Forty vectors are a sample, label modulo three its phase; samples of unlike scale converge early, late or not: what each round admits and how it is judged, run as a stream."""
    v = _t(spark, d, "embeddings").withColumn("s", F.floor(F.col("vec_id") / 40))
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.lit(0.024) + F.col("s") % 6 * 0.001))
    at = shared_folder(spark, "rounds")
    enqueue(v.select(F.col("s").alias("sample_id"), F.col("vec_id").alias("spectrum_id"), (F.col("label") % 3).alias("cluster_id"), scaled.alias("fr")), at, least=20, most=35)
    rounds = Rounds(spark, at, least=20, most=35)
    rounds.run()
    judged = rounds.verdicts().withColumn("sample_id", F.col("sample_id").cast("long"))
    return _round(judged.select("sample_id", "round", "admitted", "n_results", "n_clusters", "max_rms", "converged", "done"))


def flagship(spark, d):
    """Compositions of all suppliers, clustered by a given label, against reference formulas."""
    from .analyze import analyze

    c = chemistry.mass_to_atomic(compositions(spark, d), ["l_suppkey"])
    m = c.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("element", "at_fr"))).alias("at_fr"), F.map_from_entries(F.collect_list(F.struct("element", "w_fr"))).alias("w_fr"))
    rows = m.select((F.col("l_suppkey") % 3).alias("sample_id"), F.col("l_suppkey").alias("spectrum_id"), "at_fr", "w_fr", F.lit(0).alias("quant_flag"), F.lit(0.0).alias("an_err"))
    labels = rows.select("sample_id", "spectrum_id", (F.col("spectrum_id") % 2).cast("int").alias("cluster_id"))
    done = analyze(rows, ELEMENTS, Clustering(ref_formulae=("Fe2Mg5Ca3Al4Si4O7", "FeMg2CaAl2Si2O3", "FeMg2CaAl2Si2O4", "CaMgSi2O6", "Mg2SiO4")), labels=labels)
    return _round(done.clusters.select("sample_id", "cluster_id", "n_points", "wcss", "rms").join(refs.wide_references(done.references, ["sample_id", "cluster_id"]), ["sample_id", "cluster_id"], "left"))


QUERIES = {f.__name__: f for f in (
    json_prop_extract, spectrum_histogram, spectrum_total_counts, spectrum_validity_flag, spectrum_smooth, composition_mass_fraction, mass_to_atomic, atomic_to_mass_roundtrip, mean_atomic_number,
    normalise_mass_fractions, select_good, discard_report, post_fit_flag, first_spot_contaminated, substrate_contamination, cluster_stats, cluster_rms, cluster_reference_match, cluster_reference_wide,
    convergence, pairwise_mixture_fit, silhouette_exact, k_vote, line_choice, pb_stats, standards_mean, standards_upsert, k_ratio, incremental_requantify_merge, particle_stats, particle_filter,
    particle_histogram, grid_frames, frame_coordinates, excel_letters, clean_ids, line_keys, two_point_calibration, latest_calibration, interp_lookup, trapezoid, detector_sigma, rdev_shares,
    element_frequency, fit_summary_rows, eligible_lines, reference_lines, zaf_factors, zaf_fixed_point, formulas_read, pretty_formulas,
    width_calibration, calibration_lookup, convergence_by_sample, fit_quality, post_fit_flag_strict, reference_background, background_comments, peak_windows, element_sets, mixture_ranking, known_mixture,
    single_phase, clusters_csv, spectra_csv, particle_table, standard_results, standards_for_formulas, missing_reference, edge_particles, particles_until, stage_coordinates, grid_offsets, fwhm_sigma,
    sample_accuracy, shuffled_frames, histogram_fit, kmeans_labels, k_selection, kmeans_rounds, free_mixture, fit_peaks, particles_in_images, image_regions, latest_version, spectra_source, acquisition_rounds, flagship,
)}
