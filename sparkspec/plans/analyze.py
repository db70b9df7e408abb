"""Analyses of whole tables of samples: selection, clusters, statistics, references, mixtures; and what runners did one sample at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import Clustering, default_clustering
from ..functions.chemistry import parse_formula
from ..operators import cluster, mixtures, refs, select, standards, stats
from ..operators.fitting import fit_parameters, peak_rows, quantified
from ..operators.shared import cut
from ..physics.fit import Instrument, Tables

KEY = ["sample_id", "cluster_id"]


@dataclass
class Analysis:
    """Tables of an analysis; all have sample_id."""

    selected: DataFrame
    report: DataFrame
    labels: DataFrame
    features: DataFrame
    clusters: DataFrame
    references: DataFrame | None
    mixtures: DataFrame | None
    free_mixtures: DataFrame | None
    verdict: DataFrame
    failed: DataFrame


def analyze(results: DataFrame, elements: list[str], settings: Clustering | None = None, *, undetectable: float = 0.0, labels: DataFrame | None = None, least: int = 5, known_mixture: bool = False, keep=None) -> Analysis:
    """Analyse all samples of ``results`` (sample_id, spectrum_id, at_fr, w_fr, quant_flag, an_err) in one job.

    Samples with fewer than ``least`` good spectra drop out. ``labels``
    (sample_id, spectrum_id, cluster_id) replaces the clustering if given.
    Without ``settings`` those stand that the elements suggest. With
    ``known_mixture`` the samples are mixtures of the reference phases, and all
    their pairs are ranked, whatever their error.
    A sample that cannot be clustered is in ``failed`` with its error, and in
    no other table but the report. ``keep`` cuts lineage of what is read several times, the labels, clusters
    and points of mixtures (default: a checkpoint).
    """
    spark = results.sparkSession
    settings = settings or default_clustering(elements)
    fr = F.col(settings.features)
    limit = None if settings.max_analytical_error_percent is None else settings.max_analytical_error_percent / 100
    named = results.withColumn("reason", select.selection_reason(F.col("quant_flag"), F.col("an_err"), fr.isNotNull(), max_err=limit, undetectable=undetectable, accepted=settings.quant_flags_accepted))
    report = select.discard_report(named, ["sample_id"])
    good = named.where("reason = 'good'").select("sample_id", "spectrum_id", select.filled(fr, elements).alias("fr"))
    if labels is None:
        made = cluster.cluster_samples(good, ["sample_id"], k=settings.k, max_k=settings.max_k, method=settings.k_finding_method if settings.k_finding_method != "forced" else "silhouette", seed=settings.seed, least=least)
        labels = (keep or cut)(made)
        failed = labels.where("error is not null").select("sample_id", "error")
        labels = labels.where("error is null")
    else:
        failed = good.select("sample_id", F.lit(None).cast("string").alias("error")).limit(0)
    points = good.join(labels.select("sample_id", "spectrum_id", "cluster_id"), ["sample_id", "spectrum_id"])
    names = F.array(*[F.lit(e) for e in elements])
    long = points.select(*KEY, "spectrum_id", F.explode(F.arrays_zip(names.alias("element"), F.col("fr").alias("value"))).alias("p")).select(*KEY, "spectrum_id", "p.element", "p.value")
    features, rows = stats.cluster_statistics(long, KEY)
    means = F.map_from_entries(F.collect_list(F.struct("element", "mean")))
    centres = features.groupBy(*KEY).agg(means.alias("m")).select(*KEY, select.filled(F.col("m"), elements).alias("fr"))
    # a row a cluster, and the points of clusters that are no single phase: later steps come back to both several times
    clusters = (keep or cut)(rows.join(centres, KEY))
    found = mix = free = None
    if settings.ref_formulae:
        phases, _ = refs.reference_phases(spark, list(settings.ref_formulae), elements, by_mass=settings.features == "w_fr")
        found = refs.match_references(clusters, phases, KEY)
        best = found.groupBy(*KEY).agg(F.max("conf").alias("max_conf"))
    else:
        best = clusters.select(*KEY, F.lit(None).cast("double").alias("max_conf"))
    judged = clusters.join(best, KEY, "left")
    # without references the published rule lets a tight cluster of any size pass to the free mixture
    mixed = judged.where(~F.coalesce(mixtures.is_single_phase(F.col("rms"), F.col("max_conf"), F.col("n_points"), True), F.lit(False))).select(*KEY)
    suspects = (keep or cut)(points.join(mixed, KEY, "left_semi"))
    if found is not None and len(settings.ref_formulae) > 1:
        mix = mixtures.ranked_mixtures(mixtures.fit_pairs(suspects, phases, KEY, known=known_mixture), KEY)
        explained = mix.where("conf >= 0.5").select(*KEY).distinct()
        suspects = suspects.join(explained, KEY, "left_anti")
    free = mixtures.free_mixture(suspects, KEY, elements, seed=settings.seed)
    per = clusters.groupBy("sample_id").agg(F.max("rms").alias("max_rms"), F.count(F.lit(1)).alias("n_clusters"), F.sum("wcss").alias("wcss"), F.sum("n_points").alias("n_used"))
    conf = refs.assigned_confidence(found, ["cluster_id"], ["sample_id"]) if found is not None else per.select("sample_id", F.lit(None).cast("double").alias("min_conf"))
    verdict = per.join(conf, "sample_id", "left").withColumn("converged", F.coalesce(refs.converged(F.col("max_rms"), F.col("min_conf")), F.lit(False)))
    return Analysis(named, report, labels, features, clusters, refs.ranked_references(found, KEY) if found is not None else None, mix, free, verdict, failed)


def quantify_and_analyze(spectra: DataFrame, elements: list[str], instrument: Instrument, tables: Tables, library: dict[tuple[str, str], float], settings: Clustering, *, target: float, only_missing: bool = True, **how) -> tuple[DataFrame, Analysis]:
    """Quantify the spectra that have no result yet (or all) and analyse everything.

    Where ``spectra`` has a particle_id, particles whose first spot is
    contaminated (``select.first_spot_contaminated``) are left out, and rows
    with one are fitted as particles.
    """
    particle = [F.col("particle_id").isNotNull().alias("is_particle")] if "particle_id" in spectra.columns else []
    if "particle_id" in spectra.columns:
        spectra = spectra.join(select.first_spot_contaminated(spectra, target), ["sample_id", "particle_id"], "left_anti")
    key = ["sample_id", "spectrum_id"]
    todo = select.needs_quantification(spectra) if only_missing and "an_err" in spectra.columns else spectra
    new = quantified(todo.select(*key, "counts", *particle), elements, instrument, tables, library, key=key, target=target, **how)
    new = new.drop("is_particle")
    rest = spectra.drop("counts", "background")
    results = select.merge_requantified(rest, new.drop("counts"), key) if only_missing and "an_err" in spectra.columns else new
    return results, analyze(results, elements, settings)


def build_standards(spectra: DataFrame, formula: str, std_id: str, references: DataFrame, instrument: Instrument, tables: Tables, zaf: dict[tuple[str, str], float], *, mode: str, beam_kev: float, target: float, least_pb: float = 10.0) -> DataFrame:
    """Standard entries (mode, el_line, std_id, measured_pb, corrected_pb, stdev_pb, n_spectra, ...) from spectra of one compound.

    ``zaf`` holds the matrix factor of each reference line in that compound;
    spectra that miss a reference line are flagged 10 and do not count.
    """
    from ..functions.chemistry import mass_fractions_of

    w = mass_fractions_of(formula)
    key = ["sample_id", "spectrum_id"]
    fits = quantified(spectra.select(*key, "counts"), list(w), instrument, tables, None, key=key, target=target)
    peaks = peak_rows(fits.where("quant_flag = 0"), key)
    whole = standards.missing_reference_flag(peaks, references, key).where("quant_flag = 0")
    lines = peaks.join(whole.select(*key), key, "left_semi").join(references.select("element", "line").distinct(), ["element", "line"], "left_semi")
    pb = stats.standards_of_lines(lines, ["element", "line"], least=least_pb)
    factor = spectra.sparkSession.createDataFrame([(e, l, float(v), float(w[e])) for (e, l), v in zaf.items() if e in w], "element string, line string, zaf double, w double")
    out = pb.join(factor, ["element", "line"])
    return out.select(F.lit(mode).alias("mode"), F.lit(int(beam_kev)).alias("beam_kev"), F.concat_ws("_", "element", "line").alias("el_line"), F.lit(std_id).alias("std_id"), F.lit(formula).alias("formula"),
                      F.col("mean_pb").alias("measured_pb"), standards.corrected_pb(F.col("mean_pb"), F.col("zaf"), F.col("w")).alias("corrected_pb"), F.col("std_pb").alias("stdev_pb"), "n_spectra", F.lit(True).alias("use_for_mean"))


def build_all_standards(spectra: DataFrame, compounds: dict[str, tuple[str, str]], references: DataFrame, instrument: Instrument, tables: Tables, zaf: dict[str, dict[tuple[str, str], float]], **how) -> tuple[DataFrame | None, dict[str, str]]:
    """Standard entries of many compounds at once, and the reason for each that gave none.

    ``compounds`` names the formula and the standard's id for each sample_id of
    ``spectra``, ``zaf`` the factors of its reference lines. Compounds, tens of
    them, are one plan each, since each has its own elements to fit; all run in
    one job. ``references`` (element, line) are cut to a compound's elements.
    """
    made, failed = None, {}
    for sample, (formula, std_id) in compounds.items():
        try:
            elements = list(parse_formula(formula))
        except ValueError as e:
            failed[sample] = str(e)
            continue
        if not zaf.get(sample):
            failed[sample] = "no matrix factors are given"
            continue
        own = references.where(F.col("element").isin(elements))
        entries = build_standards(spectra.where(F.col("sample_id") == sample), formula, std_id, own, instrument, tables, zaf[sample], **how).withColumn("sample_id", F.lit(sample))
        made = entries if made is None else made.unionByName(entries)
    return made, failed


def fit_summary(results: DataFrame, key: list[str], label: str = "spectrum_id") -> DataFrame:
    """All fit parameters of each spectrum (``fit_parameters``) with mean and deviation rows for each sample."""
    wide = fit_parameters(results, [*key, label])
    return stats.with_summary_rows(wide, key, label, [c for c in wide.columns if c not in (*key, label)])


def particle_sizes(images: DataFrame, key: list[str] = (), **how) -> DataFrame:
    """Statistics of the particles in images."""
    from ..operators.images import segment_particles

    found = segment_particles(images, **how).withColumnRenamed("diameter_um", "diameter")
    return stats.particle_statistics(found, list(key))
