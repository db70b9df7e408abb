"""Which spectra may be fitted, how fits are flagged, and which compositions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.spectra import low_background, total_counts
from ..functions.text import contamination_comment

#: Meaning of each quantification flag.
FLAGS = {
    -1: "fit did not converge", 0: "ok", 1: "no spectral data", 2: "total counts too low", 3: "low background", 4: "poor fit", 5: "high analytical error",
    6: "excess absorption", 7: "substrate contamination", 8: "reference background too low", 9: "fit failed", 10: "reference peak missing",
}


def spectrum_flag(counts: Column, energies: Column, target: float, min_background: float, window: Column | None = None) -> Column:
    """Flag of a spectrum before fitting, null if it may be fitted: 1 without data, 2 under 0.9 of the target counts, 3 with low background (in ``window``, if only some channels have ``energies``)."""
    seen = counts if window is None else window
    return F.when(counts.isNull(), 1).when(total_counts(counts) < 0.9 * target, 2).when(low_background(seen, energies, min_background), 3).cast("int")


def first_spot_contaminated(spectra: DataFrame, target: float) -> DataFrame:
    """Particles whose first spectrum holds less than 0.95 of the target counts."""
    first = F.row_number().over(W.partitionBy("sample_id", "particle_id").orderBy("spectrum_id"))
    return spectra.withColumn("_r", first).where((F.col("_r") == 1) & (total_counts(F.col("counts")) < 0.95 * target)).select("sample_id", "particle_id")


def fit_quality(redchi: Column, total: Column, an_err: Column, absorbed: Column, is_particle: Column) -> Column:
    """Bad-fit code: 1 for reduced chi square above 0.2 % of all counts, 2 for an analytical error above 0.5, 3 for a particle absorbing over 0.7; else null."""
    return F.when(redchi > 0.002 * total, 1).when(an_err > 0.5, 2).when(is_particle & (absorbed > 0.7), 3).cast("int")


def post_fit_flag(bad_fit: Column, failed: Column, contaminated: Column, ref_background: Column, min_background: float, converged: Column, *, strict: bool = False) -> Column:
    """Flag after fitting. A fit that did not converge is -1 whatever else holds, unless ``strict`` lets flags 4 to 9 stand."""
    flag = F.when(failed, 9).when(bad_fit == 1, 4).when(bad_fit == 2, 5).when(bad_fit == 3, 6).when(contaminated, 7).when(ref_background < min_background, 8).otherwise(0)
    over = ~converged & ~failed & (F.lit(not strict) | (flag == 0))
    return F.when(over, -1).otherwise(flag).cast("int")


def substrate_contamination(peaks: DataFrame, totals: DataFrame, substrate: list[str], share: float = 0.1) -> DataFrame:
    """(sample_id, spectrum_id, element): first substrate element, by symbol, whose peaks hold more than ``share`` of all counts."""
    sums = peaks.where(F.col("element").isin(substrate)).groupBy("sample_id", "spectrum_id", "element").agg(F.sum("intensity").alias("i"))
    over = sums.join(totals, ["sample_id", "spectrum_id"]).where(F.col("i") > share * F.col("total"))
    return over.groupBy("sample_id", "spectrum_id").agg(F.min("element").alias("element"))


def background_comment(least: Column, threshold: float) -> Column:
    return contamination_comment(least, least < threshold)


def selection_reason(flag: Column, an_err: Column, quantified: Column, *, max_err: float | None = 0.05, undetectable: float = 0.0, accepted: tuple[int, ...] = (0, -1)) -> Column:
    """Why a composition is used or not: ``good``, ``null`` (never quantified), ``flagged`` or ``error``.

    The allowed error is asymmetric: from -(max_err + undetectable) to
    max_err, both included. Without ``max_err`` every error is allowed.
    """
    reason = F.when(~F.coalesce(quantified, F.lit(False)), "null").when(~F.coalesce(flag.isin(*accepted), F.lit(False)), "flagged")
    if max_err is not None:
        reason = reason.when(an_err.isNull() | F.isnan(an_err) | (an_err > max_err) | (an_err < -(max_err + undetectable)), "error")
    return reason.otherwise("good")


def select_good(results: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Used and unused rows of ``results`` (quant_flag, an_err, fr map), with the reason."""
    named = results.withColumn("reason", selection_reason(F.col("quant_flag"), F.col("an_err"), F.col("fr").isNotNull(), **limits))
    return named.where("reason = 'good'"), named.where("reason <> 'good'")


def filled(fractions: Column, elements: list[str]) -> Column:
    """A fraction for each listed element, 0 where a map has none."""
    return F.array(*[F.coalesce(F.element_at(fractions, F.lit(e)), F.lit(0.0)) for e in elements])


def discard_report(named: DataFrame, key: list[str]) -> DataFrame:
    """Per group: rows in all, for each reason, and whether over half were flagged."""
    count = lambda r: F.count_if(F.col("reason") == r)
    out = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), count("good").alias("n_good"), count("null").alias("n_null"), count("flagged").alias("n_flagged"), count("error").alias("n_error"))
    return out.withColumn("warn", F.col("n_flagged") > 0.5 * F.col("n"))


def detectable(elements: Column, undetectable: tuple[str, ...] = ("H", "He", "Li")) -> Column:
    """Elements without repeats and without those the detector cannot see."""
    return F.array_except(F.array_distinct(elements), F.array(*[F.lit(e) for e in undetectable]))


def substrate_only(substrate: Column, sample: Column) -> Column:
    """Elements of the substrate that the sample does not have."""
    return F.array_except(F.array_distinct(substrate), sample)


def needs_quantification(results: DataFrame) -> DataFrame:
    """Rows that have no analytical error yet."""
    return results.where("an_err is null")


def merge_requantified(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of those with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
