"""The library of standards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chemistry import reduced_formula
from ..functions.formulas import reduced_formula_of


def standard_means(standards: DataFrame, key: list[str]) -> DataFrame:
    """Mean corrected ratio of each line over the entries in use, with standard deviation (n) and relative error in percent; the mean is derived, never stored."""
    used = standards.where(F.col("use_for_mean") & (F.col("std_id") != "Mean"))
    out = used.groupBy(*key).agg(F.avg("corrected_pb").alias("mean_pb"), F.stddev_pop("corrected_pb").alias("std_pb"), F.count(F.lit(1)).alias("n_standards"))
    return out.withColumn("rel_std_pct", F.col("std_pb") / F.col("mean_pb") * 100)


def upsert(library: DataFrame, entries: DataFrame) -> DataFrame:
    """The library with the entries; all lines of a standard that is measured anew are replaced."""
    return library.join(entries.select("std_id").distinct(), "std_id", "left_anti").unionByName(entries, allowMissingColumns=True)


def means_for_formulas(standards: DataFrame, formulas: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Means over the standards whose formula is among ``formulas`` (equal when reduced), and the lines that have none."""
    wanted = sorted({reduced_formula(f) for f in formulas})
    kept = standards.where(reduced_formula_of(F.col("formula")).isin(wanted))
    means = standard_means(kept, key)
    return means, standards.select(*key).distinct().join(means.select(*key), key, "left_anti")


def library_for(standards: DataFrame, formulas: list[str] | None = None) -> dict[tuple[str, str], float]:
    """The mean ratio of each line (element, line) for quantification: over the standards of ``formulas`` where a line has any, as for a mixture of known phases, else over all in use. A library holds some hundred lines."""
    means = standard_means(standards, ["el_line"]).select("el_line", "mean_pb")
    if formulas:
        own, _ = means_for_formulas(standards, formulas, ["el_line"])
        means = means.join(own.select("el_line", F.col("mean_pb").alias("_own")), "el_line", "left").select("el_line", F.coalesce("_own", "mean_pb").alias("mean_pb"))
    return {tuple(r.el_line.split("_", 1)): r.mean_pb for r in means.collect()}


def with_standard(peaks: DataFrame, means: DataFrame, key: list[str]) -> DataFrame:
    """Peaks with k_ratio = pb / mean_pb and an ``error``: ``no standard`` or ``standard not positive``, in which cases k_ratio is null."""
    out = peaks.join(means.select(*key, "mean_pb"), key, "left")
    error = F.when(F.col("mean_pb").isNull() | F.isnan("mean_pb"), "no standard").when(F.col("mean_pb") <= 0, "standard not positive")
    return out.withColumn("error", error).withColumn("k_ratio", F.when(F.col("error").isNull(), F.col("pb") / F.col("mean_pb")))


def standard_results(lines: DataFrame, factors: DataFrame, key: list[str]) -> DataFrame:
    """The results table of measured standards: (key, measured_pb, stdev_pb, corrected_pb, rel_std_pct, n_spectra).

    ``lines`` has the statistics of each reference line (mean_pb, std_pb,
    rel_std_pct, n_spectra), ``factors`` its matrix factor and mass fraction
    (zaf, w_fr); a line without a factor has no corrected ratio.
    """
    both = lines.join(factors.select(*key, "zaf", "w_fr"), key, "left")
    return both.select(*key, F.col("mean_pb").alias("measured_pb"), F.col("std_pb").alias("stdev_pb"), corrected_pb(F.col("mean_pb"), F.col("zaf"), F.col("w_fr")).alias("corrected_pb"), "rel_std_pct", "n_spectra")


def corrected_pb(mean_pb: Column, zaf: Column, w_fr: Column) -> Column:
    """A standard's ratio referred to the pure element."""
    return zaf * mean_pb / w_fr


def missing_reference_flag(peaks: DataFrame, references: DataFrame, key: list[str]) -> DataFrame:
    """(key, quant_flag): 10 for a standard's spectrum without one of the reference lines (element, line), else 0.

    The lines that a spectrum has are bits of a number, so one partial
    aggregation does it. A reference line with a null is never found.
    """
    want = [tuple(r) for r in references.select("element", "line").distinct().collect()]  # lines of one standard
    parts = [want[i : i + 63] for i in range(0, len(want), 63)]
    bit = lambda row, i: F.when((F.col("element") == row[0]) & (F.col("line") == row[1]), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    seen = lambda part: F.when(F.col("area") > 0, reduce(lambda a, b: a.bitwiseOR(b), [bit(row, i) for i, row in enumerate(part)])).otherwise(F.lit(0).cast("long"))
    found = peaks.select(*key, *[seen(part).alias(f"_{i}") for i, part in enumerate(parts)]).groupBy(*key).agg(F.lit(0).alias("_"), *[F.bit_or(f"_{i}").alias(f"_{i}") for i in range(len(parts))])
    missing = reduce(lambda a, b: a | b, [F.col(f"_{i}") != F.lit((1 << len(part)) - 1).cast("long") for i, part in enumerate(parts)], F.lit(False))
    return found.select(*key, F.when(missing, 10).otherwise(0).alias("quant_flag"))


def latest_calibration(table: DataFrame, key: list[str], name: str = "file_name") -> DataFrame:
    """For each mode the row of the last file name; offset, scale and spot_size must be there."""
    rest = [c for c in table.columns if c not in key]
    whole = table.where(F.col("offset").isNotNull() & F.col("scale").isNotNull() & F.col("spot_size").isNotNull())
    return whole.groupBy(*key).agg(F.max_by(F.struct(*rest), name).alias("_l")).select(*key, "_l.*")
