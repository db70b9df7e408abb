"""X-ray lines: which can be excited, their reference lines, and the one to quantify with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.chemistry import atomic_number

QUANTIFICATION_LINES = ("Ka1", "La1", "Ma1", "Mz1")


def eligible_lines(elements: DataFrame, lines: DataFrame, *, beam_kev: float, least_kev: float, most_kev: float, sigma_least: float) -> DataFrame:
    """(element, line, kind, energy_kev, weight): lines that the beam excites and the detector sees, with escape and pile-up lines.

    ``lines`` is the user's line table (element, line, energy_kev, weight). A
    line counts from an overvoltage of max(0.99 E0 / Emax, 1.2) on, and above
    the least energy less three detector widths. Strong lines (weight over
    0.3) have an escape line above 1.74 keV, and a pile-up line if twice their
    energy is in range.
    """
    e, w = F.col("energy_kev"), F.col("weight")
    seen = lines.join(F.broadcast(elements.select("element").distinct()), "element").where((F.lit(beam_kev) / e > max(0.99 * beam_kev / most_kev, 1.2)) & (e > least_kev - 3 * sigma_least))
    kinds = F.array_compact(F.array(F.lit("line"), F.when((w > 0.3) & (e > 1.74), F.lit("escSiKa")), F.when((w > 0.3) & (2 * e < most_kev), F.lit("pileup"))))
    rows = seen.withColumn("kind", F.explode(kinds))
    at = F.when(F.col("kind") == "escSiKa", e - 1.74).when(F.col("kind") == "pileup", 2 * e).otherwise(e)
    return rows.withColumn("energy_kev", at).select("element", "line", "kind", "energy_kev", "weight")


def reference_line(element: Column, line: Column, has_la1: Column) -> Column:
    """The line of an element's group to which the others are tied: Ka1; La1 or, without it, Ll; Ma1 above Z 58, else Mz1. N lines count as M lines."""
    group = F.substring(line, 1, 1)
    return F.when(group == "K", "Ka1").when(group == "L", F.when(has_la1, "La1").otherwise("Ll")).when(group.isin("M", "N"), F.when(atomic_number(element) > 58, "Ma1").otherwise("Mz1"))


def quantification_line(peaks: DataFrame, key: list[str], *, beam_kev: float) -> DataFrame:
    """One line for each element of a spectrum: preferably above 2 keV with an overvoltage over 1.65, then of the largest area, then by name."""
    some = peaks.where(F.col("line").isin(*QUANTIFICATION_LINES))
    best = (F.col("energy_kev") > 2) & (F.lit(beam_kev) / F.col("energy_kev") > 1.65)
    order = W.partitionBy(*key, "element").orderBy(F.desc(best), F.desc("area"), "line")
    return some.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sample_windows(center: Column, half: Column, offset: float, width: float) -> tuple[Column, Column]:
    """First channel and number of channels strictly within ``half`` keV of a centre, for use with slice."""
    first = F.greatest(F.lit(0), F.floor((center - half - offset) / width) + 1)
    last = F.ceil((center + half - offset) / width) - 1
    return first.cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int")


def background_at(background: Column, peaks: Column, offset: float, width: float) -> Column:
    """Least background within one FWHM of any of a spectrum's reference peaks (an array of center and fwhm); infinity where no channel lies there."""

    def least(p: Column) -> Column:
        first, n = sample_windows(p["center"], p["fwhm"], offset, width)
        return F.coalesce(F.array_min(F.slice(background, first + 1, n)), F.lit(float("inf")))

    return F.coalesce(F.array_min(F.transform(peaks, least)), F.lit(float("inf")))


def least_reference_background(spectra: DataFrame, peaks: DataFrame, key: list[str], *, offset: float, width: float) -> DataFrame:
    """(key, ref_background) of spectra (key, background) from long peaks (key, is_reference, center, fwhm); see ``background_at``."""
    lines = peaks.where("is_reference").groupBy(*key).agg(F.collect_list(F.struct("center", "fwhm")).alias("_p"))
    return spectra.select(*key, "background").join(lines, key).select(*key, background_at(F.col("background"), F.col("_p"), offset, width).alias("ref_background"))
