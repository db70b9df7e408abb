"""Spectra as arrays: axis, sums, background tests and detector functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def energy_axis(start: int, stop: int, offset: float, width: float) -> Column:
    """Energies in keV of channels start .. stop - 1."""
    return F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda i: F.lit(offset) + F.lit(width) * i)


def parse_counts(text: Column) -> Column:
    """``[c0,c1,...]`` as an array; null if it is no such list."""
    return F.from_json(text, "array<double>")


def total_counts(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def window_counts(counts: Column, start: int, stop: int) -> Column:
    """The half-open slice start .. stop of channels."""
    return F.slice(counts, F.lit(start + 1), F.lit(max(0, stop - start)))


def box_smooth(values: Column) -> Column:
    """Mean of three neighbours; beyond the ends there are zeros."""
    one = lambda v: F.transform(v, lambda x, i: (F.coalesce(F.get(v, i - 1), F.lit(0.0)) + x + F.coalesce(F.get(v, i + 1), F.lit(0.0))) / 3)
    return F.get(F.transform(F.array(values), one), F.lit(0))  # bound to a variable, else each element would compute all values anew


def low_background(counts: Column, energies: Column, least: float, below_kev: float = 2.0, n: int = 20) -> Column:
    """True if the ``n`` smallest smoothed counts of the filled channels under 2 keV all lie below ``least``; true without such channels."""
    pairs = F.arrays_zip(counts.alias("c"), energies.alias("e"))
    some = F.transform(F.filter(pairs, lambda p: (p["c"] > 0) & (p["e"] < below_kev)), lambda p: p["c"].cast("double"))
    return F.forall(F.slice(F.array_sort(box_smooth(some)), 1, n), lambda x: x < least)


def detector_sigma(energy: Column, conv_eff: float, noise: float, fano: float) -> Column:
    """Width of the detector's response at an energy in keV."""
    return F.lit(conv_eff) * F.sqrt(F.lit(noise * noise) + energy * fano / conv_eff)


def sigmoid_parameter(energy: Column, base: float, height: float, middle: float, slope: float, scale: float = 1.0) -> Column:
    """A calibrated peak-shape parameter: base + height / (1 + exp(-slope (E - middle))), times scale. Coefficients come from the calibration table."""
    return (F.lit(base) + F.lit(height) / (1 + F.exp(-F.lit(slope) * (energy - middle)))) * scale


def two_point_calibration(width: Column, offset: Column, measured: list[Column], true: list[Column]) -> tuple[Column, Column]:
    """New channel width and offset from two reference lines: where they were measured with the old axis, and where they are.

    Two lines in one channel have no width between them: it is infinite, as in
    IEEE arithmetic, not an error. Decimal places keep equal lines equal.
    """
    i, j = ((m - offset).cast("double") / width for m in measured)
    span, gap = (true[1] - true[0]).cast("double"), j - i
    per = lambda n: F.when(gap == 0, n * F.lit(float("inf"))).otherwise(n / gap)
    return per(span), true[0].cast("double") - per(i * span)
