"""Calibration of the detector, and accuracy of results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def calibration_of(table: DataFrame, microscope: str, mode: str) -> DataFrame:
    """The latest row of a calibration table (microscope, mode, valid_from, ...) for an instrument and mode; no row where the mode is not calibrated."""
    mine = table.where((F.col("microscope") == microscope) & (F.col("mode") == mode))
    rest = [c for c in table.columns if c not in ("microscope", "mode")]
    return mine.groupBy("microscope", "mode").agg(F.max_by(F.struct(*rest), "valid_from").alias("_l")).select("microscope", "mode", "_l.*")


def width_calibration(peaks: DataFrame, key: list[str], energy: str = "energy_kev", sigma: str = "sigma") -> DataFrame:
    """Straight line sigma^2 = p1 + p2 * E through measured widths, and from it the detector's noise and Fano terms for a conversion of 1 eV.

    A group needs two energies; else its line is null.
    """
    y = F.col(sigma) * F.col(sigma)
    out = peaks.groupBy(*key).agg(F.regr_slope(y, F.col(energy)).alias("p2"), F.regr_intercept(y, F.col(energy)).alias("p1"), F.count(y).alias("n"))
    return out.select(*key, "p1", "p2", "n")


def sigma_of_fwhm(fwhm: Column) -> Column:
    return fwhm / (2 * np.sqrt(2 * np.log(2)))


def lorentzian(x: np.ndarray, height: float, center: float, width: float) -> np.ndarray:
    return height * width**2 / ((x - center) ** 2 + width**2)


def lorentzian_of_histogram(bins: DataFrame, key: list[str], *, rounds: int = 100, tol: float = 1e-10) -> DataFrame:
    """(key, height, center, width, rounds): a Lorentzian through the middles of histogram bins (key, lo, hi, n); width is half of that at half height.

    Damped Gauss-Newton: a round sums the normal equations of the three
    parameters over the bins, takes the step if squares shrink and else damps
    it more, until no parameter moves by more than ``tol`` of its size. A
    histogram's bins are an array, and the rounds an ``aggregate``: all groups
    take all rounds in one job. Null counts are no bins; fewer than three
    bins, or none with a positive count, give nulls.
    """
    point = F.struct(((F.col("lo") + F.col("hi")) / 2).cast("double").alias("x"), F.col("n").cast("double").alias("n"))
    groups = bins.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.col("n").isNotNull(), point))).alias("b"))
    b = F.col("b")
    bind = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    total = lambda rows, of: F.aggregate(rows, F.lit(0.0), lambda s, r: s + of(r))
    squares = lambda p: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.pow(p["a"] / (1 + F.pow((x["x"] - p["c"]) / p["w"], 2)) - x["n"], 2))
    parameters = lambda a, c, w: F.struct(a.alias("a"), c.alias("c"), w.alias("w"))

    def slopes(p: Column) -> Column:
        def row(x: Column) -> Column:
            q = (x["x"] - p["c"]) / p["w"]
            s = 1 / (1 + q * q)
            return F.struct(s.alias("a"), (2 * p["a"] * s * s * q / p["w"]).alias("c"), (2 * p["a"] * s * s * q * q / p["w"]).alias("w"), (p["a"] * s - x["n"]).alias("r"))

        return F.transform(b, row)

    def equations(rows: Column) -> Column:
        pairs = [(i, j) for i in "acw" for j in "acwr" if i <= j or j == "r"]
        return F.struct(*[total(rows, lambda r, i=i, j=j: r[i] * r[j]).alias(i + j) for i, j in dict.fromkeys((min(p), max(p)) if "r" not in p else p for p in pairs)])

    def step(now: Column, e: Column) -> Column:
        """Cramer's rule for the damped equations."""
        m = 1 + now["damp"]
        aa, cc, ww, ac, aw, cw = e["aa"] * m, e["cc"] * m, e["ww"] * m, e["ac"], e["aw"], e["cw"]
        det = aa * (cc * ww - cw * cw) - ac * (ac * ww - cw * aw) + aw * (ac * cw - cc * aw)
        ra, rc, rw = e["ar"], e["cr"], e["wr"]
        da = ra * (cc * ww - cw * cw) - ac * (rc * ww - cw * rw) + aw * (rc * cw - cc * rw)
        dc = aa * (rc * ww - cw * rw) - ra * (ac * ww - cw * aw) + aw * (ac * rw - rc * aw)
        dw = aa * (cc * rw - rc * cw) - ac * (ac * rw - rc * aw) + ra * (ac * cw - cc * aw)
        p = now["p"]
        return F.when(det != 0, parameters(F.greatest(F.lit(0.0), p["a"] - da / det), p["c"] - dc / det, F.greatest(F.lit(1e-12), F.abs(p["w"] - dw / det)))).otherwise(p)

    def turn(now: Column, _: Column) -> Column:
        def judged(new: Column) -> Column:
            def taken(sse: Column) -> Column:
                better = sse < now["sse"]
                p = now["p"]
                size = lambda k: F.abs(new[k] - p[k]) <= tol * F.greatest(F.abs(p[k]), F.lit(1e-9))
                still = size("a") & size("c") & size("w")
                return F.struct(F.when(better, new).otherwise(p).alias("p"), F.when(better, sse).otherwise(now["sse"]).alias("sse"), F.when(better, now["damp"] / 10).otherwise(now["damp"] * 10).alias("damp"), (now["rounds"] + 1).alias("rounds"), (still | (now["damp"] > 1e12)).alias("done"))

            return bind(squares(new), taken)

        solved = bind(bind(slopes(now["p"]), equations), lambda e: step(now, e))
        return F.when(now["done"], now).otherwise(bind(solved, judged))

    top = F.array_max(F.transform(b, lambda x: x["n"]))
    span = F.greatest(F.element_at(b, -1)["x"] - F.element_at(b, 1)["x"], F.lit(1e-9))
    first = parameters(top, F.get(F.filter(b, lambda x: x["n"] == top), F.lit(0))["x"], span / 10)
    ready = groups.select(*key, b, F.when((F.size(b) >= 3) & (top > 0), first).alias("p0"))
    start = F.struct(F.col("p0").alias("p"), squares(F.col("p0")).alias("sse"), F.lit(0.001).alias("damp"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    fitted = ready.select(*key, F.when(F.col("p0").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn)).alias("f"))
    return fitted.select(*key, F.col("f.p.a").alias("height"), F.col("f.p.c").alias("center"), F.col("f.p.w").alias("width"), F.col("f.rounds").alias("rounds"))


def accuracy(rows: DataFrame, key: list[str], *, flags: tuple[int, ...] = (0, -1), max_err: float = 0.05, least_fr: float = 0.0) -> DataFrame:
    """Per sample the root mean square deviation of measured from expected fractions (both in percent), over accepted results and elements above a least fraction, and whether it is under 1, 2 and 3."""
    used = rows.where(F.col("quant_flag").isin(*flags) & (F.abs("an_err") <= max_err) & (F.col("expected") > least_fr))
    out = used.groupBy(*key).agg(F.sqrt(F.avg(F.pow(F.col("measured") - F.col("expected"), 2))).alias("d_rms"), F.count(F.lit(1)).alias("n"))
    return out.withColumns({f"under_{t}": F.col("d_rms") < t for t in (1, 2, 3)})


def shuffled(frames: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """Frames with their place in a seeded random order that depends on labels alone, not on partitions.

    The order is that of a hash. Rows are numbered within the 4096 ranges of
    its first digits, and the sizes of the ranges before are added.
    """
    from pyspark.sql import Window as W

    hashed = frames.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(label)))).withColumn("_range", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # at most 4096 rows
    place = F.row_number().over(W.partitionBy("_range").orderBy("_h", label)) + F.col("_before")
    return hashed.join(F.broadcast(before), "_range").withColumn("place", place.cast("int")).drop("_h", "_range", "_before")
