"""Matrix corrections of peak-to-background ratios on long tables, one pass in Catalyst expressions.

Backscattering, stopping power and absorption follow Love and Scott (1978),
Statham (1979, 2016) and Essani et al. (2020); the continuum follows Duncumb,
Barkshire and Statham (2001).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chemistry import atomic_mass, atomic_number, mass_to_atomic

Calibration = Callable[[Column], Column]


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """c0 + c1 x + c2 x^2 + ..."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


#: Fixed values of the published fits, lowest power first.
ETA_20 = [-52.3791e-4, 150.48371e-4, -1.67373e-4, 0.00716e-4]
ETA_SLOPE = [-1112.8e-4, 30.289e-4, -0.15498e-4]
LOSS_I = [0.0, 0.33148, 0.05596, -0.06339, 0.00947]
LOSS_G = [0.0, 2.87898, -1.51307, 0.81312, -0.08241]
CHARACTERISTIC = [1.0, 3.0e-6, 4.5e-13]
CONTINUUM = [1.0, 3.34e-6, 5.59e-13]


def backscatter_coefficient(z: Column, beam_kev: float) -> Column:
    return polynomial(z, ETA_20) * (1 + polynomial(z, ETA_SLOPE) * F.log(F.lit(beam_kev / 20)))


def backscatter_factor(eta: Column, energy: Column, beam_kev: float) -> Column:
    """Ratio of the losses of characteristic and continuum radiation by backscattering."""
    u = F.lit(beam_kev) / energy
    peak = 1 - eta * F.pow(polynomial(F.log(u), LOSS_I) + eta * polynomial(F.log(u), LOSS_G) / u, 1.67)
    ground = 1 - (1 - peak) * F.pow(2 / (1 + eta), 0.63) * (0.79 + 0.44 * energy / beam_kev)
    return peak / ground


def absorption_factor(mu: Column, energy: Column, beam_kev: float, takeoff_deg: float) -> Column:
    """Ratio of the absorbed shares of characteristic and continuum radiation."""
    x = mu / F.sin(F.radians(F.lit(takeoff_deg))) * (F.lit(beam_kev**1.65) - F.pow(energy, 1.65))
    return polynomial(x, CONTINUUM) / polynomial(x, CHARACTERISTIC)


def generated_continuum(energy: Column, z: Column, p: Column, f: Column, beta: Column, m: Column, ln_j: Column, beam_kev: float, k: float = 0.8) -> Column:
    """Continuum generated at an energy, times the stopping power: m is the sum of w Z / A and ln_j the mean log ionisation potential in keV."""
    u = F.lit(beam_kev) / energy
    made = F.lit(k) * z * f * F.pow((F.lit(beam_kev) - energy) / energy, p) * energy / (energy + beta)
    stopping = (1 + 16.05 * F.sqrt(F.exp(ln_j) / energy) * F.pow((F.sqrt(u) - 1) / (u - 1), 1.07)) / m
    return made / stopping


def zaf_factors(compositions: DataFrame, lines: DataFrame, absorption: DataFrame, ionisation: DataFrame, key: list[str], *, beam_kev: float, takeoff_deg: float, p: str, f: str, beta: str) -> DataFrame:
    """(key, element, line, z_factor, a_factor, r_factor, zaf) for each composition and quantified line.

    ``compositions`` is long (key, element, w_fr); fractions are normalised.
    ``lines`` (element, line, energy_kev), ``absorption`` (element, line,
    absorber, mu) and ``ionisation`` (z, j_ev) are tables of the user, each a
    few thousand rows, which Spark broadcasts by their size. ``p``, ``f`` and ``beta``
    are SQL expressions of the calibration in a mean or elemental ``z``.
    """
    w = mass_to_atomic(compositions, key)
    w = w.withColumn("m", F.col("at_fr") * atomic_mass(F.col("element")))
    total = w.groupBy(*key).agg(F.sum("m").alias("_t"))
    w = w.join(total, key).withColumn("w", F.col("m") / F.col("_t")).select(*key, "element", "w")
    w = w.withColumns({"z": atomic_number(F.col("element")), "a": atomic_mass(F.col("element"))})
    j = (ionisation.select(F.col("z").cast("double").alias("z"), F.log(F.col("j_ev") / 1000).alias("ln_j")))
    w = w.join(j, "z")
    share = F.col("w") * F.col("z") / F.col("a")
    means = w.groupBy(*key).agg(
        (F.sum(F.col("w") * F.pow("z", 1.75) / F.col("a")) / F.sum(F.col("w") * F.pow("z", 0.75) / F.col("a"))).alias("z_mean"),
        F.sum(share).alias("m"), (F.sum(share * F.col("ln_j")) / F.sum(share)).alias("ln_j"),
        F.sum(F.col("w") * F.expr(beta)).alias("beta"), F.sum(F.col("w") * backscatter_coefficient(F.col("z"), beam_kev)).alias("eta"))
    mu = w.select(*key, F.col("element").alias("absorber"), "w").join(absorption, "absorber").groupBy(*key, "element", "line").agg(F.sum(F.col("w") * F.col("mu")).alias("mu"))
    own = w.select(*key, "element", F.col("z").alias("z_own"), F.col("a").alias("a_own"), F.col("ln_j").alias("ln_j_own")).join(lines, "element")
    rows = own.join(means, key).join(mu, [*key, "element", "line"], "left")
    of = lambda expression, column: F.expr(re.sub(r"\bz\b", column, expression))
    e = F.col("energy_kev")
    sample = generated_continuum(e, F.col("z_mean"), of(p, "z_mean"), of(f, "z_mean"), F.col("beta"), F.col("m"), F.col("ln_j"), beam_kev)
    pure = generated_continuum(e, F.col("z_own"), of(p, "z_own"), of(f, "z_own"), of(beta, "z_own"), F.col("z_own") / F.col("a_own"), F.col("ln_j_own"), beam_kev)
    rows = rows.withColumns({"z_factor": sample / pure, "a_factor": absorption_factor(F.coalesce("mu", F.lit(0.0)), e, beam_kev, takeoff_deg), "r_factor": backscatter_factor(F.col("eta"), e, beam_kev)})
    return rows.select(*key, "element", "line", "z_factor", "a_factor", "r_factor", (F.col("z_factor") * F.col("a_factor") * F.col("r_factor")).alias("zaf"))


def quantify_ratios(ratios: DataFrame, lines: DataFrame, absorption: DataFrame, ionisation: DataFrame, key: list[str], *, beam_kev: float, takeoff_deg: float, p: Calibration, f: Calibration, beta: Calibration, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """(key, element, line, w_fr, rounds, converged): fixed point of w = k_ratio * zaf(w), at most ``rounds`` rounds, until no fraction moves by more than ``tol``.

    ``ratios`` has (key, element, line, k_ratio), a line an element; the tables
    are those of ``zaf_factors``, the calibration functions of a column z. Fractions start from the
    ratios, scaled to one. What does not change between rounds is joined to
    the ratios once; a composition's elements, some dozens at most, become an
    array, and the rounds are an ``aggregate`` over it: no join, job or
    checkpoint a round. Ratios that are null, or of elements or lines the
    tables lack, take no part.
    """
    z, e = F.col("z"), F.col("energy_kev")
    j = ionisation.select(F.col("z").cast("double").alias("z"), F.log(F.col("j_ev") / 1000).alias("ln_j"))
    mu = absorption.groupBy("element", "line").agg(F.map_from_entries(F.collect_list(F.struct("absorber", "mu"))).alias("mu"))
    rows = ratios.where("k_ratio is not null").select(*key, "element", "line", "k_ratio").withColumns({"z": atomic_number(F.col("element")), "a": atomic_mass(F.col("element"))})
    rows = rows.join(j, "z").join(lines.select("element", "line", "energy_kev"), ["element", "line"]).join(mu, ["element", "line"], "left")
    pure = generated_continuum(e, z, p(z), f(z), beta(z), z / F.col("a"), F.col("ln_j"), beam_kev)
    fixed = F.struct("element", "line", F.col("k_ratio").alias("k"), e.alias("e"), (F.pow(z, 1.75) / F.col("a")).alias("up"), (F.pow(z, 0.75) / F.col("a")).alias("down"), (z / F.col("a")).alias("share"), (z / F.col("a") * F.col("ln_j")).alias("loss"),
                     beta(z).alias("beta"), backscatter_coefficient(z, beam_kev).alias("eta"), pure.alias("pure"), F.coalesce("mu", F.create_map().cast("map<string,double>")).alias("mu"))
    groups = rows.groupBy(*key).agg(F.array_sort(F.collect_list(fixed), lambda x, y: F.when(x["element"] < y["element"], -1).when(x["element"] > y["element"], 1).otherwise(0)).alias("els"))
    els = F.col("els")
    names = F.transform(els, lambda x: x["element"])
    # absorption of each line by each element, in the order of the elements
    matrix = F.transform(els, lambda x: F.transform(names, lambda n: F.coalesce(F.element_at(x["mu"], n), F.lit(0.0))))
    groups = groups.select(*key, "els", matrix.alias("matrix"), F.transform(els, lambda x: x["k"] / F.aggregate(els, F.lit(0.0), lambda s, y: s + y["k"])).alias("start"))
    dot = lambda w, values: F.aggregate(F.zip_with(w, values, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    field = lambda name: F.transform(F.col("els"), lambda x: x[name])

    def factors(w: Column) -> Column:
        means = F.struct((dot(w, field("up")) / dot(w, field("down"))).alias("z"), dot(w, field("share")).alias("m"), dot(w, field("loss")).alias("loss"), dot(w, field("beta")).alias("beta"), dot(w, field("eta")).alias("eta"))

        def each(mean: Column) -> Column:
            sample = lambda x: generated_continuum(x["e"], mean["z"], p(mean["z"]), f(mean["z"]), mean["beta"], mean["m"], mean["loss"] / mean["m"], beam_kev)
            return F.zip_with("els", "matrix", lambda x, mu_: x["k"] * sample(x) / x["pure"] * absorption_factor(dot(w, mu_), x["e"], beam_kev, takeoff_deg) * backscatter_factor(mean["eta"], x["e"], beam_kev))

        return F.get(F.transform(F.array(means), each), F.lit(0))

    def turn(now: Column, _: Column) -> Column:
        total = F.aggregate(now["w"], F.lit(0.0), lambda s, x: s + x)
        scaled = F.get(F.transform(F.array(total), lambda t: F.transform(now["w"], lambda x: x / t)), F.lit(0))
        new = F.get(F.transform(F.array(scaled), factors), F.lit(0))
        step = lambda w: F.struct(w.alias("w"), (now["rounds"] + 1).alias("rounds"), (F.array_max(F.zip_with(w, now["w"], lambda x, y: F.abs(x - y))) <= tol).alias("done"))
        return F.when(now["done"], now).otherwise(F.get(F.transform(F.array(new), step), F.lit(0)))

    first = F.struct(F.col("start").alias("w"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    solved = groups.select(*key, "els", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, turn).alias("end"))
    out = solved.select(*key, F.explode(F.arrays_zip(field("element").alias("element"), field("line").alias("line"), F.col("end.w").alias("w_fr"))).alias("x"), F.col("end.rounds").alias("rounds"), F.col("end.done").alias("converged"))
    return out.select(*key, "x.element", "x.line", "x.w_fr", "rounds", "converged")
