"""Elements, chemical formulas and fractions."""

from __future__ import annotations

import re
from math import gcd
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Element symbols in order of atomic number, and their standard atomic masses.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U"
).split()
MASSES = [
    1.008, 4.002602, 6.94, 9.0121831, 10.81, 12.011, 14.007, 15.999, 18.998403163, 20.1797, 22.98976928, 24.305, 26.9815385, 28.085, 30.973761998, 32.06, 35.45, 39.948,
    39.0983, 40.078, 44.955908, 47.867, 50.9415, 51.9961, 54.938044, 55.845, 58.933194, 58.6934, 63.546, 65.38, 69.723, 72.63, 74.921595, 78.971, 79.904, 83.798,
    85.4678, 87.62, 88.90584, 91.224, 92.90637, 95.95, 98.0, 101.07, 102.9055, 106.42, 107.8682, 112.414, 114.818, 118.71, 121.76, 127.6, 126.90447, 131.293,
    132.90545196, 137.327, 138.90547, 140.116, 140.90766, 144.242, 145.0, 150.36, 151.964, 157.25, 158.92535, 162.5, 164.93033, 167.259, 168.93422, 173.045, 174.9668,
    178.49, 180.94788, 183.84, 186.207, 190.23, 192.217, 195.084, 196.966569, 200.592, 204.38, 207.2, 208.9804, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0, 232.0377, 231.03588, 238.02891,
]
Z = {symbol: i + 1 for i, symbol in enumerate(SYMBOLS)}
MASS = dict(zip(SYMBOLS, MASSES))


def elements(spark: SparkSession) -> DataFrame:
    """(element, z, mass), one row an element."""
    return spark.createDataFrame([(s, Z[s], MASS[s]) for s in SYMBOLS], "element string, z int, mass double")


def _lookup(table: dict, of: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), of)


def atomic_number(element: Column) -> Column:
    """Atomic number as double; null for an unknown symbol."""
    return _lookup({k: float(v) for k, v in Z.items()}, element)


def atomic_mass(element: Column) -> Column:
    return _lookup(MASS, element)


def parse_formula(formula: str) -> dict[str, float]:
    """Amount of each element: nested brackets and decimal amounts are allowed. Raises ValueError on anything else."""
    text = re.sub(r"\s", "", formula or "")
    stack: list[dict[str, float]] = [{}]
    at = 0
    number = re.compile(r"\d+\.?\d*|\.\d+")
    while at < len(text):
        c = text[at]
        if c in "([{":
            stack.append({})
            at += 1
            continue
        if c in ")]}":
            if len(stack) == 1:
                raise ValueError(f"unbalanced bracket in {formula!r}")
            group, at = stack.pop(), at + 1
        else:
            m = re.match(r"[A-Z][a-z]?", text[at:])
            if not m or m[0] not in Z and m[0][0] not in Z:
                raise ValueError(f"no element at {text[at:]!r} in {formula!r}")
            symbol = m[0] if m[0] in Z else m[0][0]
            group, at = {symbol: 1.0}, at + len(symbol)
        m = number.match(text, at)
        times = float(m[0]) if m else 1.0
        at = m.end() if m else at
        for k, v in group.items():
            stack[-1][k] = stack[-1].get(k, 0.0) + v * times
    if len(stack) > 1 or not stack[0]:
        raise ValueError(f"incomplete formula {formula!r}")
    return stack[0]


def _shown(x: float) -> str:
    return "" if x == 1 else f"{x:g}"


def reduced_formula(formula: str) -> str:
    """A key that is equal for formulas of one composition: elements by symbol, amounts with no common divisor."""
    amounts = parse_formula(formula)
    scaled = {k: round(v * 1000) for k, v in amounts.items() if v > 0}
    step = reduce(gcd, scaled.values())
    return "".join(f"{k}{_shown(scaled[k] // step)}" for k in sorted(scaled))


def mass_fractions_of(formula: str) -> dict[str, float]:
    amounts = parse_formula(formula)
    total = sum(n * MASS[k] for k, n in amounts.items())
    return {k: n * MASS[k] / total for k, n in amounts.items()}


def formula_mass(formula: str) -> float:
    return sum(n * MASS[k] for k, n in parse_formula(formula).items())


def pretty_formula(fractions: dict[str, float], least: float = 0.005) -> str:
    """A formula for atomic fractions: those under ``least`` are dropped, amounts are relative to the smallest, one decimal."""
    kept = {k: v for k, v in fractions.items() if v >= least}
    if not kept:
        return ""
    small = min(kept.values())
    return "".join(f"{k}{_shown(round(kept[k] / small, 1))}" for k in sorted(kept, key=lambda k: Z.get(k, 0)))


def _normalised(value: Column, key: list[str], tolerance: float = 1e-3) -> Column:
    """Fractions scaled to a sum of one where their sum is off by more than the tolerance."""
    total = F.sum(value).over(W.partitionBy(*key))
    return F.when(F.abs(total - 1) > tolerance + 1e-5, value / total).otherwise(value)


def atomic_to_mass(long: DataFrame, key: list[str], at_fr: str = "at_fr", out: str = "w_fr") -> DataFrame:
    """Adds mass fractions to a long table (key, element, atomic fraction)."""
    m = _normalised(F.col(at_fr), key) * atomic_mass(F.col("element"))
    return long.withColumn("_m", m).withColumn(out, F.col("_m") / F.sum("_m").over(W.partitionBy(*key))).drop("_m")


def mass_to_atomic(long: DataFrame, key: list[str], w_fr: str = "w_fr", out: str = "at_fr") -> DataFrame:
    """Adds atomic fractions to a long table (key, element, mass fraction)."""
    m = _normalised(F.col(w_fr), key) / atomic_mass(F.col("element"))
    return long.withColumn("_m", m).withColumn(out, F.col("_m") / F.sum("_m").over(W.partitionBy(*key))).drop("_m")


def normalise_mass_fractions(long: DataFrame, key: list[str], w_fr: str = "w_fr", *, force: bool = False, undetectable: float = 0.0) -> DataFrame:
    """Mass fractions scaled to 1 if forced or above 1, to 1 - undetectable if below that, else as they are."""
    total = F.sum(w_fr).over(W.partitionBy(*key))
    low = 1.0 - undetectable
    value = F.when(F.lit(force) | (total > 1), F.col(w_fr) / total).when(total < low, F.col(w_fr) / total * low).otherwise(F.col(w_fr))
    return long.withColumn(w_fr, value)


def mean_atomic_numbers(long: DataFrame, key: list[str], w_fr: str = "w_fr", at_fr: str = "at_fr") -> DataFrame:
    """Mean atomic number of each composition by mass, by atoms, after Markowicz and after Statham."""
    z, a, w = atomic_number(F.col("element")), atomic_mass(F.col("element")), F.col(w_fr)
    return long.groupBy(*key).agg(
        F.sum(w * z).alias("z_mass"), F.sum(F.col(at_fr) * z).alias("z_atomic"),
        (F.sum(w * z * z / a) / F.sum(w * z / a)).alias("z_markowicz"),
        (F.sum(w * F.pow(z, 1.75) / a) / F.sum(w * F.pow(z, 0.75) / a)).alias("z_statham"),
    )
