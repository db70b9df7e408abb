"""Clusters against reference phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.chemistry import formula_mass, mass_fractions_of, parse_formula


def reference_phases(spark: SparkSession, formulas: list[str], elements: list[str], *, by_mass: bool = False) -> tuple[DataFrame, list[str]]:
    """(ref_idx, formula, fr, mix_weight) for formulas over the detectable ``elements``, and the formulas that cannot be read.

    ``fr`` holds one fraction an element, scaled to 1 over the detectable ones
    for atomic features. The mixture weight is the formula's mass for mass
    fractions, else its number of detectable atoms. An unreadable formula
    takes no index, so later names stay with their own fractions.
    """
    rows, bad = [], []
    for formula in formulas:
        try:
            amounts = parse_formula(formula)
        except ValueError:
            bad.append(formula)
            continue
        if by_mass:
            fr, weight = mass_fractions_of(formula), formula_mass(formula)
        else:
            seen = {k: v for k, v in amounts.items() if k in elements}
            total = sum(seen.values()) or 1.0
            fr, weight = {k: v / total for k, v in seen.items()}, float(sum(seen.values()))
        rows.append((len(rows), formula, [float(fr.get(e, 0.0)) for e in elements], weight))
    return spark.createDataFrame(rows, "ref_idx int, formula string, fr array<double>, mix_weight double"), bad


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _pivots(refs: DataFrame, n: int = 3, sample: int = 1000) -> list[list[float]]:
    """A few reference phases far from each other, of ``sample`` of them at most; any pivots give the same matches."""
    some = [r.fr for r in refs.orderBy(F.xxhash64("ref_idx"), "ref_idx").select("fr").limit(sample).collect() if r.fr]
    kept = some[:1]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    while len(kept) < min(n, len(some)):
        kept.append(max(some, key=lambda p: min(gap(p, q) for q in kept)))
    return kept


def near_references(centroids: DataFrame, refs: DataFrame, *, reach: float = 0.1, times_rms: float = 5.0) -> DataFrame:
    """``centroids`` (fr, rms, ...) with each phase of ``refs`` under max(reach, times_rms * rms), and its ``distance``: an equi-join, for any number of phases.

    By the triangle inequality a phase within t of a centroid is, from any
    pivot, at most t nearer or farther than the centroid. Distances to three
    pivots, in bands as wide as t or wider, are the join's keys: widths are
    ``reach`` times a power of two, and a centroid looks into at most three
    bands a pivot. Exact distances decide.
    """
    pivots = [F.array(*[F.lit(float(x)) for x in p]) for p in _pivots(refs)]
    t = F.greatest(F.lit(reach), F.col("rms") * times_rms)
    level = F.greatest(F.lit(0.0), F.ceil(F.log2(t / reach))).cast("int")
    width = lambda: F.lit(reach) * F.pow(F.lit(2.0), F.col("_level"))
    around = centroids.withColumns({"_t": t, "_level": level})
    levels = sorted(r[0] for r in around.select("_level").distinct().collect() if r[0] is not None)  # a few powers of two
    for i, pivot in enumerate(pivots):
        far = F.coalesce(distance(F.col("fr"), pivot), F.lit(0.0))
        room = F.col("_t") * (1 + 1e-9) + 1e-12
        around = around.withColumn(f"_b{i}", F.explode(F.sequence(F.floor((far - room) / width()), F.floor((far + room) / width()))))
    keys = ["_level", *[f"_b{i}" for i in range(len(pivots))]]
    phases = refs.select("ref_idx", "formula", F.col("fr").alias("ref_fr")).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    for i, pivot in enumerate(pivots):
        phases = phases.withColumn(f"_b{i}", F.floor(distance(F.col("ref_fr"), pivot) / width()))
    met = around.join(phases, keys).withColumn("distance", distance(F.col("fr"), F.col("ref_fr")))
    return met.where(F.col("distance") < F.col("_t")).drop("_t", *keys)


def match_references(centroids: DataFrame, refs: DataFrame, key: list[str], *, sigma: float = 0.03, ambiguity: float = 0.3, reach: float = 0.1, times_rms: float = 5.0) -> DataFrame:
    """References near each centroid (key, fr, rms): distance, raw and ambiguity-normalised confidence.

    A reference is near under max(reach, times_rms * rms). The raw confidence
    is c = exp(-d^2 / 2 sigma^2); w = exp(-(1 - c)^2 / 2 ambiguity^2), scaled
    to a sum of one over the cluster's references, multiplies it.
    """
    near = near_references(centroids, refs, reach=reach, times_rms=times_rms)
    raw = F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma))
    near = near.withColumn("raw_conf", raw).withColumn("_w", F.exp(-F.pow(1 - F.col("raw_conf"), 2) / (2 * ambiguity * ambiguity)))
    return near.withColumn("conf", F.col("raw_conf") * F.col("_w") / F.sum("_w").over(W.partitionBy(*key))).drop("_w", "ref_fr")


def ranked_references(matches: DataFrame, key: list[str], least: float = 0.01, digits: int = 2) -> DataFrame:
    """Matches above the least confidence with their rank in the cluster and the confidence rounded half to even."""
    kept = matches.where(F.col("conf") > least)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("conf"), "ref_idx"))).withColumn("conf", F.bround("conf", digits))


def wide_references(ranked: DataFrame, key: list[str], n: int = 3) -> DataFrame:
    """Ref1, Conf1, Ref2, ... of each cluster."""
    pick = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c)))
    return ranked.groupBy(*key).agg(*[x for i in range(1, n + 1) for x in (pick("formula", i).alias(f"ref{i}"), pick("conf", i).alias(f"conf{i}"))])


def assigned_confidence(matches: DataFrame, key: list[str], over: list[str]) -> DataFrame:
    """Least over the clusters of a sample of their best confidence, weights for ambiguity included; clusters without a reference do not count."""
    best = matches.groupBy(*over, *key).agg(F.max("conf").alias("best"))
    return best.groupBy(*over).agg(F.min("best").alias("min_conf"))


def converged(max_rms: Column, min_conf: Column) -> Column:
    """Whether a sample's clusters suffice: all tight and, where any has a reference near it, all of those recognised; without any near, tighter ones."""
    return F.when(min_conf.isNull(), max_rms < 0.025).otherwise((min_conf > 0.8) & (max_rms < 0.03))
