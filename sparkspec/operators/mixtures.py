"""Clusters as mixtures of two phases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.chemistry import pretty_formula
from ..functions.formulas import pretty_of
from .cluster import spread
from .cluster_large import with_sample
from .shared import cut, small


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mixing_share(x: Column, h1: Column, h2: Column) -> Column:
    """Share of the first phase that brings the mixture nearest to x, within 0 and 1; null for equal phases."""
    d = _less(h1, h2)
    square = _dot(d, d)
    return F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(_less(x, h2), d) / square)))


def reconstruction_error(x: Column, h1: Column, h2: Column, w: Column) -> Column:
    """Sum over features of exp(15 |difference|) - 1 for one point; divide by points and features for the mean."""
    mixed = F.zip_with(h1, h2, lambda a, b: a * w + b * (1 - w))
    return F.aggregate(F.zip_with(x, mixed, lambda a, b: F.exp(15 * F.abs(a - b)) - 1), F.lit(0.0), lambda s, e: s + e)


def molar_fraction(share: Column, weight1: Column, weight2: Column) -> Column:
    """Molar fraction of the first phase from its share in the fractions and the phases' weights."""
    r = weight1 / weight2
    c2 = 1 - share
    x2 = c2 * r / (1 - c2 * (1 - r))
    return (1 - c2) * (1 + x2 * (1 / r - 1))


def mixture_confidence(error: Column, known: bool = False) -> Column:
    """exp(-e^2 / 0.5) for an error under 2, or always for a known mixture; else null."""
    value = F.exp(-error * error / (2 * 0.5**2))
    return value if known else F.when(error < 2, value)


def possible_pairs(points: DataFrame, refs: DataFrame, key: list[str], *, most_error: float = 2.0, block: int = 1000) -> DataFrame:
    """(key, ref1, ref2, h1, h2, w1, w2, f1, f2): the pairs of phases whose error in a cluster may be under ``most_error``; no point is compared with a phase for it.

    exp(15 |x|) - 1 is convex, so a pair's error is at least that of the
    cluster's centroid at some place of the segment between both phases. Under
    the limit no feature of that place is farther than t = ln(limit * m + 1) / 15
    from the centroid's, nor is the place farther than D, where
    15 D + 112.5 D^2 = limit * m, for m features. Hence a phase takes a share of
    at most min((centroid + t) / phase) over its features, where fractions are
    not negative, and the shares of a pair must reach one: pairs meet by bands
    of that share. Then both phases together must cover each feature, and the
    segment must pass within D.
    """
    m = F.size("mu")
    long = points.select(*key, F.posexplode("fr").alias("_i", "_x")).groupBy(*key, "_i").agg(F.avg("_x").alias("_m"), F.min("_x").alias("_low"))
    centres = long.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("mu"), (F.min("_low") >= 0).alias("plain"))  # as many numbers as features
    phases = refs.select("ref_idx", F.col("fr").alias("h"), F.col("mix_weight").alias("w"), F.col("formula").alias("f"))
    blocks = max(1, -(-phases.count() // block))
    # every cluster with every block of phases, a row each: what a cluster may hold is judged phase by phase
    near = centres.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(phases.withColumn("_b", F.pmod(F.xxhash64("ref_idx"), F.lit(blocks)).cast("int")), "_b")
    near = near.withColumns({"t": F.log(most_error * m + 1) / 15, "D": (F.sqrt(225 + 450 * most_error * m) - 15) / 225})
    share = F.array_min(F.zip_with("mu", "h", lambda x, y: F.when(y > 0, (x + F.col("t")) / y).otherwise(1.0)))
    plain = F.col("plain") & F.forall("h", lambda x: x >= 0)
    near = near.withColumn("share", F.when(plain, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).otherwise(1.0))
    slack = 1e-9
    band = lambda x: F.floor(x * 20).cast("int")
    one = near.select(*key, "mu", "t", "D", "plain", *[F.col(c).alias(n) for c, n in (("ref_idx", "ref1"), ("h", "h1"), ("w", "w1"), ("f", "f1"), ("share", "s1"))], band(F.greatest(F.lit(0.0), 1 - F.col("share") - slack)).alias("_band"))
    two = near.select(*key, *[F.col(c).alias(n) for c, n in (("ref_idx", "ref2"), ("h", "h2"), ("w", "w2"), ("f", "f2"), ("share", "s2"))], F.explode(F.sequence(F.lit(0), band(F.col("share") + slack))).alias("_band"))
    met = one.join(two, [*key, "_band"]).where((F.col("ref1") < F.col("ref2")) & (F.col("s1") + F.col("s2") >= 1 - slack))
    covered = F.forall(F.zip_with("mu", F.zip_with("h1", "h2", lambda x, y: F.greatest(x, y)), lambda x, y: y + F.col("t") + slack >= x), lambda ok: ok)
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(mixing_share(F.col("mu"), F.col("h1"), F.col("h2")), F.lit(0.0))))
    apart = lambda w: F.aggregate(F.zip_with("mu", F.zip_with("h1", "h2", lambda a, b: a * w + b * (1 - w)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    met = met.where(covered).withColumn("_w", place)
    return met.where(apart(F.col("_w")) <= F.pow(F.col("D"), 2) + slack).select(*key, "ref1", "ref2", "h1", "h2", "w1", "w2", "f1", "f2")


def fit_pairs(points: DataFrame, refs: DataFrame, key: list[str], *, known: bool = False, every: bool = False) -> DataFrame:
    """Pairs of references as mixtures for the points (key, fr) of each cluster: those of an error under 2, which alone have a confidence; ``known`` or ``every``: all pairs.

    Rows decouple, so each point's share has a closed form. Columns: ref1,
    ref2, name (both formulas), n, error, conf, molar_fr_mean, molar_fr_std (n)
    and mol_ratio. Pairs are bounded from the centroid before points meet them
    (``possible_pairs``), for any number of phases; all pairs are for a list of
    known ones, whose number is checked.
    """
    if known or every:
        few = small(refs, 500)
        a = few.select(F.col("ref_idx").alias("ref1"), F.col("fr").alias("h1"), F.col("mix_weight").alias("w1"), F.col("formula").alias("f1"))
        b = few.select(F.col("ref_idx").alias("ref2"), F.col("fr").alias("h2"), F.col("mix_weight").alias("w2"), F.col("formula").alias("f2"))
        met = points.join(F.broadcast(a.join(b, F.col("ref1") < F.col("ref2"))), F.lit(True))
    else:
        own = points.select(*key, "fr", F.xxhash64("fr").alias("_point"))
        pairs = cut(possible_pairs(own, refs, key))
        first = refs.select(F.size("fr").alias("n")).first()
        met = with_sample(own, pairs, key, "_point", 2 * first.n + 8 if first else 8)
    each = met.withColumn("share", mixing_share(F.col("fr"), F.col("h1"), F.col("h2"))).where("share is not null")
    each = each.withColumns({
        "_e": reconstruction_error(F.col("fr"), F.col("h1"), F.col("h2"), F.col("share")), "_k": F.size("fr"),
        "_m": molar_fraction(F.col("share"), F.col("w1"), F.col("w2")),
    })
    out = each.groupBy(*key, "ref1", "ref2", F.concat_ws(", ", "f1", "f2").alias("name")).agg(F.count(F.lit(1)).alias("n"), (F.sum("_e") / F.sum("_k")).alias("error"), F.avg("_m").alias("molar_fr_mean"), F.stddev_pop("_m").alias("molar_fr_std"))
    out = out.withColumn("conf", mixture_confidence(F.col("error"), known))
    return (out if known or every else out.where("conf is not null")).withColumn("mol_ratio", F.col("molar_fr_mean") / F.nullif(1 - F.col("molar_fr_mean"), F.lit(0.0)))


def ranked_mixtures(fits: DataFrame, key: list[str], digits: int = 2) -> DataFrame:
    """Mixtures with a confidence, ranked in their cluster, values rounded half to even."""
    some = fits.where("conf is not null")
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("conf"), "ref1", "ref2"))
    return some.withColumn("rank", rank).withColumns({c: F.bround(c, digits) for c in ("conf", "mol_ratio", "molar_fr_mean", "molar_fr_std")})


def is_single_phase(rms: Column, max_conf: Column, n_points: Column, has_refs: bool) -> Column:
    """Whether a cluster stems from one phase: it is tight, and a reference is likely or, without references, it has over three points."""
    sure = F.coalesce(max_conf > 0.5, F.lit(False)) if has_refs else n_points > 3
    return (rms < 0.03) & sure


def simplex(v: np.ndarray) -> np.ndarray:
    """Nearest rows that are not negative and sum to one."""
    u = -np.sort(-v, axis=1)
    c = np.cumsum(u, axis=1) - 1
    k = np.arange(1, v.shape[1] + 1)
    rho = (u - c / k > 0).sum(axis=1)
    return np.maximum(v - (c[np.arange(len(v)), rho - 1] / rho)[:, None], 0)


def factor_two(x: np.ndarray, seed: int = 0, tol: float = 1e-3, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Shares W (n, 2) and phases H (2, m), rows on the simplex, that bring W H near x: W in closed form, H by projected gradient steps."""
    rng = np.random.default_rng(seed)
    h = simplex(x[rng.choice(len(x), 2, replace=len(x) < 2)] + rng.normal(0, 0.02, (2, x.shape[1])))
    w = np.full((len(x), 2), 0.5)
    for _ in range(rounds):
        d = h[0] - h[1]
        first = np.clip((x - h[1]) @ d / max(float(d @ d), 1e-15), 0, 1)
        new_w = np.stack([first, 1 - first], 1)
        g = new_w.T @ new_w
        new_h = h
        for _ in range(5):
            new_h = simplex(new_h - (g @ new_h - new_w.T @ x) / max(float(np.linalg.eigvalsh(g)[-1]), 1e-12))
        moved = max(np.abs(new_w - w).max(), np.abs(new_h - h).max())
        w, h = new_w, new_h
        if moved < tol:
            break
    return w, h


def _ordered(h: np.ndarray, w: np.ndarray | None = None):
    """Both phases with the one first that comes first by its fractions, descending."""
    swap = tuple(h[0]) < tuple(h[1])
    return (h[::-1] if swap else h), (w[:, ::-1] if swap and w is not None else w)


def _large_factors(points: DataFrame, key: list[str], *, tol: float = 1e-3, rounds: int = 200) -> DataFrame:
    """(key, h1, h2) for clusters of any number of points (key, fr, _point): a round sums, over all partitions, what the update of the phases needs of shares and points."""
    kinds = dict(points.dtypes)
    dims = points.select(F.size("fr").alias("n")).first().n
    start = points.groupBy(*key).agg(F.min(F.struct("_point", "fr"))["fr"].alias("h1"), F.max(F.struct("_point", "fr"))["fr"].alias("h2"))
    now = cut(start)
    x = [F.col("fr")[i] for i in range(dims)]
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", h1 array<double>, h2 array<double>, moved double"

    def step(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                h = np.array([r.h1, r.h2], float)
                g, wx = np.array([[r.g11, r.g12], [r.g12, r.g22]]), np.array([[getattr(r, f"a{i}") for i in range(dims)], [getattr(r, f"b{i}") for i in range(dims)]])
                new = h
                for _ in range(5):
                    new = simplex(new - (g @ new - wx) / max(float(np.linalg.eigvalsh(g)[-1]), 1e-12))
                out.append([*[getattr(r, k) for k in key], new[0].tolist(), new[1].tolist(), float(np.abs(new - h).max())])
            yield pd.DataFrame(out, columns=[*key, "h1", "h2", "moved"])

    for _ in range(rounds):
        near = with_sample(points, now, key, "_point", 2 * dims).withColumn("w", F.coalesce(mixing_share(F.col("fr"), F.col("h1"), F.col("h2")), F.lit(0.5)))
        w, v = F.col("w"), 1 - F.col("w")
        sums = near.groupBy(*key).agg(F.sum(w * w).alias("g11"), F.sum(w * v).alias("g12"), F.sum(v * v).alias("g22"), *[F.sum(w * c).alias(f"a{i}") for i, c in enumerate(x)], *[F.sum(v * c).alias(f"b{i}") for i, c in enumerate(x)])
        new = cut(sums.join(now, key).mapInPandas(step, schema))
        now = new.drop("moved")
        if new.where(F.col("moved") >= tol).isEmpty():
            break
    return now


def free_mixture(points: DataFrame, key: list[str], elements: list[str], *, seed: int = 0, most: int = 10_000) -> DataFrame:
    """Two unknown phases for the points (key, fr) of each cluster: formulas, error, confidence, mean share and its deviation (n).

    A cluster of one sample is some hundred spectra, which one task holds.
    Those of more than ``most`` points are factored by sums over all
    partitions, round by round, from their points of least and greatest hash.
    """
    kinds = dict(points.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in key)
    schema = f"{named}, formula1 string, formula2 string, error double, conf double, share_mean double, share_std double"
    formula = lambda row: pretty_formula(dict(zip(elements, row)))

    def run(ids, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["fr"].tolist(), float)
        x = x[np.lexsort(x.T[::-1])]
        w, h = factor_two(x, seed)
        h, w = _ordered(h, w)
        error = float((np.exp(15 * np.abs(x - w @ h)) - 1).mean())
        conf = float(np.exp(-(error**2) / 0.5)) if error < 2 else None
        return pd.DataFrame([[*ids, *map(formula, h), error, conf, float(w[:, 0].mean()), float(w[:, 0].std())]])

    rows = cut(points.select(*key, "fr"))
    sizes = cut(rows.groupBy(*key).agg((F.count(F.lit(1)) > most).alias("_large")))
    if sizes.where("_large").isEmpty():
        return spread(rows, key).groupBy(*key).applyInPandas(run, schema)
    sized = rows.join(sizes, key)
    done = spread(sized.where("not _large").drop("_large"), key).groupBy(*key).applyInPandas(run, schema)
    many = cut(sized.where("_large").drop("_large").withColumn("_point", F.xxhash64("fr")))  # each round reads it
    swap = F.col("h1") < F.col("h2")
    found = cut(_large_factors(many, key).select(*key, F.when(swap, F.col("h2")).otherwise(F.col("h1")).alias("h1"), F.when(swap, F.col("h1")).otherwise(F.col("h2")).alias("h2")))
    each = with_sample(many, found, key, "_point", 2 * 64).withColumn("share", F.coalesce(mixing_share(F.col("fr"), F.col("h1"), F.col("h2")), F.lit(0.5)))
    each = each.withColumns({"_e": reconstruction_error(F.col("fr"), F.col("h1"), F.col("h2"), F.col("share")), "_k": F.size("fr")})
    out = each.groupBy(*key).agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), (F.sum("_e") / F.sum("_k")).alias("error"), F.avg("share").alias("share_mean"), F.stddev_pop("share").alias("share_std"))
    names = F.array(*[F.lit(e) for e in elements])
    text = lambda c: pretty_of(F.map_from_arrays(names, F.col(c)))
    return done.unionByName(out.select(*key, text("h1").alias("formula1"), text("h2").alias("formula2"), "error", mixture_confidence(F.col("error")).alias("conf"), "share_mean", "share_std"))
