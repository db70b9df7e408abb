"""Clustering of a sample's compositions: k-means, silhouettes, choice of k."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import cut, spread


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres: k-means++ start, then Lloyd's steps until labels stay."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        total = d.sum()
        centres.append(x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))])
    centres = np.array(centres)
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        if (new == labels).all():
            break
        labels = new
        member = (labels == np.arange(k)[:, None]).astype(float)
        size = member.sum(1)
        centres = np.where(size[:, None] > 0, member @ x / np.maximum(size, 1)[:, None], centres)
    return labels, centres


def inertia(x: np.ndarray, labels: np.ndarray) -> float:
    return float(sum(((x[labels == j] - x[labels == j].mean(0)) ** 2).sum() for j in np.unique(labels)))


def distances(x: np.ndarray) -> np.ndarray:
    """All Euclidean distances; exact zeros for equal points."""
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if len(x) * len(x) * x.shape[1] < 2e7 else np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in x])


def silhouettes(x: np.ndarray, labels: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
    """Silhouette of each point by plain Euclidean distance; 0 for a cluster of one. ``d`` may hold the distances."""
    d = distances(x) if d is None else d
    names, of = np.unique(labels, return_inverse=True)
    member = (of[:, None] == np.arange(len(names))).astype(float)
    size = member.sum(0)
    sums = d @ member
    own = sums[np.arange(len(x)), of] / np.maximum(size[of] - 1, 1)
    near = np.where(member > 0, np.inf, sums / size).min(1)
    out = (near - own) / np.maximum(np.maximum(near, own), 1e-300)
    return np.where((size[of] > 1) & np.isfinite(near), out, 0.0)


def calinski_harabasz(x: np.ndarray, labels: np.ndarray) -> float:
    k = len(np.unique(labels))
    within = inertia(x, labels)
    between = float(((x - x.mean(0)) ** 2).sum()) - within
    return between / max(within, 1e-300) * (len(x) - k) / max(k - 1, 1)


class Silhouettes:
    """Silhouettes of many clusterings of the same points, by distances that are made strip by strip and never kept whole."""

    def __init__(self, x: np.ndarray, strip: int = 256):
        self.x, self.strip = x - x.mean(0), strip
        self.square = (self.x * self.x).sum(1)
        self.at = np.unique(np.linspace(0, len(x) - 1, min(len(x), strip)).astype(int))
        self.rows = self._rows(self.at)

    def _rows(self, at: np.ndarray) -> np.ndarray:
        """Distances of some points to all: by products, and anew where they are so small that these are not exact."""
        d = self.square[at][:, None] + self.square - 2 * self.x[at] @ self.x.T
        i, j = np.nonzero(d < 1e-6 * (self.square[at][:, None] + self.square))
        for n in range(0, len(i), 65_536):
            r, c = i[n : n + 65_536], j[n : n + 65_536]
            d[r, c] = ((self.x[at[r]] - self.x[c]) ** 2).sum(1)
        return np.sqrt(np.maximum(d, 0))

    @staticmethod
    def _scores(sums: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = np.arange(len(of))
        own = sums[n, of] / np.maximum(size[of] - 1, 1)
        others = sums / size
        others[n, of] = np.inf
        near = others.min(1)
        out = (near - own) / np.maximum(np.maximum(near, own), 1e-300)
        return np.where((size[of] > 1) & np.isfinite(near), out, 0.0)

    @staticmethod
    def named(labels: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Clusters numbered by their first points, and a key that equal clusterings share."""
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        of = np.argsort(np.argsort(first))[of].astype(np.int32)
        return of, of.tobytes()

    def fails(self, of: np.ndarray) -> bool:
        """Whether one of the points that are looked at first has a silhouette of 0 or less."""
        member = (of[:, None] == np.arange(of.max() + 1)).astype(float)
        return bool((self._scores(self.rows @ member, of[self.at], member.sum(0)) <= 0).any())

    def of_all(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """Silhouettes of all points for each clustering, in one pass over the distances. Points that are below 0 most are looked at first from now on."""
        members = [(of[:, None] == np.arange(of.max() + 1)).astype(float) for of in many]
        whole, cuts = np.concatenate(members, 1), np.cumsum([m.shape[1] for m in members])[:-1]
        sums = np.concatenate([self._rows(np.arange(n, min(n + self.strip, len(self.x)))) @ whole for n in range(0, len(self.x), self.strip)])
        out = [self._scores(part, of, m.sum(0)) for part, of, m in zip(np.split(sums, cuts, 1), many, members)]
        worst = np.setdiff1d(np.unique([i for s in out for i in np.argsort(s)[:16] if s[i] <= 0]).astype(int), self.at)[: 4 * self.strip]
        if len(worst) and len(self.at) < 8 * self.strip:
            self.at, self.rows = np.concatenate([self.at, worst]), np.concatenate([self.rows, self._rows(worst)])
        return out


def best_clustering(x: np.ndarray, k: int, rng: np.random.Generator, runs: int = 20, tries: int = 50) -> tuple[np.ndarray, float]:
    """Labels of the best of ``runs`` clusterings by mean silhouette; each is tried again until no silhouette is negative or 0, the last try stands. NaN for k = 1.

    Most tries fail at a few points already. Those that do not are taken to
    hold, judged together in one pass over all distances, and the runs gone
    through again with what is known by then.
    """
    if k <= 1:
        return np.zeros(len(x), int), float("nan")
    judge, drawn, known = Silhouettes(x), [], {}

    def drawn_at(i: int) -> list:
        while len(drawn) <= i:
            labels = kmeans(x, k, rng)[0]
            of, name = judge.named(labels)
            drawn.append([labels, of, name, of.max() > 0, None])
        return drawn[i]

    while True:
        i, ends, asked = 0, [], {}
        for _ in range(runs):
            for _ in range(tries):
                one = drawn_at(i)
                labels, of, name, parts, failed = one
                i += 1
                if not parts:
                    continue
                if name in known:
                    failed = not (known[name] > 0).all()
                elif not failed:
                    failed = one[4] = judge.fails(of)
                if not failed:
                    break
            ends.append((labels, name, parts))
            if parts and name not in known:
                asked[name] = of
        if not asked:
            break
        known |= zip(asked, judge.of_all(list(asked.values())))
    best, score = None, -np.inf
    for labels, name, parts in ends:
        if parts and known[name].mean() > score:
            best, score = labels, float(known[name].mean())
    return (best, score) if best is not None else (np.zeros(len(x), int), float("nan"))


def is_single_cluster(x: np.ndarray, rng: np.random.Generator) -> bool:
    """One cluster if the spread is small, two clusters part badly, or a second one saves little."""
    rms = float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()))
    if rms < 0.03 or len(x) < 3:
        return True
    labels, s2 = best_clustering(x, 2, rng, runs=10, tries=1)
    if np.isnan(s2) or s2 < 0.5:
        return True
    if s2 > 0.6:
        return False
    return inertia(x, np.zeros(len(x), int)) / max(inertia(x, labels), 1e-300) < 1.5


def knee(ks: list[int], values: list[float]) -> int | None:
    """The k farthest below the straight line from the first to the last distortion; None without a bend."""
    if len(ks) < 3 or values[0] <= values[-1]:
        return None
    a, b = np.array(ks, float), np.array(values)
    line = b[0] + (b[-1] - b[0]) * (a - a[0]) / (a[-1] - a[0])
    drop = line - b
    return int(ks[int(drop.argmax())]) if drop.max() > 1e-9 else None


def k_choices(x: np.ndarray, max_k: int, method: str, rng: np.random.Generator, n: int) -> list[int]:
    """``n`` choices of k: by silhouette or Calinski-Harabasz from 2 on, or by the elbow of the distortion from 1 on. All silhouettes are had in one pass over the distances."""
    top = min(max_k, len(x) - 1)
    if top < 2:
        return [1] * n
    ks = range(1 if method == "elbow" else 2, top + 1)
    made = [{k: min((kmeans(x, k, rng)[0] for _ in range(3)), key=lambda l: inertia(x, l)) for k in ks} for _ in range(n)]
    if method == "elbow":
        return [knee(list(runs), [inertia(x, l) for l in runs.values()]) or 1 for runs in made]
    if method != "silhouette":
        found = [{k: calinski_harabasz(x, l) for k, l in runs.items() if len(np.unique(l)) > 1} for runs in made]
    else:
        named = [{k: Silhouettes.named(l) for k, l in runs.items()} for runs in made]
        asked = {name: of for runs in named for of, name in runs.values() if of.max() > 0}
        score = {name: float(s.mean()) for name, s in zip(asked, Silhouettes(x).of_all(list(asked.values())))} if asked else {}
        found = [{k: score[name] for k, (_, name) in runs.items() if name in score} for runs in named]
    return [max(scores, key=scores.get) if scores else 1 for scores in found]


def k_once(x: np.ndarray, max_k: int, method: str, rng: np.random.Generator) -> int:
    """One choice of k, see ``k_choices``."""
    return k_choices(x, max_k, method, rng, 1)[0]


def vote(choices: list[int], rounds: int) -> int | None:
    """The accepted k of ballots so far: the top one if it has twice the votes of the second; after ``rounds`` the least with half of the top's votes; else None."""
    ks, counts = np.unique(choices, return_counts=True)
    order = np.lexsort((ks, -counts))
    if len(ks) == 1 or counts[order[0]] >= 2 * counts[order[1]]:
        return int(ks[order[0]])
    return int(ks[counts >= counts.max() / 2].min()) if rounds >= 5 else None


def choose_k(x: np.ndarray, max_k: int = 6, method: str = "silhouette", seed: int = 0, per_round: int = 20) -> int:
    rng = np.random.default_rng(seed)
    if len(x) < 3 or is_single_cluster(x, rng):
        return 1
    choices: list[int] = []
    for round_ in range(1, 6):
        choices += k_choices(x, max_k, method, rng, per_round)
        k = vote(choices, round_)
        if k is not None:
            return k
    return 1


def canonical(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels renamed by descending size, then by centre, so that they depend on the data alone."""
    names = np.unique(labels)
    order = sorted(names, key=lambda j: (-(labels == j).sum(), tuple(x[labels == j].mean(0))))
    place = {j: i for i, j in enumerate(order)}
    return np.array([place[j] for j in labels])


def cluster_samples(points: DataFrame, key: list[str], *, point: str = "spectrum_id", k: int | None = None, max_k: int = 6, method: str = "silhouette", seed: int = 0, least: int = 5, most: int = 10_000) -> DataFrame:
    """(key, point, cluster_id, k, silhouette, error) for the points (key, point, fr) of each sample.

    A sample is some hundred to some thousand spectra, which is what one group
    holds, since silhouettes need all distances; samples of more than ``most``
    points are clustered over all partitions instead (``cluster_large``) and
    have no silhouette. Groups run side by side. Samples of fewer than ``least`` points
    give no rows. A sample that cannot be clustered gives one row without a
    point, with the reason as its error; the others go on. ``k`` of 0 or None
    means to find it. Points are put in the order of their ids, so
    partitioning does not matter.
    """
    from .cluster_large import cluster_large, with_sample

    kinds = dict(points.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, point]) + ", cluster_id int, k int, silhouette double, error string"
    names = [*key, point, "cluster_id", "k", "silhouette", "error"]

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(point, kind="stable")
        x = np.array(rows["fr"].tolist(), float)
        if not np.isfinite(x).all():
            raise ValueError("a composition holds null or non-finite fractions")
        n = k or choose_k(x, max_k, method, seed)
        labels, score = best_clustering(x, min(n, len(x)), np.random.default_rng(seed))
        out = rows[[*key, point]].copy()
        labels = canonical(x, labels)
        out["cluster_id"], out["k"], out["silhouette"], out["error"] = labels, len(np.unique(labels)), None if np.isnan(score) else score, None
        return out

    def run(ids, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < least:
            return pd.DataFrame(columns=names)
        try:
            return clustered(rows)
        except Exception as e:  # one bad sample is reported, not the end of the job
            return pd.DataFrame([[*ids, None, None, None, None, f"{type(e).__name__}: {e}"]], columns=names)

    rows = points.select(*key, point, "fr")
    large = [tuple(r) for r in rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*key).limit(1).collect()]
    if not large:
        return spread(rows, key).groupBy(*key).applyInPandas(run, schema)
    held = F.coalesce(~F.exists("fr", lambda x: F.coalesce(x.cast("double") - x.cast("double") != 0.0, F.lit(True))), F.lit(False))  # of an infinite or NaN component the difference is NaN
    whole = F.min(held) & (F.min(F.size("fr")) == F.max(F.size("fr")))
    sizes = rows.groupBy(*key).agg((F.count(F.lit(1)) > most).alias("_large"), whole.alias("_whole"))
    sizes = cut(sizes.withColumn("_sample", F.monotonically_increasing_id()))  # a key of its own, since one of ``key`` may be null
    sides = sizes.select("_large", "_whole", "_sample", *[F.col(c).alias(f"_{c}_") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in key]
    sized = rows.join(F.broadcast(sides) if sizes.count() <= 1 << 20 else sides, same)
    done = spread(sized.where("not _large").select(*key, point, "fr"), key).groupBy(*key).applyInPandas(run, schema)
    many = cluster_large(sized.where("_large and _whole").select("_sample", point, "fr"), ["_sample"], point=point, k=k, max_k=max_k, method=method, seed=seed)
    none = lambda kind: F.lit(None).cast(kind)
    many = with_sample(many, sizes.select("_sample", *key), ["_sample"], point, 4).withColumns({"silhouette": none("double"), "error": none("string")})
    failed = sizes.where("_large and not _whole").select(*key, none(kinds[point]).alias(point), none("int").alias("cluster_id"), none("int").alias("k"), none("double").alias("silhouette"), F.lit("ValueError: a composition holds null or non-finite fractions").alias("error"))
    return done.unionByName(many.select(*names)).unionByName(failed)


def k_vote(choices: DataFrame, key: list[str], *, last_round: bool = False) -> DataFrame:
    """The vote over rows (key, k) in SQL: accepted_k is null while no k has twice the votes of the next one."""
    counts = choices.groupBy(*key, "k").agg(F.count(F.lit(1)).alias("votes"))
    order = W.partitionBy(*key).orderBy(F.desc("votes"), "k")
    ranked = counts.withColumns({"r": F.row_number().over(order), "second": F.lead("votes", 1, 0).over(order), "top": F.max("votes").over(W.partitionBy(*key))})
    first = F.max(F.when(F.col("r") == 1, F.col("k"))), F.max(F.when(F.col("r") == 1, F.col("votes") >= 2 * F.col("second")))
    out = ranked.groupBy(*key).agg(first[0].alias("top_k"), first[1].alias("clear"), F.min(F.when(F.col("votes") >= F.col("top") / 2, F.col("k"))).alias("least_k"))
    other = F.col("least_k") if last_round else F.lit(None)
    return out.select(*key, "top_k", F.when(F.col("clear"), F.col("top_k")).otherwise(other).cast("int").alias("accepted_k"))


def exact_silhouettes(points: DataFrame, key: list[str], point: str, cluster: str, vector: str, *, block: int = 65_536, blocks: int = 16, strip: int = 1024) -> DataFrame:
    """(key, point, cluster, silhouette), as silhouettes ask for by the distances of all pairs of each sample.

    A sample is cut into ``blocks`` blocks (fewer where it is small, more where
    they would hold over some ``block`` points), and each pair of blocks is a
    task, which sums the distances of a point to each cluster, ``strip`` points
    at a time. So a point is sent once for each block, whose number does not
    grow with the sample up to a million points, and comes back as one row of
    sums for each; pairs are never rows. A cluster of one, or without another, has 0.
    """
    from .cluster_large import with_sample

    rows = points.select(*key, F.col(point).alias("_p"), F.col(cluster).alias("_c"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    count = F.count(F.lit(1))
    parts = rows.groupBy(*key).agg(F.greatest(F.ceil(count / block), F.least(F.lit(blocks), F.ceil(count / 512))).cast("int").alias("_n"))
    placed = with_sample(rows, cut(parts), key, "_p", 1).withColumn("_s", F.pmod(F.xxhash64("_p"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "_p", "_c"]) + f", _t array<struct<_d:{kinds['_c']},n:bigint,total:double>>"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, flat = table["_s"].to_numpy(), table["_v"].combine_chunks()
        x = np.asarray(flat.flatten()).reshape(len(side), -1) if len(side) else np.zeros((0, 1))
        names = table["_c"].combine_chunks().dictionary_encode()
        of, kinds_ = np.asarray(names.indices), len(names.dictionary)
        i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        member = (of[:, None] == np.arange(kinds_)).astype(float)
        square, total, n = (x * x).sum(1), np.zeros((len(side), kinds_)), np.zeros((len(side), kinds_), np.int64)
        xr, mr, sr = x[right], member[right], square[right]
        for at in range(0, len(left), strip):
            one = left[at : at + strip]
            d = x[one] @ xr.T
            d *= -2
            d += square[one][:, None]
            d += sr
            np.maximum(d, 0, out=d)
            np.sqrt(d, out=d)
            if i == j:
                d[np.arange(len(one)), np.arange(at, at + len(one))] = 0
            else:
                total[right] += d.T @ member[one]
            total[one] += d @ mr
        n[left] = mr.sum(0).astype(np.int64)
        if i == j:
            n[left, of[left]] -= 1
        else:
            n[right] = member[left].sum(0).astype(np.int64)
        r, c = np.nonzero(n)
        ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(side)))]).astype(np.int32)
        sums = pa.StructArray.from_arrays([names.dictionary.take(pa.array(c)), pa.array(n[r, c]), pa.array(total[r, c])], ["_d", "n", "total"])
        return table.select([*key, "_p", "_c"]).append_column("_t", pa.ListArray.from_arrays(pa.array(ends), sums))

    pairs = placed.select(*key, "_p", "_c", "_v", "_s", F.least("_s", "_o").alias("_i"), F.greatest("_s", "_o").alias("_j"))
    sums = spread(pairs, [*key, "_i", "_j"]).groupBy(*key, "_i", "_j").applyInArrow(run, schema)
    dealt = sums.repartition(*key, "_p", "_c")  # by the point, before its sums become rows: both aggregations below need no other exchange
    means = dealt.select(*key, "_p", "_c", F.explode("_t").alias("_t")).select(*key, "_p", "_c", "_t.*").groupBy(*key, "_p", "_c", "_d").agg((F.sum("total") / F.sum("n")).alias("m"))
    done = means.groupBy(*key, "_p", "_c").agg(F.max(F.when(F.col("_c") == F.col("_d"), F.col("m"))).alias("own"), F.min(F.when(F.col("_c") != F.col("_d"), F.col("m"))).alias("near"))
    score = F.when(F.col("own").isNull() | F.col("near").isNull(), 0.0).otherwise((F.col("near") - F.col("own")) / F.greatest("near", "own"))
    return done.select(*key, F.col("_p").alias(point), F.col("_c").alias(cluster), score.alias("silhouette"))
