"""Particles in grey images: segmentation, measures and measurement spots."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Segmentation models by name: image (2-D uint8), settings -> mask of 0 and 255, or labels 1..n.
MODELS: dict[str, Callable[[np.ndarray, dict], np.ndarray]] = {}


def register_model(name: str, segment: Callable[[np.ndarray, dict], np.ndarray]) -> None:
    """Make a segmentation function available under a name; a name can be taken once."""
    if name in MODELS:
        raise ValueError(f"segmentation model {name!r} is registered already")
    MODELS[name] = segment


def blur(image: np.ndarray) -> np.ndarray:
    """5 x 5 binomial blur with mirrored borders."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    wide = np.pad(image.astype(float), 2, mode="reflect" if min(image.shape) > 2 else "edge")
    rows = sum(k[i] * wide[i : i + image.shape[0]] for i in range(5))
    return np.rint(sum(k[i] * rows[:, i : i + image.shape[1]] for i in range(5))).astype(np.uint8)


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected components of true pixels, numbered from 1 in reading order: runs of each row are joined to those above them."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = 1 if diagonal else 0
    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < stop[j] + reach and start[j] < stop[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    names = np.array([find(i) for i in range(len(rows))], int)
    _, number = np.unique(names, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, a, b, n in zip(rows, start, stop, number):
        out[y, a:b] = n + 1
    return out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with background regions that do not reach the border."""
    outer = label(~np.pad(mask, 1), diagonal=False)
    return ~(outer == outer[0, 0])[1:-1, 1:-1]


def threshold_bright(image: np.ndarray, settings: dict) -> np.ndarray:
    """Pixels brighter than the threshold after blurring, holes filled."""
    return fill_holes(blur(image) > settings.get("brightness", 100)).astype(np.uint8) * 255


MODELS["threshold_bright"] = threshold_bright


def components(mask: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """Labels, and for each its area, bounding box (ends excluded) and centroid; a label image keeps its labels."""
    kinds = np.unique(mask)
    labels = label(mask > 0) if mask.dtype == bool or set(kinds.tolist()) <= {0, 255} else mask.astype(np.int32)
    y, x = np.nonzero(labels)
    of = labels[y, x]
    if not len(of):
        return labels, pd.DataFrame(columns=["label", "area", "x0", "y0", "x1", "y1", "cx", "cy"])
    g = pd.DataFrame({"label": of, "x": x, "y": y}).groupby("label").agg(area=("x", "size"), x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max"), cx=("x", "mean"), cy=("y", "mean")).reset_index()
    g[["x1", "y1"]] += 1
    return labels, g


def particles(image: np.ndarray, *, model: str = "threshold_bright", settings: dict | None = None, pixel_um: float = 1.0, least_um2: float = 0.0, most_um2: float = float("inf"), margin: int = 3) -> tuple[np.ndarray, pd.DataFrame]:
    """Particles within area limits (both included) that stay clear of the border."""
    labels, g = components(MODELS[model](image, settings or {}))
    h, w = image.shape
    area = g["area"] * pixel_um**2
    inside = (g["x0"] >= margin) & (g["y0"] >= margin) & (g["x1"] <= w - margin) & (g["y1"] <= h - margin)
    return labels, g[(area >= least_um2) & (area <= most_um2) & inside]


def segment_particles(images: DataFrame, **how) -> DataFrame:
    """(image_id, particle_id, area_um2, diameter_um, x0, y0, x1, y1, cx, cy) of images (image_id, height, width, pixel_size_um, pixels).

    Images come to Python in batches of ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB).
    """
    schema = "image_id string, particle_id long, area_um2 double, diameter_um double, x0 int, y0 int, x1 int, y1 int, cx double, cy double"

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.pixels is None or r.height * r.width == 0:
                    continue
                image = np.frombuffer(r.pixels, np.uint8)[: r.height * r.width].reshape(r.height, r.width)
                _, g = particles(image, pixel_um=r.pixel_size_um, **how)
                for n, p in enumerate(g.itertuples(index=False)):
                    area = float(p.area) * r.pixel_size_um**2
                    out.append((str(r.image_id), n, area, 2 * np.sqrt(area / np.pi), int(p.x0), int(p.y0), int(p.x1), int(p.y1), float(p.cx), float(p.cy)))
            yield pd.DataFrame(out, columns=schema.replace(",", "").split()[::2])

    return images.select("image_id", "height", "width", "pixel_size_um", "pixels").mapInPandas(run, schema)


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels whose whole disc of the radius lies in the mask."""
    if radius <= 0:
        return mask
    wide = np.pad(mask, radius)
    out = np.ones_like(mask)
    for dy in range(-radius, radius + 1):
        half = int(np.sqrt(radius * radius - dy * dy))
        rows = wide[radius + dy : radius + dy + mask.shape[0]]
        sums = np.cumsum(np.pad(rows, ((0, 0), (1, 0))).astype(np.int32), axis=1)
        a = radius - half
        out &= sums[:, a + 2 * half + 1 : a + 2 * half + 1 + mask.shape[1]] - sums[:, a : a + mask.shape[1]] == 2 * half + 1
    return out


def bright_regions(image: np.ndarray, mask: np.ndarray, *, threshold: int, pixel_um: float, margin_um: float, least_um2: float = 0.1) -> np.ndarray:
    """Labels of bright regions inside a particle: the eroded particle is scaled to 255 and cut at the threshold; small regions go."""
    inner = erode(mask, max(10, int(margin_um / pixel_um)))
    values = np.where(inner, image, 0).astype(float)
    if values.max() > 0:
        values = values * 255 / values.max()
    labels, g = components((values > threshold).astype(np.uint8) * 255)
    small = g.loc[g["area"] * pixel_um**2 < least_um2, "label"]
    labels[np.isin(labels, small)] = 0
    return labels


def random_spots(points: np.ndarray, n: int, distance: float, seed: int = 0) -> np.ndarray:
    """At most ``n`` points in random order, each farther than ``distance`` from those before; few points are all taken."""
    points = points[np.random.default_rng(seed).permutation(len(points))]
    if len(points) <= n:
        return points
    kept = [points[0]]
    for p in points[1:]:
        if len(kept) == n:
            break
        if min(np.hypot(*(p - q)) for q in kept) > distance:
            kept.append(p)
    return np.array(kept)


def even_spots(points: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """``n`` points, each the farthest from those before it; few points are all taken."""
    if len(points) <= n:
        return points
    rng = np.random.default_rng(seed)
    kept = [int(rng.integers(len(points)))]
    gap = np.hypot(*(points - points[kept[0]]).T)
    while len(kept) < n:
        kept.append(int(gap.argmax()))
        gap = np.minimum(gap, np.hypot(*(points - points[kept[-1]]).T))
    return points[kept]


def peak_spots(image: np.ndarray, labels: np.ndarray, *, n: int, threshold: float, radius: int) -> np.ndarray:
    """Centres (x, y) of the brightest spots of each region: those within 97 % of its maximum; a disc around each is blanked, until nothing reaches the threshold or after 100 n rounds."""
    found = []
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    for region in range(1, labels.max(initial=0) + 1):
        values = blur(np.where(labels == region, image, 0)).astype(float)
        for _ in range(100 * n):
            top = values.max(initial=0)
            if top < threshold or top <= 0:
                break
            _, g = components((values > int(top * 0.97)).astype(np.uint8) * 255)
            for p in g.itertuples(index=False):
                x, y = p.x0 + (p.x1 - p.x0) // 2, p.y0 + (p.y1 - p.y0) // 2
                found.append((x, y))
                values[(xx - x) ** 2 + (yy - y) ** 2 <= radius * radius] = 0
    return np.array(found, int).reshape(-1, 2)


def select_spots(points: DataFrame, key: list[str], *, n: int, distance: float = 0.0, method: str = "random", seed: int = 0) -> DataFrame:
    """Measurement spots (key, x, y) of each particle: ``random`` keeps a distance, ``even`` spreads them out. A particle's candidates are pixels of one image."""
    kinds = dict(points.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", spot int, x double, y double"

    def run(ids, rows: pd.DataFrame) -> pd.DataFrame:
        xy = rows[["x", "y"]].sort_values(["y", "x"]).to_numpy(float)
        kept = random_spots(xy, n, distance, seed) if method == "random" else even_spots(xy, n, seed)
        return pd.DataFrame([[*ids, i, *p] for i, p in enumerate(kept)], columns=[*key, "spot", "x", "y"])

    return points.select(*key, "x", "y").groupBy(*key).applyInPandas(run, schema)
