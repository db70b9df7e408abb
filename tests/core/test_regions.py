"""Regions as tables against the labelling of whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkspec.operators import images, regions


def _spiral(n):
    """A one-pixel-wide spiral: one region whose runs lie far apart in steps."""
    m = np.zeros((n, n), bool)
    y, x, dy, dx, left = 0, 0, 0, 1, n
    m[0, 0] = True
    while left > 2:
        for _ in range(left - 1):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
        if dx == 0 or True:
            left -= 1 if dy == 0 else 1
    return m


def _masks():
    rng = np.random.default_rng(4)
    yield "sparse", rng.random((40, 200)) < 0.2
    yield "dense", rng.random((30, 150)) < 0.5
    yield "full", np.ones((20, 130), bool)
    yield "empty", np.zeros((5, 5), bool)
    yield "diagonal", np.eye(150, dtype=bool) | np.eye(150, dtype=bool)[::-1]
    yield "comb", np.arange(130)[None] % 2 == np.zeros((3, 1))  # a row of 65 runs
    yield "spiral", _spiral(24)


def test_regions_equal_whole_images(spark):
    masks = dict(_masks())
    rows = [(n, int(y), int(x)) for n, m in masks.items() for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows + rows[:50] + [("dense", None, 3), (None, 2, None)], "image string, y int, x int").repartition(6)
    got = {}
    for r in regions.region_statistics(regions.regions_of(df, ["image"]), ["image"]).collect():
        got.setdefault(r.image, []).append((r.area, r.x0, r.y0, r.x1, r.y1, round(r.cx, 9), round(r.cy, 9)))
    for name, mask in masks.items():
        want = images.components(mask)[1]
        assert sorted(got.get(name, [])) == sorted((p.area, p.x0, p.y0, p.x1, p.y1, round(p.cx, 9), round(p.cy, 9)) for p in want.itertuples())
    numbers = regions.regions_of(df.where("image = 'sparse'"), ["image"])
    first = numbers.groupBy("region").agg(F.min(F.struct("y", "x0")).alias("p")).orderBy("region").collect()
    assert [r.region for r in first] == list(range(len(first))) and [tuple(r.p) for r in first] == sorted(tuple(r.p) for r in first)
    assert regions.regions_of(df.limit(0), ["image"]).count() == 0


def test_tiles_of_a_large_image_join(spark):
    """A frame around 4,000 by 4,000 pixels, cut into tiles: its sides are one region, and no task sees the image."""
    side = 4000
    at = lambda y, x: F.struct(y.cast("long").alias("y"), x.cast("long").alias("x"))
    i, last = F.col("id"), F.lit(side - 1)
    edge = spark.range(side).select(F.lit(1).alias("image"), F.explode(F.array(at(F.lit(0), i), at(last, i), at(i, F.lit(0)), at(i, last))).alias("p")).select("image", "p.*")
    (r,) = regions.region_statistics(regions.regions_of(edge, ["image"]), ["image"]).collect()
    assert (r.area, r.x0, r.y0, r.x1, r.y1, r.cx, r.cy) == (4 * side - 4, 0, 0, side, side, pytest.approx((side - 1) / 2), pytest.approx((side - 1) / 2))


def test_pixels_of_images(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (7, 9)).astype(np.uint8)
    df = spark.createDataFrame([("a", 7, 9, bytearray(image.tobytes())), ("b", 2, 2, None), ("c", 0, 0, bytearray())], "image_id string, height int, width int, pixels binary")
    found = regions.pixels_of(df, 100)
    assert {(r.y, r.x) for r in found.collect()} == set(map(tuple, np.argwhere(image > 100).tolist()))
    plan = regions.touching(regions.runs_of(found, ["image_id"]).withColumn("id", F.col("y") * 100 + F.col("x0")), ["image_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
