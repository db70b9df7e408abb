"""Regions of touching pixels as tables: runs in rows, runs that touch, stars of runs; images of any size and number, without a function in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import cut

#: columns that two runs of neighbouring rows are looked for in together
TILE = 64


def runs_of(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x0, x1): maximal runs of pixels (key, y, x) in a row, both ends included; repeated pixels count once, null coordinates not at all."""
    own = pixels.where("x is not null and y is not null").select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    placed = own.withColumn("_g", F.col("x") - F.row_number().over(W.partitionBy(*key, "y").orderBy("x")))
    return placed.groupBy(*key, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def touching(runs: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b): ids of runs in neighbouring rows that share a column or a corner. A run is looked for in the tiles it covers, so a row of many runs is no product."""
    tile = lambda a, b: F.explode(F.sequence(F.floor(a / TILE), F.floor(b / TILE))).alias("_t")
    low = runs.select(*key, "y", "id", "x0", "x1", tile(F.col("x0"), F.col("x1")))
    high = runs.select(*key, (F.col("y") - 1).alias("y"), F.col("id").alias("_id"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), tile(F.col("x0") - 1, F.col("x1") + 1))
    met = low.join(high, [*key, "y", "_t"]).where("_x0 <= x1 + 1 and x0 <= _x1 + 1")
    return met.select(*key, F.col("id").alias("a"), F.col("_id").alias("b")).distinct()


def connected(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, root): the least id that edges (key, a, b) lead to, for each id that has one. Large and small stars in turn, as many rounds as the logarithm of the longest way."""
    now = cut(edges.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        both = now.unionAll(now.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*key, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, [*key, "a"]).where("b > a").select(*key, F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(*key, "b").agg(F.min("a").alias("m"))
        small = large.join(low, [*key, "b"])
        new = cut(small.where("a <> m").select(*key, F.col("m").alias("a"), F.col("a").alias("b")).unionAll(low.select(*key, F.col("m").alias("a"), "b")).distinct())
        ends = new.select(*key, F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(new.select(*key, F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy(*key, "id").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down > 0)").isEmpty():
            return new.select(*key, F.col("b").alias("id"), F.col("a").alias("root"))
        now = new


def regions_of(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x0, x1, region): runs of the foreground ``pixels`` (key, y, x) with the region that they belong to, diagonal neighbours included.

    ``region`` numbers the regions of an image from 0 by their first pixel, row
    by row. Tiles of a large image that carry its coordinates join by
    themselves. Coordinates are whole, from 0 to 2**31.
    """
    runs = cut(runs_of(pixels, key).withColumn("id", F.col("y") * (1 << 31) + F.col("x0")))
    roots = connected(touching(runs, key), key)
    named = runs.join(roots, [*key, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    number = named.select(*key, "root").distinct().withColumn("region", F.row_number().over(W.partitionBy(*key).orderBy("root")) - 1)
    return named.join(number, [*key, "root"]).select(*key, "y", "x0", "x1", "region")


def region_statistics(runs: DataFrame, key: list[str]) -> DataFrame:
    """(key, region, area, x0, y0, x1, y1, cx, cy): pixels, bounding box with its ends excluded, and centroid."""
    n = F.col("x1") - F.col("x0") + 1
    out = runs.groupBy(*key, "region").agg(F.sum(n).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("_x"), F.sum(F.col("y") * n).alias("_y"))
    return out.withColumns({"cx": F.col("_x") / F.col("area"), "cy": F.col("_y") / F.col("area")}).drop("_x", "_y")


def pixels_of(images: DataFrame, threshold: int) -> DataFrame:
    """(image_id, y, x) of pixels brighter than the threshold in images (image_id, height, width, pixels: 8-bit grey)."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.conv(F.hex(F.substr("pixels", i + 1, F.lit(1))), 16, 10).cast("int") > threshold))
    some = images.where("pixels is not null and height * width > 0").select("image_id", "width", at.alias("_i"))
    return some.select("image_id", F.floor(F.col("_i") / F.col("width")).alias("y"), (F.col("_i") % F.col("width")).alias("x"))
