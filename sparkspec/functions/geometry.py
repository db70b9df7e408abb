"""Frames, grids, stage coordinates and particle measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.shared import spread
from .text import excel_letters


def relative_to_pixel(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Pixel coordinates of a place given relative to the frame's centre in units of the frame's width."""
    return (x + 0.5) * width, (y / (height / width) + 0.5) * height


def pixel_to_relative(px: Column, py: Column, width: int, height: int) -> tuple[Column, Column]:
    """The inverse of ``relative_to_pixel``."""
    return px / width - 0.5, (py / height - 0.5) * (height / width)


def pixel_to_stage(px: Column, py: Column, width: int, height: int, frame_width_mm: Column, centre_x: Column, centre_y: Column) -> tuple[Column, Column]:
    """Stage coordinates in mm of a pixel of a frame of the given width around a centre."""
    step = frame_width_mm / width
    return centre_x + (px - width / 2) * step, centre_y - (py - height / 2) * step


def equivalent_diameter(area: Column) -> Column:
    return 2 * F.sqrt(area / F.pi())


def grids(given: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, x, y): for each row of ``given`` (key, half_width, spacing, ratio, circle, margin, cx, cy) a lattice of frame centres, with letters for columns and numbers for rows.

    Rows are ``ratio`` (frame height by width) times the spacing apart. Points
    lie strictly inside the circle, or in the rectangle with its border. With
    ``margin`` a frame's diagonal, spacing * sqrt(1 + ratio**2), is kept free.
    A row gives many frames, so rows are dealt out first.
    """
    given = spread(given, key) if key else given
    step, tall = F.col("spacing"), F.col("spacing") * F.col("ratio")
    reach = F.col("half_width") - F.when(F.col("margin"), step * F.sqrt(1 + F.col("ratio") * F.col("ratio"))).otherwise(0.0)
    number = lambda size: (F.floor(F.col("half_width") / size) + 1).cast("int")
    wide = given.withColumns({"_reach": reach, "_nx": number(step), "_ny": number(tall)}).withColumn("_i", F.explode(F.sequence(-F.col("_nx"), F.col("_nx"))))
    wide = wide.withColumns({"_letters": excel_letters(F.col("_i") + F.col("_nx")), "_dx": F.col("_i") * step})  # once a column of the lattice
    at = wide.withColumn("_j", F.explode(F.sequence(-F.col("_ny"), F.col("_ny"))))
    dx, dy = F.col("_dx"), F.col("_j") * tall
    inside = F.when(F.col("circle"), dx * dx + dy * dy < F.col("_reach") * F.col("_reach")).otherwise((F.abs(dx) <= F.col("_reach")) & (F.abs(dy) <= F.col("_reach") * F.col("ratio")))
    return at.where(inside).select(*key, F.concat("_letters", (F.col("_j") + F.col("_ny")).cast("string")).alias("label"), (dx + F.col("cx")).alias("x"), (dy + F.col("cy")).alias("y"))


def grid(spark: SparkSession, *, half_width: float, spacing: float, circle: bool = True, ratio: float = 1.0, margin: bool = False, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(label, x, y): the lattice of one sample, see ``grids``."""
    given = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("half_width", float(half_width)), ("spacing", float(spacing)), ("ratio", float(ratio)), ("circle", circle), ("margin", margin), ("cx", float(centre[0])), ("cy", float(centre[1])))])
    return grids(given, []).select("label", "x", "y")


def grid_offset(cycle: Column, min_distance: float, spacing: float) -> tuple[Column, Column]:
    """Shift of the whole grid in its n-th repetition: three directions in turn, farther each round; null beyond the spacing."""
    length = F.lit(min_distance) * F.ceil(cycle / 3)
    away = cycle % 3
    ok = (cycle >= 0) & (length <= spacing)
    return F.when(ok, F.when(away != 2, length).otherwise(0.0)), F.when(ok, F.when(away != 1, length).otherwise(0.0))
