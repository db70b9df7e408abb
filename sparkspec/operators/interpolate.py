"""Piecewise-linear lookup on a curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def interpolate(rows: DataFrame, curve: DataFrame, *, at: str, x: str = "x", y: str = "y", out: str = "value", bin_width: float) -> DataFrame:
    """``rows`` with the curve's value at column ``at``; beyond its ends the end values hold.

    Segments of the curve are dealt to the bins of ``bin_width`` that they
    cross, and rows meet the segments of their own bin, so the join is an
    equality join at any size. The curve's points are ordered in one task:
    they are a table of an instrument, some thousand points.
    """
    ends = curve.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1"))
    order = W.orderBy(x)
    segments = curve.select(F.col(x).alias("_a"), F.col(y).alias("_ya"), F.lead(x).over(order).alias("_b"), F.lead(y).over(order).alias("_yb")).where("_b is not null")
    cell = lambda c: F.floor(c / bin_width)
    dealt = segments.withColumn("_bin", F.explode(F.sequence(cell(F.col("_a")), cell(F.col("_b")))))
    kept = rows.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(ends)).withColumn("_at", F.least(F.greatest(F.col(at), F.col("_x0")), F.col("_x1")))
    kept = kept.withColumn("_bin", cell(F.col("_at")))
    met = kept.join(dealt, (kept["_bin"] == dealt["_bin"]) & (F.col("_at") >= F.col("_a")) & ((F.col("_at") < F.col("_b")) | ((F.col("_b") == F.col("_x1")) & (F.col("_at") == F.col("_x1")))), "left")
    value = F.when(F.col("_x0") == F.col("_x1"), F.col("_y0")).otherwise(F.col("_ya") + (F.col("_yb") - F.col("_ya")) * (F.col("_at") - F.col("_a")) / (F.col("_b") - F.col("_a")))
    return met.select(*[rows[c] for c in rows.columns], value.alias(out))


def trapezoid(points: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(key, integral) by the trapezoid rule over the points of each group in order of x."""
    order = W.partitionBy(*key).orderBy(x)
    area = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return points.withColumn("_a", area).groupBy(*key).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))
