"""Statistics of clusters, lines, fit parameters and particles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cluster_statistics(points: DataFrame, key: list[str], feature: str = "element", value: str = "value", point: str = "spectrum_id") -> tuple[DataFrame, DataFrame]:
    """Per cluster and feature its mean and standard deviation (n - 1), and per cluster n_points, wcss and rms.

    ``points`` is long: key, point id, feature, value. One point has no
    deviation. Distances are Euclidean over all features of the cluster.
    """
    centres = points.groupBy(*key, feature).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_s"))
    # squares about the mean, from sums that partial aggregation has already brought together
    apart = points.join(centres.select(*key, feature, "mean"), [*key, feature])
    rows = apart.groupBy(*key).agg(F.countDistinct(point).alias("n_points"), F.sum(F.pow(F.col(value) - F.col("mean"), 2)).alias("wcss"))
    return centres.drop("_n", "_s"), rows.withColumn("rms", F.sqrt(F.col("wcss") / F.col("n_points")))


def standards_of_lines(long: DataFrame, key: list[str], value: str = "pb", *, least: float | None = 10.0) -> DataFrame:
    """Mean, standard deviation (n), relative deviation in percent and count of peak-to-background ratios; NaN, null and ratios under ``least`` do not count, lines without any go."""
    x = F.nanvl(F.col(value), F.lit(None).cast("double"))
    ok = F.when(x >= least, x) if least is not None else x
    out = long.withColumn("_x", ok).groupBy(*key).agg(F.avg("_x").alias("mean_pb"), F.stddev_pop("_x").alias("std_pb"), F.count("_x").alias("n_spectra"))
    return out.where("n_spectra > 0").withColumn("rel_std_pct", F.col("std_pb") / F.col("mean_pb") * 100)


def with_summary_rows(wide: DataFrame, key: list[str], label: str, values: list[str]) -> DataFrame:
    """``wide`` and for each group a row labelled ``mean`` and one ``std`` (n - 1)."""
    both = wide.groupBy(*key).agg(F.array(
        F.struct(F.lit("mean").alias(label), *[F.avg(v).alias(v) for v in values]), F.struct(F.lit("std").alias(label), *[F.stddev_samp(v).alias(v) for v in values])).alias("_r"))
    rows = wide.select(*key, F.col(label).cast("string").alias(label), *values)
    return rows.unionByName(both.select(*key, F.explode("_r").alias("_r")).select(*key, "_r.*"))


def particle_statistics(particles: DataFrame, key: list[str], diameter: str = "diameter") -> DataFrame:
    """Number, mean, standard deviation (n), extremes and exact percentiles of diameters.

    Percentiles are exact, so an aggregate holds a count for each distinct
    diameter of its group: areas are whole pixels, of which a group of any
    number of particles has some thousand.
    """
    d = F.col(diameter)
    q = F.percentile(d, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = particles.groupBy(*key).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("stdev"), F.max(d).alias("max"), F.min(d).alias("min"), q.alias("_q"))
    return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(("d10", "d25", "median", "d75", "d90"))]).drop("_q")


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): equal bins over the range of a column, the last one closed; empty bins are listed."""
    ends = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("_all")).where("_all > 0")
    width = (F.col("b") - F.col("a")) / bins
    placed = rows.where(F.col(value).isNotNull()).join(F.broadcast(ends))
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("a")) / width))).cast("int")
    counts = placed.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_ = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def drop_particles(particles: DataFrame, ids: list[int] = (), frames: list[str] = ()) -> DataFrame:
    """Particles without those listed by id or frame."""
    gone = F.lit(False)
    if ids:
        gone = gone | F.coalesce(F.col("particle_id").isin(*ids), F.lit(False))
    if frames:
        gone = gone | F.coalesce(F.col("frame_id").isin(*frames), F.lit(False))
    return particles.where(~gone)


def missing_particles(particles: DataFrame, ids: list[int]) -> DataFrame:
    """Listed ids that no particle has."""
    asked = particles.sparkSession.createDataFrame([(i,) for i in ids], "particle_id long")
    return asked.join(particles.select("particle_id"), "particle_id", "left_anti")


def area_in_range(area_px: Column, pixel_um: float, least_um2: float, most_um2: float) -> Column:
    """True for a particle whose area in pixels lies within limits in square micrometres, both included."""
    return area_px.between(least_um2 / pixel_um**2, most_um2 / pixel_um**2)


def touches_edge(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: int = 3) -> Column:
    """True for a bounding box (ends excluded) that comes within ``margin`` pixels of the image's border."""
    return (x0 < margin) | (y0 < margin) | (x1 > width - margin) | (y1 > height - margin)


def deviation_shares(rows: DataFrame, measured: str, expected: str, relative: tuple[float, ...] = (5, 10, 15), absolute: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Shares of rows whose relative deviation in percent, and absolute deviation, lie under each limit."""
    rel = (F.col(measured) - F.col(expected)) / F.col(expected) * 100
    ab = F.col(measured) - F.col(expected)
    share = lambda x, t: F.avg((F.abs(x) < t).cast("double"))
    return rows.agg(*[share(rel, t).alias(f"rdev_{t:g}") for t in relative], *[share(ab, t).alias(f"adev_{t:g}") for t in absolute])


def element_frequency(long: DataFrame) -> DataFrame:
    return long.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
