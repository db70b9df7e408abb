"""Writers: spectra, compositions, clusters, standards, calibrations and particles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import AT, BACKGROUND, COLUMNS, COUNTS, ERROR, W

_BACK = {own: name for name, (own, _) in COLUMNS.items()}


def spectra_table(rows: DataFrame, elements: list[str], clusters: DataFrame | None = None, *, arrays: bool = True) -> DataFrame:
    """Columns of ``Data.csv``: percentages with two decimals, fixed order, cluster ids joined by key; columns without a value are left out for clusters and background."""
    key = ["sample_id", "spectrum_id"]
    if clusters is not None:
        rows = rows.drop("cluster_id").join(clusters.select(*key, "cluster_id"), key, "left")
    have = set(rows.columns)
    cols = [F.col(c).alias(_BACK[c]) for c in ("spectrum_id", "frame_id", "particle_id", "x", "y") if c in have]
    percent = lambda c: F.bround(c * 100, 2)
    cols += [percent(F.element_at(m, F.lit(e))).alias(e + end) for m, end in (("at_fr", AT), ("w_fr", W)) if m in have for e in elements]
    cols += [percent(F.col("an_err")).alias(ERROR)] if "an_err" in have else []
    if clusters is not None:
        cols.append(F.col("cluster_id").alias("Cluster_ID"))
    cols += [F.col(c).alias(_BACK[c]) for c in ("r_squared", "redchi_sq", "quant_flag", "comments", "real_time", "live_time") if c in have]
    if arrays:
        text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
        cols += [F.when(F.col(c).isNotNull(), text(c)).alias(n) for c, n in (("counts", COUNTS), ("background", BACKGROUND)) if c in have]
    out = rows.select(*cols)
    maybe = [c for c in ("Cluster_ID", BACKGROUND) if c in out.columns]
    if maybe:
        filled = out.agg(*[F.count(f"`{c}`").alias(c) for c in maybe]).first()
        out = out.drop(*[c for c in maybe if not filled[c]])
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A new directory of CSV files; an existing one is an error, so nothing is overwritten. Runs in versions are ``versions.Versions``."""
    df.write.option("header", True).option("escape", '"').mode("error").csv(path)


def clusters_table(stats: DataFrame, rms: DataFrame, refs: DataFrame | None, mixtures: DataFrame | None, elements: list[str], *, feature: str = "at") -> DataFrame:
    """Columns of ``Clusters.csv`` from long tables: percentages with two decimals, wcss times 10 000, all ranked references and mixtures by rank (as many columns as the longest list needs)."""
    most = lambda df: df.agg(F.max("rank")).first()[0] or 0
    key = [c for c in ("sample_id", "cluster_id") if c in stats.columns]
    pick = lambda c, e: F.bround(F.max(F.when(F.col("element") == e, F.col(c))) * 100, 2)
    wide = stats.groupBy(*key).agg(*[x for e in elements for x in (pick("mean", e).alias(f"{e}_{feature}%"), pick("std", e).alias(f"{e}_std_{feature}%"))])
    out = rms.select(*key, "n_points", F.bround(F.col("rms") * 100, 2).alias(f"RMS_dist_{feature}%"), F.bround(F.col("wcss") * 10000, 2).alias(f"wcss_{feature}%")).join(wide, key)
    ranked = lambda c, i: F.max(F.when(F.col("rank") == i, F.col(c)))
    if refs is not None and most(refs):
        out = out.join(refs.groupBy(*key).agg(*[x for i in range(1, most(refs) + 1) for x in (ranked("formula", i).alias(f"Ref{i}"), ranked("conf", i).alias(f"Conf{i}"))]), key, "left")
    if mixtures is not None and most(mixtures):
        named = {"name": "Mix", "conf": "ConfMix", "mol_ratio": "Mol_Ratio", "molar_fr_mean": "Icomp_Mol_Fr_Mean", "molar_fr_std": "Stddev"}
        out = out.join(mixtures.groupBy(*key).agg(*[ranked(c, i).alias(f"{n}{i}") for i in range(1, most(mixtures) + 1) for c, n in named.items()]), key, "left")
    return out


def clustering_info(n_collected: int, n_used: int, n_clusters: int, wcss: float, silhouette: float | None, settings: dict, timestamp: str) -> str:
    """JSON of a run; an undefined silhouette is null."""
    return json.dumps({"datetime": timestamp, "n_spectra_collected": n_collected, "n_spectra_used": n_used, "n_clusters": n_clusters, "wcss": wcss, "sil_score": silhouette, **settings}, indent=2)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)


def detector_calibration(spark: SparkSession, path: str, mode: str, spot_size: float, offset: float, scale: float, timestamp: str) -> str:
    """A new, later-sorting calibration, ``<timestamp>.json``, with offset and scale at six decimals; returns its path."""
    at = f"{path.rstrip('/')}/{timestamp}.json"
    write_text(spark, json.dumps({mode: {"spot_size": spot_size, "offset": round(offset, 6), "scale": round(scale, 6)}}), at)
    return at


def standards_json(library: DataFrame, means: DataFrame) -> DataFrame:
    """One row of JSON in the library's file form, with the derived ``Mean`` entry of each line last."""
    entry = library.select("mode", "el_line", F.struct(
        F.col("std_id").alias("ID"), F.col("formula").alias("Formula"), F.col("std_type").alias("Std_type"), F.col("measured_at").alias("datetime"), F.col("corrected_pb").alias("Corrected_PB"),
        F.col("measured_pb").alias("Measured_PB"), F.col("stdev_pb").alias("Stdev_PB"), F.col("use_for_mean").alias("Use_for_mean_calc"), F.col("mean_z").alias("Mean_Z")).alias("e"), F.lit(0).alias("o"))
    null = lambda kind: F.lit(None).cast(kind)
    mean = means.select("mode", "el_line", F.struct(
        F.lit("Mean").alias("ID"), null("string").alias("Formula"), null("string").alias("Std_type"), null("string").alias("datetime"), F.col("mean_pb").alias("Corrected_PB"), null("double").alias("Measured_PB"),
        F.col("std_pb").alias("Stdev_PB"), null("boolean").alias("Use_for_mean_calc"), null("map<string,double>").alias("Mean_Z")).alias("e"), F.lit(1).alias("o"))
    name = lambda s: F.concat(s["o"].cast("string"), s["i"])
    order = lambda x, y: F.when(name(x) < name(y), -1).when(name(x) > name(y), 1).otherwise(0)
    lines = entry.unionByName(mean).groupBy("mode", "el_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("e.ID").alias("i"), "e")), order), lambda s: s["e"]).alias("l"))
    modes = lines.groupBy("mode").agg(F.map_from_entries(F.collect_list(F.struct("el_line", "l"))).alias("m"))
    return modes.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("mode", "m")))).alias("value"))


def particle_table(particles: DataFrame) -> DataFrame:
    return particles.select(F.col("particle_id").alias("Particle #"), F.col("frame_id").alias("Frame ID"), F.col("area_um2").alias("Area (μm²)"), F.col("diameter_um").alias("Equivalent Diameter (μm)"))
