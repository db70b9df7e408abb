"""Readers: spectra tables, EMSA files, standards, calibrations, clusters and images."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, loads

#: CSV column names of the spectra table and the names used here.
COLUMNS = {
    "Spectrum #": ("spectrum_id", "long"), "Frame ID": ("frame_id", "string"), "Particle #": ("particle_id", "long"), "x": ("x", "double"), "y": ("y", "double"),
    "r_squared": ("r_squared", "double"), "redchi_sq": ("redchi_sq", "double"), "Quant_flag": ("quant_flag", "int"), "Comments": ("comments", "string"),
    "Real_time": ("real_time", "double"), "Live_time": ("live_time", "double"), "Cluster_ID": ("cluster_id", "int"),
}
AT, W, ERROR, COUNTS, BACKGROUND = "_at%", "_w%", "An er w%", "Spectrum", "Background"


def _csv(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def read_spectra(spark: SparkSession, path: str | list[str], sample_id: str | None = None) -> DataFrame:
    """Rows of ``Data.csv`` or ``Compositions.csv`` files: known columns, counts and background as arrays, and fractions as maps.

    Element columns are found by their endings. Percentages become fractions.
    A row without any fraction is not quantified: its maps are null. Columns
    that a file lacks are null. The sample is the directory of the file, or
    ``sample_id``.
    """
    raw = _csv(spark, path)
    quoted = lambda c: F.col(f"`{c}`")
    out = [(F.lit(sample_id) if sample_id else F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)).alias("sample_id")]
    for name, (own, kind) in COLUMNS.items():
        value = quoted(name) if name in raw.columns else F.lit(None)
        out.append((value.cast("double").cast(kind) if kind in ("long", "int") else value.cast(kind)).alias(own))

    def fractions(ending: str):
        names = [c for c in raw.columns if c.endswith(ending) and not c.startswith(("An er", "std")) and not c.endswith("_std" + ending)]
        if not names:
            return F.lit(None).cast("map<string,double>")
        pairs = F.array(*[F.struct(F.lit(c[: -len(ending)]).alias("k"), F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")) / 100) for c in names])
        some = F.filter(pairs, lambda p: p["col2"].isNotNull())
        return F.when(F.size(some) > 0, F.map_from_entries(some))

    out += [fractions(AT).alias("at_fr"), fractions(W).alias("w_fr")]
    out.append(((quoted(ERROR).cast("double") / 100) if ERROR in raw.columns else F.lit(None).cast("double")).alias("an_err"))
    for name, own in ((COUNTS, "counts"), (BACKGROUND, "background")):
        out.append((F.from_json(quoted(name), "array<double>") if name in raw.columns else F.lit(None).cast("array<double>")).alias(own))
    return raw.select(*out)


def long_fractions(rows: DataFrame, key: list[str], fractions: str = "at_fr", out: str = "value") -> DataFrame:
    """(key, element, value): one row for each fraction."""
    return rows.select(*key, F.explode(fractions).alias("element", out))


def read_config(spark: SparkSession, path: str) -> Config:
    """The settings of a run."""
    return loads(spark.read.text(path, wholetext=True).first()[0])


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, energy, counts) of EMSA files: ``#KEY : value`` headers, then one number a line after ``#SPECTRUM``.

    Lines that are no numbers are skipped; counts are cut or filled with zeros
    to NPOINTS; energies are OFFSET + i * XPERCHAN in the file's unit.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("l"))
    head = F.filter("l", lambda x: x.startswith("#") & x.contains(":"))
    pairs = F.transform(head, lambda x: F.struct(F.upper(F.trim(F.regexp_extract(x, r"^#([^:]*?)\s*:", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    once = F.filter(pairs, lambda p: p["k"] != "")
    rows = lines.select("path", "l", F.aggregate(once, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"]))).alias("meta"))
    begin = F.array_position(F.transform("l", lambda x: F.upper(F.trim(x)).startswith("#SPECTRUM")), F.lit(True))
    body = F.filter(F.transform(F.slice("l", (begin + 1).cast("int"), F.size("l")), lambda x: F.trim(F.regexp_replace(x, ",", "")).try_cast("double")), lambda x: x.isNotNull())
    rows = rows.select("path", "meta", body.alias("b")).withColumn("n", F.coalesce(F.element_at("meta", F.lit("NPOINTS")).try_cast("double").cast("int"), F.size("b")))
    number = lambda k, d: F.coalesce(F.element_at("meta", F.lit(k)).try_cast("double"), F.lit(d))
    counts = F.slice(F.concat("b", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.col("n") - F.size("b")))), F.lit(1), F.col("n"))
    axis = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: number("OFFSET", 0.0) + i * number("XPERCHAN", 1.0))).otherwise(F.array().cast("array<double>"))
    return rows.select("path", "meta", axis.alias("energy"), counts.alias("counts"))


def sample_dir(spark: SparkSession, root: str, sample_id: str) -> str:
    """The directory of a sample: directly below the root, or the first one nested deeper; an error if it is at both or at neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    inside = files.select(F.regexp_extract("path", rf"^(.*/{re.escape(sample_id)})/", 1).alias("dir")).where("dir <> ''").distinct()
    parent = F.trim(F.regexp_replace(F.regexp_replace("dir", r"/[^/]*/*$", ""), "^[a-z0-9]+:", ""), F.lit("/"))
    found = inside.agg(F.count(F.lit(1)).alias("n"), F.min("dir").alias("first"), F.max(parent == root.split(":")[-1].strip("/")).alias("top")).first()
    if not found.n:
        raise FileNotFoundError(f"no directory {sample_id!r} below {root}")
    if found.top and found.n > 1:
        raise ValueError(f"{sample_id!r} is at the root and below it, in {found.n} places, such as {found.first}")
    return found.first


_ENTRY = "struct<ID:string,Formula:string,Std_type:string,datetime:string,Corrected_PB:double,Measured_PB:double,Stdev_PB:double,`Rel_stdev_PB (%)`:double,Use_for_mean_calc:boolean,Mean_Z:map<string,double>>"


def read_standards(spark: SparkSession, path: str, beam_kev: float) -> DataFrame:
    """Rows (beam_kev, mode, el_line, std_id, ...) of a standards library file; its stored ``Mean`` entries are left out."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,array<{_ENTRY}>>>").alias("m"))
    modes = text.select(F.explode("m").alias("mode", "lines")).select("mode", F.explode("lines").alias("el_line", "entries"))
    rows = modes.select("mode", "el_line", F.explode("entries").alias("e"))
    return rows.where("e.ID <> 'Mean'").select(
        F.lit(int(beam_kev)).alias("beam_kev"), "mode", "el_line", F.col("e.ID").alias("std_id"), F.col("e.Formula").alias("formula"), F.col("e.Std_type").alias("std_type"), F.col("e.datetime").alias("measured_at"),
        F.col("e.Corrected_PB").alias("corrected_pb"), F.col("e.Measured_PB").alias("measured_pb"), F.col("e.Stdev_PB").alias("stdev_pb"), F.coalesce("e.Use_for_mean_calc", F.lit(False)).alias("use_for_mean"), F.col("e.Mean_Z").alias("mean_z"))


def read_detector_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, mode, spot_size, offset, scale) of all channel calibrations ``*.json`` (files, or directories of one) that a path names."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+\.json)(?:/[^/]+)?$", 1).alias("file_name"), F.from_json("value", "map<string,struct<spot_size:double,offset:double,scale:double>>").alias("m"))
    return text.select("file_name", F.explode("m").alias("mode", "c")).select("file_name", "mode", "c.*")


def check_mode(mode: str, allowed: list[str]) -> str:
    if mode not in allowed:
        raise ValueError(f"measurement mode {mode!r} is not one of {allowed}")
    return mode


def read_clusters(spark: SparkSession, path: str, ignore: tuple[int, ...] = ()) -> DataFrame:
    """The one cluster of an analysis folder that is left without the ignored ids; an error if there are more."""
    raw = _csv(spark, path)
    kept = raw.withColumnRenamed(raw.columns[0], "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int")).where(~F.col("cluster_id").isin(*ignore) if ignore else F.lit(True))
    if kept.count() > 1:
        raise ValueError(f"more than one cluster is left in {path}")
    return kept


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    """(particle_id, frame_id, area_um2, diameter_um) of particle size files."""
    raw = _csv(spark, path)
    named = {"Particle #": ("particle_id", "long"), "Frame ID": ("frame_id", "string"), "Area (μm²)": ("area_um2", "double"), "Equivalent Diameter (μm)": ("diameter_um", "double")}
    return raw.select(*[F.col(f"`{c}`").cast(k).alias(n) for c, (n, k) in named.items()])


def read_images(spark: SparkSession, path: str, width: int, height: int, pixel_um: float) -> DataFrame:
    """Raw 8-bit grey images as rows for ``operators.images``."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("image_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(float(pixel_um)).alias("pixel_size_um"), F.col("content").alias("pixels"))
