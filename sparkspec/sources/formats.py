"""Spectra files as Spark formats: ``emsa`` and ``spectra_csv``, whose filters by sample and spectrum choose the files that are opened."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.shared import ship
from .readers import AT, BACKGROUND, COLUMNS, COUNTS, ERROR, W

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?$|[+-]?(Infinity|Inf|NaN)$", re.I)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if path.startswith("file:") or ":" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def number(text: str | None) -> float | None:
    text = (text or "").strip()
    return float(text.rstrip("dDfF") if text[-1:] in "dDfF" and text.lower()[-3:] != "inf" else text) if _NUMBER.match(text) else None


@dataclass
class Files(InputPartition):
    """Some files with the sample and spectrum that each is named after."""

    paths: list[tuple[str, str, str]]


class KeyedFiles(DataSourceReader):
    """Files below a path: the directory names the sample (``sample_id=`` before it goes), the file its spectrum.

    Filters that compare a key with values are applied to names, so no other
    file is opened; the rest stays with Spark. Files go to partitions by size,
    ``bytes`` each. Only the columns of the schema are made.
    """

    keys: tuple[str, ...] = ("sample_id",)
    suffix = ""

    def __init__(self, schema, options):
        self.columns, self.path = [f.name for f in schema.fields], options["path"]
        self.bytes = int(options.get("bytes", 32 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name in self.keys and all(isinstance(v, str) for v in values):
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        parts, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(self.suffix) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            sample, spectrum = f.path.rsplit("/", 2)[-2].removeprefix("sample_id="), f.base_name[: len(f.base_name) - len(self.suffix)]
            if all(v in self.wanted.get(k, {v}) for k, v in (("sample_id", sample), ("spectrum_id", spectrum)) if k in self.keys):
                if not parts or held + (f.size or 0) > self.bytes:
                    parts.append([])
                    held = 0
                parts[-1].append((f.path, sample, spectrum))
                held += f.size or 0
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        for path, sample, spectrum in partition.paths:
            with system.open_input_stream(path) as file:
                text = file.read().decode("utf-8", "replace")
            for row in self.rows(text, path, sample, spectrum):
                yield tuple(row.get(c) for c in self.columns)

    def rows(self, text: str, path: str, sample: str, spectrum: str) -> Iterator[dict]:
        raise NotImplementedError


class EmsaReader(KeyedFiles):
    keys, suffix = ("sample_id", "spectrum_id"), ".msa"

    def rows(self, text, path, sample, spectrum) -> Iterator[dict]:
        """As ``readers.read_msa``; values are read only if the schema has them."""
        lines = re.split(r"\r?\n", text)
        meta = {}
        for line in lines:
            if line.startswith("#") and ":" in line:
                key, _, value = line[1:].partition(":")
                if key.strip():
                    meta[key.strip().upper()] = value.strip()
        row = {"path": path, "sample_id": sample, "spectrum_id": spectrum, "meta": meta}
        if {"energy", "counts"} & set(self.columns):
            begin = next((i + 1 for i, line in enumerate(lines) if line.strip().upper().startswith("#SPECTRUM")), 0)
            values = [v for v in (number(line.replace(",", "")) for line in lines[begin:]) if v is not None]
            given = number(meta.get("NPOINTS"))
            n = len(values) if given is None else int(given)
            offset, step = number(meta.get("OFFSET")), number(meta.get("XPERCHAN"))
            row["counts"] = (values + [0.0] * max(0, n - len(values)))[:n]
            row["energy"] = [(offset or 0.0) + i * (1.0 if step is None else step) for i in range(n)]
        yield row


class SpectraReader(KeyedFiles):
    suffix = ".csv"

    def rows(self, text, path, sample, spectrum) -> Iterator[dict]:
        """As ``readers.read_spectra``, a file at a time, so files may differ in their columns."""
        whole = lambda v: None if v is None else int(v)
        kinds = {"long": lambda t: whole(number(t)), "int": lambda t: whole(number(t)), "double": number, "string": lambda t: t or None}
        for raw in csv.DictReader(io.StringIO(text)):
            row = {"sample_id": sample} | {own: kinds[kind](raw.get(name)) for name, (own, kind) in COLUMNS.items() if own in self.columns}
            for own, ending in (("at_fr", AT), ("w_fr", W)):
                if own in self.columns:
                    values = {c[: -len(ending)]: number(v) for c, v in raw.items() if c and c.endswith(ending) and not c.startswith(("An er", "std")) and not c.endswith("_std" + ending)}
                    row[own] = {k: v / 100 for k, v in values.items() if v is not None and v == v} or None
            if "an_err" in self.columns:
                error = number(raw.get(ERROR))
                row["an_err"] = None if error is None else error / 100
            for own, name in (("counts", COUNTS), ("background", BACKGROUND)):
                if own in self.columns:
                    row[own] = [float(x) for x in json.loads(raw[name])] if raw.get(name) else None
            yield row


class Emsa(DataSource):
    """``spark.read.format("emsa").load(path)``; a schema of fewer columns reads those alone."""

    @classmethod
    def name(cls) -> str:
        return "emsa"

    def schema(self) -> str:
        return "path string, sample_id string, spectrum_id string, meta map<string,string>, energy array<double>, counts array<double>"

    def reader(self, schema) -> DataSourceReader:
        return EmsaReader(schema, self.options)


class SpectraCsv(DataSource):
    """``spark.read.format("spectra_csv").load(path)``: spectra tables below a path, a directory for each sample."""

    @classmethod
    def name(cls) -> str:
        return "spectra_csv"

    def schema(self) -> str:
        known = ", ".join(f"{own} {kind}" for own, kind in COLUMNS.values())
        return f"sample_id string, {known}, at_fr map<string,double>, w_fr map<string,double>, an_err double, counts array<double>, background array<double>"

    def reader(self, schema) -> DataSourceReader:
        return SpectraReader(schema, self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session and let filters reach them."""
    ship(spark)
    for source in (Emsa, SpectraCsv):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def load(spark: SparkSession, kind: str, path: str, schema: str | None = None) -> DataFrame:
    reader = register(spark).read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)
