"""Tables of a run in versions: a run is readable once its manifest is there, which is written last."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.analyze import Analysis
from .writers import clusters_table

MANIFEST, CLAIM = "manifest.json", "claim"


class Versions:
    """Runs below ``path`` in folders ``v=<n>``, each with any number of tables.

    A writer claims the next free number by a file that only one can create,
    writes its tables, and writes the manifest last: rows and columns of each
    table, and what the caller adds. Readers see the newest version that has a
    manifest; nothing is ever overwritten, so a run that is killed leaves the
    one before it as it was. All work goes through the cluster's file system.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.root}/{below}" if below else self.root)

    def _write(self, below: str, text: str, overwrite: bool = False) -> None:
        out = self._fs.create(self._path(below), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def committed(self) -> list[int]:
        """Numbers of the runs that can be read, ascending."""
        return [n for n in self._numbers() if self._fs.exists(self._path(f"v={n}/{MANIFEST}"))]

    def manifest(self, version: int | None = None) -> dict:
        version = self._known(version)
        rows = self.spark.read.text(f"{self.root}/v={version}/{MANIFEST}", wholetext=True).collect()  # one row
        return json.loads(rows[0].value)

    def _known(self, version: int | None, table: str | None = None) -> int:
        have = self.committed()
        if version is not None:
            if version not in have:
                raise FileNotFoundError(f"{self.root} has no committed version {version}")
            return version
        for n in reversed(have):
            if table is None or self._fs.exists(self._path(f"v={n}/{table}")):
                return n
        raise FileNotFoundError(f"{self.root} has no committed version" + (f" with {table}" if table else ""))

    def claim(self) -> int:
        """A new version number of one's own."""
        n = (self._numbers() or [0])[-1] + 1
        while True:
            try:
                self._write(f"v={n}/{CLAIM}", str(time.time()))
                return n
            except Exception as e:
                if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                    raise
                n += 1

    def write(self, tables: dict[str, DataFrame], **notes) -> int:
        """Write tables as a new version and commit it; returns its number."""
        n = self.claim()
        about = {}
        for name, df in tables.items():
            at = f"{self.root}/v={n}/{name}"
            df.write.mode("error").parquet(at)
            about[name] = {"rows": self.spark.read.schema(df.schema).parquet(at).count(), "columns": df.columns}
        self._write(f"v={n}/{MANIFEST}", json.dumps({"version": n, "written_at": time.time(), "tables": about, **notes}))
        return n

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version, or of the newest committed one that holds it."""
        return self.spark.read.parquet(f"{self.root}/v={self._known(version, table)}/{table}")

    def history(self, table: str) -> DataFrame:
        """All committed rows of a table with their ``version``."""
        parts = [self.read(table, n).withColumn("version", F.lit(n)) for n in self.committed() if self._fs.exists(self._path(f"v={n}/{table}"))]
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    def sweep(self, older_s: float = 86_400.0) -> list[int]:
        """Remove versions without a manifest whose claim is older than ``older_s`` seconds; returns their numbers."""
        gone = []
        for n in set(self._numbers()) - set(self.committed()):
            claim = self._path(f"v={n}/{CLAIM}")
            if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 >= older_s:
                self._fs.delete(self._path(f"v={n}"), True)
                gone.append(n)
        return sorted(gone)


def write_analysis(store: Versions, done: Analysis, elements: list[str], **notes) -> int:
    """An analysis as a version: ``Data`` with the reason and cluster of each spectrum, ``Clusters``, ``Report``, ``Verdict``, ``Failed``, and ``Compositions``, the clustered rows alone, only where spectra were left out."""
    key = ["sample_id", "spectrum_id"]
    data = done.selected.join(done.labels.select(*key, "cluster_id"), key, "left")
    tables = {"Data": data, "Clusters": clusters_table(done.features, done.clusters, done.references, done.mixtures, elements), "Report": done.report, "Verdict": done.verdict, "Failed": done.failed}
    clusters = tables["Clusters"]
    tables["Clusters"] = clusters.select(*[F.col(f"`{c}`").alias(c.replace("%", "_percent")) for c in clusters.columns])
    left_out = data.where("cluster_id is null").select("sample_id").distinct()
    if not left_out.isEmpty():
        tables["Compositions"] = data.where("cluster_id is not null").join(left_out, "sample_id", "left_semi")
    return store.write(tables, **notes)
