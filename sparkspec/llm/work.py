"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; only where unset, and in local mode alone, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sparkspec-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[2]
        made = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "sparkspec"), "zip", top, "sparkspec")
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)


class Work:
    """Writes DataFrames as Parquet into the shared folder and reads them back.

    A written table cuts lineage, survives lost executors and keeps file
    statistics, so Spark sizes later joins by what is really there. What an
    operator does not drop itself goes when the application ends, since its
    result may still read it.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self._n = 0
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root), spark.sparkContext._jsc.hadoopConfiguration()
        fs = path.getFileSystem(conf)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
        at = self.path(name)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._work_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            if at := getattr(df, "_work_path", None):
                self.delete(at)

    def delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores, so that no column of ``df`` has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands in several rows, null among them."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
