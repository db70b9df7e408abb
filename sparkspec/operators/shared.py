"""What several operators need of the session: cutting lineage, and small tables of a checked size."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp()) / "sparkspec"), "zip", top, "sparkspec"))
        _SHIPPED.add(app)


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sparkspec-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which goes when the application ends; where that is unset, under one of our own in local mode, and an error elsewhere."""
    context = spark.sparkContext
    at = f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return at


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of ``spark.checkpoint.dir``; where that is unset, in a folder of its own in local mode, and an error elsewhere."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows dealt out by key over a fixed number of tasks: groups that are small in bytes but long to compute would else be merged into few tasks."""
    session = rows.sparkSession
    n = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *key)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df`` to be broadcast, for joins without an equality; more than ``most`` rows are an error."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a table of at most {most} rows is needed here")
    return F.broadcast(df)
