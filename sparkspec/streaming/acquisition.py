"""The acquisition loop as a stream: files of spectra arrive, each batch is appended once, samples are judged again, and the stream stops when all have converged."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Clustering
from ..operators.shared import cut
from ..plans.analyze import analyze
from ..sources.formats import filesystem


class Acquisition:
    """Runs ``prepare`` (spectra to results) on each micro-batch and keeps results in ``store``.

    Batches are written to ``store/results/part=<p>/batch=<id>``, where p is a
    hash of the sample in ``parts`` parts, so a batch that is run again after a
    restart replaces its own files and keys never double. Only samples of the
    batch are analysed again, and only their parts are read. A sample is done when its clusters have
    converged and it has ``least`` results, or at ``most``. ``stop_when`` is
    the number of samples; when so many are done the query is asked to stop.
    """

    def __init__(self, spark: SparkSession, store: str, elements: list[str], settings: Clustering, *, prepare: Callable[[DataFrame], DataFrame] | None = None, least: int = 50, most: int = 100, stop_when: int | None = None, parts: int = 64):
        self.spark, self.store, self.elements, self.settings = spark, store.rstrip("/"), elements, settings
        self.prepare, self.least, self.most, self.stop_when = prepare or (lambda df: df), least, most, stop_when
        self.stopped, self.parts = False, parts

    def results(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.store}/results").parquet(f"{self.store}/results").drop("batch", "part")

    def _judged(self, before: int | None = None) -> list[int]:
        """Batches (before one) whose verdicts are whole, ascending."""
        system, root = filesystem(self.store)
        dirs = system.get_file_info(fs.FileSelector(f"{root}/verdicts", allow_not_found=True))
        found = sorted(int(d.base_name.partition("=")[2]) for d in dirs if d.base_name.startswith("batch=") and system.get_file_info(f"{d.path}/_SUCCESS").type == fs.FileType.File)
        return [n for n in found if before is None or n < before]

    def verdicts(self) -> DataFrame:
        """The last verdict of each sample: the newest batch's file holds those of all samples."""
        return self.spark.read.parquet(f"{self.store}/verdicts/batch={self._judged()[-1]}")

    def _keep_verdicts(self, judged: DataFrame, batch_id: int) -> None:
        """Write the verdicts of a batch with the last ones of all other samples, so that no reader goes through all batches; of older files the one before stays for a batch that runs again."""
        older = self._judged(before=batch_id)
        if older:
            last = self.spark.read.parquet(f"{self.store}/verdicts/batch={older[-1]}")
            judged = judged.unionByName(last.join(judged.select("sample_id"), "sample_id", "left_anti"), allowMissingColumns=True)
        judged.write.mode("overwrite").parquet(f"{self.store}/verdicts/batch={batch_id}")
        system, root = filesystem(self.store)
        for n in older[:-1]:
            system.delete_dir(f"{root}/verdicts/batch={n}")

    def batch(self, df: DataFrame, batch_id: int) -> None:
        own = self.prepare(df).withColumns({"part": F.pmod(F.xxhash64("sample_id"), F.lit(self.parts)).cast("int"), "batch": F.lit(batch_id)})
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{self.store}/results")
        stored = self.spark.read.option("basePath", f"{self.store}/results").parquet(f"{self.store}/results")
        touched = stored.where(F.col("batch") == batch_id).select("part", "sample_id").distinct()
        parts = [r.part for r in touched.select("part").distinct().collect()]  # at most ``parts``
        mine = stored.where(F.col("part").isin(parts)).join(touched, ["part", "sample_id"], "left_semi").drop("part", "batch")
        verdict = analyze(mine, self.elements, self.settings).verdict
        counts = mine.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_results"))
        judged = counts.join(verdict, "sample_id", "left").withColumn("done", (F.coalesce("converged", F.lit(False)) & (F.col("n_results") >= self.least)) | (F.col("n_results") >= self.most))
        self._keep_verdicts(cut(judged), batch_id)
        if self.stop_when and self.verdicts().where("done").count() >= self.stop_when:
            self.stopped = True

    def start(self, spectra: DataFrame, *, available_now: bool = True) -> StreamingQuery:
        writer = spectra.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.store}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def run(self, spectra: DataFrame, *, available_now: bool = True, poll_s: float = 0.5) -> None:
        """Start, and stop early once enough samples are done; what is in the source but unread stays for the next run."""
        query = self.start(spectra, available_now=available_now)
        while query.isActive:
            query.awaitTermination(poll_s)
            if self.stopped and query.isActive:
                query.stop()
        if query.exception() is not None and not self.stopped:
            raise query.exception()


def spectra_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 10) -> DataFrame:
    """Parquet files of spectra as they arrive, a few in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def particles_until(particles: DataFrame, target: int) -> DataFrame:
    """Particles in order of frame and number until there are ``target``: the running count is kept per frame, so no task orders all particles."""
    frames = particles.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    before = frames.withColumn("before", F.sum("n").over(W.orderBy("frame_id").rowsBetween(W.unboundedPreceding, -1)))  # one row a frame
    rank = F.row_number().over(W.partitionBy("frame_id").orderBy("particle_id"))
    return particles.withColumn("_r", rank).join(before.select("frame_id", F.coalesce("before", F.lit(0)).alias("_b")), "frame_id").where(F.col("_r") + F.col("_b") <= target).drop("_r", "_b")
