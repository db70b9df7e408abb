"""Acquisition in rounds: a source that admits a quota of spectra from each open sample, and running statistics of phases kept as state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import refs
from ..operators.shared import ship
from ..sources.formats import filesystem

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PHASES = "sample_id string, round int, admitted long, n_results long, ended boolean, cluster_id long, n_points long, fr array<double>, rms double"


def _names(system: fs.FileSystem, at: str) -> list[fs.FileInfo]:
    return [f for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if not f.base_name.startswith(("_", "."))]


def _committed(system: fs.FileSystem, root: str) -> list[dict]:
    """What the rounds that have ended left behind, in order."""
    found = []
    for f in _names(system, f"{root}/rounds"):
        with system.open_input_stream(f.path) as file:
            found.append(json.loads(file.read()))
    return sorted(found, key=lambda r: r["round"])


@dataclass
class RoundPart(InputPartition):
    """One part of the samples in one round."""

    round: int
    part: int
    files: list[str]


class QuotaReader(DataSourceStreamReader):
    """Offsets are numbers of rounds. A round is offered when the one before it is judged, and holds rows of samples that were still open then.

    Both are read from the store, so a batch that runs again after a restart
    reads the same rows.
    """

    def __init__(self, store: str):
        self.store = store

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        system, root = filesystem(self.store)
        ended = _committed(system, root)
        more = not ended or ended[-1]["open"] > 0
        there = system.get_file_info(f"{root}/queue/round={len(ended)}").type == fs.FileType.Directory
        return {"round": len(ended) + (1 if more and there else 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, root = filesystem(self.store)
        out = []
        for r in range(start["round"], end["round"]):
            for part in _names(system, f"{root}/queue/round={r}"):
                out.append(RoundPart(r, int(part.base_name.partition("=")[2]), [f.path for f in _names(system, part.path)]))
        return out

    def read(self, partition: InputPartition) -> Iterator:
        system, root = filesystem(self.store)
        still = None
        if partition.round:
            # an open sample had rows in the round before, and a verdict
            files = [f.path for f in _names(system, f"{root}/verdicts/batch={partition.round - 1}/part={partition.part}")]
            if not files:
                return
            still = ds.dataset(files, filesystem=system, format="parquet").to_table(columns=["sample_id"], filter=~ds.field("done"))["sample_id"].combine_chunks()
        for path in partition.files:
            with system.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches():
                    if still is not None:
                        batch = batch.filter(pc.is_in(batch.column("sample_id"), value_set=still))
                    if batch.num_rows:
                        yield batch


class QuotaSource(DataSource):
    """``spark.readStream.format("sample_quota").option("path", store)``: the queue that ``enqueue`` wrote, a quota of each open sample a round."""

    @classmethod
    def name(cls) -> str:
        return "sample_quota"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QuotaReader(self.options["path"])


def enqueue(points: DataFrame, store: str, *, quota: int = 10, least: int = 50, most: int = 100, parts: int = 8) -> None:
    """Write points (sample_id, spectrum_id, cluster_id, fr) as rounds of min(``quota``, ``least``) spectra a sample, the last one what is left up to ``most``.

    A sample's spectra come in order of spectrum_id; no more than ``most`` of
    them are ever sorted together, however many it has. ``parts`` pieces by a
    hash of the sample are what a round's tasks read. Rows without a sample or
    composition are left out.
    """
    step = min(quota, least)
    order = W.partitionBy("sample_id").orderBy("spectrum_id")
    some = points.where("sample_id is not null and fr is not null and cluster_id is not null").select(F.col("sample_id").cast("string").alias("sample_id"), "spectrum_id", F.col("cluster_id").cast("long").alias("cluster_id"), F.transform("fr", lambda x: x.cast("double")).alias("fr"))
    first = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    last = first.withColumn("last", F.lead("_n").over(order).isNull())
    placed = last.select("sample_id", "spectrum_id", "cluster_id", "fr", "last", F.floor((F.col("_n") - 1) / step).cast("int").alias("turn"), F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int").alias("part"))
    placed.withColumn("round", F.col("turn")).repartition(parts, "part").write.partitionBy("round", "part").parquet(f"{store}/queue")


def _joined(a: tuple, n: int, mean: np.ndarray, m2: float) -> tuple:
    """Statistics (n, mean, squares about the mean) of two sets together."""
    if a is None:
        return n, mean, m2
    total, gap = a[0] + n, mean - np.asarray(a[1])
    return total, np.asarray(a[1]) + gap * n / total, a[2] + m2 + float(gap @ gap) * a[0] * n / total


class RunningPhases(StatefulProcessor):
    """For each sample the number, mean and squares about the mean of every phase's points; a batch adds its own, nothing is read again.

    A sample without new spectra for ``idle_ms`` of processing time is given
    up: its phases are returned a last time as ended, and its state goes.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, round int")
        self.phases = handle.getMapState("phases", "cluster_id long", "n long, mean array<double>, m2 double")

    def _rows(self, key: tuple, turn: int, admitted: int, n: int, ended: bool) -> Iterator[pd.DataFrame]:
        held = sorted((k[0], v) for k, v in self.phases.iterator())
        size = len(held)
        yield pd.DataFrame({
            "sample_id": [key[0]] * size, "round": np.full(size, turn, np.int32), "admitted": np.full(size, admitted, np.int64), "n_results": np.full(size, n, np.int64), "ended": [ended] * size,
            "cluster_id": [c for c, _ in held], "n_points": [v[0] for _, v in held], "fr": [list(v[1]) for _, v in held], "rms": [float(np.sqrt(max(0.0, v[2]) / v[0])) for _, v in held],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, turn = self.total.get() if self.total.exists() else (0, 0)
        new, admitted, ended = {}, 0, False
        for frame in rows:
            admitted += len(frame)
            ended |= bool(frame["last"].any())
            turn = max(turn, int(frame["turn"].max()))
            for cluster, part in frame.groupby("cluster_id"):
                x = np.array(part["fr"].tolist(), float)
                mean = x.mean(axis=0)
                new[cluster] = _joined(new.get(cluster), len(x), mean, float(((x - mean) ** 2).sum()))
        for cluster, (count, mean, m2) in new.items():
            mine = (int(cluster),)
            held = self.phases.getValue(mine) if self.phases.containsKey(mine) else None
            count, mean, m2 = _joined(held, count, mean, m2)
            self.phases.updateValue(mine, (int(count), [float(v) for v in mean], float(m2)))
        self.total.update((n + admitted, turn))
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._rows(key, turn, admitted, n + admitted, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, turn = self.total.get()
        yield from self._rows(key, turn, 0, n, True)
        self.phases.clear()
        self.total.clear()

    def close(self) -> None:
        pass


def running_phases(points: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Phases so far of each sample that a batch of the stream ``points`` (sample_id, spectrum_id, cluster_id, fr, last, turn) touches."""
    ship(points.sparkSession)
    return points.groupBy("sample_id").transformWithStateInPandas(RunningPhases(idle_ms), outputStructType=PHASES, outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None")


def verdicts_of(phases: DataFrame, references: DataFrame | None, *, least: int, most: int) -> DataFrame:
    """One row a sample: how wide its phases are, how well the worst is recognised, and whether it is done.

    Done is a sample whose phases have converged with ``least`` results or
    more, one with ``most``, or one that has no more spectra.
    """
    key = ["sample_id", "round"]
    per = phases.groupBy(*key).agg(F.max("admitted").alias("admitted"), F.max("n_results").alias("n_results"), F.bool_or("ended").alias("ended"), F.count(F.lit(1)).alias("n_clusters"), F.max("rms").alias("max_rms"))
    if references is None:
        judged = per.withColumn("min_conf", F.lit(None).cast("double"))
    else:
        found = refs.match_references(phases, references, ["sample_id", "cluster_id"])
        judged = per.join(refs.assigned_confidence(found, ["cluster_id"], ["sample_id"]), "sample_id", "left")
    fine = F.coalesce(refs.converged(F.col("max_rms"), F.col("min_conf")), F.lit(False))
    return judged.withColumn("converged", fine).withColumn("done", (F.col("converged") & (F.col("n_results") >= least)) | (F.col("n_results") >= most) | F.col("ended"))


class Rounds:
    """Runs the rounds of a store that ``enqueue`` filled until no sample is open; may be stopped and run again.

    State is kept by RocksDB in ``parts`` partitions and checkpointed in the
    store; a round's phases and verdicts replace their own folder, and its
    marker comes last. ``parts`` is that of ``enqueue``.
    """

    def __init__(self, spark: SparkSession, store: str, *, least: int = 50, most: int = 100, references: DataFrame | None = None, parts: int = 8):
        self.spark, self.store, self.least, self.most, self.references, self.parts = spark, store.rstrip("/"), least, most, references, parts
        self.rounds = 0

    def judge(self, batch: DataFrame, batch_id: int) -> None:
        """Each micro-batch is one round: what the state gives is written once, then judged."""
        at = f"{self.store}/phases/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        phases = self.spark.read.schema(PHASES).parquet(at)
        judged = verdicts_of(phases, self.references, least=self.least, most=self.most)
        out = f"{self.store}/verdicts/batch={batch_id}"
        judged.withColumn("part", F.pmod(F.xxhash64("sample_id"), F.lit(self.parts)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(out)
        still = self.spark.read.parquet(out).where("not done").count()
        system, root = filesystem(self.store)
        system.create_dir(f"{root}/rounds", recursive=True)
        with system.open_output_stream(f"{root}/rounds/{batch_id}.json") as file:
            file.write(json.dumps({"round": batch_id, "open": still}).encode())
        self.rounds += 1

    def start(self) -> StreamingQuery:
        ship(self.spark)
        self.spark.dataSource.register(QuotaSource)
        schema = "sample_id string, spectrum_id long, cluster_id long, fr array<double>, last boolean, turn int"
        points = self.spark.readStream.format("sample_quota").option("path", self.store).option("schema", schema).load()
        # state has as many partitions as the queue has parts; a query keeps the settings it starts with
        own = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.shuffle.partitions": str(self.parts)}
        before = {name: self.spark.conf.get(name) for name in own}
        for name, value in own.items():
            self.spark.conf.set(name, value)
        try:
            return running_phases(points).writeStream.outputMode("update").foreachBatch(self.judge).option("checkpointLocation", f"{self.store}/checkpoint").start()
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)

    def run(self, most_rounds: int | None = None, poll_s: float = 0.1) -> None:
        """All rounds, or about ``most_rounds`` of them; what is left stays for the next run."""
        query = self.start()
        try:
            if most_rounds is None:
                query.processAllAvailable()
            while most_rounds is not None and query.isActive and self.rounds < most_rounds and not self.ended():
                query.awaitTermination(poll_s)
        finally:
            query.stop()

    def ended(self) -> bool:
        system, root = filesystem(self.store)
        done = _committed(system, root)
        return bool(done) and (done[-1]["open"] == 0 or system.get_file_info(f"{root}/queue/round={len(done)}").type == fs.FileType.NotFound)

    def verdicts(self) -> DataFrame:
        """All verdicts, one row for each sample and round."""
        return self.spark.read.option("basePath", f"{self.store}/verdicts").parquet(f"{self.store}/verdicts").drop("batch", "part")
