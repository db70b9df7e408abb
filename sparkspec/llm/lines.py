"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from .skew import salted_join
from .work import Work, spare

_STRIP = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.call_function("btrim", line, F.lit(_STRIP))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _text_mark(text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, pos, h1, h2): the lines whose keys have at least ``min_chars`` code points, by their place in the text."""
    keyed = F.transform(F.transform(_split(F.col("text")), line_key), lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), _digest(k).alias("k"))))
    # the mark is made before lines become rows, so no row carries the text
    marked = docs.select("doc_id", _text_mark(F.col("text")).alias("mark"), F.filter(keyed, lambda x: x.isNotNull()).alias("keys"))
    return marked.select("doc_id", "mark", F.explode("keys").alias("x")).select("doc_id", "mark", "x.pos", "x.k.h1", "x.k.h2")


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, max_doc), bucketed by key, on levels.

    ``add`` merge-anti-joins a batch with the runs: keys that no run holds
    become the batch's own run, keys already held become a run of increments.
    More than ``fanout`` runs on a level are compacted into one run on the
    next. Runs share buckets and order, so an anti join shuffles no run.
    The tables lie in the shared folder until ``close``.
    """

    def __init__(self, work: Work, buckets: int, fanout: int = 2):
        self.work, self.spark, self.buckets, self.fanout = work, work.spark, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.at: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.at[name] = self.work.path("run")
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", self.at[name]).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("n2"), F.col("max_doc").alias("m2"))
            out = out.hint("merge").join(more, ["h1", "h2"], "full").select(
                "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m2").alias("max_doc")
            )
        return out

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (doc_id, h1, h2); no document may be in two batches."""
        batch = keys.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        own = self._write(batch.repartition(self.buckets, "h1", "h2"))
        held = [name for level in self.levels for name in level]
        if held:
            new = self.spark.table(own)
            for name in held:
                new = new.hint("merge").join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
            fresh = self._write(new)
            again = self._write(self.spark.table(own).hint("merge").join(self.spark.table(fresh).select("h1", "h2"), ["h1", "h2"], "left_anti"))
            self._drop(own)
            self.levels[0] += [fresh, again]
        else:
            self.levels[0].append(own)
        for level, runs in enumerate(self.levels):
            if len(runs) <= self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(runs)))
            self.levels[level] = []
            for name in runs:
                self._drop(name)

    def all(self) -> DataFrame:
        """Every key once, over all levels."""
        return self._merged([name for level in self.levels for name in level])

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.work.delete(self.at.pop(name))

    def close(self) -> None:
        for name in list(self.at):
            self._drop(name)


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines removed from ``text``, and what was done.

    A line's key is the line stripped and lower-cased (``line_key``). A key of
    at least ``min_chars`` code points that at least ``min_docs`` documents
    hold loses all its lines except in the largest doc_id that holds it.

    Adds n_lines (before dropping), n_dropped and text_kept. A null or empty
    text has one empty line. Rows with the same doc_id are one document when
    documents are counted; each is cleaned by itself. A null doc_id counts as
    no document, and its lines go wherever the key goes. An empty table gives
    an empty result. The added names replace columns of the same name.

    Documents are dealt into ``n_batches`` by a hash of doc_id; each batch is
    merge-anti-joined with the runs of those before it (``LineRuns``).
    """
    spark = docs.sparkSession
    work = Work(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = work.table(
        document_keys(docs.select("doc_id", "text"), min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int")),
        "keys", partition_by="batch",
    )
    runs = LineRuns(work, buckets)
    try:
        for i in range(n_batches):
            runs.add(keys.where(F.col("batch") == i).select("doc_id", "h1", "h2"))
        often = work.table(runs.all().where(F.col("n_docs") >= min_docs), "often")
    finally:
        runs.close()
    # n_docs counts the documents of a key: enough to tell which keys are hot
    held = salted_join(keys.select("doc_id", "mark", "pos", "h1", "h2"), often.drop("n_docs"), ["h1", "h2"], ["doc_id"], counts=often.withColumnRenamed("n_docs", "n")).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text_kept")]
    given = docs.select(*rest)
    own, mark, dropped, left = spare(given, "_id"), spare(given, "_mark"), spare(given, "_lost"), spare(given, "_kept")
    # places, not keys: what is left of a text is found in time linear in its lines
    lost = work.table(held.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias(dropped)).withColumnsRenamed({"doc_id": own, "mark": mark}), "lost")
    work.drop(keys, often)
    # a merge join at every size: the text is dealt once, whatever the number of lost lines
    joined = given.join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)) & (_text_mark(F.col("text")) == F.col(mark)), "left")
    lines = _split(F.col("text"))
    # the outer array holds the lines once; without it each place would split the text anew
    left_over = F.transform(F.array(lines), lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(dropped)), lambda i: F.get(all_, i)))
    kept = F.when(F.col(dropped).isNull(), lines).otherwise(F.get(left_over, F.lit(0)))
    done = joined.withColumns({"n_lines": F.size(lines).cast("long"), left: kept})
    return done.select(*rest, "n_lines", (F.col("n_lines") - F.size(left)).cast("long").alias("n_dropped"), F.concat_ws("\n", left).alias("text_kept"))
