"""Exact top-k inner products over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .work import Work

_OUT = "query_id long, vec_id long, score long"


def usable(embedding: Column) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def one_row_each(vectors: DataFrame, *columns: str) -> DataFrame:
    """One row a vec_id: of several, the one with the greatest values counts. A null vec_id takes no part."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), *columns)
    return rows.groupBy("vec_id").agg(F.max(F.struct(*columns)).alias("v")).select("vec_id", "v.*")


class ImpactIndex:
    """Posting lists of integer vectors in descending quantised impact, processed score at a time.

    A value's impact is its magnitude, quantised to one of ``levels`` levels of
    about equally many postings. A segment holds the postings of one level and
    one dimension: the rows and their values. Queries take in the segments
    level by level, all dimensions of a level before the next.

    What a row may still gain after a level is at most the length of its
    values that are not taken in yet times the length of the query in those
    dimensions alone; the second accumulator keeps the query's squares that
    are spent. A query stops when few rows can reach k scores that are known
    exactly; those are rescored from their whole values. ``stops`` counts
    queries by the number of levels they took.

    Sums are whole numbers which the accumulators hold exactly where values
    allow it; else a slack covers rounding, and rescoring uses Python's
    integers where 64 bits would not do.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = 12):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        n, dims = self.vectors.shape
        size = np.abs(self.vectors.astype(float))
        self.top, self.dims = float(size.max(initial=0)), dims
        row, dim = np.nonzero(size)
        values, inverse, count = np.unique(-size[row, dim], return_inverse=True, return_counts=True)
        level = np.unique((np.cumsum(count) - count) * levels // max(1, len(row)), return_inverse=True)[1][inverse]
        self.levels = int(level.max(initial=-1)) + 1
        by = np.argsort(level * dims + dim, kind="stable")
        self.rows, self.values = row[by], self.vectors[row, dim][by].astype(float)
        self.ends = np.searchsorted((level * dims + dim)[by], np.arange(self.levels * dims + 1))
        square = np.bincount(level * n + row, size[row, dim] ** 2, self.levels * n).reshape(self.levels, n)
        self.rest = np.sqrt(np.maximum(0, square[::-1].cumsum(axis=0)[::-1] - square))
        self.length = np.sqrt((size**2).sum(axis=1)).max(initial=0)
        self.stops = np.zeros(self.levels + 1, np.int64)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, batch: int = 128, floors: np.ndarray | None = None):
        """For each query the ids and scores of the k best (ties to the smaller id), its own id left out; with ``floors`` only rows that can reach a query's floor are looked for."""
        floors = np.full(len(own), -np.inf) if floors is None else floors
        for at in range(0, len(own), batch):
            yield from self._batch(own[at : at + batch], queries[at : at + batch], k, floors[at : at + batch])

    def _exact(self, some: np.ndarray, query: np.ndarray) -> np.ndarray:
        wide = self.top * float(np.abs(query.astype(float)).max(initial=0)) * max(1, self.dims) >= 1 << 62
        return self.vectors[some].astype(object) @ query.astype(object) if wide and len(some) else self.vectors[some] @ query

    def _batch(self, own, queries, k, floors):
        n, real = len(self.ids), queries.astype(float)
        most = max(self.top, float(np.abs(real).max(initial=0)))
        kind = np.float32 if most * most * max(1, self.dims) < 1 << 24 else np.float64
        place = np.minimum(np.searchsorted(self.ids, own), n - 1)
        mine = self.ids[place] == own
        length = np.sqrt((real**2).sum(axis=1))
        slack = 2 + (1e-6 if kind is np.float32 else 1e-9) * length * self.length
        members: list = [None] * len(own)
        if n <= k + 1 or not self.levels:
            members = [np.setdiff1d(np.arange(n), place[q : q + 1] if mine[q] else []) for q in range(len(own))]
        open_ = np.flatnonzero([m is None for m in members])
        # one column a query, so that a posting adds to a run of neighbours
        score, spent = np.zeros((n, len(open_)), kind), np.zeros((n, len(open_)), kind)
        score[place[open_[mine[open_]]], np.flatnonzero(mine[open_])] = -np.inf
        asked, least = real[open_].T.astype(kind), floors[open_].copy()
        for level in range(self.levels):
            if not len(open_):
                break
            for dim in range(self.dims):
                a, b = self.ends[level * self.dims + dim : level * self.dims + dim + 2]
                if a < b:
                    rows = self.rows[a:b]
                    score[rows] += self.values[a:b, None].astype(kind) * asked[dim]
                    spent[rows] += asked[dim] ** 2
            last = level + 1 == self.levels
            if not last and 4 * (level + 1) < 2 * self.levels:
                continue
            best = np.argpartition(score, n - k, axis=0)[n - k :]
            known = np.array([min(self._exact(best[:, j], queries[q])) for j, q in enumerate(open_)], float)
            least = np.maximum(least, known)
            left = np.sqrt(np.maximum(0, (length[open_] ** 2).astype(kind) - spent)) * self.rest[level][:, None].astype(kind)
            can = score + left >= (least - slack[open_] - np.abs(least) * 1e-7).astype(kind)
            close = np.full(len(open_), last) | (can.sum(axis=0) <= max(4 * k, n >> 3))
            for j in np.flatnonzero(close):
                members[open_[j]] = np.flatnonzero(can[:, j])
            self.stops[level + 1] += close.sum()
            stay = ~close
            if not stay.all():
                open_, least, asked = open_[stay], least[stay], asked[:, stay]
                score, spent = np.ascontiguousarray(score[:, stay]), np.ascontiguousarray(spent[:, stay])
        for q, some in enumerate(members):
            exact = self._exact(some, queries[q])
            order = np.array(sorted(range(len(some)), key=lambda i: (-exact[i], self.ids[some[i]]))[:k], np.int64) if exact.dtype == object else np.lexsort((self.ids[some], -exact))[:k]
            yield self.ids[some[order]], exact[order]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _search(k: int):
    """Streams sorted rows (dim, b, side, vec_id, floor, v): the vectors of a block become an index, and its queries run over it as they come; rows under a query's floor are left out."""

    def run(batches):
        key, held, index = None, [], None
        limits = np.iinfo(np.int64)
        for batch in batches:
            dims, blocks, sides, ids, floors = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            turn = np.flatnonzero(np.r_[True, (np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(sides) != 0)]) if len(ids) else np.zeros(0, np.int64)
            for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(ids)]):
                part = _matrix(pa.chunked_array([batch.column(5).slice(a, b - a)]), b - a)
                if (dims[a], blocks[a]) != key:
                    key, held, index = (dims[a], blocks[a]), [], None
                if sides[a] == 0:
                    held.append((ids[a:b], part))
                    continue
                if index is None and held:
                    index, held = ImpactIndex(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])), []
                if index is None:
                    continue
                floor = floors[a:b]
                found = list(index.search(ids[a:b], part, k, floors=np.where(floor > limits.min, floor.astype(float), -np.inf)))
                exact = [np.array([min(limits.max, max(limits.min, int(x))) for x in s], np.int64) if s.dtype == object else s for _, s in found]
                found = [(i[s >= f], s[s >= f]) for (i, _), s, f in zip(found, exact, floor.tolist())]
                exact = [s for _, s in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[a:b], [len(s) for s in exact])), pa.array(np.concatenate([i for i, _ in found]).astype(np.int64)), pa.array(np.concatenate(exact).astype(np.int64)),
                ], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 20, scale: int = 64, every: int = 20, block: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by ``every`` its k best other vectors.

    Components become floor(scale * x), x as double; the score is the integer
    inner product, ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components take no part; vectors of another length
    than the query are no candidates of it. Rows that repeat a vec_id count
    once (the greatest vector). Fewer than k candidates give fewer rows; an
    empty table gives an empty result. A score beyond a long ends at its
    limits. Other columns are not read.

    The index is built in blocks of at most about ``block`` vectors, smaller
    ones where that would leave cores idle. A query first searches one block;
    the k-th score it finds there is a proven floor, with which it streams
    through the others: they stop as soon as no row can reach it, and most
    return nothing. A task holds one block's index and one batch of queries.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    whole = one_row_each(vectors.where(usable(F.col("embedding"))), "embedding")
    ints = work.table(whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")), "vectors")
    n = ints.count()
    n_blocks = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 2048)))
    none = F.lit(-(1 << 63))
    own = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_blocks)).cast("int")
    rows = ints.select(F.size("v").alias("dim"), own.alias("b"), F.lit(0).alias("side"), "vec_id", none.alias("floor"), "v")
    queries = ints.where(F.col("vec_id") % every == 0).select(F.size("v").alias("dim"), own.alias("b"), F.lit(1).alias("side"), "vec_id", none.alias("floor"), "v")
    order = ["dim", "b", "side", "vec_id"]

    def searched(asked: DataFrame) -> DataFrame:
        dealt = rows.unionAll(asked).repartition(n_blocks, "dim", "b").sortWithinPartitions(*order)
        return dealt.mapInArrow(_search(k), _OUT)

    first = work.table(searched(queries), "first")
    found = first
    if n_blocks > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_floor"))
        known = queries.join(floors, queries.vec_id == floors.query_id, "left").withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where("_o <> b")
        found = first.unionAll(searched(known.select("dim", F.col("_o").alias("b"), "side", "vec_id", F.coalesce("_floor", none).alias("floor"), "v")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
