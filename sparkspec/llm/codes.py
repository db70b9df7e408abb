"""Vectors as short codes: integer codebooks for each part, searched by partial distances."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .embed import _runs, _vectors
from .skew import salted_join
from .topk import usable
from .work import Work

PARTS = 4

_SUMS = "dim int, part int, entry int, n long, sums array<long>"


def nearest(rows: np.ndarray, book: np.ndarray, block: int = 512, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the nearest entry of ``book`` (squared distance, ties to the lower index), and that distance.

    Dimensions go in descending variance of the codebook, ``step`` at a time.
    After each step the entry that leads a row is measured completely; entries
    whose sum so far is strictly greater than the least complete distance of
    the row leave the mask, so an entry that ties stays.
    """
    order = np.argsort(-book.var(axis=0), kind="stable")
    rows, book = np.ascontiguousarray(rows[:, order]), np.ascontiguousarray(book[:, order])
    width = rows.shape[1]
    index, least = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for first in range(0, len(rows) if width else 0, block):
        part = rows[first : first + block]
        each = np.arange(len(part))
        sums = np.zeros((len(part), len(book)), np.int64)
        for d in range(min(step, width)):
            gap = part[:, d, None] - book[None, :, d]
            sums += gap * gap
        lead = sums.argmin(axis=1)
        best = ((part - book[lead]) ** 2).sum(axis=1)
        row, entry = np.nonzero(sums <= best[:, None])
        total = sums[row, entry]
        for done in range(step, width, step):
            gap = part[row, done : done + step] - book[entry, done : done + step]
            total = total + (gap * gap).sum(axis=1)
            start = np.searchsorted(row, each)
            ahead = np.minimum.reduceat(total, start)
            leads = np.flatnonzero(total == ahead[row])
            leads = leads[np.searchsorted(row[leads], each)]
            best = np.minimum(best, ((part - book[entry[leads]]) ** 2).sum(axis=1))
            stays = total <= best[row]
            row, entry, total = row[stays], entry[stays], total[stays]
        start = np.searchsorted(row, each)
        best = np.minimum.reduceat(total, start)
        first_of = np.flatnonzero(total == best[row])
        first_of = first_of[np.searchsorted(row[first_of], each)]
        index[first : first + block], least[first : first + block] = entry[first_of], best
    return index, least


def _parts(column, at: np.ndarray, dim: int) -> list[np.ndarray]:
    """The rows ``at`` cut into equal parts; zeros fill up the last one."""
    width = -(-dim // PARTS)
    rows = np.zeros((len(at), width * PARTS), np.int64)
    if dim:
        rows[:, :dim] = _vectors(column, at)
    return [rows[:, p * width : (p + 1) * width] for p in range(PARTS)]


def _assigned_sums(shared):
    """For each task and entry, the number of parts assigned to it and their sum."""

    def run(batches):
        books, total = shared.value, {}
        for batch in batches:
            for (dim,), at in _runs(batch, "dim"):
                for p, rows in enumerate(_parts(batch.column(1), at, dim)):
                    book = books[dim][p]
                    n, sums = total.setdefault((dim, p), (np.zeros(len(book), np.int64), np.zeros_like(book)))
                    entry, _ = nearest(rows, book)
                    n += np.bincount(entry, minlength=len(book))
                    np.add.at(sums, entry, rows)
        for (dim, p), (n, sums) in total.items():
            some = np.flatnonzero(n)
            offsets = np.arange(len(some) + 1, dtype=np.int32) * sums.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), dim, np.int32)), pa.array(np.full(len(some), p, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[some].ravel())),
            ], names=["dim", "part", "entry", "n", "sums"])

    return run


def _coded(shared):
    def run(batches):
        books = shared.value
        for batch in batches:
            code, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for (dim,), at in _runs(batch, "dim"):
                for p, rows in enumerate(_parts(batch.column(1), at, dim)):
                    code[at, p], least = nearest(rows, books[dim][p])
                    error[at] += least
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "dim", "code", "error"])

    return run


def integer_vector(embedding: Column, scale: int) -> Column:
    """floor(``scale`` * x) of each component; beyond what squares of whole vectors hold in 62 bits, the bound itself."""
    most = F.floor(F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.size(embedding), F.lit(1))))
    return F.transform(embedding, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * scale))))


def learn_codebooks(rows: DataFrame, *, entries: int = 256, rounds: int = 4) -> dict[int, list[np.ndarray]]:
    """Codebooks of the four parts for each length of the vectors v of ``rows`` (dim, v, vec_id).

    They start as the parts of the ``entries`` rows of least vec_id (null last,
    ties by vector). Each round sums on the executors what every entry gets;
    the driver holds codebooks and sums of codebooks only, ``entries`` vectors
    of each length that occurs. A round without change ends the search.
    """
    spark = rows.sparkSession
    books: dict[int, list[np.ndarray]] = {}
    for (dim,) in rows.select("dim").distinct().orderBy("dim").collect():
        first = rows.where(F.col("dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
        books[dim] = [b.copy() for b in _parts(first["v"], np.arange(first.num_rows), dim)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("dim", "v").mapInArrow(_assigned_sums(shared), _SUMS)
        found = sums.select("dim", "part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
        shared.unpersist()
        dims, part, entry, at, n, x = (c.to_numpy() for c in found.columns)
        new = {dim: [b.copy() for b in book] for dim, book in books.items()}
        for dim, book in new.items():
            for p in range(PARTS):
                mine = (dims == dim) & (part == p)
                book[p][entry[mine], at[mine]] = x[mine] // n[mine]
        same = all((a == b).all() for dim in books for a, b in zip(books[dim], new[dim]))
        books = new
        if same:
            break
    return books


def codebook_digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all components, in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, *, scale: int = 1024, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of ``vectors`` (vec_id, embedding, label) with a usable vector.

    A vector becomes integers, floor(``scale`` * component), in four equal
    parts; a part becomes the index of its codebook's nearest entry. error is
    the squared distance between vector and code, label_error its sum over the
    rows of equal labels (nulls together; null where it does not fit a long).

    Rows whose vector is null or holds null or non-finite components are left
    out. Rows that repeat a vec_id, or have none, are coded each by its own
    vector. Vectors of unequal lengths have codebooks of their own; a length
    that four does not divide counts as if zeros followed, and an empty vector
    gets the first entries. Components whose squares would not fit 62 bits
    over the whole vector count as the greatest that do (2**27 at length 64,
    131072 before scaling). An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    label = dict(vectors.dtypes)["label"]
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(usable(F.col("embedding")))
    rows = work.table(good.select(F.size("embedding").cast("int").alias("dim"), integer_vector(F.col("embedding"), scale).alias("v"), "vec_id", "label"), "integers")
    books = learn_codebooks(rows, entries=entries, rounds=rounds)
    coded = work.table(rows.mapInArrow(_coded(spark.sparkContext.broadcast(books)), f"vec_id long, label {label}, dim int, code string, error long"), "codes")
    work.drop(rows)
    keys = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    named = coded.select("vec_id", *keys, "dim", "code", "error")
    sums = work.table(named.groupBy("_none", "_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    digests = [F.lit(x) for dim, book in books.items() for x in (dim, codebook_digest(book))]
    digest = F.element_at(F.create_map(*digests), F.col("dim")) if digests else F.lit(None).cast("string")
    return salted_join(named, sums.drop("n"), ["_none", "_label"], ["vec_id", "code"], counts=sums).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
