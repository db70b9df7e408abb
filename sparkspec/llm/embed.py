"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector kept of each group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, roots
from .skew import salted_join
from .topk import _matrix, one_row_each, usable
from .work import Work

_HOME = "label {label}, dim int, cell int, vec_id long, n long, v array<double>"
_EXTENT = "label {label}, dim int, cell int, most array<float>"
_MEMBER = "label {label}, dim int, cell int, home boolean, vec_id long, n long, v array<double>"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k centres of unit length, by cosine; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, total / np.maximum(length, 1e-12), centres)
    return centres


def _runs(batch: pa.RecordBatch | pa.Table, *columns: str):
    """Rows of a batch by the values of ``columns``: (values, row numbers)."""
    codes = np.zeros(batch.num_rows, np.int64)
    for name in columns:
        column = batch.column(batch.schema.get_field_index(name))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        index = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (int(index.max(initial=0)) + 1) + index, return_inverse=True)[1].ravel()
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    for at in np.split(order, cuts[1:]):
        if len(at):
            yield tuple(batch.column(batch.schema.get_field_index(c))[int(at[0])].as_py() for c in columns), at


def _vectors(column, at: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(at))
    return _matrix(part if isinstance(part, pa.ChunkedArray) else pa.chunked_array([part]), len(at))


def _lists(rows: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def _home(shared):
    """Each class at length one, with the nearest centre of its label as its cell."""

    def run(batches):
        books = shared.value
        for batch in batches:
            for (label, dim), at in _runs(batch, "label", "dim"):
                rows = unit(_vectors(batch.column(4), at))
                book = books.get((label, dim))
                cell = np.zeros(len(at), np.int32) if book is None else (rows @ book.T).argmax(axis=1).astype(np.int32)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(cell), batch.column(2).take(pick), batch.column(3).take(pick), _lists(rows, pa.float64())], names=["label", "dim", "cell", "vec_id", "n", "v"])

    return run


def _extents(shared):
    """For each cell met, the largest product of a member with every other centre, less that with its own."""

    def run(batches):
        books, seen, schema = shared.value, {}, None
        for batch in batches:
            schema = batch.schema.field("label").type
            for (label, dim), at in _runs(batch, "label", "dim"):
                if (book := books.get((label, dim))) is None:
                    continue
                cell = batch.column(2).to_numpy()[at]
                near = _vectors(batch.column(5), at) @ book.T
                near -= near[np.arange(len(at)), cell][:, None]
                most = seen.setdefault((label, dim), np.full((len(book), len(book)), -np.inf, np.float32))
                order = np.argsort(cell, kind="stable")
                lead = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
                mine = cell[order][lead]
                most[mine] = np.maximum(most[mine], np.maximum.reduceat(near[order], lead, axis=0))
        for (label, dim), most in seen.items():
            some = np.flatnonzero(np.isfinite(most).all(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), schema), pa.array([dim] * len(some), pa.int32()), pa.array(some.astype(np.int32)), _lists(most[some], pa.float32())], names=["label", "dim", "cell", "most"])

    return run


def _largest(table: pa.Table) -> pa.Table:
    """One row a cell: the largest of its extents in each direction."""
    most = _matrix(table["most"], table.num_rows).max(axis=0, keepdims=True)
    return pa.Table.from_arrays([*(table[c].combine_chunks().slice(0, 1) for c in ("label", "dim", "cell")), _lists(most, pa.float32())], names=["label", "dim", "cell", "most"])


def _guests(shared, least: float):
    """Each class in its own cell, and in each earlier cell in which a partner may live.

    Two unit vectors of cosine >= least are at most r = sqrt(2 - 2 least)
    apart. For a member y of cell c, y.j - y.c is at most the extent
    most[c, j] in the direction from centre c to centre j; so a vector x with
    a partner in c has x.j - x.c <= most[c, j] + r |j - c| for every j.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def run(batches):
        books, extents = shared.value
        gaps = {}
        for batch in batches:
            for (label, dim), at in _runs(batch, "label", "dim"):
                own = batch.column(2).to_numpy()[at]
                rows = _vectors(batch.column(5), at)
                who, to = np.zeros(0, np.int64), np.zeros(0, np.int32)
                if (book := books.get((label, dim))) is not None:
                    most = extents[label, dim]
                    if (label, dim) not in gaps:
                        gaps = {(label, dim): (most + reach * np.sqrt(np.maximum(0, 2 - 2 * book @ book.T))).astype(np.float64)}
                    room = gaps[label, dim]
                    near = rows @ book.T
                    may = near[np.arange(len(at)), own][:, None] - near <= room[:, own].T
                    who, to = np.nonzero(may & (np.arange(len(book)) < own[:, None]))
                    step = max(1, (1 << 22) // len(book))
                    keep = [(near[who[i : i + step]] - near[who[i : i + step], to[i : i + step]][:, None] <= room[to[i : i + step]]).all(axis=1) for i in range(0, len(who), step)]
                    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
                    who, to = who[keep], to[keep].astype(np.int32)
                each = np.r_[np.arange(len(at)), who]
                pick = pa.array(at[each])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.r_[own, to].astype(np.int32)), pa.array(np.arange(len(each)) < len(at)),
                    batch.column(3).take(pick), batch.column(4).take(pick), _lists(rows[each], pa.float64()),
                ], names=["label", "dim", "cell", "home", "vec_id", "n", "v"])

    return run


def _compare(least: float):
    """Links within pairs of blocks: each vector's number of links, and one edge to the least vector of its component here."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        table = table.sort_by("vec_id").combine_chunks()
        for (_, _, _, i, j), at in _runs(table, "label", "dim", "cell", "i", "j"):
            ids, n, home, side = (table[c].to_numpy()[at] for c in ("vec_id", "n", "home", "side"))
            rows = _vectors(table["v"], at)
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            hit = rows[left] @ rows[right].T >= least
            hit &= home[left][:, None] | home[right][None, :]
            if i == j:
                hit &= left[:, None] < right[None, :]
            a, b = np.nonzero(hit)
            a, b = left[a], right[b]
            if len(a):
                links = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
                some = np.flatnonzero(links)
                out.append((ids[some], links[some].astype(np.int64), ids[roots(len(ids), a, b)][some]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table({"vec_id": cols[0].astype(np.int64), "links": cols[1], "root": cols[2].astype(np.int64)})

    return run


def codebooks(classes: DataFrame, *, per_cell: int = 16, max_cells: int = 1024, sample_bytes: int = 64 << 20) -> dict[tuple, np.ndarray]:
    """Centres by (label, dim) from spherical k-means: one for each ``per_cell`` sampled classes, two at least where a label has 8 of them, ``max_cells`` at most.

    The sample holds the classes of the least hashes of vec_id over all labels,
    as many as fill ``sample_bytes`` as 32-bit numbers. All squares of numbers
    of centres together stay under a quarter of those bytes, so that the table
    of extents does not take more room than the sample either.
    """
    longest = classes.agg(F.max("dim")).first()[0] or 1
    seen = classes.orderBy(F.xxhash64("vec_id"), "vec_id").select("label", "dim", F.transform("v", lambda x: x.cast("float")).alias("v")).limit(max(1, sample_bytes // (4 * longest))).toArrow()
    books = {}
    runs = list(_runs(seen, "label", "dim"))
    fair = int(np.sqrt(sample_bytes / 4 / max(1, len(runs))))
    for key, at in runs:
        if (k := min(max_cells, max(len(at) // per_cell, min(2, len(at) // 4)), fair)) > 1:
            books[key] = spherical_kmeans(unit(_vectors(seen["v"], at).astype(float)), k)
    return books


def near_duplicate_vectors(vectors: DataFrame, *, least: float = 0.98, per_cell: int = 16, max_cells: int = 1024, sample_bytes: int = 64 << 20, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vec_id of ``vectors`` (vec_id, embedding, label).

    Vectors with equal, not null labels and equal lengths are linked if their
    cosine in double precision is at least ``least``. Vectors that are null,
    zero or hold null or non-finite components link with nothing. Rows that
    repeat a vec_id count once (greatest label, then vector); a null vec_id is
    left out. An empty table gives an empty result.

    Equal vectors of a label form a class first. Each label has its own cells
    from spherical k-means over a bounded sample (``codebooks``); a label of
    under 8 sampled classes is one cell. Every class goes to its
    nearest cell and to each earlier one in which a partner may lie, judged by
    how far the members of that cell reach in the direction of every other
    centre (``_guests``), so no link is missed. Cells are compared in pairs of
    blocks of about ``block`` vectors, small cells several in a task, which
    give counts and one edge a vector, not pairs.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    label = dict(vectors.dtypes)["label"]
    rows = one_row_each(vectors, "label", "embedding")
    rows = work.table(rows.withColumn("ok", F.col("label").isNotNull() & usable(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))), "rows")
    doubles = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    good = rows.where("ok").select("vec_id", "label", doubles.alias("v"))
    # equal vectors are told by 128 bits of hash, so that only narrow rows meet their class again
    mark = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")]
    keys = ["label", "h1", "h2"]
    classes = good.select("vec_id", "label", *mark, "v").groupBy(*keys).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = work.table(classes.select(*keys, "vec_id", "n", F.size("v").alias("dim"), "v"), "classes")
    books = codebooks(classes, per_cell=per_cell, max_cells=max_cells, sample_bytes=sample_bytes)
    shared = spark.sparkContext.broadcast(books)
    homes = work.table(classes.select("label", "dim", "vec_id", "n", "v").mapInArrow(_home(shared), _HOME.format(label=label)), "homes")
    found = homes.mapInArrow(_extents(shared), _EXTENT.format(label=label)).groupBy("label", "dim", "cell").applyInArrow(_largest, _EXTENT.format(label=label)).toArrow()  # as many numbers as the codebooks allow
    extents = {key: np.full((len(book), len(book)), -np.inf, np.float32) for key, book in books.items()}
    for key, at in _runs(found, "label", "dim"):
        extents[key][found["cell"].to_numpy()[at]] = _vectors(found["most"], at)
    members = work.table(homes.mapInArrow(_guests(spark.sparkContext.broadcast((books, extents)), least), _MEMBER.format(label=label)), "members")
    cell = ["label", "dim", "cell"]
    sizes = members.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    packs = max(1, members.count() // (2 * block))
    placed = members.join(sizes, cell).withColumn("side", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("parts")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = other.withColumns({"i": F.least("side", "o"), "j": F.greatest("side", "o")})
    alone = F.pmod(F.xxhash64(*cell), F.lit(packs))
    pairs = pairs.select(*members.columns, "side", "i", "j", F.when(F.col("parts") == 1, alone).otherwise(F.xxhash64(*cell, "i", "j")).alias("pack"))
    links = work.table(pairs.groupBy("pack").applyInArrow(_compare(least), "vec_id long, links long, root long"), "links")
    comp = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), work)
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    reps = classes.select(F.col("vec_id").alias("rep"), *keys, "n")
    named = reps.join(counts, reps.rep == counts.vec_id, "left").join(comp, reps.rep == comp.id, "left").select(
        *keys, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = work.table(named, "named")
    work.drop(homes, members, links, classes)
    done = salted_join(good.select("vec_id", "label", *mark), named.drop("n"), keys, ["vec_id"], counts=named).select("vec_id", "n_links", "component_id")
    bad = rows.where(~F.coalesce("ok", F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionAll(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
