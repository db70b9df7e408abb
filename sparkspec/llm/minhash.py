"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components, roots
from .skew import salted_join
from .text import mix, pieces, release, shingles, words
from .work import Work, spare

_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def shingle_sets(column: pa.Array, k: int):
    """For each row its distinct k-word shingles as sorted 64-bit hashes; fewer words than k are one shingle, no words none."""
    for _, _, data, offsets in pieces(column):
        hashed, _, first = words(data, offsets)
        runs = shingles(hashed, k) if len(hashed) >= k else np.zeros(0, np.uint64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield shingles(hashed[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation signatures, rows of ``bins`` minima.

    The hash range is cut into equal bins, and the least hash in each is kept.
    An empty bin takes the value of the first non-empty bin of its own fixed
    random sequence ``probes`` (optimal densification).
    """
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, one in enumerate(sets):
        at = ((one >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at.astype(np.int64)
        out[i, at[lead].astype(np.int64)] = one[lead]
        full[i, at[lead].astype(np.int64)] = True
    rows, holes = np.nonzero(~full & full.any(axis=1)[:, None])
    for step in range(probes.shape[1]):
        if not len(rows):
            return out
        source = probes[holes, step]
        found = full[rows, source]
        out[rows[found], holes[found]] = out[rows[found], source[found]]
        rows, holes = rows[~found], holes[~found]
    for i in np.unique(rows):  # sequences are finite: what is left takes the next non-empty bin
        have = np.flatnonzero(full[i])
        mine = holes[rows == i]
        out[i, mine] = out[i, have[np.searchsorted(have, mine) % len(have)]]
    return out


def _digest(sets: list[np.ndarray], salt: int = 0xD6E8FEB86659FD93) -> pa.Array:
    """A 64-bit digest of each set."""
    return pa.array(np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))


def _sign(bands: int, width: int, k: int):
    bins = bands * width
    probes = np.random.default_rng(20240229).integers(0, bins, (bins, 64))

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            done = 0
            sets: list[np.ndarray] = []

            def flush(sets, done):
                banded = signatures(sets, bins, probes).reshape(len(sets), bands, width)
                acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
                for j in range(width):
                    acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + banded[:, :, j])
                some = np.array([len(s) > 0 for s in sets])
                offsets = np.r_[0, np.cumsum(np.where(some, bands, 0))].astype(np.int32)
                return pa.RecordBatch.from_arrays([
                    ids.slice(done, len(sets)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _digest(sets),
                    _digest(sets, 0x9FB21C651E98DF25),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(acc[some].ravel().view(np.int64))),
                ], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

            for one in shingle_sets(column, k):
                sets.append(one)
                if len(sets) == 256:
                    yield flush(sets, done)
                    done += len(sets)
                    sets = []
            if sets:
                yield flush(sets, done)
            del batch, ids, column, sets
            release()

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            done, sets = 0, []
            for one in shingle_sets(batch.column(1), k):
                sets.append(one)
                if len(sets) == 256 or done + len(sets) == batch.num_rows:
                    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))), _digest(sets)], names=["id", "set", "digest"])
                    done, sets = done + len(sets), []
            del batch, sets
            release()

    return run


def _block_links(percent: int, step: int = 8192):
    """Edges between two blocks of sets: shared shingles become columns, a slice at a time, and products count intersections."""

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, comps, side = (table[c].to_numpy(zero_copy_only=False) for c in ("rep", "c", "side"))
        column = table["set"].combine_chunks()
        column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)
        flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(reps)), sizes)
        _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[name] > 1
        row, name = row[shared], np.unique(name[shared], return_inverse=True)[1]
        order = np.argsort(name, kind="stable")
        row, name = row[order], name[order]
        inter = np.zeros((len(reps), len(reps)), np.float32)
        for first in range(0, int(name[-1]) + 1 if len(name) else 0, step):
            a, b = np.searchsorted(name, [first, first + step])
            part = np.zeros((len(reps), step), np.float32)
            part[row[a:b], name[a:b] - first] = 1
            inter += part @ part.T
        inter = inter.astype(np.int64)  # counts of shared shingles, exact in the float up to 2**24
        union = sizes[:, None] + sizes[None] - inter
        hit = (100 * inter >= percent * union) & (comps[:, None] != comps[None]) & (np.arange(len(reps))[:, None] < np.arange(len(reps)))
        left, right = np.nonzero(hit)
        root = roots(len(reps), left, right)
        moved = np.flatnonzero(root != np.arange(len(reps)))
        return pa.table({"a": reps[root[moved]], "b": reps[moved]})

    def run(table: pa.Table) -> pa.Table:
        done = links(table)
        release()
        return done

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    sided = salted_join(pairs, sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), ["b"], ["a"])
    both = salted_join(sided, sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), ["a"], ["b"], counts=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))).withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")


def _rest(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, block: int, most: int, work: Work) -> DataFrame | None:
    """Links between components that share a bucket, by comparing blocks of sets; None if every bucket is one component.

    Buckets that share a class form a group; where that would join more than
    ``most`` classes, each bucket is a group of its own (buckets of the same
    classes one), so chains of overlapping buckets never grow into one group.
    A group's large components are cut into blocks of their own, its small
    ones share blocks (long sets count as several), and pairs of blocks are compared unless both belong to
    one large component: so a group that is one large component and a few
    others costs blocks in proportion.
    """
    named = members.join(comp, members.rep == comp.id, "left").select("bucket", "rep", "m", F.coalesce("component", "rep").alias("c"))
    several = named.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("rep").alias("lo"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("same")).where("x < y")
    several = work.table(several.select("bucket", "lo", "n", F.xxhash64(F.lit("bucket"), "same", "n").alias("alone")), "several")
    if several.isEmpty():
        return None
    open_ = work.table(salted_join(named, several.drop("n"), ["bucket"], ["rep"], counts=several), "open")
    groups = components(open_.select(F.col("lo").alias("a"), F.col("rep").alias("b")), work)
    joint = open_.join(groups, open_.rep == groups.id).select("rep", "m", "c", "alone", "component")
    wide = joint.select("component", "rep").distinct().groupBy("component").agg((F.count(F.lit(1)) > most).alias("wide"))
    rows = work.table(joint.join(wide, "component").select(F.when(F.col("wide"), F.col("alone")).otherwise(F.col("component")).alias("g"), "rep", "m", "c").distinct(), "groups")
    # a long set counts as several, so a block holds some 2**20 shingles at most
    size = rows.groupBy("g", "c").agg(F.sum(1 + F.floor(F.col("m") * block / (1 << 20))).alias("k"))
    little = size.where(F.col("k") < block // 4).groupBy("g").agg(F.sum("k").alias("small"))
    sized = rows.join(size, ["g", "c"]).join(little, "g", "left")
    own = F.col("k") >= block // 4
    parts = F.greatest(F.lit(1), F.ceil(F.when(own, F.col("k")).otherwise(F.col("small")) / block)).cast("int")
    placed = work.table(sized.select("g", "rep", "c", F.when(own, F.col("c")).otherwise(F.lit(-(1 << 63))).alias("of"), F.pmod(F.when(own, F.xxhash64("rep", F.lit(3))).otherwise(F.xxhash64("c", F.lit(3))), parts).alias("n")), "placed")
    blocks = placed.select("g", "of", "n").distinct()
    other = blocks.select("g", F.col("of").alias("of2"), F.col("n").alias("n2"))
    meet = blocks.join(other, "g").where((F.struct("of", "n") <= F.struct("of2", "n2")) & ((F.col("of") != F.col("of2")) | (F.col("of") == -(1 << 63))))
    same = (F.col("of") == F.col("of2")) & (F.col("n") == F.col("n2"))
    ends = meet.select("g", "of", "n", "of2", "n2", F.explode(F.when(same, F.array(F.struct("of", "n"))).otherwise(F.array(F.struct("of", "n"), F.struct(F.col("of2").alias("of"), F.col("n2").alias("n"))))).alias("e"))
    ends = ends.select("g", F.xxhash64("of", "n").alias("p"), F.xxhash64("of2", "n2").alias("q"), F.col("e.of").alias("of"), F.col("e.n").alias("n"))
    dealt = ends.join(placed, ["g", "of", "n"]).join(sets.select(F.col("id").alias("rep"), "set"), "rep").select("g", "p", "q", "rep", "c", F.lit(0).alias("side"), "set")
    return dealt.groupBy("g", "p", "q").applyInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, percent: int = 85, bands: int = 28, width: int = 6, small: int = 8, block: int = 256, most: int = 8192) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut at white space; a row's set holds its
    distinct ``shingle``-word shingles, or all its words as one if there are
    fewer. Rows are linked if 100 * intersection >= ``percent`` * union;
    component_id is the least doc_id reachable, itself included.

    Rows with equal sets form a class, and its least doc_id stands for it.
    Classes that share a band of the signature share a bucket. Buckets of at
    most ``small`` classes compare all of them; in a larger one edges go from
    one hub to all, the class that shares most bands with others, which is the
    middle of a group. Links are confirmed on the full sets. Where a large
    bucket still holds several components, their sets are compared in blocks
    of ``block`` (``_rest``), so that no pair in a bucket stays unseen. Joins
    on buckets, hubs and classes are salted where a key is hot.

    Null or empty texts have an empty set and link with nothing. Rows that
    repeat a doc_id are compared each by its own text and may get different
    components; kept is true for all rows of the component's least doc_id. A
    null doc_id gets n_shingles of its row, a null component and kept true. An
    empty table gives an empty result. Other columns are not read.
    """
    how = {"shingle": shingle, "percent": percent, "bands": bands, "width": width, "small": small, "block": block, "most": most}
    work = Work(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _repeats(source):
        found = _by_row(work.table(source.withColumn("_row", F.monotonically_increasing_id()), "rows"), work, **how).drop("_row", "_stays")
    else:
        found = _components_of(source, work, **how)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands in several rows."""
    return not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _by_row(keyed: DataFrame, work: Work, **how) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, _stays) for the rows (_row, doc_id, text) of a written table; one row of each component stays, and all of null doc_ids."""
    ids = keyed.select("_row", F.col("doc_id").cast("long").alias("doc_id"))
    named = keyed.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _components_of(named, work, **how).select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_group"))
    known = work.table(found.where("_row is not null").join(ids, "_row"), "known")
    first = known.groupBy("_group").agg(F.min(F.struct("doc_id", "_row")).alias("_first"))
    some = known.join(first, "_group").select("_row", "doc_id", "n_shingles", F.col("_first.doc_id").alias("component_id"), (F.col("_first._row") == F.col("_row")).alias("_stays"))
    none = F.lit(None).cast("long")
    return some.unionAll(found.where("_row is null").select("_row", none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(True).alias("_stays")))


def _components_of(source: DataFrame, work: Work, *, shingle: int = 3, percent: int = 85, bands: int = 28, width: int = 6, small: int = 8, block: int = 256, most: int = 8192) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row (doc_id, text); no doc_id but null repeats."""
    signed = work.table(source.mapInArrow(_sign(bands, width, shingle), _SIGNED), "signed")
    one = signed.where("doc_id is not null")
    classes = work.table(one.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "classes")

    entries = classes.select("rep", F.col("n_shingles").alias("m"), F.explode("bands").alias("bucket"))
    sizes = work.table(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "m")).alias("lo"), F.max(F.struct("rep", "m")).alias("hi")).where("n > 1"), "buckets")
    some = sizes.where("n > 2").select("bucket", "n")
    members = work.table(salted_join(entries, some, ["bucket"], ["rep"], counts=some), "members")
    few, many = members.where(F.col("n") <= small), members.where(F.col("n") > small).select("bucket", "rep", "m", "n")
    fame = many.groupBy("rep").agg(F.sum("n").alias("fame"))
    hubs = many.join(fame, "rep").groupBy("bucket").agg(F.max_by(F.struct("rep", "m"), F.struct("fame", -F.col("rep"))).alias("hub"))
    pair = lambda x, y: [F.least(F.col(x + ".rep"), F.col(y + ".rep")).alias("a"), F.greatest(F.col(x + ".rep"), F.col(y + ".rep")).alias("b"), F.least(F.col(x + ".m"), F.col(y + ".m")).alias("u"), F.greatest(F.col(x + ".m"), F.col(y + ".m")).alias("v")]
    pairs = (
        sizes.where("n = 2").select(*pair("lo", "hi"))
        .unionAll(few.alias("x").join(few.alias("y"), "bucket").where("x.rep < y.rep").select(*pair("x", "y")))
        .unionAll(salted_join(many, hubs, ["bucket"], ["rep"], counts=some.where(F.col("n") > small)).select(F.struct("rep", "m").alias("x"), F.col("hub").alias("y")).where("x.rep <> y.rep").select(*pair("x", "y")))
    )
    # the sizes alone bound the similarity
    pairs = work.table(pairs.where(F.col("u") * 100 >= F.col("v") * percent).select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(many.select("rep")).distinct()
    # a merge join at every size: texts are dealt once, whatever the number of classes that share a bucket
    found = source.join(wanted.hint("merge"), source.doc_id == wanted.id, "left_semi").mapInArrow(_sets(shingle), "id long, set array<long>, digest long")
    sets = work.table(found.select("id", "set"), "sets")
    links = work.table(_confirmed(pairs, sets, percent), "links")
    comp = work.table(components(links, work), "components")
    more = _rest(many.select("bucket", "rep", "m"), comp, sets, percent, block, most, work)
    if more is not None:
        comp = work.table(components(links.unionAll(more), work), "components")
    work.drop(sets, members, pairs, sizes)
    keys = ["n_shingles", "set_a", "set_b"]
    named = work.table(classes.join(comp, classes.rep == comp.id, "left").select(*keys, "n", F.coalesce("component", "rep").alias("component_id")), "named")
    work.drop(classes, links)
    some = salted_join(one.where("n_shingles > 0").select("doc_id", *keys), named.drop("n"), keys, ["doc_id"], counts=named).select("doc_id", "n_shingles", "component_id")
    bare = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionAll(bare)


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each group of near duplicates does: one of the least doc_id. Rows of null doc_id all stay."""
    work = Work(docs.sparkSession)
    if not _repeats(docs):
        kept = spare(docs, "_kept")
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        stays = _components_of(source, work, **how).where("doc_id <=> component_id").select(F.col("doc_id").alias(kept)).distinct()
        return docs.join(stays, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")
    row = spare(docs, "_row")
    keyed = work.table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    stays = _by_row(keyed.select(F.col(row).alias("_row"), "doc_id", "text"), work, **how).where("_stays and _row is not null").select(F.col("_row").alias(row))
    known = keyed.where("doc_id is not null").join(stays, row, "left_semi")
    return known.unionAll(keyed.where("doc_id is null").select(*known.columns)).select(*docs.columns)
