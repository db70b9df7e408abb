"""How far the sources of a language diverge in their words: dense tiles for common terms, posting corrections for rare ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .skew import salted_join
from .text import LOWER, pieces, release, spans
from .work import Work

#: bytes of a term: A-Z, a-z and all of a character beyond ASCII
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True

#: what probabilities are counted in
SCALE = 1_000_000_000

_COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = "lang string, source string, item string, part long"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of some rows, A-Z lower-cased, and the row of each."""
    low = LOWER[data]
    inside = _TERM[low]
    starts, ends = spans(inside, offsets)
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside])))
    return words.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _count(batches):
    """Occurrences and documents of each term for each group, summed over a few megabytes of text; a null term stands for the group itself."""
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (1, 2))
        pair = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        met, lead, group = np.unique(pair, return_index=True, return_inverse=True)
        group = group.ravel()
        langs, sources = batch.column(1).take(pa.array(lead)), batch.column(2).take(pa.array(lead))
        none = pa.array(np.zeros(len(met), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(met), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"])
        for a, _, data, offsets in pieces(batch.column(0), 8 << 20):
            words, row = terms_of(data, offsets)
            kinds = len(words.dictionary)
            if not kinds:
                continue
            seen, n = np.unique(row * kinds + words.indices.to_numpy(), return_counts=True)
            key = group[a + seen // kinds] * kinds + seen % kinds
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            own = key[order][first]
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(own // kinds)), sources.take(pa.array(own // kinds)), words.dictionary.take(pa.array(own % kinds)).cast(pa.string()),
                pa.array(np.add.reduceat(n[order], first)), pa.array(np.diff(np.r_[first, len(order)]).astype(np.int64)),
            ], names=["lang", "source", "term", "n", "docs"])
        del batch
        release()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term for each group; a row of null term for each group. Nulls read as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("text"), text("lang"), text("source")).mapInArrow(_count, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kinds)), exact for any counts."""
    up = F.lit(SCALE).cast("decimal(11,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", up, (total + kinds).cast("decimal(20,0)"))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def _dense(p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over the terms (columns of ``p``) for each pair of a left and a right group (rows)."""
    out = np.zeros((len(left), len(right)), np.int64)
    other = p[right]
    for i, g in enumerate(left):
        out[i] = _f(p[g][None], other).sum(axis=1)
    return out


def _one_sided(group: np.ndarray, p: np.ndarray, zero: np.ndarray, left: np.ndarray, right: np.ndarray, own: bool) -> np.ndarray:
    """What postings of one side change against both groups lacking the term: the left group's (``own``) or the right one's."""
    out = np.zeros((len(left), len(right)), np.int64)
    base = zero[right][None]
    for i, g in enumerate(left if own else right):
        value, n = np.unique(p[group == g], return_counts=True)
        if not len(value):
            continue
        if own:
            out[i] = (n[:, None] * (_f(value[:, None], base) - _f(zero[g], base))).sum(axis=0)
        else:
            out[:, i] = (n[None] * (_f(zero[left][:, None], value[None]) - _f(zero[left], zero[g])[:, None])).sum(axis=1)
    return out


def _both_sided(term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray, size: int, room: int = 1 << 20) -> np.ndarray:
    """What pairs of postings of a term (sorted by term) change beyond the sum of both one-sided corrections."""
    out = np.zeros((size, size), np.int64)
    start = np.flatnonzero(np.r_[True, np.diff(term) != 0]) if len(term) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(term)])
    for m in np.unique(length[length > 1]).tolist():
        some = start[length == m]
        step = max(1, room // (m * m))
        for first in range(0, len(some), step):
            at = some[first : first + step, None] + np.arange(m)
            g, h = np.broadcast_arrays(group[at][:, :, None], group[at][:, None, :])
            pg, ph = np.broadcast_arrays(p[at][:, :, None], p[at][:, None, :])
            value = _f(pg, ph) - _f(pg, zero[h]) - _f(zero[g], ph) + _f(zero[g], zero[h])
            np.add.at(out, (g.ravel(), h.ravel()), value.ravel())
    return out


def _tile(step: int = 2048):
    """Partial sums of all pairs between two blocks of groups over one bucket of terms."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, a, b, bucket = (k.as_py() for k in key)
        table = table.combine_chunks()
        mark = table["term"].is_null().to_numpy()
        groups = table.filter(pa.array(mark))
        names, block, zero, kinds = groups["source"].combine_chunks(), groups["own"].to_numpy(), groups["p"].to_numpy(), groups["kinds"].to_numpy()
        rows = table.filter(pa.array(~mark))
        group = pc.index_in(rows["source"], value_set=names).to_numpy().astype(np.int64)
        code = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        group, code, p, heavy = group[order], code[order], rows["p"].to_numpy()[order], rows["heavy"].to_numpy(zero_copy_only=False)[order]
        size, out = len(names), np.zeros((len(names), len(names)), np.int64)
        sides = [np.flatnonzero(block == a), np.flatnonzero(block == b)]
        for left, right in [sides] if a == b else [sides, sides[::-1]]:
            part = _f(zero[left][:, None], zero[right][None]) * (int(kinds[0]) if bucket == 0 else 0)
            flat = _f(zero[left][:, None], zero[right][None])
            _, at = np.unique(code[heavy], return_inverse=True)
            at = at.ravel()
            for first in range(0, int(at[-1]) + 1 if len(at) else 0, step):
                lo, hi = np.searchsorted(at, [first, first + step])
                n = int(at[hi - 1]) - first + 1
                tile = np.repeat(zero[:, None], n, axis=1)
                tile[group[heavy][lo:hi], at[lo:hi] - first] = p[heavy][lo:hi]
                part += _dense(tile, left, right) - n * flat
            part += _one_sided(group[~heavy], p[~heavy], zero, left, right, True) + _one_sided(group[~heavy], p[~heavy], zero, left, right, False)
            out[np.ix_(left, right)] += part
        met = _both_sided(code[~heavy], group[~heavy], p[~heavy], zero, size)
        used = np.zeros((size, size), bool)
        used[np.ix_(sides[0], sides[1])] = used[np.ix_(sides[1], sides[0])] = True
        used[np.arange(size), np.arange(size)] = False
        g, h = np.nonzero(used)
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": names.take(pa.array(g)), "item": names.take(pa.array(h)), "part": pa.array((out + met)[g, h])})

    return run


def audit(docs: DataFrame, *, least_docs: int = 3, top: int = 200, heavy: float = 0.25, block: int = 256, rows: int = 1 << 17) -> DataFrame:
    """(lang, source, part, item, value, rank) for the groups (lang, source) of ``docs`` (text, lang, source).

    Terms are runs of ASCII letters, A-Z lower-cased, and characters beyond
    ASCII; a language keeps those in at least ``least_docs`` of its documents.
    With add-one smoothing over them every group and language gives a term p,
    in thousand millionths; f = floor((p - q)**2 / q). Part ``pair``: every other
    source of the language with f summed over all its kept terms, q the
    other's. Part ``term``: kept terms more likely in the group than in its
    language (q), the ``top`` greatest f. Ranks go by value, then item.

    A term in at least ``heavy`` of a language's groups is dense: tiles of
    groups by terms give its sums. The others are postings, which correct what
    two groups without the term would give: one-sided by the values that
    occur, two-sided for pairs of postings of a term. All sums are exact.
    Groups are dealt into blocks of ``block`` on average, terms into buckets of
    about ``rows`` postings of a block, and each pair of blocks and bucket is
    one small task; only the sums of pairs, which the result holds anyway, are
    shuffled. Groups and hot sources are joined salted.

    Null text, lang or source read as ''. Repeated rows count as documents of
    their own, texts are read whole. A group without terms has its pairs (value
    0 where the language keeps no term) and no term rows; an empty table gives
    an empty result. Other columns are not read.
    """
    work = Work(docs.sparkSession)
    counts = work.table(term_counts(docs), "counts")
    one = F.lit(1)
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.count(one).alias("spread")).where(F.col("docs") >= least_docs)
    terms = work.table(terms.drop("docs"), "terms")
    kept = work.table(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    langs = terms.groupBy("lang").agg(F.count(one).alias("kinds"), F.sum("n_lang").alias("total_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(one).alias("postings"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").fillna(0, ["total", "postings"])
    groups = work.table(groups, "groups")
    blocks = groups.groupBy("lang").agg(F.count(one).alias("n_groups")).withColumn("blocks", F.ceil(F.col("n_groups") / block).cast("int"))
    own = F.pmod(F.xxhash64("source", F.lit(5)), F.col("blocks")).cast("int").alias("own")
    # one row a language: joined with the groups, of which a language has at most a few a document
    shape = blocks.join(langs, "lang", "left").fillna(0, ["kinds", "total_lang"])
    placed = salted_join(groups, shape, ["lang"], ["source"]).select("*", own)
    placed = work.table(placed, "placed")
    widest = placed.groupBy("lang", "own").agg(F.sum("postings").alias("n")).groupBy("lang").agg(F.greatest(one, F.ceil(F.max("n") / rows)).cast("int").alias("buckets"))
    placed = work.table(salted_join(placed, widest, ["lang"], ["source"]), "blocks")

    side = placed.select("lang", "source", "total", "kinds", "total_lang", "n_groups", "blocks", "buckets", "own")
    given = placed.where("postings > 0").select("lang", "source", F.col("postings").alias("n"))
    full = salted_join(kept, side, ["lang", "source"], ["term"], counts=given)
    p, q = probability(F.col("n"), F.col("total"), F.col("kinds")), probability(F.col("n_lang"), F.col("total_lang"), F.col("kinds"))
    full = work.table(full.select("lang", "source", "term", p.alias("p"), q.alias("q"), (F.col("spread") >= heavy * F.col("n_groups")).alias("heavy"), "kinds", "blocks", "own", F.pmod(F.xxhash64("term", F.lit(6)), F.col("buckets")).cast("int").alias("bucket")), "postings")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = full.where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    empty = F.when(F.col("kinds") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.greatest(F.col("kinds"), one))).otherwise(1)
    marks = placed.select("lang", "source", F.lit(None).cast("string").alias("term"), empty.alias("p"), F.lit(False).alias("heavy"), "kinds", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    dealt = full.select(*marks.columns).unionAll(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "bucket", "source", "term", "p", "heavy", "kinds", "own")
    sums = dealt.groupBy("lang", "a", "b", "bucket").applyInArrow(_tile(), _SUMS)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("part").alias("value")).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionAll(columns(apart, "term"))
