"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import held_out
from .text import LOWER, SPACE, pieces, span_hashes, spans
from .work import Work

FEATURES = (
    "log_bytes", "log_words", "mean_word", "max_word", "short_words", "upper", "digits", "marks", "wide", "bars", "bangs", "symbols",
    "stops", "spaces", "log_lines", "mean_line", "distinct_words", "top_word", "repeats", "distinct_lines", "marked_words", "capital_words", "entropy", "twice",
)

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_MARK = ((_BYTE > 32) & (_BYTE < 127)) & ~_DIGIT & ~_UPPER & ~((_BYTE >= 97) & (_BYTE <= 122))
_CLASSES = [_UPPER, _DIGIT, _MARK, _BYTE >= 128, np.isin(_BYTE, list(b"|")), np.isin(_BYTE, list(b"!")), np.isin(_BYTE, list(b"#$%&*")), np.isin(_BYTE, list(b".?")), SPACE]


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; an empty or null one has zeros."""
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for row, end, data, offsets in pieces(column):
        n = np.diff(offsets)
        starts, ends = spans(~SPACE[data], offsets)
        low = span_hashes(LOWER[data], starts, ends)
        first = np.searchsorted(starts, offsets)
        # the last byte and the capitals of each word
        marked, capital = _MARK[data[ends - 1]], np.zeros(len(starts), bool)
        upper = np.r_[0, np.cumsum(_UPPER[data])]
        capital = (upper[ends] - upper[starts]) * 2 > ends - starts
        ls, le = spans(data != 10, offsets)
        lines = span_hashes(data, ls, le)
        line_at = np.searchsorted(ls, offsets)
        sums = [np.r_[0, np.cumsum(c[data])] for c in _CLASSES]
        size = ends - starts
        for i in range(end - row):
            if not n[i]:
                continue
            a, b, x = int(offsets[i]), int(offsets[i + 1]), out[row + i]
            share = [(s[b] - s[a]) / n[i] for s in sums]
            w, lengths, l = low[first[i] : first[i + 1]], size[first[i] : first[i + 1]], lines[line_at[i] : line_at[i + 1]]
            k = len(w)
            x[0], x[1], x[14] = np.log1p(n[i]), np.log1p(k), np.log1p(len(l))
            x[5:14] = share
            x[15] = n[i] / max(1, len(l))
            bytes_ = np.bincount(data[a:b], minlength=1)
            p = bytes_[bytes_ > 0] / n[i]
            x[22] = -(p * np.log2(p)).sum()
            if k:
                _, counts = np.unique(w, return_counts=True)
                x[2], x[3], x[4] = lengths.mean(), lengths.max(), (lengths <= 2).mean()
                x[16], x[17] = len(counts) / k, counts.max() / k
                x[18] = (w[1:] == w[:-1]).sum() / k
                x[20], x[21] = marked[first[i] : first[i + 1]].mean(), capital[first[i] : first[i + 1]].mean()
                x[23] = counts[counts > 1].sum() / k
            if len(l):
                x[19] = len(np.unique(l)) / len(l)
    return out


class BoostedTrees:
    """Gradient-boosted trees on binned features with logistic loss.

    All trees have the same depth and lie in flat arrays: node j of a tree has
    the children 2j + 1 and 2j + 2, so a batch walks down by array indexing.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 2.0):
        self.depth = depth
        inner, leaves = (1 << depth) - 1, 1 << depth
        self.feature = np.zeros((trees, inner), np.int32)
        self.threshold = np.full((trees, inner), np.inf, np.float32)
        self.value = np.zeros((trees, leaves))
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], 1)
        flat = binned + np.arange(x.shape[1]) * bins
        score = np.full(len(y), self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for d in range(depth):
                wide = 1 << d
                width = x.shape[1] * bins
                at = (node[:, None] * width + flat).ravel()
                g = np.bincount(at, np.repeat(grad, x.shape[1]), wide * width).reshape(wide, x.shape[1], bins)
                h = np.bincount(at, np.repeat(hess, x.shape[1]), wide * width).reshape(wide, x.shape[1], bins)
                gl, hl = g.cumsum(2), h.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain[(hl < 2) | (ht - hl < 2)] = 0
                best = gain.reshape(wide, -1).argmax(1)
                f, cut = best // bins, best % bins
                good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
                ids = wide - 1 + np.arange(wide)
                self.feature[t, ids] = f
                for j in np.flatnonzero(good):
                    if cut[j] < len(edges[f[j]]):
                        self.threshold[t, ids[j]] = edges[f[j]][cut[j]]
                node = 2 * node + (x[np.arange(len(y)), self.feature[t, wide - 1 + node]] > self.threshold[t, wide - 1 + node])
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            self.value[t] = rate * g / (h + smooth)
            score += self.value[t, node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for t in range(len(self.value)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node - inner]
        return 1 / (1 + np.exp(-total))


def _measure(batches):
    for batch in batches:
        x = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))], names=["doc_id", "x"])


def _rate(shared):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = 20000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) marks some documents 0 or 1. The trees learn
    from at most ``sample`` labelled rows, those of the least hash of doc_id
    among rows that are not held out; the bound keeps what the driver gathers
    fixed. Statistics come from whole texts; nothing else enters a score.

    Null and empty texts have zero statistics and get a score like any other.
    Rows that repeat a doc_id teach once. Null labels and null doc_ids teach nothing; without two kinds of labels
    every score is the share of label 1 (0.5 without labels). Rows repeat as
    they come; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Work(spark)
    kind = dict(docs.dtypes)["doc_id"]
    measured = work.table(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_measure, f"doc_id {kind}, x array<float>"), "measured")
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row a document, so that a repeated doc_id adds nothing to what is gathered
    rows = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("x").alias("x"), F.max("quality").alias("quality")).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    trees = BoostedTrees(x, rows["quality"].to_numpy(float))
    rated = measured.mapInArrow(_rate(spark.sparkContext.broadcast(trees)), f"doc_id {kind}, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
