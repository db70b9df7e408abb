"""Token ids in files of Huffman-coded blocks, and reading them back."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import Memo, shared_coder, spelled
from .work import Work

_L = "a-z\xdf-\xf6\xf8-\xff"
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^0-9{_L}]+")
#: White space beyond ASCII, and controls that some count as such: a text with one is encoded as a whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class WordBpe:
    """A BPE with word ends of the tokenizers library that drops white space: words are encoded by themselves and remembered."""

    def __init__(self, spec: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.word = Memo(self._word, most_words)

    def _word(self, word: str) -> bytes:
        if "<|" not in word and _PLAIN.fullmatch(word):
            tokenize = self.model.tokenize
            ids = [t.id for part in _TOKEN.findall(word.lower()) for t in tokenize(spelled(part))]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.word.__getitem__, text.split()))


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of an optimal prefix code with no code longer than ``limit`` bits (package-merge); 0 for absent symbols."""
    lengths = np.zeros(len(counts), np.int64)
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    n = len(order)
    if n <= 1:
        lengths[order] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    leaves = counts[order].astype(np.float64)
    levels, merged = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[leaves, pairs]
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Codebook:
    """A canonical code from its lengths; bits are written from the lowest up, so codes are kept reversed."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint64)
        self.limit = int(max(1, lengths.max(initial=1)))
        symbols = np.lexsort((np.arange(len(lengths)), lengths))
        symbols = symbols[lengths[symbols] > 0]
        size = lengths[symbols]
        # canonical: each code is the one before plus 1, shifted to its own length
        weight = (np.int64(1) << (self.limit - size)) if len(size) else np.zeros(0, np.int64)
        code = (np.cumsum(weight) - weight) >> (self.limit - size)
        back = np.zeros(len(size), np.uint64)
        for bit in range(self.limit):
            has = bit < size
            back[has] |= ((code[has] >> (size[has] - 1 - bit)) & 1).astype(np.uint64) << np.uint64(bit)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = back
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.step = np.ones(1 << self.limit, np.int64)
        for bits in np.unique(size):
            mine = size == bits
            at = (back[mine].astype(np.int64)[:, None] | (np.arange(1 << (self.limit - bits)) << bits)[None, :])
            self.symbol[at] = symbols[mine][:, None]
            self.step[at] = bits

    def pack(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids`` in 64-bit words, and the bit offset of each ``every``-th id."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        starts = ends - size
        codes = self.codes[ids]
        word, shift = (starts >> np.uint64(6)).astype(np.int64), starts & np.uint64(63)
        words = np.zeros(int(ends[-1] >> np.uint64(6)) + 1, np.uint64)
        lead = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[lead]] = np.bitwise_or.reduceat(codes << shift, lead)
        over = np.flatnonzero(shift + size > 64)
        words[word[over] + 1] |= codes[over] >> (np.uint64(64) - shift[over])
        return words.tobytes(), starts[::every].astype(np.int64)

    def unpack(self, data: bytes, points: np.ndarray, n: int, every: int) -> np.ndarray:
        """``n`` ids by table: all runs that begin at ``points`` advance side by side."""
        words = np.r_[np.frombuffer(data, np.uint64), np.zeros(2 + every * self.limit // 64, np.uint64)]
        mask = np.uint64((1 << self.limit) - 1)
        at = points.astype(np.int64).copy()
        out = np.empty((every, len(points)), np.uint32)
        for i in range(min(every, n)):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            peek = ((words[word] >> shift) | ((words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))) & mask
            peek = peek.astype(np.int64)
            out[i] = self.symbol[peek]
            at += self.step[peek]
        return out.T.reshape(-1)[:n] if n >= every else out[:n].T.reshape(-1)[:n]


def _tokens(shared, end_id: int):
    def run(batches):
        coder = shared_coder(WordBpe, shared.value)
        end = np.array([end_id], coder.kind).tobytes()
        width = np.dtype(coder.kind).itemsize
        counts = np.zeros(max(coder.size, end_id + 1), np.int64)
        none = lambda kind: pa.array([None], kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                ids = [coder.encode(t) + end if t else end for t in texts]
                counts += np.bincount(np.frombuffer(b"".join(ids), coder.kind), minlength=len(counts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(part.num_rows, pa.list_(pa.int64()))], names=["doc_id", "tie", "n", "ids", "counts"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["doc_id", "tie", "n", "ids", "counts"])

    return run


_BLOCK = "part int, block int, first long, n_tokens long, docs binary, sizes binary, points binary, every int, data binary"


def _blocks(shared, kind: str, block: int, every: int):
    def run(batches):
        book = Codebook(shared.value)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        docs, have, sizes, held = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(have), kind)
            data, points = book.pack(ids, every)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([_doc_ids(docs)], pa.binary()), pa.array([np.array(sizes, "<i8").tobytes()], pa.binary()),
                pa.array([points.astype("<i8").tobytes()], pa.binary()), pa.array([every], pa.int32()), pa.array([data], pa.binary()),
            ], names=["part", "block", "first", "n_tokens", "docs", "sizes", "points", "every", "data"])

        for batch in batches:
            for doc, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs.append(doc)
                sizes.append(n)
                have.append(ids.as_py())
                held += n
                if held >= block:
                    yield flush()
                    number, first = number + 1, first + held
                    docs, have, sizes, held = [], [], [], 0
        if docs:
            yield flush()

    return run


def _doc_ids(docs: list) -> bytes:
    """Doc ids of a block: a byte each that is 1 for null, then 64-bit values."""
    return bytes(d is None for d in docs) + np.array([d or 0 for d in docs], "<i8").tobytes()


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, limit: int = 16, block: int = 1 << 18, every: int = 64, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids below ``path`` in ascending doc_id order.

    Ids are those of the whole text without added special tokens, with
    ``end_id`` after each document. ``path/codebook`` holds the code lengths of
    a canonical Huffman code of at most ``limit`` bits from the counts of all
    ids; ``path/blocks`` holds blocks of whole documents of about ``block``
    ids: the part and number give their order, ``first`` the ids before the
    block in its part, ``docs`` and ``sizes`` its documents, ``data`` the bits,
    and ``points`` the bit offset of each ``every``-th id (``every`` is kept beside them), so that a block is
    decoded alone and in many places at once. The files are Parquet, the
    format that Spark's writers can put in any store.

    A null text is empty; null doc_ids come first; rows that repeat a doc_id
    follow each other by a hash of their text. An empty table gives no block.
    Other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark)
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else "<u4"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    coded = work.table(given.mapInArrow(_tokens(spark.sparkContext.broadcast(spec), end_id), "doc_id long, tie long, n long, ids binary, counts array<long>").withColumn("row", F.monotonically_increasing_id()), "ids")
    sums = coded.where("counts is not null").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).where("n > 0").collect()  # at most the vocabulary
    counts = np.zeros(max([end_id, *(r.pos for r in sums)]) + 1, np.int64)
    for r in sums:
        counts[r.pos] = r.n
    lengths = limited_lengths(counts, max(limit, int(np.ceil(np.log2(max(2, len(sums)))))))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one doc_id, or of none, may be any number: their texts and places range them too
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("row").asc()]
    ordered = coded.where("counts is null").select("doc_id", "n", "ids", "tie", "row").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_blocks(spark.sparkContext.broadcast(lengths), kind, block, every), _BLOCK)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    work.drop(coded)


def _decode(shared):
    def run(batches):
        book = Codebook(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_tokens"]
                ids = book.unpack(row["data"], np.frombuffer(row["points"], "<i8"), n, row["every"])
                sizes = np.frombuffer(row["sizes"], "<i8")
                k = len(sizes)
                null, docs = row["docs"][:k], np.frombuffer(row["docs"][k:], "<i8")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, mask=np.frombuffer(null, bool)), pa.array(ends - sizes + row["start"]), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array([zlib.crc32(ids[b - s : b].astype("<u4").tobytes()) for b, s in zip(ends.tolist(), sizes.tolist())], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return run


def read(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of each document in files of ``write``; ``start`` counts the ids of all documents before it. Files of no documents give no rows; a null text has its end id alone."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r.id] = r.bits
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("_part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("_before"))
    # one row a part: as many as write() was told to make
    placed = blocks.join(F.broadcast(before), F.col("part") == F.col("_part")).withColumn("start", F.col("first") + F.col("_before"))
    given = placed.select("start", "n_tokens", "docs", "sizes", "points", "every", "data")
    run = _decode(spark.sparkContext.broadcast(lengths))
    if ids:
        return given.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>, ids_crc32 long")
    return given.mapInArrow(lambda b: (x.select(["doc_id", "start", "n_tokens", "ids_crc32"]) for x in run(b)), "doc_id long, start long, n_tokens long, ids_crc32 long")
