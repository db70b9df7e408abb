"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .text import LOWER, pieces
from .work import ship, spare

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text is divisible by 5, and for a null doc_id: such rows teach nothing."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


class ByteTable:
    """Rows of numbers by 64-bit key other than 0, found by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self._slots = None

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}  # made anew where it is used: a quarter of it is full

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self) -> None:
        slots, full = np.full(1 << self.bits, -1, np.int32), (1 << self.bits) - 1
        left, at = np.arange(len(self.keys)), self._place(self.keys)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & full
        self._slots, self._keys = slots, np.where(slots >= 0, self.keys[slots], 0) if len(self.keys) else np.zeros(1 << self.bits, np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 if absent."""
        if self._slots is None:
            self._build()
        full = (1 << self.bits) - 1
        at = self._place(keys)
        there = self._keys[at]
        hit = there == keys
        out = np.where(hit, self._slots[at], -1)
        left = np.flatnonzero(~hit & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & full
            there, wanted = self._keys[at], keys[left]
            hit = there == wanted
            out[left[hit]] = self._slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], at[on]
        return out


class ContextTrees:
    """Per language a byte context tree of variable order, kept as two sparse tables over all languages.

    The cost of a byte is the code length, in nats, of method C: a symbol seen
    n times after a context that saw d symbols in t places has probability
    n / (t + d); otherwise the escape d / (t + d) leads to the next shorter
    context, and below order 0 all 256 bytes are alike. There is no exclusion:
    a symbol that a longer context already ruled out keeps its share in the
    shorter one, so the code wastes a little, alike for all languages.
    Statistics are frozen after learning, so a text's code length is a sum over
    its places. A-Z are lower-cased; a text begins after ``order`` spaces.

    ``counts`` has for each language the grams of the highest order, as numbers
    of ``order`` + 1 bytes, and how often they occur; those of lower orders
    follow, since every place has one gram of each order.

    ``grams`` holds every context of every order with a symbol that any
    language saw after it, and the whole cost for each language, escapes
    included; ``escapes`` holds the contexts with the cost of leaving them. A
    place whose gram is absent pays the escapes and takes the next shorter
    gram. Keys are the bytes themselves, so no two grams share one. The tables
    are broadcast: where they would take more than ``most_bytes``, as with
    hundreds of languages, the order is lowered until they do not.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = 3, most_bytes: int = 128 << 20):
        self.names = sorted(counts)
        given = order
        while True:
            seen = [[self._shorter(*counts[x], o) for x in self.names] for o in range(order + 1)]
            keys = [np.unique(np.concatenate([k for k, _ in one])) if one else np.zeros(0, np.uint64) for one in seen]
            places = [np.unique(k >> np.uint64(8)) for k in keys]
            if order == 0 or sum(map(len, keys + places)) * (8 + 4 * len(self.names)) <= most_bytes:
                break
            order -= 1
        self.order, self.lowered = order, given - order
        n = len(self.names)
        rows, leaves = sum(map(len, keys)), sum(map(len, places))
        costs, escapes = np.zeros((rows, n), np.float32), np.zeros((leaves, n), np.float32)
        lower, shorter, at, out = np.full((1, n), np.log(256.0), np.float32), np.zeros(1, np.uint64), 0, 0
        for o in range(order + 1):
            cost, leave = costs[at : at + len(keys[o])], escapes[out : out + len(places[o])]
            below = np.searchsorted(shorter, self._tag(keys[o] & np.uint64((1 << 8 * o) - 1), o - 1)) if o else np.zeros(len(keys[o]), np.int64)
            place = np.searchsorted(places[o], keys[o] >> np.uint64(8))
            for i, (mine, count) in enumerate(seen[o]):
                if len(mine):
                    lead = np.flatnonzero(np.r_[True, np.diff(mine >> np.uint64(8)) != 0])
                    total, kinds = np.add.reduceat(count, lead), np.diff(np.r_[lead, len(mine)])
                    both = (total + kinds).astype(float)
                    leave[np.searchsorted(places[o], mine[lead] >> np.uint64(8)), i] = np.log(both / kinds)
                # what a language did not see costs its escape and the same symbol after the shorter context
                cost[:, i] = leave[place, i] + lower[below, i]
                if len(mine):
                    cost[np.searchsorted(keys[o], mine), i] = np.log(np.repeat(both, kinds) / count)
            lower, shorter = cost, self._tag(keys[o], o)
            at, out = at + len(cost), out + len(leave)
        tagged = lambda some: np.concatenate([self._tag(k, o) for o, k in enumerate(some)])
        self.grams, self.escapes = ByteTable(tagged(keys), costs), ByteTable(tagged(places), escapes)

    @staticmethod
    def _shorter(keys: np.ndarray, count: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of grams of order ``o`` from those of a higher one."""
        low = keys & np.uint64((1 << 8 * (o + 1)) - 1)
        order = np.argsort(low, kind="stable")
        low, count = low[order], count[order]
        lead = np.flatnonzero(np.r_[True, np.diff(low) != 0]) if len(low) else np.zeros(0, np.int64)
        return low[lead], np.add.reduceat(count, lead) if len(lead) else count

    @staticmethod
    def _tag(keys: np.ndarray, o: int) -> np.ndarray:
        return keys | np.uint64((o + 1) << 56)

    @staticmethod
    def _grams(data: np.ndarray, offsets: np.ndarray, o: int) -> np.ndarray:
        """The last ``o`` bytes and the byte of each place in one number, the byte lowest; spaces stand before a row."""
        low = LOWER[data].astype(np.uint64)
        out = low.copy()
        for back in range(1, min(o, len(low) - 1) + 1):
            out[back:] |= low[:-back] << np.uint64(8 * back)
        size = np.diff(offsets)
        spaces = np.uint64(0x2020202020202020 & ((1 << 8 * (o + 1)) - 1))
        for have in range(1, o + 1):  # places with so many bytes of their row, their own included
            at, own = offsets[:-1][size >= have] + have - 1, np.uint64((1 << 8 * have) - 1)
            out[at] = (out[at] & own) | (spaces & ~own)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        some = np.flatnonzero(np.diff(offsets) > 0)
        if not len(some) or not self.names:
            return out
        whole = self._grams(data, offsets, self.order)
        cost = np.zeros((len(whole), len(self.names)), np.float32)
        left = np.arange(len(whole))
        for o in range(self.order, -1, -1):
            keys = whole[left] & np.uint64((1 << 8 * (o + 1)) - 1)
            row = self.grams.find(self._tag(keys, o))
            hit = row >= 0
            cost[left[hit]] += self.grams.values[row[hit]]
            left, keys = left[~hit], keys[~hit]
            row = self.escapes.find(self._tag(keys >> np.uint64(8), o))
            cost[left[row >= 0]] += self.escapes.values[row[row >= 0]]
        cost[left] += np.float32(np.log(256.0))
        for i in range(len(self.names)):
            out[some, i] = np.add.reduceat(cost[:, i].astype(np.float64), offsets[some])
        return out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for rows with a letter of any script."""
    count = np.r_[0, np.cumsum(_LETTER[LOWER[data]])]
    some = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return some


def gram_counts(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``order`` + 1 bytes in some rows, ascending, and how often each occurs."""
    return np.unique(ContextTrees._grams(data, offsets, order), return_counts=True)


def _counted(order: int):
    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, offsets in pieces(batch.column(1), 1 << 20):
                for lang in sorted(set(langs[a:b])):
                    rows = [i for i in range(b - a) if langs[a + i] == lang]
                    own = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rows])
                    keys, n = gram_counts(own, np.r_[0, np.cumsum([offsets[i + 1] - offsets[i] for i in rows])].astype(np.int64), order)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def _predict(shared, name: str, evidence: int):
    def run(batches):
        trees = shared.value
        for batch in batches:
            names, scores, saved = [], [], []
            for _, _, data, offsets in pieces(batch.column(batch.schema.get_field_index(name)), 1 << 18):
                letters = _has_letter(data, offsets)
                if not trees.names:
                    names += ["und"] * len(letters)
                    scores += [0.0] * len(letters)
                    saved += [0.0] * len(letters)
                    continue
                length = trees.lengths(data, offsets)
                best = length.argmin(axis=1)
                saved += (np.diff(offsets) * np.log(256.0) - length[np.arange(len(best)), best]).tolist()
                # a long text would drive every share to 0 or 1, so lengths are scaled to ``evidence`` bytes
                length *= np.minimum(1, evidence / np.maximum(1, np.diff(offsets)))[:, None]
                share = 1 / np.exp(np.minimum(0, length[np.arange(len(best)), best][:, None] - length)).sum(axis=1)
                names += [trees.names[i] if ok else "und" for i, ok in zip(best, letters)]
                scores += np.where(letters, share, 0.0).tolist()
            columns = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != name]
            kept = [f for f in batch.schema.names if f != name]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(saved, pa.float64())], names=[*kept, "lang_pred", "score", "saved"])

    return run


def learn(docs: DataFrame, per_language: int = 300, order: int = 3) -> ContextTrees:
    """Context trees from at most ``per_language`` whole texts a language, those of the least hash of doc_id.

    Only rows that are not held out, with a language and a text that is not
    empty, teach; of rows that repeat a doc_id the greatest text does. A
    language's rows are thinned by hash to about twice that many before they
    are ranked, so no task ranks a common language. Grams are counted where
    the texts are, and only sums for each gram of each language reach the
    driver: as many as a language has different runs of ``order`` + 1 bytes,
    whatever the length of its texts.
    """
    may = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != "")).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    # one row a language
    sizes = may.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = may.join(F.broadcast(sizes), "lang").where(draw * F.col("n") <= 2 * per_language + 100)
    one = some.groupBy("lang", "doc_id").agg(F.max("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id"))
    rows = one.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "text")
    ship(docs.sparkSession)
    found = rows.mapInArrow(_counted(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    lang = found["lang"].combine_chunks().dictionary_encode()
    code, gram, n = lang.indices.to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    return ContextTrees({name: (gram[code == i], n[code == i]) for i, name in enumerate(lang.dictionary.to_pylist())}, order)


def identify(docs: DataFrame, trees: ContextTrees, evidence: int = 24) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and saved.

    Each whole text gets the language of the shortest code length (ties: the
    first name by code point). The score is that language's share of the
    likelihood with code lengths scaled down to ``evidence`` bytes: near 1
    where one language explains the text, near an equal share where several
    do as well or none does. A null text, and one without a letter, gets
    ``und`` and a score of 0, and so does every text where no language was learned. Rows
    repeat as they come; an empty table gives an empty result; columns of the
    added names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "saved")]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*rest).dtypes)
    name = spare(docs, "_text")
    return docs.select(*rest, F.col("text").cast("string").alias(name)).mapInArrow(_predict(spark.sparkContext.broadcast(trees), name, evidence), f"{schema}, lang_pred string, score double, saved double")
