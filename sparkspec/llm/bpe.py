"""BPE encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import pieces, powers
from .work import ship, spare

#: Characters that any definition of white space may hold; a cut never comes after one of them.
_WIDE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_ODD = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: Pieces of a text between safe places: those where white space follows something else.
PIECE = re.compile(f"[{_WIDE}]*[^{_WIDE}]+(?:[{_ODD}][{_WIDE}]*[^{_WIDE}]*)*|[{_WIDE}]+")

_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Texts on which these plain patterns agree with the tokenizer's own.
_PLAIN = re.compile(f"[ \t\n\r!-~{_L}]*")
_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^ \t\n\r0-9{_L}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in printable)
    extra = {b: 0x100 + i for i, b in enumerate(rest)}
    return "".join(chr(extra.get(b, b)) for b in range(256))


_LETTERS = byte_letters()


def spelled(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


class Memo(dict):
    """Results of ``make`` by key, in two generations of at most ``most`` entries; what is used stays."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """A byte-level BPE of the tokenizers library with reuse of chunks.

    A text is cut into chunks where a rolling hash of the last ``window``
    bytes is 0 modulo ``every``: equal passages of different documents are cut
    alike, and a chunk is encoded once while it stays in the memo. A chunk
    keeps its inner tokens, from its first safe place to its last one, and the
    text of its two ends. A join is repaired by encoding the end and the
    beginning around it anew; they reach to the next safe places, where the
    tokenizer's own pattern always ends one match and looks back at nothing,
    so both sides agree exactly with the encoding of the whole text. Where a
    chunk has no safe place, the join takes in the next chunk too.
    """

    def __init__(self, spec: str, every: int = 512, window: int = 16, most_pieces: int = 150_000, most_chunks: int = 12_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = self.whole.model
        self.every, self.window = every, window
        self.piece = Memo(self._piece, most_pieces)
        self.chunk = Memo(self._chunk, most_chunks)
        back = {c: b for b, c in enumerate(_LETTERS)}
        special = {i: t.content.encode() for i, t in self.whole.get_added_tokens_decoder().items()}
        size = self.whole.get_vocab_size()
        self.bytes = [special[i] if i in special else bytes(back[c] for c in self.whole.id_to_token(i)) for i in range(size)]

    def _piece(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text):
            tokenize = self.model.tokenize
            ids = [t.id for word in _TOKEN.findall(text) for t in tokenize(spelled(word))]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, PIECE.findall(text)))

    def _chunk(self, data: bytes) -> tuple[str, bytes | None, str]:
        cut = PIECE.findall(data.decode())
        if len(cut) < 2:
            return "".join(cut), None, ""
        return cut[0], b"".join(map(self.piece.__getitem__, cut[1:-1])), cut[-1]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where a chunk begins, by the rolling hash of the bytes before them; never inside a character."""
        n, w = len(data), self.window
        if n <= w:
            return np.zeros(0, np.int64)
        base = 0x9E3779B97F4A7C15
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n)[:n], out=prefix[1:])
        rolled = (prefix[w:n] - prefix[: n - w]) * powers(pow(base, -1, 1 << 64), n)[: n - w]
        top = rolled >> np.uint64(40)
        return np.flatnonzero((top % np.uint64(self.every) == 0) & ((data[w:] & 0xC0) != 0x80)) + w

    def encode(self, data: bytes, cuts: list[int]) -> bytes:
        """Ids of a text as little-endian 32-bit integers; ``cuts`` are places inside it."""
        out, pending, at = [], "", 0
        for end in [*cuts, len(data)]:
            head, inner, tail = self.chunk[data[at:end]]
            at = end
            if inner is None:
                pending += head
            else:
                out += [self._pieces(pending + head), inner]
                pending = tail
        out.append(self._pieces(pending))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict = {}


def shared_coder(kind, spec: str, **how):
    """One coder a worker process, so its memos live as long as the worker."""
    key = (kind.__name__, hashlib.sha256(spec.encode()).digest(), tuple(sorted(how.items())))
    if key not in _CODERS:
        _CODERS[key] = kind(spec, **how)
    return _CODERS[key]


def _encode(shared, name: str):
    def run(batches):
        coder = shared_coder(ByteBpe, shared.value)
        for batch in batches:
            where = batch.schema.get_field_index(name)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != where]
            names = [n for n in batch.schema.names if n != name]
            for row, end, data, offsets in pieces(batch.column(where)):
                cuts = coder.cuts(data)
                first = np.searchsorted(cuts, offsets, "right")
                last = np.searchsorted(cuts, offsets, "left")
                ids, tokens, texts = [], [], []
                for i in range(end - row):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    one = coder.encode(data[a:b].tobytes(), (cuts[first[i] : last[i + 1]] - a).tolist())
                    ids.append(hashlib.sha256(one).hexdigest())
                    tokens.append(np.frombuffer(one, "<u4").astype(np.int32))
                    texts.append(coder.decode(tokens[-1]))
                at = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(row, end - row) for c in columns],
                    pa.array(np.diff(at).astype(np.int64)), pa.array(ids, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens))), pa.array(texts, pa.string()),
                ], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: str, *, ids: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also ids and decoded.

    ``tokenizer`` is the path of a byte-level BPE in the tokenizers library's
    format, read on the driver. Ids equal those of encoding the whole text
    without added special tokens, truncation or padding; ``decoded`` is their
    decoding. A null text counts as empty and has no ids. Rows repeat as they
    come, an empty table gives an empty result, and columns of the added names
    are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    added = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    rest = [c for c in docs.columns if c not in added]
    name = spare(docs, "_text")
    given = docs.select(*rest, F.col("text").cast("string").alias(name))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*rest).dtypes)
    extra = ", ids array<int>, decoded string" if ids else ""
    run = _encode(shared, name)
    if not ids:
        inner = run
        run = lambda batches: (b.select(b.schema.names[:-2]) for b in inner(batches))
    return given.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
