"""BPE with chunk reuse and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkspec.llm import tokenbin
from sparkspec.llm.bpe import ByteBpe, encode
from sparkspec.llm.tokenbin import Codebook, WordBpe, limited_lengths
from sparkspec.llm.work import Work

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ATOMS = ["the", " ", "  ", "\n", "\r\n", "\t", "é", "über", "'s", "'S", "'ll", "can't", "12", "٣", "x1", "!!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "\xa0", "\x85", "\x1c", " ", "​", "᠎", "　", "日本", "é", "İ", "Σ", "ΟΔΟΣ", "ß", "×", "ª", "²", "😀", "\x00", "﻿", "naïve", "A", "#$%", "_"]
texts = st.lists(st.sampled_from(ATOMS), max_size=40).map("".join) | st.text(max_size=60)


def whole(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


BYTE_WHOLE, WORD_WHOLE = whole(BYTE), whole(WORD)
CODER = ByteBpe(open(BYTE, encoding="utf-8").read(), every=4, window=3, most_pieces=50, most_chunks=10)
WORDS = WordBpe(open(WORD, encoding="utf-8").read(), most_words=20)


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_chunked_encoding_is_exact(text):
    data = text.encode()
    cuts = CODER.cuts(np.frombuffer(data, np.uint8)).tolist() if data else []
    ids = np.frombuffer(CODER.encode(data, cuts), "<u4")
    assert ids.tolist() == BYTE_WHOLE.encode(text, add_special_tokens=False).ids
    assert CODER.decode(ids) == BYTE_WHOLE.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_word_encoding_is_exact(text):
    assert np.frombuffer(WORDS.encode(text), WORDS.kind).tolist() == WORD_WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(9, 12))
def test_huffman_round_trip(ids, limit):
    counts = np.bincount(ids, minlength=301)
    lengths = limited_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths[counts > 0] > 0).all()
    assert sum(2.0 ** -lengths[lengths > 0]) <= 1
    book = Codebook(lengths)
    data, points = book.pack(np.array(ids), 64)
    assert book.unpack(data, points, len(ids), 64).tolist() == ids


def test_unlimited_code_is_optimal():
    rng = random.Random(1)
    counts = np.array([rng.randint(1, 1000) for _ in range(40)])
    heap, total = sorted(counts.tolist()), 0
    while len(heap) > 1:
        x = heap.pop(0) + heap.pop(0)
        total += x
        heap = sorted([*heap, x])
    assert (limited_lengths(counts, 30) * counts).sum() == total


ROWS = [(5, "Hello  world, it's 2024", "a"), (1, "", "b"), (None, None, "c"), (3, "x" * 5000 + " y", None), (3, "dup", "d"), (3, "dup", "d"), (9, "École <|endoftext|> a b", "e")]


def test_encode_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    rows = encode(docs, BYTE).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    for r in rows:
        assert r.ids == BYTE_WHOLE.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)
    assert encode(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("block, every", [(4, 3), (1 << 18, 64)])
def test_files_round_trip(spark, tmp_path, block, every):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    at = f"file://{tmp_path}/t"
    tokenbin.write(docs, at, WORD, block=block, every=every, parts=3)
    rows = sorted(tokenbin.read(spark, at).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 3, 3, 5, 9]
    at = 0
    want = {r[0]: [] for r in ROWS}
    for doc, text, _ in ROWS:
        want[doc].append([*WORD_WHOLE.encode(text or "", add_special_tokens=False).ids, 1])
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        want[r.doc_id].remove(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_files_of_no_documents(spark, tmp_path):
    tokenbin.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", WORD)
    assert tokenbin.read(spark, f"file://{tmp_path}/t").count() == 0


def test_queries_on_documents(spark):
    from sparkspec.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op8_bpe"](spark, "/root/testdata/sf0.001").collect():
        import hashlib

        ids = BYTE_WHOLE.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(BYTE_WHOLE.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for r in sorted(QUERIES["op10_token_binary"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id):
        ids = [*WORD_WHOLE.encode(docs[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_binary_of_rows_without_ids(spark):
    """Rows that share a doc_id, or have none, are ranged by their texts and places: no part holds them all."""
    rows = [(None, f"the word {i}") for i in range(300)] + [(5, "the same text")] * 300
    at = Work(spark).path("tokens")
    tokenbin.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), at, public_tokenizers.path("word_bpe_49k.json"), parts=6)
    sizes = [r.n for r in spark.read.parquet(f"{at}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    got = tokenbin.read(spark, at).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 300
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
