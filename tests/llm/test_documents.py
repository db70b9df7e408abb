"""Document operators against brute force on small tables with odd rows."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkspec.llm import langid, licenses, minhash
from sparkspec.llm.components import components, roots
from sparkspec.llm.langid import ContextTrees, gram_counts, identify, learn
from sparkspec.llm.licenses import scan
from sparkspec.llm.lines import dedup_lines
from sparkspec.llm.minhash import drop_near_duplicates, near_duplicates
from sparkspec.llm.mixing import draw, mix, mixed_documents
from sparkspec.llm.skew import salted_join
from sparkspec.llm.quality import FEATURES, BoostedTrees, classify, features
from sparkspec.llm.work import Work

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k=3):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k=3, percent=85):
    s = {d: sets_of(t, k) for d, t in docs.items()}
    comp = {d: d for d in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def noisy(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def near_corpus():
    rng = random.Random(4)
    docs, i = {}, 0
    for size, copies, edits in ((120, 40, 3), (60, 25, 2), (30, 12, 1), (12, 6, 0), (4, 5, 0), (2, 3, 0), (1, 3, 0)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            docs[i * 7 % 997] = noisy(rng, base, rng.randint(0, edits))
            i += 1
    # a chain: each like the next, the ends unlike
    base = [f"c{j}" for j in range(100)]
    for j in range(12):
        docs[i * 7 % 997] = " ".join([f"d{x}" for x in range(j * 2)] + base[j * 2 :])
        i += 1
    for _ in range(60):
        docs[i * 7 % 997] = " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40)))
        i += 1
    docs[991], docs[992], docs[993], docs[994] = "", None, " \n\t", "A  b\x0bC d"
    docs[995] = "a B\nc D"
    return docs


@pytest.mark.parametrize("small, block", [(8, 256), (2, 6)])
def test_near_duplicates_equal_brute_force(spark, small, block):
    docs = near_corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, rep string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, small=small, block=block).collect()}
    assert got == brute_components(docs)
    kept = {r.doc_id for r in drop_near_duplicates(df, small=small).collect()}
    assert kept == {d for d, (_, c) in got.items() if c == d}


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == Counter([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (None, 3, None, True), (None, 0, None, True), (3, 0, 3, True)])
    assert near_duplicates(df.limit(0)).count() == 0
    assert sum(r.doc_id is None for r in drop_near_duplicates(df).collect()) == 2


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b + " more words here"), (2, b), (2, c), (3, c), (4, a), (5, "other words of its own"), (5, "other words of its own"), (None, a)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == Counter([(1, 58, 1, True)] * 2 + [(1, 61, 1, True), (2, 58, 1, False), (2, 58, 2, True), (3, 58, 2, False), (4, 58, 1, False)] + [(5, 3, 5, True)] * 2 + [(None, 58, None, True)])
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, a), (1, a), (1, rows[2][1]), (2, c), (5, rows[7][1])])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    probes = rng.integers(0, 168, (168, 64))
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64) * 2)
    b = np.unique(np.r_[a[:360], rng.integers(0, 2**63, 40, dtype=np.uint64)])
    few = np.unique(rng.integers(0, 2**63, 3, dtype=np.uint64) * 2)
    s = minhash.signatures([a, b, few, few.copy()], 168, probes)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - truth) < 0.12 and (s[2] == s[3]).all() and set(s[2].tolist()) <= set(few.tolist())


def test_shingle_hashes_equal_tuples():
    texts = ["The cat  sat on\tThe mat", "the CAT sat", "", None, "é É a", "one", "x" * 3000 + " y z w"]
    got = [len(s) for s in minhash.shingle_sets(pa.array(texts), 3)]
    assert got == [len(sets_of(t)) for t in texts]


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 104), (5, 5), (None, 3)] + [(200, 200 + i) for i in range(1, 50)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark)).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 102, 104)} == {100} and {got[i] for i in range(200, 250)} == {200}
    a, b = np.array([0, 3, 7]), np.array([3, 7, 9])
    assert roots(10, a, b)[[3, 7, 9]].tolist() == [0, 0, 0]
    assert components(spark.createDataFrame([], "a long, b long"), Work(spark)).count() == 0


def test_components_and_joins_with_hot_keys(spark):
    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000 + rng.randrange(40), 2000 + rng.randrange(40)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    both = [{r.id: r.component for r in components(df, Work(spark), broadcast_edges=most).collect()} for most in (0, 500_000)]
    assert both[0] == both[1] and {both[0][i] for i in range(400)} == {0} and {both[0][i] for i in range(1000, 1041)} == {1000}
    rows = spark.createDataFrame([(1, i, 0) for i in range(500)] + [(2, i, 1) for i in range(70)] + [(3 + i, i, 2) for i in range(90)], "k int, x int, y int")
    side = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c"), (999, "d")], "k int, name string")
    for how in ("inner", "left"):
        got = salted_join(rows, side, ["k"], ["x"], how=how, parts=20)
        assert got.columns == ["k", "x", "y", "name"] and Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(side, "k", how).collect()))
    assert salted_join(rows.limit(0), side, ["k"], ["x"]).count() == 0


def brute_lines(docs, least=40, often=5):
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for d, t in docs:
        for l in (t or "").split("\n"):
            if len(key(l)) >= least and d is not None:
                held.setdefault(key(l), set()).add(d)
    gone = {k: max(v) for k, v in held.items() if len(v) >= often}
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [l for l in ls if gone.get(key(l), d) == d or key(l) not in gone]
        kept = [l for l in ls if key(l) not in gone or (d is not None and gone[key(l)] == d)]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return Counter(map(str, out))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [f"  Common Line number {i} " + "é" * 30 + ("\r" if i % 2 else "") for i in range(6)] + ["short line"] * 3 + ["É" * 41, "ÀB" * 21]
    docs = []
    for d in range(60):
        ls = [rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 8))] + [f"unique {d} " + "z" * 50]
        docs.append((d, "\n".join(ls)))
    docs += [(70, None), (71, ""), (72, "\n\n"), (None, pool[0] + "\nx"), (5, pool[1]), (5, pool[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit(1))
    for batches in (1, 4, 7):
        got = Counter(str((r.doc_id, r.n_lines, r.n_dropped, r.text_kept)) for r in dedup_lines(df, n_batches=batches).collect())
        assert got == brute_lines(docs)
    assert dedup_lines(df.limit(0)).count() == 0


def test_mixing_targets_and_sums(spark):
    rng = random.Random(5)
    docs = [(i, " ".join("abcd" for _ in range(rng.randint(0, 30))), rng.choice(["s0", "s0", "s0", "s1", "s2", "S3", None])) for i in range(400)] + [(900, None, "s1"), (901, "", None), (None, "one two", "s2"), (3, "again", "s0"), (3, "again", "s0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("_key", F.lit("own"))
    rows = mix(df).collect()
    assert len(rows) == len(docs) and {r._key for r in rows} == {"own"}
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    again = mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    text = mixed_documents(mix(df.drop("size")), ["doc_id", "text", "source"]).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in text) == sum(r.taken for r in rows)
    assert mix(df.limit(0)).count() == 0
    plain = df.where("doc_id between 4 and 899")
    assert Counter((r.doc_id, r.taken) for r in mix(plain).collect()) == Counter((r.doc_id, r.taken) for r in draw(plain.drop("size")).collect())


def test_mixing_prefers_weight(spark):
    docs = [(i, "word " * 10 + f"w{i}", "s0" if i < 2000 else "s1", 1.0 if i % 2 else 0.25) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, good double")
    for how in ({"weight": "good"}, {"weight": "good", "bins": 4}):
        taken = {True: 0, False: 0}
        for r in mix(df, weights=(1, 3), budget_pct=50, **how).collect():
            taken[r.good == 1.0] += r.taken if r.source == "s0" else 0
        assert taken[True] > 2 * taken[False] > 0


def test_slices_hold_equal_shares(spark, monkeypatch):
    from sparkspec.llm import mixing

    sizes, real = [], mixing.Work.table

    def table(self, frame, name, **how):
        out = real(self, frame, name, **how)
        if name == "slices":
            sizes.extend(r.n for r in out.collect())
        return out

    monkeypatch.setattr(mixing.Work, "table", table)
    docs = [(i, "word", "s0", 1 / 16 if i % 3 == 0 else 0.5 if i % 3 == 1 else 1.0) for i in range(20000)]
    draw(spark.createDataFrame(docs, "doc_id long, text string, source string, w double"), weight="w", bins=50).collect()
    assert len(sizes) == 50 and max(sizes) < 1.3 * 20000 / 50


def test_quality_levels(spark):
    rows = [("plain words of usual length make a good text with many different ones in it " * 2,), ("aaaa " * 50,), ("12 34 5 6",), ("",), (None,)]
    from sparkspec.llm.mixing import quality_level

    text = F.coalesce("text", F.lit(""))
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(quality_level(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0), text)).collect()]
    assert got[0] > got[1] > got[2] >= got[3] == got[4] == 1


def test_license_scan(spark):
    pad = " ".join(f"filler{i}" for i in range(30))
    docs = [
        (1, f"{pad} Released under the MIT License. {pad}", "", "mit"), (2, "This work is licensed under the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
        (3, "Licensed under CC BY-NC 4.0. cc-BY", "cc-by", "cc-by,cc-by-nc"), (4, "All rights reserved; all Rights\n\nreserved", "reserved", "copyright,reserved"), (5, "General licence public", "", ""), (6, None, "", ""), (7, "", "", ""),
        (8, "Licensed under the Apache License, Version 2.0", "", "apache-2.0"), (9, "public license general public licensed", "", ""), (None, "allrights reserved éall rights reserved", "", ""), (10, "mit released the under license " * 5, "", ""),
    ]
    df = spark.createDataFrame([(d, t, 1) for d, t, *_ in docs], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in scan(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for d, t, base, labels in docs:
        w, places = word.findall((t or "").translate(LOW)), []
        for phrase in ("cc by", "general public license", "all rights reserved"):
            p = phrase.split()
            places += [i for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), base)
        assert set(labels.split(",")) - {""} <= set(r.labels.split(",")) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (labels or not r.labels)
    assert scan(df.limit(0)).count() == 0


def brute_templates(docs, templates, rarest=6, share=0.6, slack=8):
    """(labels of templates, largest share) of each text, by every template at every shift."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = [word.findall((t or "").translate(LOW)) for t in docs]
    df = Counter(w for r in rows for w in set(r))
    out = [(set(), 0.0) for _ in rows]
    for label, text, phrase in templates:
        words, key = licenses.template_words(text), licenses.template_words(phrase)
        idf = {w: np.log1p(len(rows) / df[w]) for w in words if df[w]}
        top = sorted(idf, key=lambda w: (-idf[w], w))[:rarest]
        own = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
        for n, r in enumerate(rows):
            starts = [i for i in range(len(r)) if r[i : i + len(key)] == key]
            for shift in range(-len(words), len(r)) if starts else []:
                near = [i for i in starts if (abs(i - shift - own) <= slack if own is not None else -len(key) <= i - shift <= len(words))]
                got = sum(idf[w] for i, w in enumerate(words) if w in top and 0 <= i + shift < len(r) and r[i + shift] == w)
                if near and got / sum(idf[w] for w in top) >= share - 1e-12:
                    out[n] = (out[n][0] | {label}, max(out[n][1], min(1.0, got / sum(idf[w] for w in top))))
    return out


def test_license_scan_of_files_with_many_licenses(spark):
    texts = [t for _, t, _ in licenses.TEMPLATES]
    far = "released under the licence " + "of others " * 9 + "mit license"
    docs = [far, ". ".join(texts), ". ".join(texts[::-1]), *(f"{a}; {b}" for a, b in zip(texts, texts[3:])), *texts * 2, "mit license " * 3, "nothing here", None]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    for n, (labels, score) in enumerate(brute_templates(docs, licenses.TEMPLATES)):
        base = set(got[n].base_labels.split(",")) - {""}
        assert set(got[n].labels.split(",")) - {""} == labels | base
        assert got[n].score == pytest.approx(score if labels else float(bool(base)))
    assert {label for label, *_ in licenses.TEMPLATES} <= set(got[1].labels.split(",")) and got[0].labels == ""


def test_license_scan_of_long_key_phrases(spark):
    phrase = "everyone may copy distribute and change this program provided notices remain"
    own = [("own", phrase, phrase), *licenses.TEMPLATES]
    df = spark.createDataFrame([(1, f"So: {phrase}."), (2, phrase.replace("remain", "go")), (3, "mit license")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in scan(df, templates=own).collect()}[1] == "own"
    assert {r.doc_id: r.labels for r in scan(df, templates=own).collect()}[2] == ""


def brute_ppm(sample, text, order):
    """Code length in nats of method C, from counts."""
    counts = [{} for _ in range(order + 1)]
    for t in sample:
        t = b" " * order + t.lower()
        for i in range(order, len(t)):
            for o in range(order + 1):
                counts[o].setdefault(t[i - o : i], Counter())[t[i]] += 1
    total, t = 0.0, b" " * order + text.lower()
    for i in range(order, len(t)):
        p = 1.0
        for o in range(order, -1, -1):
            c = counts[o].get(t[i - o : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if t[i] in c:
                p *= c[t[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        total -= np.log(p)
    return total


def trees_of(sample, order=3, **how):
    joined = lambda texts: gram_counts(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), order)
    return ContextTrees({name: joined(texts) for name, texts in sample.items()}, order, **how)


@pytest.mark.parametrize("order", [0, 1, 3, 6])
def test_code_lengths_equal_brute_force(order):
    rng = random.Random(order)
    sample = {"a": [b"the cat sat on the mat", b"The dog", b"a"], "b": ["été après la pluie".encode(), b"le chat"], "c": [bytes(rng.randrange(256) for _ in range(300))], "d": []}
    trees = trees_of(sample, order)
    texts = [b"the cat", "été".encode(), b"T", b"", b"le the 12", "привет, 日本".encode(), b"mat", bytes(range(256)), b"\x00\xff"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    got = trees.lengths(data, offsets)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([brute_ppm(sample[n], t, order) for n in "abcd"], rel=1e-5)
    small = trees_of(sample, order, most_bytes=100)  # too little even for order 0, which is what is left
    assert small.order == 0 and small.lowered == order
    assert small.lengths(data, offsets)[1] == pytest.approx([brute_ppm(sample[n], texts[1], 0) for n in "abcd"], rel=1e-5)


def test_many_languages_lower_the_order():
    """A hundred languages of letters of their own: tables stay within their bytes, and every language is told."""
    rng = np.random.default_rng(9)
    alphabets = [rng.permutation(26)[:12] + 97 for _ in range(100)]
    sample = {f"l{i:02d}": [rng.choice(a, 4000).astype(np.uint8).tobytes()] for i, a in enumerate(alphabets)}
    whole, small = trees_of(sample), trees_of(sample, most_bytes=1 << 20)
    assert (whole.order, small.order, small.lowered) == (3, 1, 2)
    for trees in (whole, small):
        assert trees.grams.values.nbytes + trees.escapes.values.nbytes <= 128 << 20
        tests = [rng.choice(a, 200).astype(np.uint8).tobytes() for a in alphabets]
        lengths = trees.lengths(np.frombuffer(b"".join(tests), np.uint8), np.arange(101) * 200)
        assert (lengths.argmin(axis=1) == np.arange(100)).all()


def test_language_scores_tell_mixed_texts():
    sample = {"a": [b"the cat sat on the mat and the dog ran to the house " * 5], "b": ["été après la pluie le chat dort dans la maison ".encode() * 5]}
    trees = trees_of(sample)
    shared = type("Shared", (), {"value": trees})
    rows = ["the dog and the cat ran " * 4, ("the dog ran to the house " + "le chat dort dans la pluie ") * 3, "zq7 xx ## kj " * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"])
    clear, mixed, junk = pa.Table.from_batches(list(langid._predict(shared, "t", 24)([batch])))["score"].to_pylist()
    assert clear > 0.999 and clear > mixed and clear > junk


def test_learning_is_bounded(spark):
    rows = [(1, "en", "the cat sat.")] * 900 + [(i, "fr" if i % 3 else "en", f"le chat {i:04d}") for i in range(2, 4000)]
    made = []
    real = langid.ContextTrees
    try:
        langid.ContextTrees = type("Seen", (), {"__init__": lambda self, counts, order: made.append(counts), "_grams": staticmethod(real._grams)})
        learn(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4))
    finally:
        langid.ContextTrees = real
    assert {k: int(n.sum()) for k, (_, n) in made[0].items()} == {"en": 300 * 12, "fr": 300 * 12}


def test_learning_gathers_grams_not_texts(spark):
    """Long texts reach no driver: what is gathered is as many rows as there are different grams."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"), F.repeat(F.when(F.col("id") % 2 == 0, F.lit("abc abd ")).otherwise(F.lit("xyz xyw ")), 200_000).alias("text"))
    trees = learn(docs)
    assert len(trees.grams.keys) < 120
    got = identify(docs.select("doc_id", "text"), trees)
    assert {(r.doc_id % 2, r.lang_pred) for r in got.collect()} == {(0, "a"), (1, "b")}


def test_language_id_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = learn(docs)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !!", "c"), (None, "the thing and the", "d"), (5, "привет", "e")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, trees).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en" and got[5][0] != "und" and all(0 <= s <= 1 for _, s in got.values())
    named = identify(docs, trees).collect()
    held = [r for r in named if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.99
    none = learn(docs.limit(0))
    assert {r.lang_pred for r in identify(odd, none).collect()} == {"und"} and identify(odd.limit(0), trees).count() == 0


def test_quality_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(got[i].held_out for i in held) and sum(got[i].predicted == marks[i] for i in held) / len(held) > 0.93
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "x")], "doc_id long, text string, quality string")
    rows = classify(odd, labels.limit(0)).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in rows) and classify(odd.limit(0), labels).count() == 0
    assert features(pa.array([None, ""])).sum() == 0


def brute_features(text):
    """The statistics of one text, word by word."""
    data = text.encode()
    n, ws = len(data), re.findall(rb"[^\x20\x09-\x0D]+", data)
    ls = [l for l in data.split(b"\n") if l]
    share = lambda chars: sum(data.count(bytes([c])) for c in chars) / n
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out = dict.fromkeys(FEATURES, 0.0)
    out |= {"log_bytes": np.log1p(n), "log_words": np.log1p(len(ws)), "log_lines": np.log1p(len(ls)), "mean_line": n / max(1, len(ls))}
    out |= {"upper": share(range(65, 91)), "digits": share(range(48, 58)), "marks": share(marks), "wide": share(range(128, 256)), "bars": share(b"|"), "bangs": share(b"!"), "symbols": share(b"#$%&*"), "stops": share(b".?"), "spaces": share(b"\t\n\x0b\x0c\r ")}
    out["entropy"] = -sum(k / n * np.log2(k / n) for k in Counter(data).values())
    if ws:
        low, k = [w.lower() for w in ws], len(ws)
        c = Counter(low)
        out |= {"mean_word": sum(map(len, ws)) / k, "max_word": max(map(len, ws)), "short_words": sum(len(w) <= 2 for w in ws) / k}
        out |= {"distinct_words": len(c) / k, "top_word": max(c.values()) / k, "repeats": sum(a == b for a, b in zip(low, low[1:])) / k, "twice": sum(v for v in c.values() if v > 1) / k}
        out |= {"marked_words": sum(w[-1] in marks for w in ws) / k, "capital_words": sum(2 * sum(65 <= x <= 90 for x in w) > len(w) for w in ws) / k}
    if ls:
        out["distinct_lines"] = len(set(ls)) / len(ls)
    return [out[f] for f in FEATURES]


def test_statistics_equal_brute_force():
    texts = ["The cat, the CAT sat!\nthe cat\n\nthe cat\nOK 12 | # é 日本", "a", "\n\n", "x " * 3000 + "end.", "word " * 300000]  # the last is longer than a piece
    got = features(pa.array(texts))
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx(brute_features(text), rel=1e-5, abs=1e-6)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = (x[:, 2] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    t = BoostedTrees(x, y, trees=1, depth=1, rate=0.2, bins=16, smooth=2.0)
    p = y.mean()
    grad, hess = y - p, np.full(300, p * (1 - p))
    gains = {}
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1]).astype(np.float32)):
            left = x[:, f] <= cut
            if min(hess[left].sum(), hess[~left].sum()) >= 2:
                gains[f, float(cut)] = sum(grad[m].sum() ** 2 / (hess[m].sum() + 2) for m in (left, ~left))
    f, cut = max(gains, key=gains.get)
    assert (t.feature[0, 0], float(t.threshold[0, 0])) == (f, cut)
    left = x[:, f] <= cut
    assert t.value[0] == pytest.approx([0.2 * grad[m].sum() / (hess[m].sum() + 2) for m in (left, ~left)])


def test_flat_trees_equal_recursion():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1)).astype(float)
    t = BoostedTrees(x, y, trees=30, depth=3)

    def walk(k, row, node=0):
        if node >= (1 << t.depth) - 1:
            return t.value[k, node - (1 << t.depth) + 1]
        return walk(k, row, 2 * node + 1 + int(row[t.feature[k, node]] > t.threshold[k, node]))

    want = [1 / (1 + np.exp(-(t.base + sum(walk(k, r) for k in range(30))))) for r in x[:20]]
    assert np.allclose(t.score(x[:20]), want) and ((t.score(x) > 0.5) == y).mean() > 0.97


def test_lines_of_one_long_document(spark):
    """A document of 120,000 lines, nearly all common: its places are found in linear time."""
    lines = [f"line number {i} is long enough to count as a passage" for i in range(30_000)]
    rows = [(d, "\n".join(lines)) for d in range(5)] + [(7, "\n".join(x for line in lines for x in (line, "", line.upper(), f"own {line}")))]
    rows += [(0, "\n".join(lines[:3])), (0, "\n".join(["short", lines[1]]))]  # rows of one doc_id with texts of their own
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    begun = time.time()
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text_kept[:60]) for r in dedup_lines(df).collect())
    assert time.time() - begun < 60
    assert got == sorted([(d, 30_000, 30_000, "") for d in range(5)] + [(0, 3, 3, ""), (0, 2, 1, "short"), (7, 120_000, 0, lines[0] + "\n\n" + lines[0].upper()[: 60 - len(lines[0]) - 2])])


def test_quality_gathers_one_row_a_document(spark):
    rng = random.Random(2)
    docs = [(i, ("word " * (3 + i % 9) + "!!!" * (i % 2)), i % 2) for i in range(160)]
    once = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    many = once.unionAll(spark.range(30_000).select(F.lit(docs[3][0]).cast("long"), F.lit(docs[3][1])))
    labels = spark.createDataFrame([(d, q, rng.random()) for d, _, q in docs], "doc_id long, quality int, x double")
    scores = lambda df: {(r.doc_id, round(r.score, 12)) for r in classify(df, labels).collect()}
    assert scores(many) == scores(once)
