"""Vector codes, source divergence and URL filters against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkspec.llm import codes, divergence
from sparkspec.llm.codes import compress, nearest
from sparkspec.llm.divergence import audit
from sparkspec.llm.urls import RULES, judge_urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("width", [1, 3, 4, 5, 16, 33])
def test_partial_distances_equal_whole_ones(width):
    rng = np.random.default_rng(width)
    book = rng.integers(-9, 9, (40, width))
    book[7] = book[3]  # a tie of whole entries
    rows = np.concatenate([rng.integers(-9, 9, (700, width)), book[[7, 3]], np.full((2, width), 1 << 26)])
    whole = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    index, least = nearest(rows, book, block=64)
    assert (index == whole.argmin(axis=1)).all() and (least == whole.min(axis=1)).all()


def brute_codes(rows, entries, rounds):
    ints = {i: [math.floor(1024 * float(x)) for x in v] for i, v in rows.items()}
    width = len(next(iter(ints.values()))) // 4
    parts = [{i: v[p * width : (p + 1) * width] for i, v in ints.items()} for p in range(4)]
    books = [[part[i] for i in sorted(ints)[:entries]] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for part, book in zip(parts, books):
            got = defaultdict(list)
            for x in part.values():
                got[near(x, book)[1]].append(x)
            for j, xs in got.items():
                book[j] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = {i: [near(part[i], book) for part, book in zip(parts, books)] for i in ints}
    return {i: ("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for i, f in found.items()}, digest


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=12).astype(np.float32).tolist() for i in range(-40, 160)}
    rows |= {i: rows[0] for i in range(160, 260)}  # a third of all rows is one vector
    label = lambda i: None if i % 7 == 0 else i % 3
    good = [(i, v, label(i), "x", 1) for i, v in rows.items()]
    bad = [(900, None, 1, "x", 1), (901, [1.0, None] * 6, 1, "x", 1), (902, [float("nan")] * 12, 1, "x", 1), (903, [float("inf")] * 12, None, "x", 1)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int, _label string, dim int").repartition(7)
    got = {r.vec_id: r for r in compress(df, entries=20, rounds=4).collect()}
    want, digest = brute_codes(rows, 20, 4)
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    sums = Counter()
    for i, (_, e) in want.items():
        sums[label(i)] += e
    assert all(r.label_error == sums[label(i)] for i, r in got.items())
    assert compress(df.limit(0)).count() == 0


def test_codes_of_odd_rows(spark):
    rows = [(None, [1.0] * 5, None), (1, [0.5] * 5, 1), (1, [0.5] * 5, 1), (1, [0.25] * 5, 1), (2, [], 2), (3, [1e30] * 5, 3), (4, [-1e30] * 5, 3), (5, [2.0, 2.0], None)]
    got = compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert len(got) == len(rows) and all(r.error == 0 for r in got)  # each is an entry of its own length's codebooks
    assert len({r.codebooks_sha256 for r in got}) == 3
    assert sorted(r.code for r in got if r.vec_id == 1) == ["00000000", "01010100", "01010100"]  # the last part is zeros alone, and a tie


def brute_audit(docs, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    words = [(lang or "", source or "", term.findall((text or "").translate(LOW))) for text, lang, source in docs]
    out = set()
    for lang in {w[0] for w in words}:
        held = Counter(t for l, _, ws in words if l == lang for t in set(ws))
        kept = sorted(t for t, n in held.items() if n >= least)
        groups = {s: Counter(t for l, s2, ws in words if (l, s2) == (lang, s) for t in ws if held[t] >= least) for s in {w[1] for w in words if w[0] == lang}}
        p_of = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: p_of(c) for s, c in groups.items()}
        q = p_of(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, i.decode(), -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found)}
    return out


def corpus(seed, n, sources):
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(n):
        lang, source = ["en", "de", None][min(2, int(rng.integers(0, 5)) // 2)], f"s{min(int(rng.integers(0, 2 * sources)), sources - 1)}"
        words = [f"{'Éa'[j % 2]}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}" for j in (rng.zipf(1.3, int(rng.integers(0, 40))) % 300)]
        docs.append((" ".join(w.upper() if rng.random() < 0.1 else w for w in words) + ["", "!", " 12 x_y"][i % 3], lang, source if i % 11 else None))
    return docs


@pytest.mark.parametrize("how", [{}, {"block": 3, "rows": 40}, {"heavy": 0.0}, {"heavy": 2.0, "block": 4}, {"top": 2, "least_docs": 1, "rows": 100}])
def test_divergence_equals_brute_force(spark, how):
    docs = corpus(1, 240, 13) + [(None, "en", "bare"), ("", "xx", "a"), ("one", "xx", "b"), ("lonely lonely", "yy", None), ("dup dup Dup", "en", "s1")] + [("dup dup Dup", "en", "s2")] * 3
    df = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], "text string, lang string, source string, term string, n long, p int").repartition(5)
    got = [tuple(r) for r in audit(df, **how).collect()]
    want = brute_audit(docs, how.get("least_docs", 3), how.get("top", 200))
    assert len(got) == len(set(got)) and set(got) == want


def test_divergence_of_nothing_and_of_long_texts(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert audit(empty).count() == 0
    long_text = "ab cd " * 1_500_000 + "ef"  # over one piece
    docs = [(long_text, "en", "a"), ("ab ef", "en", "b"), ("ab cd ef", "en", "b")]
    got = {tuple(r) for r in audit(spark.createDataFrame(docs, "text string, lang string, source string")).collect()}
    assert got == brute_audit(docs)


def test_probabilities_are_exact_beyond_64_bits(spark):
    n, total, kinds = 10**15 + 7, 3 * 10**15 + 11, 10**9 + 3
    row = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(kinds)).alias("p"), divergence.difference(F.lit(1 + 10**9).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + kinds) and row.f == 10**18


def shapes(path, depth=6):
    parts = (path[1:] if path.startswith("/") else path).split("/") if path else []
    shape = lambda s: "x" if re.fullmatch("[0-9A-Fa-f-]{16,}", s) or len(re.sub("[0-9]+", "0", s)) > 64 else re.sub("[0-9]+", "0", s)
    return tuple(map(shape, parts[:depth])) + (("**",) if len(parts) > depth else ())


def brute_urls(rows, depth=6, fan=8):
    """(host, path, rule, verdict, template) for each (url, label)."""
    out, seen = [], []
    for url, label in rows:
        rest = re.match(r"[^?#]*", url.partition("://")[2], re.S)[0] if url else ""
        host, path = rest.partition("/")[0].translate(LOW), rest[len(rest.partition("/")[0]) :]
        fits = [(len(r), -i, r, k) for i, (k, r) in enumerate(RULES) if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule, kind = max(fits)[2:] if fits else (None, None)
        out.append([host, path, rule, kind])
        seen.append((host, shapes(path, depth), (kind == "block") if kind else label))
    name = [""] * len(rows)
    for i in range(depth + 1):
        step = dict()
        key = lambda j: (seen[j][0], name[j])
        for node, at in groupby(sorted((j for j in range(len(rows)) if len(seen[j][1]) > i), key=key), key):
            at = list(at)
            count = Counter(seen[j][1][i] for j in at)
            branch = {j: "*" if len(count) > fan and count[seen[j][1][i]] * fan < len(at) else seen[j][1][i] for j in at}
            follows = lambda js: Counter(seen[j][1][i + 1] if len(seen[j][1]) > i + 1 else "/" for j in js)
            whole, labelled = follows(at), [seen[j][2] for j in at if seen[j][2] is not None]
            rate = sum(labelled) / max(1, len(labelled))
            merged = defaultdict(set)
            for b in set(branch.values()):
                mine = [j for j in at if branch[j] == b]
                own = follows(mine)
                met = sum(min(n * len(at), whole[s] * len(mine)) for s, n in own.items())
                known = [seen[j][2] for j in mine if seen[j][2] is not None]
                fair = abs(sum(known) - rate * len(known)) <= 2.58 * math.sqrt(rate * (1 - rate) * len(known))
                alike = 1 - met / (len(mine) * len(at)) <= 0.25 + 1 / math.sqrt(len(mine))
                merged["=" + b if not alike else "none" if not known else "some" if fair else "=" + b].add(b)
            named = {b: b if len(bs) == 1 else "{" + "|".join(sorted(bs)) + "}" for bs in merged.values() for b in bs}
            step |= {j: name[j] + "/" + named[branch[j]] for j in at}
        name = [step.get(j, n) for j, n in enumerate(name)]
    marked = [s[2] for s in seen if s[2] is not None]
    base = (sum(marked) + 1) / (len(marked) + 2)
    held = defaultdict(list)
    for (host, _, label), t in zip(seen, name):
        if label is not None:
            held[host, t].append(label)
    for row, t in zip(out, name):
        known = held[row[0], t]
        row[3] = row[3] or ("block" if sum(known) and (sum(known) + 4 * base) / (len(known) + 4) >= 0.5 else "allow")
        row.append(t)
    return [tuple(r) for r in out]


def urls():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        host = ["shop.example.net", "Shop.Example.NET", "a.example.org", "b.com", "example.org:80", "org", "deep.net"][int(rng.integers(0, 7))]
        kind = int(rng.integers(0, 6))
        path = [f"/item/{rng.integers(0, 999)}", f"/tag/w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/list", f"/{['en', 'es', 'de', 'fr'][i % 4]}/{rng.integers(0, 999)}", f"/u/{rng.integers(0, 2**60):x}0000000000/a/b/c/d/e/f", "", "/"][kind]
        label = None if rng.random() < 0.4 else bool(kind == 1 and i % 9)  # tag pages are to be blocked
        rows.append((f"{['http', 'https'][i % 2]}://{host}{path}{['', '?q=a/b', '#x/y'][i % 3]}", label))
    odd = [None, "", "no scheme.example.net/a", "://", "http://x.org/en/1\nz", "http://x.org?u=http://com/de/1", "http://example.org/en/12", "ftp://EXAMPLE.org/es/", "http://com/fr/9", "http://é.net/Ü/" + "y" * 5000]
    return rows + [(u, None) for u in odd] + [("http://only.net/a/b", True)] * 40


def test_urls_equal_brute_force(spark):
    rows = urls()
    df = spark.createDataFrame([(None if i % 50 == 0 else i, u, b, f"h{i}", i) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean, host string, n int").repartition(6)
    got = judge_urls(df, labels="bad").collect()
    want = brute_urls(rows)
    assert sorted((r.n, r.host, r.path, r.rule or "", r.verdict, r.template) for r in got) == sorted((i, *w[:2], w[2] or "", *w[3:]) for i, w in enumerate(want))
    by = {r.n: r for r in got}
    assert sum(r.verdict == "block" and r.rule is None for r in got) > 100  # tag pages without a rule, and only.net
    assert {by[i].verdict for i, (u, b) in enumerate(rows) if u and "/item/" in u and by[i].rule is None} == {"allow"}
    assert by[len(rows) - 1].verdict == "block" and by[900].host == "" and by[900].rule is None


def test_urls_of_nothing_and_without_labels(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(df).count() == 0
    plain = spark.createDataFrame([(1, "http://a.net/x/1"), (1, "http://a.net/x/1"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in judge_urls(plain).collect()) == ["allow"] * 3


def test_no_driver_side_terms():
    """The audit and the codes gather no rows of terms or vectors: only codebooks and their sums reach the driver."""
    import inspect

    assert "collect" not in inspect.getsource(divergence) and inspect.getsource(codes).count("toArrow") == 2
