"""DuckDB SQL that states the same results as the queries, for those that SQL can express."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS ss FROM w),
n AS (SELECT doc_id, len(ss) AS n FROM s),
e AS (SELECT doc_id, unnest(ss) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON id = doc_id
"""

OP7 = rf"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND doc_id <> last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL OR doc_id = last), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

OP9 = r"""
WITH e AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS solid, length(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS letters FROM documents),
d AS (SELECT *, len(w) AS size, greatest(len(w), 1) AS n, len(list_distinct(w)) AS distinct_ FROM e),
k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / ((1 + CASE WHEN solid BETWEEN 4 * n AND 10 * n THEN 5 WHEN solid BETWEEN 3 * n AND 12 * n THEN 2 ELSE 0 END
        + letters * 5 // greatest(solid, 1) + least(5, distinct_ * distinct_ // (4 * n))) / 16.0::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
c AS (SELECT *, [3.0, 1.0, 2.0][(i % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest, sum(source_size) OVER () * 1.5 AS budget
  FROM c WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((budget - capped) / rest, (cap / w, i)) AS level FROM o WHERE cap >= (budget - capped) / rest * w),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM c CROSS JOIN v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS epochs FROM t),
g AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size
    - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM g
"""

OP1 = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, id = c AS kept FROM m LEFT JOIN n ON a = id
"""


def op4() -> str:
    """The licence scan in SQL, with the templates and phrases as VALUES."""
    from .licenses import BASE_PHRASES, TEMPLATES, template_words

    listed = lambda words: "[" + ", ".join(map(repr, words)) + "]"
    texts = ", ".join(f"({t}, {label!r}, {listed(template_words(text))}, {listed(template_words(phrase))})" for t, (label, text, phrase) in enumerate(TEMPLATES))
    base = ", ".join(f"({label!r}, {listed(template_words(phrase))})" for phrase, label in BASE_PHRASES.items())
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
tp AS (SELECT * FROM (VALUES {texts}) x(template, label, words, phrase)),
bp AS (SELECT * FROM (VALUES {base}) x(label, phrase)),
b AS (SELECT doc_id, i - 1 AS pos, label FROM u JOIN bp ON u.word = bp.phrase[1] AND u.w[i:i + len(phrase) - 1] = phrase),
g AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM b GROUP BY doc_id),
p AS (SELECT template, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS at_ FROM tp),
idf AS (SELECT word, ln(1 + (SELECT count(*) FROM documents) / count(DISTINCT doc_id)) AS idf FROM u WHERE word IN (SELECT word FROM p) GROUP BY word),
k AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY idf DESC, word) AS r FROM (SELECT DISTINCT template, word, idf FROM p JOIN idf USING (word))),
top AS (SELECT * FROM k WHERE r <= 6),
need AS (SELECT template, sum(idf) AS need FROM top GROUP BY template),
a AS (SELECT u.doc_id, p.template, i - 1 - at_ AS shift, need, sum(idf) AS got FROM u JOIN p USING (word) JOIN top USING (template, word) JOIN need USING (template) GROUP BY ALL),
s AS (SELECT doc_id, template, shift, least(1.0::DOUBLE, got / need) AS share FROM a WHERE least(1.0::DOUBLE, got / need) >= 0.6),
f AS (SELECT doc_id, template, i - 1 AS start FROM u JOIN tp ON u.word = tp.phrase[1] AND u.w[i:i + len(phrase) - 1] = phrase),
own AS (SELECT template, label, [x FOR x IN range(len(words)) IF words[x + 1:x + len(phrase)] = phrase][1] AS place FROM tp),
m AS (SELECT s.doc_id, label, share FROM s JOIN f ON f.doc_id = s.doc_id AND f.template = s.template JOIN own ON own.template = s.template WHERE abs(start - shift - place) <= 8),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
c AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bl.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  round(coalesce(share, CASE WHEN n_base > 0 THEN 1 ELSE 0 END)::DOUBLE, 6) AS score
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN bl ON bl.doc_id = t.doc_id LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
"""


OP4 = op4()


def op11(entries: int = 256, rounds: int = 4) -> str:
    """Codes by integer codebooks: a list of entries for each part, assigned and averaged ``rounds`` times."""
    ctes = []
    for r in range(rounds + 1):
        ctes.append(f"""
a{r} AS (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, p.x, b.entry, list_sum([(p.x[i] - b.c[i]) * (p.x[i] - b.c[i]) FOR i IN range(1, len(p.x) + 1)])::BIGINT AS d FROM p JOIN b{r} b USING (part)) p
  JOIN b{r} b ON b.part = p.part AND b.entry = p.entry GROUP BY p.vec_id, p.part)""")
        if r < rounds:
            ctes.append(f"""
u{r} AS (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{r}),
g{r} AS (SELECT part, entry, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM u{r} GROUP BY ALL),
m{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM g{r} GROUP BY ALL),
b{r + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH v AS (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM v CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries}),{",".join(ctes)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN v USING (vec_id) CROSS JOIN h
"""


OP11 = op11()

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT row, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS kinds FROM k GROUP BY lang),
l AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + kinds) AS p,
    1 + (1000000000::HUGEINT * (t.n + 1)) // (l.total + kinds) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN l USING (lang) JOIN t USING (lang, term)
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200
"""


def op13(depth: int = 6, fan: int = 8) -> str:
    """The rules, then the tree of templates, level by level."""
    from .urls import RULES

    rules = ", ".join(f"({verdict!r}, {rule!r}, {rule.split('/', 1)[0]!r}, {'/' + rule.split('/', 1)[1]!r})" for verdict, rule in RULES)
    ctes = []
    for i in range(depth + 1):
        ctes.append(f"""
q{i} AS (SELECT *, segs[{i + 1}] AS seg, CASE WHEN len(segs) > {i + 1} THEN segs[{i + 2}] ELSE '/' END AS next FROM l{i} WHERE len(segs) > {i}),
c{i} AS (SELECT host, prefix, seg, sum(n) AS n, count(*) OVER (PARTITION BY host, prefix) AS shapes, sum(sum(n)) OVER (PARTITION BY host, prefix) AS pages FROM q{i} GROUP BY host, prefix, seg),
b{i} AS (SELECT host, prefix, seg, CASE WHEN shapes > {fan} AND n * {fan} < pages THEN '*' ELSE seg END AS branch FROM c{i}),
s{i} AS (SELECT host, prefix, branch, next, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM q{i} JOIN b{i} USING (host, prefix, seg) GROUP BY ALL),
e{i} AS (SELECT host, prefix, branch, sum(n) AS n, sum(bad) AS bad, sum(good) AS good, sum(sum(n)) OVER w AS tn, sum(sum(bad)) OVER w AS tbad, sum(sum(good)) OVER w AS tgood
  FROM s{i} GROUP BY host, prefix, branch WINDOW w AS (PARTITION BY host, prefix)),
a{i} AS (SELECT *, sum(n) OVER (PARTITION BY host, prefix, next) AS every_ FROM s{i}),
m{i} AS (SELECT host, prefix, branch, sum(least(a.n::HUGEINT * tn, every_::HUGEINT * e.n))::DOUBLE AS met FROM a{i} a JOIN e{i} e USING (host, prefix, branch) GROUP BY ALL),
f{i} AS (SELECT *, bad + good AS labelled, tbad::DOUBLE / greatest(1, tbad + tgood) AS rate, 1 - met / (n::DOUBLE * tn::DOUBLE) <= 0.25::DOUBLE + 1 / sqrt(n::DOUBLE) AS alike FROM e{i} JOIN m{i} USING (host, prefix, branch)),
k{i} AS (SELECT host, prefix, branch, CASE WHEN NOT alike THEN '=' || branch WHEN labelled = 0 THEN 'none'
  WHEN abs(bad::DOUBLE - rate * labelled::DOUBLE) <= 2.58::DOUBLE * sqrt(rate * (1 - rate) * labelled::DOUBLE) THEN 'some' ELSE '=' || branch END AS grp FROM f{i}),
j{i} AS (SELECT host, prefix, grp, CASE WHEN count(*) = 1 THEN any_value(branch) ELSE '{{' || string_agg(branch, '|' ORDER BY branch) || '}}' END AS name FROM k{i} GROUP BY ALL),
l{i + 1} AS (SELECT host, segs, n, bad, good, CASE WHEN len(segs) > {i} THEN prefix || '/' || name ELSE prefix END AS prefix
  FROM (SELECT *, CASE WHEN len(segs) > {i} THEN segs[{i + 1}] END AS seg FROM l{i}) LEFT JOIN (b{i} JOIN k{i} USING (host, prefix, branch) JOIN j{i} USING (host, prefix, grp)) USING (host, prefix, seg))""")
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url[instr(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), {_AZ}) AS host, regexp_replace(rest, '^[^/]*', '') AS path FROM u),
r AS (SELECT * FROM (VALUES {rules}) x(kind, rule, at_, start)),
o AS (SELECT row_number() OVER () AS row, * FROM h),
w AS (SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind FROM o JOIN r ON (host = at_ OR ends_with(host, '.' || at_)) AND starts_with(path, start) GROUP BY row),
z AS (SELECT o.*, rule, kind, CASE WHEN path = '' THEN [] ELSE string_split(path[2:], '/') END AS parts FROM o LEFT JOIN w USING (row)),
y AS (SELECT *, [CASE WHEN regexp_full_match(s, '[0-9A-Fa-f-]{{16,}}') OR length(regexp_replace(s, '[0-9]+', '0', 'g')) > 64 THEN 'x' ELSE regexp_replace(s, '[0-9]+', '0', 'g') END FOR s IN parts[1:{depth}]]
  || CASE WHEN len(parts) > {depth} THEN ['**'] ELSE [] END AS segs FROM z),
l0 AS (SELECT host, segs, count(*) AS n, count(*) FILTER (kind = 'block') AS bad, count(*) FILTER (kind = 'allow') AS good, '' AS prefix FROM y GROUP BY host, segs),
base AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(bad) + sum(good) + 2)::DOUBLE AS base FROM l0),{",".join(ctes)},
t AS (SELECT host, prefix, sum(bad) > 0 AS seen, (sum(bad)::DOUBLE + 4 * base) / (sum(bad) + sum(good) + 4)::DOUBLE AS purity FROM l{depth + 1} CROSS JOIN base GROUP BY host, prefix, base)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN seen AND purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, prefix AS template, round(purity, 9) AS purity
FROM y JOIN l{depth + 1} USING (host, segs) JOIN t USING (host, prefix)
"""


OP13 = op13()
