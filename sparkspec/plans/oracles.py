"""DuckDB SQL for the operator queries."""

from __future__ import annotations

from ..functions.chemistry import MASS, Z, parse_formula

_ELEMENTS = ["Fe", "Mg", "Ca", "Al", "Si", "O"]
_KINDS = ["AF", "AO", "NF", "NO", "RF", "RO"]
_EL = "el AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{e}', {Z[e]}::DOUBLE, {MASS[e]}::DOUBLE)" for k, e in zip(_KINDS, _ELEMENTS)) + ") t(kind, element, z, mass))"
_C = _EL + """,
q AS (SELECT l_suppkey, element, z, mass, sum(l_quantity) AS q FROM lineitem JOIN el ON kind = l_returnflag || l_linestatus GROUP BY ALL),
c AS (SELECT l_suppkey, element, z, mass, q / sum(q) OVER (PARTITION BY l_suppkey) AS w_fr FROM q)"""
_AT = _C + """,
a AS (SELECT *, (w_fr / mass) / sum(w_fr / mass) OVER (PARTITION BY l_suppkey) AS at_fr FROM c)"""
_S = """ch AS (SELECT user_id, floor(value / 10)::INT AS channel, count(*) AS n FROM events GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT u.user_id, r.i::INT AS channel, coalesce(ch.n, 0)::DOUBLE AS n FROM u CROSS JOIN (SELECT unnest(range(least(0, min(channel)), greatest(60, max(channel) + 1))) AS i FROM ch) r LEFT JOIN ch ON ch.user_id = u.user_id AND ch.channel = r.i)"""
_R = """o AS (SELECT o_orderkey, o_custkey, o_orderkey % 11 - 1 AS quant_flag, (o_totalprice % 100) / 500 - 0.1 AS an_err, o_orderkey % 13 <> 0 AS quantified FROM orders),
r AS (SELECT *, CASE WHEN NOT quantified THEN 'null' WHEN quant_flag NOT IN (0, -1) THEN 'flagged' WHEN an_err > 0.05 OR an_err < -(0.05 + 0.02) THEN 'error' ELSE 'good' END AS reason FROM o)"""
_V = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, (generate_subscripts(embedding, 1) - 1)::INT AS component FROM embeddings)"""


def _lloyd(rounds: int = 4) -> str:
    """Lloyd's rounds from the first vectors of even and odd labels, a materialised step each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT p.s, k, vec_id, arg_min(cluster, (list_sum([(p.fr[i] - c.fr[i]) ** 2 FOR i IN range(1, len(p.fr) + 1)]), cluster)) AS cluster FROM p JOIN c{r} c ON c.s = p.s GROUP BY p.s, k, vec_id),
x{r} AS (SELECT d.s, d.k, d.cluster, vec_id, unnest(fr) AS x, generate_subscripts(fr, 1) AS i FROM d{r} d JOIN p USING (vec_id)),
m{r} AS MATERIALIZED (SELECT s, k, cluster, i, avg(x) AS m, count(*) AS n, count(*) * var_pop(x) AS w FROM x{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT s, k, cluster, coalesce(m.fr, c.fr) AS fr FROM c{r} c LEFT JOIN (SELECT s, k, cluster, list(m ORDER BY i) AS fr FROM m{r} GROUP BY ALL) m USING (s, k, cluster))""")
    return ",\n".join(steps)


_STATS = _V + """,
f AS (SELECT label, component, avg(value) AS mean, stddev_samp(value) AS std FROM v GROUP BY ALL),
g AS (SELECT v.label, count(DISTINCT vec_id) AS n_points, sum((value - mean) ** 2) AS wcss FROM v JOIN f USING (label, component) GROUP BY v.label)"""
_P = """p AS (SELECT vec_id, label, [x::DOUBLE * 0.03 FOR x IN embedding] AS fr FROM embeddings),
ref AS (SELECT label AS ref_idx, 'R' || label AS formula, arg_min(fr, vec_id) AS h, (label + 1)::DOUBLE AS w FROM p GROUP BY label)"""
_M = _P + """,
x AS (SELECT label, vec_id, unnest(fr) AS value, generate_subscripts(fr, 1) AS i FROM p),
mean AS (SELECT label, i, avg(value) AS m FROM x GROUP BY ALL),
rms AS (SELECT x.label, count(DISTINCT vec_id) AS n_points, sqrt(sum((value - m) ** 2) / count(DISTINCT vec_id)) AS rms FROM x JOIN mean USING (label, i) GROUP BY x.label),
ce AS (SELECT label, list(m ORDER BY i) AS fr FROM mean GROUP BY label),
d AS (SELECT ce.label, ref_idx, formula, rms, sqrt(list_sum([(ce.fr[i] - h[i]) ** 2 FOR i IN range(1, len(h) + 1)])) AS distance FROM ce JOIN rms USING (label) CROSS JOIN ref),
n AS (SELECT *, exp(-distance * distance / (2 * 0.03 * 0.03)) AS raw_conf FROM d WHERE distance < greatest(0.1, rms * 5)),
k AS (SELECT *, raw_conf * exp(-((1 - raw_conf) ** 2) / (2 * 0.3 * 0.3)) / sum(exp(-((1 - raw_conf) ** 2) / (2 * 0.3 * 0.3))) OVER (PARTITION BY label) AS conf FROM n)"""
_LIB = """lib AS (SELECT p_brand AS el_line, 'std' || (p_partkey % 300) AS std_id, p_retailprice AS corrected_pb, p_size > 10 AS use_for_mean FROM part),
means AS (SELECT el_line, avg(corrected_pb) AS mean_pb, stddev_pop(corrected_pb) AS std_pb, count(*) AS n_standards FROM lib WHERE use_for_mean AND std_id <> 'Mean' GROUP BY el_line)"""
_D = """ar AS (SELECT event_type AS frame_id, event_id AS particle_id, value AS area, 2 * sqrt(value / pi()) AS diameter FROM events)"""
_LINES = """lt AS (SELECT * FROM (VALUES ('Fe', 'Ka1', 6.4, 1.0), ('Fe', 'Kb1', 7.06, 0.13), ('Fe', 'La1', 0.7, 1.0), ('Mg', 'Ka1', 1.25, 1.0), ('Ca', 'Ka1', 3.69, 1.0), ('Ca', 'Kb1', 4.01, 0.13), ('Al', 'Ka1', 1.49, 1.0), ('Si', 'Ka1', 1.74, 1.0), ('O', 'Ka1', 0.525, 1.0)) t(element, line, e, w)),
li AS (SELECT element, line, e::DOUBLE AS e, w::DOUBLE AS w FROM lt)"""



def _phases(*formulas: str) -> str:
    """Rows (index, formula, element, atomic fraction) over the six elements."""
    rows = []
    for i, formula in enumerate(formulas):
        amounts = {e: parse_formula(formula).get(e, 0.0) for e in _ELEMENTS}
        rows += [f"({i}, '{formula}', '{e}', {n / sum(amounts.values())!r}::DOUBLE)" for e, n in amounts.items()]
    return ", ".join(rows)


_PHASES = _phases("Fe2Mg5Ca3Al4Si4O7", "FeMg2CaAl2Si2O3", "FeMg2CaAl2Si2O4", "CaMgSi2O6", "Mg2SiO4")

ORACLE_SQL = {
    "json_prop_extract": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
    "spectrum_histogram": "SELECT user_id, floor(value / 10)::INT AS channel, count(*) AS n FROM events GROUP BY ALL",
    "spectrum_total_counts": f"WITH {_S} SELECT user_id, sum(n) AS total FROM s GROUP BY user_id",
    "spectrum_smooth": f"WITH {_S} SELECT user_id, channel, round((coalesce(lag(n) OVER w, 0) + n + coalesce(lead(n) OVER w, 0)) / 3, 6) AS value FROM s WINDOW w AS (PARTITION BY user_id ORDER BY channel)",
    "spectrum_validity_flag": f"""WITH {_S},
t AS (SELECT user_id, sum(n) AS total FROM s GROUP BY user_id),
b AS (SELECT user_id, channel, (coalesce(lag(n) OVER w, 0) + n + coalesce(lead(n) OVER w, 0)) / 3 AS m FROM s WHERE n > 0 AND 0.0 + 0.1 * channel < 2.0 WINDOW w AS (PARTITION BY user_id ORDER BY channel)),
l AS (SELECT user_id, bool_and(m < 1.4) AS low FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m) AS r FROM b) WHERE r <= 20 GROUP BY user_id)
SELECT t.user_id, CASE WHEN total < 0.9 * 66.0 THEN 2 WHEN coalesce(low, true) THEN 3 ELSE 0 END AS flag FROM t LEFT JOIN l USING (user_id)""",
    "composition_mass_fraction": f"WITH {_C} SELECT l_suppkey, element, round(w_fr, 6) AS w_fr FROM c",
    "mass_to_atomic": f"WITH {_AT} SELECT l_suppkey, element, round(at_fr, 6) AS at_fr FROM a",
    "atomic_to_mass_roundtrip": f"WITH {_AT} SELECT l_suppkey, element, round(at_fr * mass / sum(at_fr * mass) OVER (PARTITION BY l_suppkey), 6) AS w_fr FROM a",
    "mean_atomic_number": f"""WITH {_AT} SELECT l_suppkey, round(sum(w_fr * z), 6) AS z_mass, round(sum(at_fr * z), 6) AS z_atomic, round(sum(w_fr * z * z / mass) / sum(w_fr * z / mass), 6) AS z_markowicz,
round(sum(w_fr * z ** 1.75 / mass) / sum(w_fr * z ** 0.75 / mass), 6) AS z_statham FROM a GROUP BY l_suppkey""",
    "normalise_mass_fractions": f"""WITH {_C}, x AS (SELECT l_suppkey, element, w_fr * (0.8 + l_suppkey % 5 * 0.1) AS w FROM c), t AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM x)
SELECT l_suppkey, element, round(CASE WHEN t > 1 THEN w / t WHEN t < 0.95 THEN w / t * 0.95 ELSE w END, 6) AS w_fr FROM t""",
    "select_good": f"WITH {_R} SELECT o_orderkey, reason FROM r",
    "discard_report": f"""WITH {_R} SELECT o_custkey, count(*) AS n, count(*) FILTER (reason = 'good') AS n_good, count(*) FILTER (reason = 'null') AS n_null, count(*) FILTER (reason = 'flagged') AS n_flagged,
count(*) FILTER (reason = 'error') AS n_error, count(*) FILTER (reason = 'flagged') > 0.5 * count(*) AS warn FROM r GROUP BY o_custkey""",
    "post_fit_flag": """WITH k AS (SELECT o_orderkey, o_orderkey % 7 AS b, o_orderkey % 17 = 0 AS failed, o_orderkey % 5 = 0 AS dirty, o_orderkey % 30 AS ground, o_orderkey % 19 <> 0 AS ok FROM orders)
SELECT o_orderkey, CASE WHEN NOT ok AND NOT failed THEN -1 WHEN failed THEN 9 WHEN b < 3 THEN b + 4 WHEN dirty THEN 7 WHEN ground < 4 THEN 8 ELSE 0 END::INT AS flag FROM k""",
    "first_spot_contaminated": f"""WITH {_S}, t AS (SELECT user_id, sum(n) AS total FROM s GROUP BY user_id), f AS (SELECT *, row_number() OVER (PARTITION BY user_id % 40 ORDER BY user_id) AS r FROM t)
SELECT 's' AS sample_id, user_id % 40 AS particle_id FROM f WHERE r = 1 AND total < 0.95 * 70""",
    "substrate_contamination": f"WITH {_C} SELECT 's' AS sample_id, l_suppkey AS spectrum_id, min(element) AS element FROM c WHERE element IN ('Al', 'Si') AND w_fr > 0.17 GROUP BY l_suppkey",
    "cluster_stats": f"WITH {_STATS} SELECT label, component, round(mean, 6) AS mean, round(std, 6) AS std FROM f",
    "cluster_rms": f"WITH {_STATS} SELECT label, n_points, round(wcss, 6) AS wcss, round(sqrt(wcss / n_points), 6) AS rms FROM g",
    "cluster_reference_match": f"WITH {_M} SELECT label, ref_idx, round(distance, 6) AS distance, round(raw_conf, 6) AS raw_conf, round(conf, 6) AS conf FROM k",
    "cluster_reference_wide": f"""WITH {_M}, rk AS (SELECT label, formula, round_even(conf, 2) AS conf, row_number() OVER (PARTITION BY label ORDER BY conf DESC, ref_idx) AS r FROM k WHERE conf > 0.01)
SELECT label, max(formula) FILTER (r = 1) AS ref1, max(conf) FILTER (r = 1) AS conf1, max(formula) FILTER (r = 2) AS ref2, max(conf) FILTER (r = 2) AS conf2, max(formula) FILTER (r = 3) AS ref3, max(conf) FILTER (r = 3) AS conf3 FROM rk GROUP BY label""",
    "convergence": f"""WITH {_M}, b AS (SELECT label, max(conf) AS best FROM k GROUP BY label), z AS (SELECT (SELECT max(rms) FROM rms) AS max_rms, (SELECT min(best) FROM b) AS min_conf)
SELECT round(max_rms, 6) AS max_rms, round(min_conf, 6) AS min_conf, CASE WHEN min_conf IS NULL THEN max_rms < 0.025 ELSE min_conf > 0.8 AND max_rms < 0.03 END AS with_refs, max_rms < 0.025 AS without_refs FROM z""",
    "pairwise_mixture_fit": f"""WITH {_P}, pr AS (SELECT a.ref_idx AS ref1, b.ref_idx AS ref2, a.h AS h1, b.h AS h2, a.w / b.w AS r FROM ref a JOIN ref b ON a.ref_idx < b.ref_idx),
w AS (SELECT label, ref1, ref2, fr, h1, h2, r, least(1, greatest(0, list_sum([(fr[i] - h2[i]) * (h1[i] - h2[i]) FOR i IN range(1, len(fr) + 1)]) / list_sum([(h1[i] - h2[i]) ** 2 FOR i IN range(1, len(fr) + 1)]))) AS s FROM p CROSS JOIN pr),
e AS (SELECT label, ref1, ref2, fr, list_sum([exp(15 * abs(fr[i] - (h1[i] * s + h2[i] * (1 - s)))) - 1 FOR i IN range(1, len(fr) + 1)]) AS e, r, s, (1 - s) * r / (1 - (1 - s) * (1 - r)) AS x2 FROM w),
m AS (SELECT *, s * (1 + x2 * (1 / r - 1)) AS x1 FROM e),
t AS (SELECT label, ref1, ref2, count(*) AS n, sum(e) / sum(len(fr)) AS error, avg(x1) AS mm, stddev_pop(x1) AS ms FROM m GROUP BY ALL)
SELECT label, ref1, ref2, n, round(error, 5) AS error, round(CASE WHEN error < 2 THEN exp(-error * error / 0.5) END, 5) AS conf, round(mm, 5) AS molar_fr_mean, round(ms, 5) AS molar_fr_std FROM t""",
    "silhouette_exact": """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, label, max(m) FILTER (label = other) AS own, min(m) FILTER (label <> other) AS near FROM d GROUP BY ALL)
SELECT vec_id, label, round(CASE WHEN own IS NULL OR near IS NULL THEN 0 ELSE (near - own) / greatest(near, own) END, 5) AS silhouette FROM s""",
    "k_vote": """WITH v AS (SELECT p_brand, p_size % 6 + 1 AS k, count(*) AS votes FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(votes, 1, 0) OVER w AS second, max(votes) OVER (PARTITION BY p_brand) AS top FROM v WINDOW w AS (PARTITION BY p_brand ORDER BY votes DESC, k))
SELECT p_brand, max(k) FILTER (r = 1) AS top_k, (CASE WHEN bool_or(r = 1 AND votes >= 2 * second) THEN max(k) FILTER (r = 1) ELSE min(k) FILTER (votes >= top / 2.0) END)::INT AS accepted_k FROM r GROUP BY p_brand""",
    "line_choice": """WITH p AS (SELECT l_orderkey, l_returnflag AS element, ['Ka1', 'La1', 'Ma1', 'Kb1'][l_linenumber % 4 + 1] AS line, l_quantity / 5 AS e, l_extendedprice AS area FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, element ORDER BY (e > 2 AND 15.0 / e > 1.65) DESC, area DESC, line) AS r FROM p WHERE line <> 'Kb1')
SELECT l_orderkey, element, line, round(e, 6) AS energy_kev, round(area, 6) AS area FROM r WHERE r = 1""",
    "pb_stats": """WITH p AS (SELECT l_suppkey % 20 AS el_line, CASE WHEN l_quantity > 3 AND l_quantity * 4 >= 10 THEN l_quantity * 4 END AS x FROM lineitem)
SELECT el_line, round(avg(x), 6) AS mean_pb, round(stddev_pop(x), 6) AS std_pb, count(x) AS n_spectra, round(stddev_pop(x) / avg(x) * 100, 6) AS rel_std_pct FROM p GROUP BY el_line HAVING count(x) > 0""",
    "standards_mean": f"WITH {_LIB} SELECT el_line, round(mean_pb, 6) AS mean_pb, round(std_pb, 6) AS std_pb, n_standards, round(std_pb / mean_pb * 100, 6) AS rel_std_pct FROM means",
    "standards_upsert": f"""WITH {_LIB}, new AS (SELECT el_line, std_id, corrected_pb + 1 AS corrected_pb, use_for_mean FROM lib WHERE std_id IN ('std1', 'std2', 'std3') AND use_for_mean)
SELECT * FROM lib WHERE std_id NOT IN (SELECT std_id FROM new) UNION ALL SELECT * FROM new""",
    "k_ratio": f"""WITH {_LIB} SELECT p_partkey, round(p_size / mean_pb, 6) AS k_ratio, CASE WHEN mean_pb IS NULL THEN 'no standard' END AS error
FROM part LEFT JOIN (SELECT * FROM means WHERE el_line <> 'Brand#2') m ON el_line = p_brand""",
    "incremental_requantify_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE o_orderkey * 0.5 END::DOUBLE AS an_err FROM orders",
    "particle_stats": f"""WITH {_D} SELECT frame_id, count(*) AS n, round(avg(diameter), 6) AS mean, round(stddev_pop(diameter), 6) AS stdev, round(max(diameter), 6) AS max, round(min(diameter), 6) AS min,
round(quantile_cont(diameter, 0.1), 6) AS d10, round(quantile_cont(diameter, 0.25), 6) AS d25, round(quantile_cont(diameter, 0.5), 6) AS median, round(quantile_cont(diameter, 0.75), 6) AS d75, round(quantile_cont(diameter, 0.9), 6) AS d90 FROM ar GROUP BY frame_id""",
    "particle_filter": f"WITH {_D} SELECT frame_id, particle_id, round(area, 6) AS area, round(diameter, 6) AS diameter FROM ar WHERE particle_id NOT IN (1, 3, 5) AND frame_id <> 'error' AND area BETWEEN 8.0 AND 100.0",
    "particle_histogram": f"""WITH {_D}, e AS (SELECT min(diameter) AS a, max(diameter) AS b, (max(diameter) - min(diameter)) / 20 AS w FROM ar),
c AS (SELECT least(19, floor((diameter - a) / w))::INT AS bin, count(*) AS n FROM ar CROSS JOIN e GROUP BY 1)
SELECT i::INT AS bin, round(a + i * w, 6) AS lo, round(a + (i + 1) * w, 6) AS hi, coalesce(n, 0) AS n FROM range(20) r(i) CROSS JOIN e LEFT JOIN c ON c.bin = i""",
    "grid_frames": """WITH c AS (SELECT c_custkey, (1.5 + c_custkey % 4 * 0.5)::DOUBLE AS hw, (0.25 + c_custkey % 3 * 0.25)::DOUBLE AS s, CASE WHEN c_custkey % 2 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS r, c_custkey % 2 = 0 AS circle, c_custkey % 10 AS cx, -(c_custkey % 7) AS cy FROM customer),
g AS (SELECT *, CASE WHEN circle THEN hw - s * sqrt(1 + r * r) ELSE hw END AS h, floor(hw / s)::INT + 1 AS nx, floor(hw / (s * r))::INT + 1 AS ny FROM c),
i AS (SELECT *, unnest(range(-nx, nx + 1)) AS i FROM g),
p AS (SELECT *, unnest(range(-ny, ny + 1)) AS j FROM i)
SELECT c_custkey, CASE WHEN i + nx < 26 THEN chr((65 + i + nx)::INT) ELSE 'A' || chr((65 + i + nx - 26)::INT) END || (j + ny) AS label, round((i * s + cx)::DOUBLE, 6) AS x, round((j * (s * r) + cy)::DOUBLE, 6) AS y FROM p
WHERE CASE WHEN circle THEN (i * s) * (i * s) + (j * (s * r)) * (j * (s * r)) < h * h ELSE abs(i * s) <= h AND abs(j * (s * r)) <= h * r END""",
    "frame_coordinates": """WITH p AS (SELECT p_partkey, (p_size * 10.0)::DOUBLE AS px, (p_partkey % 700 * 1.0)::DOUBLE AS py FROM part)
SELECT p_partkey, px, py, round(px / 1024 - 0.5, 6) AS rx, round((py / 768 - 0.5) * 0.75, 6) AS ry, px AS bx, py AS by FROM p""",
    "excel_letters": """WITH o AS (SELECT o_orderkey, (o_orderkey % 20000)::INT AS i FROM orders)
SELECT o_orderkey, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + (i - 26) // 26) || chr(65 + i % 26) WHEN i < 18278 THEN chr(65 + (i - 702) // 676) || chr(65 + ((i - 702) // 26) % 26) || chr(65 + (i - 702) % 26) ELSE 'A' || chr(65 + (i - 18278) // 676) || chr(65 + ((i - 18278) // 26) % 26) || chr(65 + (i - 18278) % 26) END AS letters FROM o""",
    "clean_ids": "SELECT c_custkey, c_name AS id FROM customer",
    "line_keys": "SELECT p_partkey, string_split(p_name, ' ')[1] AS element, string_split(p_name, ' ')[2] AS line, CASE WHEN len(string_split(p_name, ' ')) > 2 THEN array_to_string(string_split(p_name, ' ')[3:], '_') END AS suffix FROM part",
    "two_point_calibration": """WITH s AS (SELECT s_suppkey, (1.4 + s_suppkey * 0.001 - 0.02) / 0.01 AS i, (8.0 + s_nationkey * 0.01 - 0.02) / 0.01 AS j FROM supplier)
SELECT s_suppkey, round(((8.0478 - 1.4866) / (j - i))::DOUBLE, 8) AS width, round((1.4866 - i * (8.0478 - 1.4866) / (j - i))::DOUBLE, 8) AS offset FROM s""".replace("AS offset", 'AS "offset"'),
    "latest_calibration": """WITH e AS (SELECT event_type, strftime(ts, '%Y%m%d_%Hh%Mm%S') || '_' || lpad(event_id::VARCHAR, 9, '0') AS file_name, value, event_id FROM events WHERE event_id % 3 <> 0)
SELECT event_type, round(arg_max(value, file_name), 6) AS "offset", round(arg_max(value, file_name) / 100, 6) AS scale, 4.3::DOUBLE AS spot_size, max(file_name) AS file_name FROM e GROUP BY event_type""",
    "interp_lookup": """WITH c AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY 1),
s AS (SELECT x AS a, y AS ya, lead(x) OVER (ORDER BY x) AS b, lead(y) OVER (ORDER BY x) AS yb FROM c),
e AS (SELECT event_id, least(greatest(value / 5, (SELECT min(x) FROM c)), (SELECT max(x) FROM c)) AS t FROM events)
SELECT event_id, round(CASE WHEN b IS NULL THEN ya ELSE ya + (yb - ya) * (t - a) / (b - a) END, 6) AS value FROM e ASOF JOIN s ON t >= a""",
    "trapezoid": """WITH ch AS (SELECT user_id, floor(value / 10) AS x, count(*)::DOUBLE AS y FROM events GROUP BY ALL), l AS (SELECT user_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM ch WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, round(coalesce(sum(a), 0), 6) AS integral FROM l GROUP BY user_id""",
    "detector_sigma": "SELECT event_id, round(0.00363::DOUBLE * sqrt(64.0::DOUBLE + value / 40 * 0.115::DOUBLE / 0.00363::DOUBLE), 6) AS sigma, round(1 + 3 / (1 + exp(-9.0::DOUBLE * (value / 40 - 0.9::DOUBLE))), 6) AS gamma FROM events",
    "rdev_shares": f"""WITH {_C}, d AS (SELECT w_fr * 100 - 100 / 6.0::DOUBLE AS d FROM c)
SELECT {', '.join(f"round(avg((abs(d / (100 / 6.0::DOUBLE) * 100) < {t})::INT), 6) AS rdev_{t}" for t in (5, 10, 15))}, {', '.join(f"round(avg((abs(d) < {t})::INT), 6) AS adev_{t}" for t in (1, 2, 3))} FROM d""",
    "element_frequency": f"WITH {_C} SELECT element, count(*) AS n FROM c WHERE w_fr > 0.167 GROUP BY element",
    "fit_summary_rows": """SELECT s_nationkey, s_suppkey::VARCHAR AS row, round(s_acctbal, 5) AS s_acctbal FROM supplier
UNION ALL SELECT s_nationkey, 'mean', round(avg(s_acctbal), 5) FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey, 'std', round(stddev_samp(s_acctbal), 5) FROM supplier GROUP BY 1""".replace("AS row", 'AS "row"'),
    "eligible_lines": f"""WITH {_LINES}, s AS (SELECT * FROM li WHERE 15.0 / e > greatest(0.99 * 15.0 / 11.0, 1.2) AND e > 0.3 - 3 * 0.03),
k AS (SELECT element, line, e, w, 'line' AS kind, e AS kev FROM s UNION ALL SELECT element, line, e, w, 'escSiKa', e - 1.74 FROM s WHERE w > 0.3 AND e > 1.74 UNION ALL SELECT element, line, e, w, 'pileup', 2 * e FROM s WHERE w > 0.3 AND 2 * e < 11)
SELECT element, line, kind, round(kev, 6) AS energy_kev, w AS weight FROM k""",
    "reference_lines": """WITH p AS (SELECT p_partkey, ['Fe', 'Pb', 'Ba', 'Ca', 'Ce', 'Pr'][p_partkey % 6 + 1] AS element, ['Kb1', 'Lb1', 'Mb', 'N4'][p_size % 4 + 1] AS line, p_partkey % 5 < 2 AS has_la1 FROM part)
SELECT *, CASE left(line, 1) WHEN 'K' THEN 'Ka1' WHEN 'L' THEN CASE WHEN has_la1 THEN 'La1' ELSE 'Ll' END ELSE CASE WHEN element IN ('Pb', 'Pr') THEN 'Ma1' ELSE 'Mz1' END END AS ref FROM p""",
    "histogram_fit": """WITH RECURSIVE v AS (SELECT label, floor(x::DOUBLE * 50)::BIGINT AS i FROM (SELECT label, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL) WHERE x IS NOT NULL AND NOT isnan(x)),
h AS (SELECT label, i, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
g AS (SELECT label, list({'x': (i / 50.0::DOUBLE + (i + 1) / 50.0::DOUBLE) / 2, 'n': n} ORDER BY i) AS b, max(n) AS top, arg_max((i / 50.0::DOUBLE + (i + 1) / 50.0::DOUBLE) / 2, (n, -i)) AS c0, greatest((max(i) - min(i)) / 50.0::DOUBLE, 1e-9) / 10 AS w0 FROM h GROUP BY label HAVING count(*) >= 3),
r AS (
  SELECT label, b, top AS a, c0 AS c, w0 AS w, list_sum([(top / (1 + ((p.x - c0) / w0) ** 2) - p.n) ** 2 FOR p IN b]) AS sse, 0.001::DOUBLE AS damp, 0 AS rounds, false AS done FROM g
  UNION ALL
  SELECT label, b, CASE WHEN s2 < sse THEN na ELSE a END, CASE WHEN s2 < sse THEN nc ELSE c END, CASE WHEN s2 < sse THEN nw ELSE w END, CASE WHEN s2 < sse THEN s2 ELSE sse END, CASE WHEN s2 < sse THEN damp / 10 ELSE damp * 10 END, rounds + 1,
    (abs(na - a) <= 1e-10 * greatest(abs(a), 1e-9) AND abs(nc - c) <= 1e-10 * greatest(abs(c), 1e-9) AND abs(nw - w) <= 1e-10 * greatest(abs(w), 1e-9)) OR damp > 1e12
  FROM (SELECT *, list_sum([(na / (1 + ((p.x - nc) / nw) ** 2) - p.n) ** 2 FOR p IN b]) AS s2
  FROM (SELECT *, greatest(0, a - (ra * (cc * ww - cw * cw) - ac * (rc * ww - cw * rw) + aw * (rc * cw - cc * rw)) / det) AS na, c - (aa * (rc * ww - cw * rw) - ra * (ac * ww - cw * aw) + aw * (ac * rw - rc * aw)) / det AS nc,
    greatest(1e-12, abs(w - (aa * (cc * rw - rc * cw) - ac * (ac * rw - rc * aw) + ra * (ac * cw - cc * aw)) / det)) AS nw
  FROM (SELECT *, aa * (cc * ww - cw * cw) - ac * (ac * ww - cw * aw) + aw * (ac * cw - cc * aw) AS det
  FROM (SELECT *, list_sum([x.a * x.a FOR x IN j]) * (1 + damp) AS aa, list_sum([x.c * x.c FOR x IN j]) * (1 + damp) AS cc, list_sum([x.w * x.w FOR x IN j]) * (1 + damp) AS ww, list_sum([x.a * x.c FOR x IN j]) AS ac, list_sum([x.a * x.w FOR x IN j]) AS aw,
    list_sum([x.c * x.w FOR x IN j]) AS cw, list_sum([x.a * x.r FOR x IN j]) AS ra, list_sum([x.c * x.r FOR x IN j]) AS rc, list_sum([x.w * x.r FOR x IN j]) AS rw
  FROM (SELECT *, [{'a': q.s, 'c': 2 * a * q.s * q.s * q.q / w, 'w': 2 * a * q.s * q.s * q.q * q.q / w, 'r': a * q.s - q.n} FOR q IN [{'q': (p.x - c) / w, 's': 1 / (1 + ((p.x - c) / w) ** 2), 'n': p.n} FOR p IN b]] AS j FROM r WHERE NOT done AND rounds < 100)))))),
f AS (SELECT * FROM r QUALIFY rounds = max(rounds) OVER (PARTITION BY label))
SELECT label, round(a, 5) AS height, round(c, 5) AS center, round(w, 5) AS width FROM f""",
    "zaf_factors": f"""WITH {_C}, {_LINES}, w AS (SELECT l_suppkey, element, z, mass AS a, w_fr AS w, ln(11.5 * z / 1000) AS lj, (-52.3791 + 150.48371 * z - 1.67373 * z ** 2 + 0.00716 * z ** 3) * 1e-4 * (1 + (-1112.8 + 30.289 * z - 0.15498 * z ** 2) * 1e-4 * ln(15.0 / 20)) AS eta FROM c),
m AS (SELECT l_suppkey, sum(w * z ** 1.75 / a) / sum(w * z ** 0.75 / a) AS zm, sum(w * z / a) AS m, sum(w * z / a * lj) / sum(w * z / a) AS lj, sum(w * (0.05 + 0.001 * z)) AS beta, sum(w * eta) AS eta, sum(w * 3000.0 * z ** 1.5 / 100) AS mu FROM w GROUP BY l_suppkey),
r AS (SELECT w.l_suppkey, w.element, e, zm, m.m AS mm, m.lj AS mlj, beta, m.eta, mu / e ** 2 AS mu, w.z AS z, w.a AS a, w.lj AS lj, 15.0 / e AS u FROM w JOIN m USING (l_suppkey) JOIN li ON li.element = w.element AND li.line = 'Ka1'),
s AS (SELECT *, ((sqrt(u) - 1) / (u - 1)) ** 1.07 AS q, mu / sin(radians(28.5)) * (15.0 ** 1.65 - e ** 1.65) AS x, ln(u) AS l FROM r),
t AS (SELECT *, zm * (1 - 0.0005 * zm) * ((15 - e) / e) ** (1 + 0.001 * zm) * e / (e + beta) / ((1 + 16.05 * sqrt(exp(mlj) / e) * q) / mm) AS gs,
  z * (1 - 0.0005 * z) * ((15 - e) / e) ** (1 + 0.001 * z) * e / (e + 0.05 + 0.001 * z) / ((1 + 16.05 * sqrt(exp(lj) / e) * q) / (z / a)) AS gp,
  (1 + 3.34e-6 * x + 5.59e-13 * x ** 2) / (1 + 3.0e-6 * x + 4.5e-13 * x ** 2) AS af,
  1 - eta * (0.33148 * l + 0.05596 * l ** 2 - 0.06339 * l ** 3 + 0.00947 * l ** 4 + eta * (2.87898 * l - 1.51307 * l ** 2 + 0.81312 * l ** 3 - 0.08241 * l ** 4) / u) ** 1.67 AS rp FROM s),
f AS (SELECT l_suppkey, element, gs / gp AS zf, af, rp / (1 - (1 - rp) * (2 / (1 + eta)) ** 0.63 * (0.79 + 0.44 * e / 15.0)) AS rf FROM t)
SELECT l_suppkey, element, 'Ka1' AS line, round(zf, 6) AS z_factor, round(af, 6) AS a_factor, round(rf, 6) AS r_factor, round(zf * af * rf, 6) AS zaf FROM f""",
    "zaf_fixed_point": f"""WITH RECURSIVE {_C}, {_LINES},
k AS (SELECT l_suppkey, element, z, mass AS a, w_fr * (0.9::DOUBLE + l_suppkey % 5 * 0.05::DOUBLE) AS k, e, 15.0::DOUBLE / e AS u, ln(11.5 * z / 1000) AS lj, ln(15.0::DOUBLE / e) AS l,
  (-52.3791 + 150.48371 * z - 1.67373 * z ** 2 + 0.00716 * z ** 3) * 1e-4 * (1 + (-1112.8 + 30.289 * z - 0.15498 * z ** 2) * 1e-4 * ln(15.0::DOUBLE / 20)) AS eta FROM c JOIN li USING (element) WHERE line = 'Ka1'),
r AS (
  SELECT *, k / sum(k) OVER (PARTITION BY l_suppkey) AS w, 0 AS rounds, false AS done FROM k
  UNION ALL
  SELECT l_suppkey, element, z, a, k, e, u, lj, l, eta, nw, rounds + 1, max(abs(nw - w)) OVER (PARTITION BY l_suppkey) <= 1e-4
  FROM (SELECT *, k * gs / gp * (1 + 3.34e-6 * x + 5.59e-13 * x ** 2) / (1 + 3.0e-6 * x + 4.5e-13 * x ** 2) * rp / (1 - (1 - rp) * (2 / (1 + me)) ** 0.63 * (0.79 + 0.44 * e / 15.0)) AS nw
  FROM (SELECT *, zm * (1 - 0.0005 * zm) * ((15 - e) / e) ** (1 + 0.001 * zm) * e / (e + mb) / ((1 + 16.05 * sqrt(exp(mlj) / e) * q) / mm) AS gs,
    z * (1 - 0.0005 * z) * ((15 - e) / e) ** (1 + 0.001 * z) * e / (e + 0.05 + 0.001 * z) / ((1 + 16.05 * sqrt(exp(lj) / e) * q) / (z / a)) AS gp,
    1 - me * (0.33148 * l + 0.05596 * l ** 2 - 0.06339 * l ** 3 + 0.00947 * l ** 4 + me * (2.87898 * l - 1.51307 * l ** 2 + 0.81312 * l ** 3 - 0.08241 * l ** 4) / u) ** 1.67 AS rp
  FROM (SELECT *, ((sqrt(u) - 1) / (u - 1)) ** 1.07 AS q, mmu / e ** 2 / sin(radians(28.5)) * (15.0 ** 1.65 - e ** 1.65) AS x
  FROM (SELECT *, sum(w * z ** 1.75 / a) OVER s / sum(w * z ** 0.75 / a) OVER s AS zm, sum(w * z / a) OVER s / t AS mm, sum(w * z / a * lj) OVER s / sum(w * z / a) OVER s AS mlj,
    sum(w * (0.05 + 0.001 * z)) OVER s / t AS mb, sum(w * eta) OVER s / t AS me, sum(w * 3000.0 * z ** 1.5 / 100) OVER s / t AS mmu
  FROM (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM r WHERE NOT done AND rounds < 20) WINDOW s AS (PARTITION BY l_suppkey)))))),
f AS (SELECT *, max(rounds) OVER (PARTITION BY l_suppkey) AS last FROM r)
SELECT l_suppkey, element, 'Ka1' AS line, round(w, 6) AS w_fr, rounds::INT AS rounds, done AS converged FROM f WHERE rounds = last""",
    "formulas_read": f"""WITH {_EL}, p AS (SELECT p_partkey, p_partkey % 11 = 0 AS bad, {_ELEMENTS}[p_partkey % 6 + 1] AS e1, {_ELEMENTS}[p_partkey // 6 % 6 + 1] AS e2, {_ELEMENTS}[p_size % 6 + 1] AS e3,
  p_size % 4 + 1 AS n1, (p_partkey % 5 + 1) * 0.5 AS n2, p_partkey % 3 + 1 AS n3 FROM part),
a AS (SELECT p_partkey, unnest([e1, e2, e3]) AS element, unnest([n1, n2, n3 * 2 * n2])::DOUBLE AS n FROM p WHERE NOT bad),
s AS (SELECT p_partkey, element, sum(n) AS n, round(sum(n) * 1000)::BIGINT AS k FROM a GROUP BY ALL),
g AS (SELECT p_partkey, list_reduce(list(k), lambda x, y: gcd(x, y)) AS g, sum(n * mass) AS mass, coalesce(sum(n * mass) FILTER (element = 'O'), 0) AS o FROM s JOIN el USING (element) GROUP BY p_partkey),
r AS (SELECT p_partkey, string_agg(element || CASE WHEN k = g THEN '' ELSE (k // g)::VARCHAR END, '' ORDER BY element) AS reduced, any_value(mass) AS mass, any_value(o) AS o FROM s JOIN g USING (p_partkey) GROUP BY p_partkey),
h AS (SELECT *, e1 || CASE n1 WHEN 1 THEN '' ELSE '_{{' || n1 || '}}' END || '(' || e2 || '[' || e3 AS head, CASE n3 WHEN 1 THEN '' ELSE '_{{' || n3 || '}}' END AS third FROM p)
SELECT p_partkey, reduced, '$' || head || CASE WHEN bad THEN '_{{' || n3 || '2}}' ELSE third || ']_{{2}}' END || ' )' || CASE n2 WHEN 1 THEN '' ELSE '_{{' || n2::DECIMAL(3, 1) || '}}' END || '$' AS latex,
  round(mass, 4) AS mass, round(o / mass, 4) AS oxygen FROM h LEFT JOIN r USING (p_partkey)""",
    "pretty_formulas": f"""WITH {_AT}, k AS (SELECT l_suppkey, element, z, at_fr / min(at_fr) OVER (PARTITION BY l_suppkey) AS n FROM a WHERE at_fr >= 1 / 6::DOUBLE),
t AS (SELECT l_suppkey, element, z, regexp_replace(round(n, 1)::DECIMAL(18, 1)::VARCHAR, '[.]0$', '') AS n FROM k),
g AS (SELECT l_suppkey, string_agg(element || CASE n WHEN '1' THEN '' ELSE n END, '' ORDER BY z) AS formula FROM t GROUP BY l_suppkey)
SELECT l_suppkey, coalesce(formula, '') AS formula FROM (SELECT DISTINCT l_suppkey FROM a) LEFT JOIN g USING (l_suppkey)""",
    "width_calibration": "SELECT p_brand, round(regr_intercept(p_retailprice, p_size), 5) AS p1, round(regr_slope(p_retailprice, p_size), 5) AS p2, count(*) AS n FROM part GROUP BY p_brand",
    "calibration_lookup": "SELECT 'm1' AS microscope, 'click' AS mode, round(arg_max(value, event_id), 6) AS scale, max(event_id) AS event_id, max(event_id) AS valid_from FROM events WHERE event_type = 'click'",
    "sample_accuracy": f"""WITH {_C}, a AS (SELECT l_suppkey, sqrt(avg((w_fr * 100 - 100 / 6.0::DOUBLE) ** 2)) AS r, count(*) AS n FROM c WHERE l_suppkey % 4 - 1 IN (0, -1) GROUP BY l_suppkey)
SELECT l_suppkey, round(r, 6) AS d_rms, n, r < 1 AS under_1, r < 2 AS under_2, r < 3 AS under_3 FROM a""",
    "shuffled_frames": "SELECT c_name, row_number() OVER (ORDER BY md5('3:' || c_name), c_name)::INT AS place FROM customer",
    "kmeans_rounds": f"""WITH p AS MATERIALIZED (SELECT label % 2 AS s, vec_id, embedding::DOUBLE[] AS fr FROM embeddings),
f AS (SELECT s, fr, row_number() OVER (PARTITION BY s ORDER BY vec_id) AS r FROM p QUALIFY r <= 3),
c0 AS MATERIALIZED (SELECT s, k, r - 1 AS cluster, fr FROM f JOIN (SELECT unnest([2, 3]) AS k) ON r <= k),
{_lloyd()},
t AS (SELECT s, k, cluster, any_value(n) AS n, sum(w) AS inertia FROM m4 GROUP BY ALL),
g AS (SELECT s, k, i, sum(n * m) / sum(n) AS gm FROM m4 GROUP BY ALL),
b AS (SELECT m4.s, m4.k, sum(n * (m - gm) ** 2) AS between_ FROM m4 JOIN g USING (s, k, i) GROUP BY ALL),
h AS (SELECT s, k, any_value(between_) / sum(inertia) * (sum(n) - count(*)) / (count(*) - 1) AS ch FROM t JOIN b USING (s, k) GROUP BY ALL)
SELECT s AS sample_id, k, cluster::INT AS cluster, n, round(inertia, 6) AS inertia, round(ch, 6) AS calinski_harabasz FROM t JOIN h USING (s, k)""",
    "spectra_source": """SELECT label::VARCHAR AS sample_id, vec_id AS spectrum_id, (vec_id % 7 - 1)::INT AS quant_flag, CASE WHEN vec_id % 100 >= 0 THEN round((vec_id % 100) / 100.0::DOUBLE, 6) END AS fe,
  list_sum([floor(abs(x::DOUBLE) * 1000) FOR x IN embedding]) AS total FROM embeddings WHERE label IN (1, 4, 7)""",
    "latest_version": "SELECT doc_id, 1 - quality AS quality, count(*) OVER () AS n_rows FROM labels WHERE doc_id IS NOT NULL",
    "image_regions": """WITH RECURSIVE e AS (SELECT floor(vec_id / 64)::BIGINT AS image, vec_id % 64 AS y, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
p AS (SELECT image, y, x, image * 100000 + y * 1000 + x AS id FROM e WHERE v::DOUBLE > 0.08::DOUBLE),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN (SELECT unnest([-1001, -1000, -999, -1, 1, 999, 1000, 1001]) AS step) ON true JOIN p b ON b.id = a.id + step),
r AS (SELECT id, id AS c FROM p UNION SELECT n.b, r.c FROM r JOIN n ON n.a = r.id WHERE r.c < n.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
g AS (SELECT image, c, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, avg(x) AS cx, avg(y) AS cy FROM p JOIN m USING (id) GROUP BY ALL)
SELECT image, row_number() OVER (PARTITION BY image ORDER BY c) - 1 AS region, area, x0, y0, x1, y1, round(cx, 6) AS cx, round(cy, 6) AS cy FROM g""",
    "acquisition_rounds": """WITH p AS (SELECT floor(vec_id / 40)::BIGINT AS s, vec_id, label % 3 AS c, embedding, row_number() OVER (PARTITION BY floor(vec_id / 40) ORDER BY vec_id) AS i FROM embeddings),
f AS (SELECT s, vec_id, c, ((i - 1) // 10)::INT AS r, [x::DOUBLE * (0.024::DOUBLE + s % 6 * 0.001::DOUBLE) FOR x IN embedding] AS fr FROM p WHERE i <= 35),
t AS (SELECT DISTINCT s, r, max(r) OVER (PARTITION BY s) AS last FROM f),
x AS (SELECT s, c, r, unnest(fr) AS x, generate_subscripts(fr, 1) AS j FROM f),
m AS (SELECT t.s, t.r, c, j, var_pop(x) AS v FROM t JOIN x ON x.s = t.s AND x.r <= t.r GROUP BY ALL),
g AS (SELECT s, r, c, sqrt(sum(v)) AS rms FROM m GROUP BY ALL),
h AS (SELECT s, r, count(*) AS n_clusters, max(rms) AS max_rms FROM g GROUP BY ALL),
n AS (SELECT t.s, t.r, any_value(last) AS last, count(*) AS n_results, count(*) FILTER (f.r = t.r) AS admitted FROM t JOIN f ON f.s = t.s AND f.r <= t.r GROUP BY t.s, t.r),
w AS (SELECT n.*, n_clusters, max_rms, max_rms < 0.025 AS converged, (max_rms < 0.025 AND n_results >= 20) OR n_results >= 35 OR n.r = last AS done FROM n JOIN h USING (s, r)),
e AS (SELECT s, min(r) AS stop FROM w WHERE done GROUP BY s)
SELECT s AS sample_id, r AS round, admitted, n_results, n_clusters, round(max_rms, 6) AS max_rms, converged, done FROM w JOIN e USING (s) WHERE r <= stop""",
    "flagship": f"""WITH {_AT},
ref AS (SELECT * FROM (VALUES {_PHASES}) t(ref_idx, formula, element, fr)),
p AS (SELECT l_suppkey % 3 AS sample_id, (l_suppkey % 2)::INT AS cluster_id, l_suppkey, element, at_fr FROM a),
m AS (SELECT sample_id, cluster_id, element, avg(at_fr) AS m FROM p GROUP BY ALL),
g AS (SELECT sample_id, cluster_id, count(DISTINCT l_suppkey) AS n_points, sum((at_fr - m) ** 2) AS wcss FROM p JOIN m USING (sample_id, cluster_id, element) GROUP BY ALL),
d AS (SELECT sample_id, cluster_id, ref_idx, formula, sqrt(sum((m - fr) ** 2)) AS d FROM m JOIN ref USING (element) GROUP BY ALL),
n AS (SELECT d.*, exp(-d * d / 0.0018) AS raw FROM d JOIN g USING (sample_id, cluster_id) WHERE d < greatest(0.1, 5 * sqrt(wcss / n_points))),
k AS (SELECT *, raw * exp(-((1 - raw) ** 2) / 0.18) / sum(exp(-((1 - raw) ** 2) / 0.18)) OVER (PARTITION BY sample_id, cluster_id) AS conf FROM n),
r AS (SELECT sample_id, cluster_id, formula, round_even(conf, 2) AS conf, row_number() OVER (PARTITION BY sample_id, cluster_id ORDER BY conf DESC, ref_idx) AS r FROM k WHERE conf > 0.01),
w AS (SELECT sample_id, cluster_id, {", ".join(f"max(formula) FILTER (r = {i}) AS ref{i}, max(conf) FILTER (r = {i}) AS conf{i}" for i in (1, 2, 3))} FROM r GROUP BY ALL)
SELECT sample_id, cluster_id, n_points, round(wcss, 6) AS wcss, round(sqrt(wcss / n_points), 6) AS rms, ref1, conf1, ref2, conf2, ref3, conf3 FROM g LEFT JOIN w USING (sample_id, cluster_id)""",
}

_LP = f"""{_LINES}, us AS (SELECT DISTINCT user_id FROM events),
pk AS (SELECT user_id, element, line, line IN ('Ka1', 'La1') AS is_reference, e + user_id % 7 * 0.03::DOUBLE AS center, 0.25::DOUBLE + e * 0.02::DOUBLE AS fwhm FROM us CROSS JOIN li)"""
_RB = f"""{_S}, {_LP}, rb AS (SELECT pk.user_id, coalesce(min(n + 0.5) FILTER (0.1::DOUBLE * channel > center - fwhm AND 0.1::DOUBLE * channel < center + fwhm), 'infinity'::DOUBLE) AS low FROM pk JOIN s USING (user_id) WHERE is_reference GROUP BY pk.user_id)"""
_MIX = """pr AS (SELECT a.ref_idx AS ref1, b.ref_idx AS ref2, a.formula || ', ' || b.formula AS name, a.h AS h1, b.h AS h2, a.w / b.w AS r FROM ref a JOIN ref b ON a.ref_idx < b.ref_idx),
w AS (SELECT label, ref1, ref2, name, fr, h1, h2, r, least(1, greatest(0, list_sum([(fr[i] - h2[i]) * (h1[i] - h2[i]) FOR i IN range(1, len(fr) + 1)]) / list_sum([(h1[i] - h2[i]) ** 2 FOR i IN range(1, len(fr) + 1)]))) AS s FROM p CROSS JOIN pr),
e AS (SELECT label, ref1, ref2, name, len(fr) AS k, list_sum([exp(15 * abs(fr[i] - (h1[i] * s + h2[i] * (1 - s)))) - 1 FOR i IN range(1, len(fr) + 1)]) AS e, r, s, (1 - s) * r / (1 - (1 - s) * (1 - r)) AS x2 FROM w),
t AS (SELECT label, ref1, ref2, name, sum(e) / sum(k) AS error, avg(s * (1 + x2 * (1 / r - 1))) AS mm FROM e GROUP BY ALL)"""

ORACLE_SQL |= {
    "convergence_by_sample": f"""WITH {_P.replace("FROM p GROUP BY label)", "FROM p WHERE label % 2 = 0 GROUP BY label)")}, two AS (SELECT ref_idx, h FROM ref UNION ALL SELECT ref_idx + 100, [x * 1.01::DOUBLE FOR x IN h] FROM ref),
x AS (SELECT label, vec_id, unnest(fr) AS value, generate_subscripts(fr, 1) AS i FROM p),
mean AS (SELECT label, i, avg(value) AS m FROM x GROUP BY ALL),
rms AS (SELECT x.label, sqrt(sum((value - m) ** 2) / count(DISTINCT vec_id)) / 5 AS rms FROM x JOIN mean USING (label, i) GROUP BY x.label),
ce AS (SELECT label, list(m ORDER BY i) AS fr FROM mean GROUP BY label),
d AS (SELECT label, rms, sqrt(list_sum([(fr[i] - h[i]) ** 2 FOR i IN range(1, len(h) + 1)])) AS d FROM ce JOIN rms USING (label) CROSS JOIN two),
n AS (SELECT label, exp(-d * d / 0.0018) AS c FROM d WHERE d < greatest(0.036, 5 * rms)),
k AS (SELECT label, c * exp(-((1 - c) ** 2) / 0.18) / sum(exp(-((1 - c) ** 2) / 0.18)) OVER (PARTITION BY label) AS conf FROM n),
b AS (SELECT label, max(conf) AS best FROM k GROUP BY label)
SELECT label, round(rms, 6) AS rms, round(best, 6) AS min_conf, CASE WHEN best IS NULL THEN rms < 0.025 ELSE best > 0.8 AND rms < 0.03 END AS converged FROM rms LEFT JOIN b USING (label)""",
    "fit_quality": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_totalprice::DOUBLE AS p FROM orders)
SELECT o_orderkey, (CASE WHEN p / 1000 > 0.002 * (p * (k % 5 + 1) / 4) THEN 1 WHEN (k % 40) / 50 - 0.2::DOUBLE > 0.5 THEN 2 WHEN k % 3 = 0 AND (k % 100) / 100 > 0.7::DOUBLE THEN 3 END)::INT AS code FROM o""",
    "post_fit_flag_strict": """WITH k AS (SELECT o_orderkey, o_orderkey % 7 AS b, o_orderkey % 17 = 0 AS failed, o_orderkey % 5 = 0 AS dirty, o_orderkey % 30 AS ground, o_orderkey % 19 <> 0 AS ok FROM orders)
SELECT o_orderkey, CASE WHEN failed THEN 9 WHEN b < 3 THEN b + 4 WHEN dirty THEN 7 WHEN ground < 4 THEN 8 WHEN NOT ok THEN -1 ELSE 0 END::INT AS flag FROM k""",
    "reference_background": f"WITH {_RB} SELECT user_id, round(low, 6) AS ref_background FROM rb",
    "background_comments": f"WITH {_RB} SELECT user_id, printf('%.1f min. ref. bckgrnd counts%s', low, CASE WHEN low < 1.0 THEN ', too low' ELSE '' END) AS comment FROM rb",
    "peak_windows": f"""WITH {_LP}, c AS (SELECT user_id, element, line, min(i) AS a, count(i) AS n, center, fwhm FROM pk LEFT JOIN range(1000) r(i) ON i > (center - fwhm) / 0.1::DOUBLE AND i < (center + fwhm) / 0.1::DOUBLE GROUP BY ALL)
SELECT user_id, element, line, coalesce(a, greatest(0, floor((center - fwhm) / 0.1::DOUBLE) + 1))::INT AS first, n::INT AS n FROM c""",
    "element_sets": f"""WITH {_C}, s AS (SELECT l_suppkey, list_sort(list(element)) AS own FROM c WHERE w_fr > 0.165 GROUP BY l_suppkey)
SELECT l_suppkey, array_to_string(CASE WHEN list_contains(own, 'Fe') THEN own ELSE list_append(own, 'Fe') END, ',') AS seen,
  array_to_string([x FOR x IN ['C', 'Al', 'O'] IF NOT list_contains(own, x)], ',') AS substrate FROM s""",
    "mixture_ranking": f"""WITH {_P.replace("FROM p GROUP BY label)", "FROM p WHERE label < 5 GROUP BY label)")}, {_MIX}
SELECT label, row_number() OVER (PARTITION BY label ORDER BY exp(-error * error / 0.5) DESC, ref1, ref2)::INT AS rank, name, round_even(exp(-error * error / 0.5), 2) AS conf FROM t WHERE error < 2""",
    "known_mixture": f"""WITH {_P.replace("FROM p GROUP BY label)", "FROM p WHERE label < 2 GROUP BY label)").replace("0.03", "0.3")}, {_MIX}
SELECT label, name, round(error, 4) AS error, round(exp(-error * error / 0.5), 4) AS conf, round(mm / (1 - mm), 4) AS mol_ratio FROM t""",
    "single_phase": f"""WITH {_M}, b AS (SELECT label, max(conf) AS best FROM k GROUP BY label)
SELECT label, rms < 0.03 AND coalesce(best > 0.5, false) AS with_refs, rms < 0.03 AND n_points > 3 AS without_refs FROM rms LEFT JOIN b USING (label)""",
    "clusters_csv": f"""WITH {_C}, p AS (SELECT s_nationkey::INT AS cluster_id, l_suppkey, element, w_fr FROM c JOIN supplier ON s_suppkey = l_suppkey),
m AS (SELECT cluster_id, element, avg(w_fr) AS m, stddev_samp(w_fr) AS s FROM p GROUP BY ALL),
g AS (SELECT cluster_id, count(DISTINCT l_suppkey) AS n_points, sum((w_fr - m) ** 2) AS wcss FROM p JOIN m USING (cluster_id, element) GROUP BY cluster_id)
SELECT cluster_id, n_points, round(round_even(sqrt(wcss / n_points) * 100, 2), 1) AS rms_pct, round(round_even(wcss * 10000, 2), 1) AS wcss_pct, {", ".join(f"round(round_even(max({c}) FILTER (element = '{e}') * 100, 2), 1) AS {a}" for e, c, a in (("Fe", "m", "fe"), ("Fe", "s", "fe_std"), ("Mg", "m", "mg"), ("Mg", "s", "mg_std")))}
FROM g JOIN m USING (cluster_id) GROUP BY cluster_id, n_points, wcss""",
    "spectra_csv": f"""WITH {_C} SELECT l_suppkey AS id, round(round_even(max(w_fr) FILTER (element = 'Fe') * 100, 2), 1) AS fe, round(round_even(max(w_fr) FILTER (element = 'O') * 100, 2), 1) AS o,
round(l_suppkey % 9, 1)::DOUBLE AS err, CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey % 3 END::INT AS cluster, (l_suppkey % 5)::INT AS flag FROM c GROUP BY l_suppkey""",
    "particle_table": f"WITH {_D} SELECT particle_id AS particle, frame_id AS frame, round(area, 6) AS area, round(diameter, 6) AS diameter FROM ar",
    "standard_results": """WITH p AS (SELECT l_suppkey % 20 AS el_line, CASE WHEN l_quantity > 3 AND l_quantity * 4 >= 10 THEN l_quantity * 4 END::DOUBLE AS x FROM lineitem)
SELECT el_line, round(avg(x), 6) AS measured_pb, round(stddev_pop(x), 6) AS stdev_pb, round(CASE WHEN el_line < 19 THEN avg(x) * (el_line / 10 + 0.5) / ((el_line + 1) / 20) END::DOUBLE, 6) AS corrected_pb,
round(stddev_pop(x) / avg(x) * 100, 6) AS rel_std_pct, count(x) AS n_spectra FROM p GROUP BY el_line HAVING count(x) > 0""",
    "standards_for_formulas": f"""WITH {_LIB}, f AS (SELECT *, ['SiO2', 'Si2O4', 'Fe2O3', 'FeO', 'Al2O3'][regexp_extract(std_id, '[0-9]+')::INT % 5 + 1] AS formula FROM lib),
g AS (SELECT * FROM f WHERE el_line NOT LIKE '%4' OR formula = 'FeO'), m AS (SELECT el_line, avg(corrected_pb) AS mean_pb, count(*) AS n FROM g WHERE formula IN ('SiO2', 'Si2O4', 'Fe2O3') AND use_for_mean GROUP BY el_line)
SELECT el_line, round(mean_pb, 6) AS mean_pb, coalesce(n, 0) AS n_standards FROM (SELECT DISTINCT el_line FROM g) LEFT JOIN m USING (el_line)""",
    "missing_reference": """SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag || l_linestatus) FILTER (l_quantity > 5 AND l_returnflag || l_linestatus IN ('NO', 'RF')) < 2 THEN 10 ELSE 0 END::INT AS quant_flag FROM lineitem GROUP BY l_orderkey""",
    "edge_particles": "WITH b AS (SELECT p_partkey, p_partkey % 997 AS x, p_size * 15 AS y, p_size AS w FROM part) SELECT p_partkey, x < 3 OR y < 3 OR x + w > 997 OR y + 10 > 757 AS near FROM b",
    "particles_until": "SELECT user_id AS frame_id, event_id AS particle_id FROM (SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS r FROM events) WHERE r <= 321",
    "stage_coordinates": """SELECT p_partkey, round((p_partkey % 11 + (p_size * 10.0 - 512) * 0.25 / 1024)::DOUBLE, 6) AS x, round((-2.0 - (p_partkey % 700 - 384) * 0.25 / 1024)::DOUBLE, 6) AS y FROM part""",
    "grid_offsets": """WITH c AS (SELECT s_suppkey, s_suppkey % 40 - 2 AS n, 0.25 * ceil((s_suppkey % 40 - 2) / 3) AS d FROM supplier)
SELECT s_suppkey, round((CASE WHEN n >= 0 AND d <= 2.5 THEN CASE WHEN n % 3 = 2 THEN 0 ELSE d END END)::DOUBLE, 6) AS dx, round((CASE WHEN n >= 0 AND d <= 2.5 THEN CASE WHEN n % 3 = 1 THEN 0 ELSE d END END)::DOUBLE, 6) AS dy FROM c""",
    "fwhm_sigma": "SELECT p_partkey, round(p_size / 100 / (2 * sqrt(2 * ln(2))), 6) AS sigma FROM part",
}
