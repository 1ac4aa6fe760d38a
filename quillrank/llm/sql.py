"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
win AS (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(ws[i:i + 34], ' '))) AS n FROM places),
cov AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM win WHERE n > 1) GROUP BY r),
loose AS (SELECT w.r, unnest(w.ws) AS x, generate_subscripts(w.ws, 1) AS j FROM w),
kept AS (SELECT l.r, string_agg(l.x, ' ' ORDER BY l.j) AS k FROM loose l
  LEFT JOIN (SELECT r, unnest(gone) AS j FROM cov) g ON g.r = l.r AND g.j = l.j WHERE g.r IS NULL GROUP BY l.r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM w LEFT JOIN cov c ON c.r = w.r LEFT JOIN kept k ON k.r = w.r
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(order: int, pattern: str) -> str:
    return f"""SELECT r, {order} AS o, hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT r, gaps, hits, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i
    FROM (SELECT r, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d))"""


OP2 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
m AS ({_matches(0, _ASSIGN)}
  UNION ALL {_matches(1, "AKIA[A-Z0-9]+")}
  UNION ALL {_matches(2, "[0-9a-f]+")}
  UNION ALL {_matches(3, "[A-Za-z0-9+/_=-]+")}),
b AS (SELECT r, o, s, s + length(hit) AS e FROM m
  WHERE (o = 0 AND length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 12) OR (o = 1 AND length(hit) >= 18) OR (o = 2 AND length(hit) >= 16)),
c AS (SELECT row_number() OVER () AS q, r, s, hit FROM m WHERE o = 3 AND length(hit) >= 20
  AND NOT regexp_matches(hit, '^[^0-9]*$') AND NOT regexp_matches(hit, '^[^A-Za-z]*$')
  AND NOT regexp_matches(hit, '^([A-Za-z]+|[0-9]+)([-_/+=]+([A-Za-z]+|[0-9]+))*[-_/+=]*$')
  AND NOT regexp_matches(hit, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')),
win AS (SELECT q, i, substr(hit, i, 20) AS part FROM (SELECT q, hit, unnest(range(1, length(hit) - 18)) AS i FROM c)),
ch AS (SELECT q, i, x, count(*) AS n FROM (SELECT q, i, unnest(string_split(part, '')) AS x FROM win) GROUP BY q, i, x),
peak AS (SELECT q, max(h) AS h FROM (SELECT q, i, log2(20.0) - sum(n * log2(n)) / 20.0 AS h FROM ch GROUP BY q, i) GROUP BY q),
x AS (SELECT c.r, 3 AS o, c.s, c.s + length(c.hit) AS e FROM c JOIN peak p ON p.q = c.q
  WHERE p.h >= CASE WHEN regexp_matches(c.hit, '^[0-9a-fA-F]+$') THEN 3.01 WHEN regexp_matches(c.hit, '^[A-Za-z0-9]+$') THEN 3.51 ELSE 3.61 END),
spell AS (SELECT r, o, s, e, ['assign', 'access', 'hex', 'entropy'][o + 1] || ':' || s || ':' || e AS t FROM (SELECT * FROM b UNION ALL SELECT * FROM x)),
per AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(t, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(t, ',' ORDER BY s, o) AS spans FROM spell GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per p ON p.r = d.r
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BWORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_BWORDS} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_BWORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k:k + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT dw.r, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.win = dw.win),
per AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY r),
cov AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM hit) GROUP BY r),
ik AS (SELECT row_number() OVER () AS q, item_id, ws FROM (SELECT DISTINCT item_id, ws FROM i WHERE len(ws) > 0)),
tt AS (SELECT q, term, min(o) AS o FROM (SELECT q, unnest(ws) AS term, generate_subscripts(ws, 1) AS o FROM ik) GROUP BY q, term),
dt AS (SELECT r, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM d),
cn AS (SELECT term, count(*) AS n FROM dt WHERE term IN (SELECT term FROM tt) GROUP BY term),
nd AS (SELECT q, least(count(*), 3) AS need FROM tt GROUP BY q),
rk AS (SELECT tt.q, tt.term, nd.need, row_number() OVER (PARTITION BY tt.q ORDER BY cn.n, tt.o) AS place, count(*) OVER (PARTITION BY tt.q) AS have
  FROM tt JOIN cn ON cn.term = tt.term JOIN nd ON nd.q = tt.q),
ev AS (SELECT dt.r, rk.q, rk.need, dt.p, max(CASE WHEN place = 1 THEN dt.p END) OVER w AS a, max(CASE WHEN place = 2 THEN dt.p END) OVER w AS b, max(CASE WHEN place = 3 THEN dt.p END) OVER w AS c
  FROM dt JOIN rk ON rk.term = dt.term AND rk.place <= 3 AND rk.have >= rk.need WINDOW w AS (PARTITION BY dt.r, rk.q ORDER BY dt.p ROWS UNBOUNDED PRECEDING)),
nr AS (SELECT DISTINCT ev.r, ik.item_id FROM ev JOIN ik ON ik.q = ev.q
  WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = need AND p - least(a, b, c) + 1 <= 30),
np AS (SELECT r, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near FROM nr GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(p.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(p.items, '')) AS items_sha256, (coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.ws)) AS contaminated,
  coalesce(np.n_near, 0)::BIGINT AS n_near, coalesce(np.near, '') AS near
FROM d LEFT JOIN per p ON p.r = d.r LEFT JOIN cov c ON c.r = d.r LEFT JOIN np ON np.r = d.r
"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT r, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS j FROM d),
t AS (SELECT r, j, line, source, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS k FROM l),
bad AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, '')) >= 5),
per AS (SELECT r, count(*) FILTER (b.k IS NOT NULL) AS n, string_agg(line, chr(10) ORDER BY j) FILTER (b.k IS NULL) AS kept
  FROM t LEFT JOIN bad b ON b.k = t.k GROUP BY r)
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, coalesce(per.n, 0)::BIGINT AS n_removed, sha256(coalesce(per.kept, '')) AS kept_sha256
FROM d LEFT JOIN per ON per.r = d.r
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || '|' || substr(md5(coalesce(text, '')), 1, 16) AS name FROM documents),
k AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END::BIGINT AS grade, name || '|' || (row_number() OVER (PARTITION BY source, name) - 1) AS key FROM d),
r AS (SELECT *, ((('0x' || substr(md5(key), 1, 13))::UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS level
  FROM c WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, v.level * w), 0) AS target FROM c, v),
g AS (SELECT r.source, r.grade, sum(r.size)::BIGINT AS words, any_value(t.target) AS target
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE r.size > 0 GROUP BY r.source, r.grade),
h AS (SELECT *, (target - coalesce(sum(words) OVER higher, 0)::DOUBLE * 3) / (sum(grade * words) OVER lower)::DOUBLE AS level FROM g
  WINDOW higher AS (PARTITION BY source ORDER BY grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    lower AS (PARTITION BY source ORDER BY grade DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, coalesce(least(3.0, grade * max_by(level, grade) FILTER (level * grade <= 3) OVER (PARTITION BY source)), 3.0) AS expected FROM h),
f AS (SELECT *, floor(expected + 1e-9)::BIGINT AS whole FROM e),
p AS (SELECT source, grade, whole, CASE WHEN expected - whole > 1e-9 THEN expected - whole ELSE 0 END AS p,
  greatest(target - sum(whole * words) OVER (PARTITION BY source), 0.0) AS missing FROM f),
x AS (SELECT r.doc_id, r.size, r.source, r.key, t.source_size, t.target, coalesce(p.whole, 0) AS whole, p.missing,
  CASE WHEN p.p > 0 THEN (r.u / (1 - r.u)) / (p.p / (1 - p.p)) END AS rank
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.grade = p.grade),
y AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, key
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM x),
z AS (SELECT *, (whole + CASE WHEN rank IS NOT NULL AND so_far + size / 2.0 <= missing THEN 1 ELSE 0 END)::BIGINT AS copies FROM y)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM z
"""

OP13 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.replace("coalesce(text, '')", _LOW)} AS ws FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' ')))) AS sh FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT row_number() OVER () AS q, sh, len(sh) AS size FROM (SELECT DISTINCT sh FROM s)),
x AS MATERIALIZED (SELECT q, size, unnest(sh) AS g FROM n),
p AS (SELECT a.q AS a, b.q AS b, a.size + b.size AS total, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.q <> b.q AND a.size * 100 >= b.size * 85 AND b.size * 100 >= a.size * 85 GROUP BY a.q, b.q, a.size, b.size),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 85 * (total - shared)),
reach(a, b) AS (SELECT q, q FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
rep AS (SELECT n.q, min(s.doc_id) AS doc_id FROM n JOIN s ON s.sh = n.sh GROUP BY n.q),
low AS (SELECT reach.a AS q, min(rep.doc_id) AS component_id FROM reach JOIN rep ON rep.q = reach.b GROUP BY reach.a)
SELECT w.doc_id, coalesce(n.size, 0)::BIGINT AS n_shingles, CASE WHEN n.q IS NULL THEN w.doc_id ELSE low.component_id END AS component_id
FROM w LEFT JOIN s ON s.r = w.r LEFT JOIN n ON n.sh = s.sh LEFT JOIN low ON low.q = n.q
"""

# CRC-32 of a word: the table by its rule, then a byte at a time from the word's hex digits.
_CRC_TABLE = "SELECT list(list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS x(b)"
_CRC = "xor(list_reduce(list_transform(range(1, (length(x) // 2) + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"

OP11 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_BWORDS} AS ws FROM documents),
b AS (SELECT unnest({_BWORDS}) AS w FROM benchmark),
e AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
t AS (SELECT w, count(*) AS n FROM b GROUP BY w),
s AS (SELECT w, sum(n)::BIGINT AS n FROM e GROUP BY w),
k AS MATERIALIZED (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM s UNION SELECT w FROM t)), ({_CRC_TABLE})),
o AS (SELECT coalesce(sum(n), 0)::BIGINT AS all_s FROM s),
p AS (SELECT coalesce(sum(n), 0)::BIGINT AS all_t FROM t),
g AS (SELECT k.bucket, floor(1000 * ln((coalesce(sum(t.n), 0) + 1)::DOUBLE * (any_value(all_t.s) + 10000)::DOUBLE / ((coalesce(sum(s.n), 0) + 1)::DOUBLE * (any_value(all_t.t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM k LEFT JOIN s ON s.w = k.w LEFT JOIN t ON t.w = k.w, (SELECT all_s AS s, all_t AS t FROM o, p) AS all_t GROUP BY k.bucket),
wt AS (SELECT e.r, sum(e.n * g.gain)::BIGINT AS weight FROM e JOIN k ON k.w = e.w JOIN g ON g.bucket = k.bucket GROUP BY e.r),
f AS (SELECT d.doc_id, d.r, len(d.ws)::BIGINT AS n_features, coalesce(wt.weight, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS luck FROM d LEFT JOIN wt ON wt.r = d.r),
z AS (SELECT *, weight + luck AS score FROM f),
y AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.doc_id, z.n_features, z.weight, z.score, CASE WHEN y.rank <= 10 * y.n // 100 THEN y.rank END AS rank FROM z LEFT JOIN y ON y.r = z.r
"""

_FAR = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::HUGEINT"


def _turn(i: int) -> str:
    """Assignment to the centroids of round i; what they move to."""
    return f"""a{i} AS MATERIALIZED (SELECT r, min(d * 16 + c) AS m FROM (SELECT k.r, c.c, {_FAR} AS d FROM k, c{i} c) GROUP BY r),
s{i} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT (m % 16)::INT AS c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM a{i} JOIN k USING (r)) GROUP BY c, i),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)"""


OP12 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1)::INT AS c, v FROM k QUALIFY c < 16),
{_turn(0)},
{_turn(1)},
{_turn(2)},
{_turn(3).split(",\ns3")[0]},
f AS (SELECT r, (m % 16)::INT AS cluster, (m // 16)::BIGINT AS distance FROM a3)
SELECT k.vec_id, f.cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia, (sum(f.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN k USING (r) JOIN c3 c ON c.c = f.cluster
"""

SQL = {
    "op1_substring_dedup": OP1,
    "op2_secret_scan": OP2,
    "op6_benchmark_decontamination": OP6,
    "op8_line_dedup": OP8,
    "op10_mixing": OP10,
    "op11_importance_resampling": OP11,
    "op12_centroid_clustering": OP12,
    "op13_ngram_jaccard_join": OP13,
}
