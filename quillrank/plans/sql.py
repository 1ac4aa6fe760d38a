"""DuckDB SQL for the queries of this package."""

from __future__ import annotations

from quillrank.functions import rules
from quillrank.plans import fixtures, profiles

_CV = fixtures.CVS.replace("{customer}", "customer").replace("{orders}", "orders")
_OFFERS = fixtures.OFFERS
_ALL_OFFERS = fixtures.OFFERS + " UNION ALL " + fixtures.PART_OFFERS.replace("{part}", "part")
_HOLLOW = r"NOT regexp_matches(coalesce({0}, ''), '[^\s\x{{85}}\p{{Z}}]')"
_BLANKS = "CASE {0} % 3 WHEN 0 THEN '  ' WHEN 1 THEN chr(10) || chr(9) ELSE chr(160) || chr(8195) END"
_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_PAIRS = f"pairs AS (SELECT a.vec_id AS offer_id, b.vec_id AS cand_id, b.label, round({_COS}, 6) AS score, {_COS} AS raw FROM embeddings a, embeddings b WHERE a.vec_id < 5 AND b.vec_id >= 5)"
_ADJ = f"""{_PAIRS},
asks AS (SELECT vec_id AS offer_id, CASE WHEN vec_id % 4 <> 3 THEN 3 + vec_id END AS ra, CASE WHEN vec_id % 2 = 0 THEN 2 END AS rt, CASE WHEN vec_id <> 3 THEN 4 + vec_id % 3 END AS ri FROM embeddings WHERE vec_id < 5),
has AS (SELECT vec_id AS cand_id, CASE WHEN vec_id % 11 <> 0 THEN vec_id % 9 END AS pa, nullif(vec_id % 4, 0) AS pt, nullif(vec_id % 7, 0) AS pi FROM embeddings WHERE vec_id >= 5),
adj AS (SELECT *, round(CASE WHEN pa < ra THEN least((ra - pa) * 0.05::DOUBLE, 0.2::DOUBLE) ELSE 0 END + CASE WHEN pt < rt THEN least((rt - pt) * 0.04::DOUBLE, 0.08::DOUBLE) ELSE 0 END
  + CASE WHEN pi < ri THEN least((ri - pi) * 0.03::DOUBLE, 0.09::DOUBLE) ELSE 0 END, 4) AS penalizacion FROM pairs JOIN asks USING (offer_id) JOIN has USING (cand_id)),
ranked AS (SELECT *, round(score - penalizacion, 6) AS score_ajustado FROM adj),
pos AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY score DESC, cand_id)::INT AS raw_pos, row_number() OVER (PARTITION BY offer_id ORDER BY score_ajustado DESC, cand_id)::INT AS adj_pos FROM ranked)"""

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORM = "trim(lower(strip_accents({0})))"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {repr(v)}" for k, v in table.items()) + " END"


def _sections(source: str, header: str, section: str) -> str:
    """CTEs that end in sec(doc_id, section, text)."""
    return f"""src AS ({source}),
ln AS (SELECT doc_id, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) AS p FROM src),
tl AS (SELECT *, trim(line) AS x, rtrim({_NORM.format("line")}, ':') AS title FROM ln),
hd AS (SELECT *, {header} AS is_header FROM tl),
op AS (SELECT *, CASE WHEN is_header THEN coalesce({section}, 'otros') END AS opens FROM hd),
cf AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'otros') AS section FROM op),
sec AS (SELECT doc_id, section, {_TRIM.format("string_agg(line, chr(10) ORDER BY p)")} AS text FROM cf WHERE NOT is_header GROUP BY doc_id, section)"""


_CV_SEC = _sections(
    _CV, "(x <> '' AND length(x) <= 40 AND NOT ends_with(x, '.') AND NOT regexp_matches(x, '[0-9(]') AND x = upper(x) AND regexp_matches(x, '[A-ZÁÉÍÓÚÑ]{3}'))", _case("title", rules.CV_HEADERS)
)
_OF_SEC, _ALL_SEC = (_sections(
    source,
    f"(x <> '' AND length(x) <= 60 AND NOT regexp_matches(x, '^[-*•]') AND (title IN ({_in([*rules.OFFER_HEADERS, *rules.OFFER_CLOSERS])}) OR (ends_with(x, ':') AND NOT contains(x, '.') AND NOT contains(x, ','))))",
    _case("title", rules.OFFER_HEADERS),
) for source in (_OFFERS, _ALL_OFFERS))
_NUM = "|".join(rules.NUMBER_WORDS)


def _years(t: str) -> str:
    n = _NORM.format(t)
    a = rf"regexp_extract({n}, '\b(\d{{1,2}}|{_NUM})\s*\+?\s*anos?\s+(?:de\s+experiencia|\w+ando|\w+iendo|of\s+experience)', 1)"
    b = rf"regexp_extract({n}, '\b(\d{{1,2}}|{_NUM})\s*\+?\s*years?\s+of\s+experience', 1)"
    v = f"coalesce(nullif({a}, ''), nullif({b}, ''))"
    return f"coalesce(try_cast({v} AS INT), {_case(v, rules.NUMBER_WORDS)})"


def _degree(t: str) -> str:
    n = _NORM.format(t)
    rest = rf"regexp_replace({n}, '\bgrado superior\b', ' ', 'g')"
    return f"greatest(CASE WHEN regexp_matches({n}, '{rules.VOCATIONAL}') THEN 1 END, CASE WHEN regexp_matches({rest}, '{rules.MASTER}') THEN 3 END, CASE WHEN regexp_matches({rest}, '{rules.DEGREE}') THEN 2 END)"


def _english(t: str) -> str:
    """The first mention with a level, among all mentions of a text."""
    n, mention = _NORM.format(t), r"\b(?:ingles|english)\b"
    lengths = lambda x: f"list_sum(list_transform({x}[1:k], lambda y: length(y)))"
    end = f"({lengths(f'string_split_regex({n}, {chr(39)}{mention}{chr(39)})')} + {lengths(f'regexp_extract_all({n}, {chr(39)}{mention}{chr(39)})')})::BIGINT"
    w = rf"regexp_extract(substr({n}, {end} + 1, 80), '(?s)^(.*?)(?:{rules.OTHER_LANGUAGES}|$)', 1)"
    phrases = " ".join(f"WHEN contains(w, '{p}') THEN {x}" for p, x in rules.LEVEL_PHRASES.items())
    level = f"coalesce({_case(r"regexp_extract(w, '\b([abc][12])\b', 1)", rules.LEVELS)}, CASE {phrases} END)"
    windows = f"list_transform(range(1, len(regexp_extract_all({n}, '{mention}')) + 1), lambda k: {w})"
    return f"list_filter(list_transform({windows}, lambda w: {level}), lambda x: x IS NOT NULL)[1]"


def _sect(name: str) -> str:
    return f"coalesce((SELECT max(text) FROM sec WHERE sec.doc_id = src.doc_id AND section = '{name}'), '')"


_R = rules.RANGE.replace("'", "''")
_PROFILE = f"""{_CV_SEC},
held AS (SELECT src.doc_id, src.texto, coalesce(e.text, '') AS e, coalesce(f.text, '') AS f, coalesce(i.text, '') AS i FROM src
  LEFT JOIN sec e ON e.doc_id = src.doc_id AND e.section = 'experiencia' LEFT JOIN sec f ON f.doc_id = src.doc_id AND f.section = 'formacion'
  LEFT JOIN sec i ON i.doc_id = src.doc_id AND i.section = 'idiomas'),
rg AS (SELECT doc_id, unnest(regexp_extract_all({_NORM.format("e")}, '{_R}', 1)) AS a, unnest(regexp_extract_all({_NORM.format("e")}, '{_R}', 2)) AS b FROM held),
iv AS (SELECT DISTINCT doc_id, a::INT AS s, coalesce(try_cast(b AS INT), {fixtures.THIS_YEAR}) AS e FROM rg WHERE coalesce(try_cast(b AS INT), {fixtures.THIS_YEAR}) >= a::INT),
hw AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9999) AS upto FROM iv),
tot AS (SELECT doc_id, sum(greatest(0, e - greatest(s, upto))) AS n FROM hw GROUP BY doc_id),
profile AS (SELECT held.doc_id, coalesce(nullif(tot.n, 0), {_years("texto")})::INT AS anios, {_degree("f")} AS titulacion, {_english("i")} AS ingles FROM held LEFT JOIN tot USING (doc_id))"""

_NAMES = r"""src AS ({0}),
ls AS (SELECT doc_id, archivo, list_filter(list_transform(string_split(texto, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM src),
fl AS (SELECT *, list_filter(l, lambda x: trim(lower(x), '.:') NOT IN ('curriculum', 'curriculum vitae', 'cv', 'resume', 'resumen', 'hoja de vida', 'datos personales'))[1] AS a, l[2] AS b FROM ls),
nm AS (SELECT doc_id, archivo, CASE WHEN len(string_split(a, ' ')) BETWEEN 2 AND 5 AND length(a) BETWEEN 5 AND 60 AND regexp_matches(a, '^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ''’.\- ]+$')
    THEN CASE WHEN a = upper(a) THEN array_to_string(list_transform(string_split(lower(a), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE a END END AS nombre,
  trim(string_split(string_split(b, '|')[1], '·')[1], ' .,-–—') AS c FROM fl),
tt AS (SELECT *, CASE WHEN length(c) BETWEEN 3 AND 60 AND NOT regexp_matches(c, '[@,0-9]') AND c <> upper(c) THEN c END AS puesto FROM nm)""".format(_CV)
_FILE = "array_to_string(list_transform(list_filter(string_split(replace(replace(regexp_replace(archivo, '\\.[^.]*$', ''), '_', ' '), '-', ' '), ' '), lambda w: w <> ''), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ')"

_REPAIR = "translate({0}, 'ıİ', 'iI')"
for _m, _table in (("´", dict(zip("aeiouAEIOU", "áéíóúÁÉÍÓÚ"))), ("˜", dict(zip("nN", "ñÑ")))):
    for _p, _a in _table.items():
        _REPAIR = f"replace({_REPAIR}, '{_p}{_m}', '{_a}')"
for _m, _table in (("´", dict(zip("aeiouAEIOU", "áéíóúÁÉÍÓÚ"))), ("˜", dict(zip("nN", "ñÑ")))):
    for _p, _a in _table.items():
        _REPAIR = f"replace({_REPAIR}, '{_m}{_p}', '{_a}')"
_DIRTY = "replace(replace(replace(text, '. ', '-' || chr(10) || ' '), ' de ', ' •' || chr(9) || chr(9) || ' '), ',' || chr(10), chr(10) || chr(10) || chr(10) || chr(10))"
_TIDY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, '•◦●▪·', '     '), '-\s*\n\s*', '', 'g'), '[ \t\r\f\v]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_CLEAN = _TIDY.format(_REPAIR.format(_DIRTY))
_FLAT = r"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')"
_EDGE = r"[^\p{L}\p{N}_]"
_CAPS = rf"[A-ZÁÉÍÓÚÑ]{{2,}}(?:{_EDGE}|$)"

_CAND = f"""cv AS ({_CV}),
cand AS (SELECT doc_id::INT AS id, 'cand ' || doc_id AS nombre, doc_id || '_' || archivo AS archivo, CASE WHEN doc_id % 13 <> 4 THEN texto END AS texto_cv,
  CASE WHEN doc_id % 7 <> 3 THEN a.embedding END AS embedding, CASE WHEN doc_id % 5 <> 2 THEN [a.embedding, b.embedding] END AS fragmentos,
  make_timestamp((1700000000 + doc_id * 3600) * 1000000) AS fecha_alta
  FROM cv JOIN embeddings a ON a.vec_id = doc_id % 480 + 6 JOIN embeddings b ON b.vec_id = doc_id % 480 + 7),
fil AS (SELECT DISTINCT archivo FROM cand WHERE id % 4 <> 1)"""
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
_SECOND = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_AT = "make_timestamp((1800000000 + {0})::BIGINT * 1000000)"
_DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COSINE = "{0} / (sqrt({1}) * sqrt({2}))".format(_DOT.format("o.v", "c.embedding"), _DOT.format("o.v", "o.v"), _DOT.format("c.embedding", "c.embedding"))
_DEGREES = _in(rules.DEGREE_NAMES.values())
_CODES = _in(k.upper() for k in rules.LEVELS)
_RANKED = f"""{_CAND},
off AS (SELECT o.doc_id::INT AS offer_id, 'Oferta ' || o.doc_id AS titulo, e.embedding AS v FROM ({_OFFERS}) o JOIN embeddings e ON e.vec_id = o.doc_id - 1),
prof AS (SELECT * FROM (WITH {_PROFILE} SELECT * FROM profile)),
ask AS (SELECT * FROM (WITH {_OF_SEC}, q AS (SELECT src.doc_id, coalesce(text, '') AS t FROM src LEFT JOIN sec ON sec.doc_id = src.doc_id AND section = 'requisitos')
  SELECT doc_id AS offer_id, {_years('t')} AS ra, {_degree('t')} AS rt, {_english('t')} AS ri FROM q)),
sc AS (SELECT o.offer_id, o.titulo, c.id, c.nombre, {_COSINE} AS score, p.anios AS pa, p.titulacion AS pt, p.ingles AS pi, ra, rt, ri,
  CASE WHEN c.fragmentos IS NULL OR {_DOT.format("c.fragmentos[1]", "o.v")} >= {_DOT.format("c.fragmentos[2]", "o.v")} THEN 'inicio de ' ELSE 'final de ' END || c.nombre AS extracto
  FROM off o CROSS JOIN cand c JOIN ask ON ask.offer_id = o.offer_id LEFT JOIN prof p ON p.doc_id = c.id AND c.texto_cv IS NOT NULL WHERE c.embedding IS NOT NULL),
pn AS (SELECT *, round(CASE WHEN pa < ra THEN least((ra - pa) * 0.05::DOUBLE, 0.2::DOUBLE) ELSE 0 END + CASE WHEN pt < rt THEN least((rt - pt) * 0.04::DOUBLE, 0.08::DOUBLE) ELSE 0 END
  + CASE WHEN pi < ri THEN least((ri - pi) * 0.03::DOUBLE, 0.09::DOUBLE) ELSE 0 END, 4) AS penalizacion, list_filter([
  CASE WHEN pa < ra THEN 'pide ' || ra || ' años de experiencia, se le calculan ' || pa END,
  CASE WHEN pt < rt THEN 'pide ' || ([{_DEGREES}])[rt::INT] || ', acredita ' || ([{_DEGREES}])[pt::INT] END,
  CASE WHEN pi < ri THEN 'pide inglés ' || ([{_CODES}])[ri::INT] || ', acredita ' || ([{_CODES}])[pi::INT] END], lambda x: x IS NOT NULL) AS avisos FROM sc),
rk AS (SELECT *, score - penalizacion AS score_ajustado, row_number() OVER (PARTITION BY offer_id ORDER BY score - penalizacion DESC, id)::INT AS posicion,
  row_number() OVER (PARTITION BY offer_id ORDER BY score DESC, id)::INT AS raw_pos FROM pn)"""
_BAR = "rpad(repeat('#', round_even(greatest({0}, 0) * 20, 0)::INT), 20, '.')"
_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"
_UNITS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_COLUMNS = {
    "candidatos": "id int, nombre string, archivo string, texto_cv string, embedding array<float>, fragmentos array<array<float>>, fecha_alta timestamp",
    "puestos": "id int, titulo string, descripcion string, huella string, embedding array<float>, fecha_alta timestamp",
    "matches": "candidato_id int, puesto_id int, score float, fecha timestamp",
}

def _pages(source: str) -> str:
    """(doc_id, text) of the texts of a source, put on pages and read again."""
    return f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
p AS (SELECT doc_id, list_filter(list_transform(range(0, len(ls), 50), lambda i: array_to_string(ls[i + 1:i + 50], chr(10))), lambda x: NOT ({_HOLLOW.format('x')})) AS ps FROM l),
t AS (SELECT doc_id, nfc_normalize(array_to_string(ps, chr(10) || chr(10))) AS text FROM p)
SELECT doc_id, {_TIDY.format(_REPAIR.format('text'))} AS text FROM t"""


def _chunks(source: str, limit: int) -> str:
    """(doc_id, pos, chunk) of the texts of a source, words as tokens."""
    return rf"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, list_transform({_UNITS}, lambda x: {{'u': x, 'w': regexp_split_to_array(x, '\s+')}}) AS l FROM {source}),
f AS (SELECT doc_id, text, flatten(list_transform(l, lambda x: CASE WHEN len(x.w) <= {limit} THEN [{{'t': x.u, 'n': len(x.w)}}]
  ELSE list_transform(range(0, len(x.w), {limit}), lambda k: {{'t': array_to_string(x.w[k + 1:k + {limit}], ' '), 'n': len(x.w[k + 1:k + {limit}])}}) END)) AS p FROM u),
r AS (SELECT doc_id, text, p, list_reduce(list_transform(p, lambda x: {{'used': x.n, 'no': 0::BIGINT, 'c': [0::BIGINT]}}), lambda a, x: CASE WHEN a.used + x.used <= {limit}
  THEN {{'used': a.used + x.used, 'no': a.no, 'c': list_append(a.c, a.no)}} ELSE {{'used': x.used, 'no': a.no + 1, 'c': list_append(a.c, a.no + 1)}} END) AS z FROM f WHERE len(p) > 0),
g AS (SELECT doc_id, unnest(list_transform(p, lambda x: x.t)) AS t, generate_subscripts(p, 1) AS i, unnest(z.c) AS pos FROM r),
h AS (SELECT doc_id, pos, string_agg(t, ' ' ORDER BY i) AS chunk FROM g GROUP BY doc_id, pos UNION ALL SELECT doc_id, 0, text FROM f WHERE len(p) = 0)
SELECT doc_id, pos::INT AS pos, chunk FROM h"""


SQL = {
    "cosine_rank_topk": f"WITH {_PAIRS} SELECT offer_id, posicion, cand_id, score FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY score DESC, cand_id)::INT AS posicion FROM pairs) WHERE posicion <= 5",
    "pruned_rank_topk": f"""SELECT offer_id, posicion, cand_id, score FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY score DESC, cand_id)::INT AS posicion
  FROM (SELECT a.vec_id AS offer_id, b.vec_id AS cand_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0)) WHERE posicion <= 5""",
    "offer_candidate_matrix": f"WITH {_PAIRS} SELECT offer_id, cand_id, score FROM pairs",
    "best_fragment": f"WITH {_PAIRS} SELECT offer_id, label, cand_id AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY offer_id, label ORDER BY score DESC, cand_id) AS n FROM pairs) WHERE n = 1",
    "fragment_centroid": """WITH u AS (SELECT label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id >= 5),
x AS (SELECT label, unnest(e) / (CASE WHEN n = 0 THEN 1 ELSE n END) AS x, generate_subscripts(e, 1) - 1 AS dim FROM u)
SELECT label, dim::INT AS dim, round(avg(x), 6) AS x FROM x GROUP BY label, dim""",
    "pooling_ablation": f"""WITH {_PAIRS}, g AS (SELECT offer_id, label, list(raw ORDER BY raw DESC) AS s, avg(raw) AS m, max(raw) AS x FROM pairs GROUP BY offer_id, label)
SELECT offer_id, label, round(m, 6) AS mean, round(m * 0.7::DOUBLE + x * (1 - 0.7::DOUBLE), 6) AS mean70, round(m * 0.5::DOUBLE + x * 0.5::DOUBLE, 6) AS mean50, round(m * 0.3::DOUBLE + x * (1 - 0.3::DOUBLE), 6) AS mean30,
  round(list_avg(s[1:3]), 6) AS top3, round(list_avg(s[1:2]), 6) AS top2, round(x, 6) AS max FROM g""",
    "penalty_verdict": f"""WITH {_ADJ} SELECT offer_id, cand_id, penalizacion, array_to_string(list_filter([
  CASE WHEN pa < ra THEN 'pide ' || ra || ' años de experiencia, se le calculan ' || pa END,
  CASE WHEN pt < rt THEN 'pide ' || (['FP o Grado Superior', 'Grado', 'Máster'])[rt::INT] || ', acredita ' || (['FP o Grado Superior', 'Grado', 'Máster'])[pt::INT] END,
  CASE WHEN pi < ri THEN 'pide inglés ' || (['A1', 'A2', 'B1', 'B2', 'C1', 'C2'])[ri::INT] || ', acredita ' || (['A1', 'A2', 'B1', 'B2', 'C1', 'C2'])[pi::INT] END], lambda x: x IS NOT NULL), ' · ') AS avisos FROM adj""",
    "adjusted_rank": f"WITH {_ADJ} SELECT offer_id, adj_pos AS posicion, cand_id, score, penalizacion, score_ajustado FROM pos WHERE adj_pos <= 5",
    "rank_shift": f"WITH {_ADJ} SELECT offer_id, cand_id, raw_pos, adj_pos, adj_pos - raw_pos AS shift FROM pos",
    "control_positions": f"WITH {_ADJ} SELECT offer_id, count(*) AS n, round(avg(raw_pos), 6) AS raw_mean, round(avg(adj_pos), 6) AS adj_mean FROM pos WHERE label = 0 GROUP BY offer_id",
    "winner_change": f"""WITH {_ADJ} SELECT offer_id, max(cand_id) FILTER (adj_pos = 1) AS winner,
  CASE WHEN max(cand_id) FILTER (adj_pos = 1) <> max(cand_id) FILTER (raw_pos = 1) THEN 'antes: ' || max(cand_id) FILTER (raw_pos = 1) ELSE '' END AS note FROM pos GROUP BY offer_id""",
    "score_heatmap": f"WITH {_PAIRS} SELECT cand_id, {', '.join(f'max(score) FILTER (offer_id = {i}) AS offer_{i}' for i in range(5))} FROM pairs GROUP BY cand_id",
    "angle_degrees": f"WITH {_PAIRS} SELECT offer_id, cand_id, round(degrees(acos(greatest(-1, least(1, raw)))), 4) AS grados FROM pairs",
    "rank_bar": f"WITH {_PAIRS} SELECT offer_id, cand_id, rpad(repeat('#', round_even(greatest(score, 0) * 20, 0)::INT), 20, '.') AS bar, round(greatest(score, 0) * 100, 4) AS percent FROM pairs",
    "section_segment_cv": f"WITH {_CV_SEC} SELECT doc_id, section, text FROM sec",
    "section_segment_offer": f"WITH {_ALL_SEC} SELECT doc_id, section, text FROM sec",
    "cv_profile": f"WITH {_PROFILE} SELECT * FROM profile",
    "offer_requirements": f"WITH {_ALL_SEC}, q AS (SELECT src.doc_id, coalesce(text, '') AS t FROM src LEFT JOIN sec ON sec.doc_id = src.doc_id AND section = 'requisitos') SELECT doc_id, {_years('t')} AS anios, {_degree('t')} AS titulacion, {_english('t')} AS ingles FROM q",
    "years_interval_union": """WITH iv AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS s, year(o_orderdate) + 1 + o_custkey % 3 AS e FROM orders),
hw AS (SELECT *, coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9999) AS upto FROM iv)
SELECT o_custkey, sum(greatest(0, e - greatest(s, upto)))::INT AS anios FROM hw GROUP BY o_custkey""",
    "years_phrase": f"SELECT doc_id, {_years('texto')} AS anios FROM ({_CV})",
    "degree_level": f"SELECT doc_id, {_degree('texto')} AS titulacion FROM ({_CV})",
    "english_level": f"SELECT doc_id, {_english('texto')} AS ingles FROM ({_CV})",
    "extractor_coverage": f"WITH {_PROFILE} SELECT count(*) AS total, count(*) FILTER (anios IS NULL) AS sin_anios, count(*) FILTER (titulacion IS NULL) AS sin_titulacion, count(*) FILTER (ingles IS NULL) AS sin_ingles FROM profile",
    "accent_repair": f"SELECT doc_id, md5({_REPAIR.format(chr(40) + 'replace(replace(replace(text, ' + repr('ó') + ', ' + repr('o´') + '), ' + repr('é') + ', ' + repr('´e') + '), ' + repr('ñ') + ', ' + repr('n˜') + ')' + chr(41))}) AS h FROM documents",
    "clean_text": f"SELECT doc_id, md5({_CLEAN}) AS h FROM documents",
    "candidate_name": f"WITH {_NAMES} SELECT doc_id, CASE WHEN archivo = 'CV1.pdf' THEN 'CV1' WHEN nombre IS NOT NULL THEN nombre || coalesce(' - ' || puesto, '') ELSE {_FILE} END AS nombre, {_FILE} AS de_archivo FROM tt",
    "candidate_title": f"WITH {_NAMES} SELECT doc_id, nombre, puesto FROM tt",
    "sentence_units": f"""WITH u AS (SELECT doc_id, {_UNITS} AS l FROM documents)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, md5(unnest(l)) AS h FROM u""",
    "hashed_embedding_score": r"""WITH t AS (SELECT 'o' AS k, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
tok AS (SELECT k, id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS w FROM t),
c AS (SELECT k, id, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 384)::INT AS dim, count(*)::DOUBLE AS n FROM tok WHERE w <> '' GROUP BY ALL),
x AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY k, id)) AS x FROM c),
s AS (SELECT o.id AS offer_id, d.id AS doc_id, round(sum(o.x * d.x), 6) AS score FROM x o JOIN x d ON o.dim = d.dim AND o.k = 'o' AND d.k = 'd' GROUP BY ALL)
SELECT offer_id, posicion, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY score DESC, doc_id)::INT AS posicion FROM s) WHERE posicion <= 5""",
    "upsert_latest": """WITH e AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL)
SELECT user_id, round(arg_max(value, ts), 4) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seq, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS fecha_alta FROM e GROUP BY user_id""",
    "upsert_merge": """WITH s AS (SELECT c_custkey AS id, c_name AS archivo, c_acctbal::DOUBLE AS saldo FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey + 1000000 AS id, c_name AS archivo, c_acctbal::DOUBLE + 1 AS saldo FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(s.id, n.id) AS id, coalesce(s.archivo, n.archivo) AS archivo, round(coalesce(n.saldo, s.saldo), 2) AS saldo FROM s FULL JOIN n ON s.archivo = n.archivo""",
    "offer_fingerprint": r"SELECT item_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS huella FROM benchmark",
    "cascade_delete": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY o_custkey",
    "candidate_listing": f"WITH {_CAND} SELECT id, nombre, archivo, coalesce(length(texto_cv), 0)::INT AS caracteres, {_ISO.format('fecha_alta')} AS fecha_alta FROM cand",
    "candidate_detail": f"""WITH {_CAND} SELECT id, nombre, archivo, md5(coalesce(texto_cv, '')) AS h, length(coalesce(texto_cv, ''))::INT AS caracteres, {_ISO.format('fecha_alta')} AS fecha_alta,
  embedding IS NOT NULL AS indexado, archivo IN (SELECT archivo FROM fil) AS pdf_disponible FROM cand""",
    "candidate_by_id": f"WITH {_CAND} SELECT id, archivo, embedding IS NOT NULL AS indexado, archivo IN (SELECT archivo FROM fil) AS pdf_disponible FROM cand WHERE id = 7",
    "candidate_pdf": f"""WITH {_CAND}, c AS (SELECT id, CASE WHEN id = 9 THEN '../x.pdf' ELSE archivo END AS archivo FROM cand),
a AS (SELECT id FROM c WHERE id % 3 = 0 UNION ALL SELECT -id - 1 FROM c WHERE id % 50 = 0)
SELECT a.id, c.archivo, CASE WHEN c.id IS NULL THEN 404 WHEN contains(c.archivo, '/') THEN 400 WHEN c.archivo NOT IN (SELECT archivo FROM fil) THEN 404 ELSE 200 END AS status FROM a LEFT JOIN c ON c.id = a.id""",
    "vector_scan": f"WITH {_CAND} SELECT id, nombre, len(embedding)::INT AS dimension, coalesce(len(fragmentos), 0)::INT AS n, round(embedding[1]::DOUBLE, 5) AS x0 FROM cand WHERE embedding IS NOT NULL",
    "upload_statuses": "SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN 400 WHEN doc_id % 5 = 0 OR " + _HOLLOW.format("text") + " THEN 422 ELSE 200 END AS status FROM documents",
    "json_requests": f"""WITH r AS (SELECT CASE WHEN item_id % 5 = 0 THEN {_BLANKS.format('item_id')} WHEN item_id % 7 <> 0 THEN text ELSE '' END AS texto, item_id AS i FROM benchmark)
SELECT md5(texto) AS h, CASE WHEN i % 2 = 0 THEN 'Oferta ' || i ELSE 'Oferta via API' END AS titulo, CASE WHEN i % 3 = 0 THEN (i % 4)::INT END AS top, i % 4 <> 0 AS guardar,
  CASE WHEN {_HOLLOW.format('texto')} THEN 400 ELSE 200 END AS status FROM r""",
    "stdin_offer": "SELECT item_id, md5(text || chr(65533) || 'A' || chr(65533)) AS h FROM benchmark",
    "offer_titles": f"""WITH n AS (SELECT p_partkey, replace(replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '_o''neil-SQL' ELSE '' END, '_', ' ') AS x FROM part)
SELECT p_partkey, {_TITLE.format('x')} AS titulo FROM n""",
    "pdf_text": f"SELECT doc_id, md5(text) AS h, NULL::VARCHAR AS error FROM ({_pages('documents')})",
    "landed_uploads": f"""SELECT 'doc_' || d.doc_id || CASE d.doc_id % 4 WHEN 0 THEN '.PDF' WHEN 3 THEN '.docx' ELSE '.pdf' END AS archivo,
  CASE WHEN d.doc_id % 4 = 3 THEN 400 WHEN d.doc_id % 5 = 0 OR {_HOLLOW.format('d.text')} THEN 422 ELSE 200 END AS status,
  CASE WHEN d.doc_id % 4 <> 3 AND NOT (d.doc_id % 5 = 0 OR {_HOLLOW.format('d.text')}) THEN md5(p.text) END AS h FROM documents d JOIN ({_pages('documents')}) p ON p.doc_id = d.doc_id""",
    "table_schemas": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c.split(' ')[0]}', '{c.split(' ')[1]}')" for t, cols in _COLUMNS.items() for i, c in enumerate(cols.split(", "))) + ") AS t(tabla, pos, columna, tipo)"
    + " UNION ALL SELECT table_name, ordinal_position - 1, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"
    + " FROM information_schema.columns WHERE table_name IN ('documents', 'embeddings', 'benchmark', 'labels')",
    "save_candidates": f"""WITH {_CAND}, s AS (SELECT * FROM cand WHERE id % 2 = 0), n AS (SELECT archivo, nombre || ' bis' AS nombre FROM cand WHERE id % 3 = 0)
SELECT coalesce(s.id, (SELECT max(id) FROM s) + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY n.archivo))::INT AS id, coalesce(s.archivo, n.archivo) AS archivo, coalesce(n.nombre, s.nombre) AS nombre,
  md5(CASE WHEN n.archivo IS NOT NULL THEN 'texto' ELSE coalesce(s.texto_cv, '') END) AS h, {_SECOND.format('coalesce(s.fecha_alta, ' + _AT.format(9) + ')')} AS fecha_alta FROM s FULL JOIN n ON n.archivo = s.archivo""",
    "save_offers": rf"""WITH b AS (SELECT text, min(item_id)::INT AS id, sha256({_TRIM.format('text')}) AS huella FROM benchmark GROUP BY text),
s AS (SELECT * FROM b WHERE id % 2 = 0), n AS (SELECT * FROM b WHERE id % 3 = 0)
SELECT coalesce(s.id, (SELECT max(id) FROM s) + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY n.huella))::INT AS id, CASE WHEN n.id IS NULL THEN 'Uno' ELSE 'Dos' END AS titulo,
  md5(regexp_replace(CASE WHEN s.id IS NULL THEN 'Dos: ' || n.text ELSE 'Uno: ' || s.text END, '\s', '', 'g')) AS h, coalesce(s.huella, n.huella) AS huella,
  {_SECOND.format('CASE WHEN s.id IS NULL THEN ' + _AT.format(7) + ' ELSE ' + _AT.format(0) + ' END')} AS fecha_alta FROM s FULL JOIN n ON n.huella = s.huella""",
    "save_matches": f"""WITH {_RANKED} SELECT id AS candidato_id, offer_id AS puesto_id, round((CASE WHEN id % 3 = 0 THEN score::FLOAT / 2 ELSE score::FLOAT END)::FLOAT::DOUBLE, 5) AS score,
  {_SECOND.format('CASE WHEN id % 3 = 0 THEN ' + _AT.format(60) + ' ELSE ' + _AT.format(0) + ' END')} AS fecha FROM sc WHERE id % 3 = 0 OR (id + offer_id) % 2 = 0""",
    "rank_detailed": f"WITH {_RANKED} SELECT offer_id, posicion, id AS cand_id, nombre, round(score, 6) AS score, penalizacion, round(score_ajustado, 6) AS score_ajustado, array_to_string(avisos, ' · ') AS avisos, extracto FROM rk",
    "rank": f"WITH {_RANKED} SELECT offer_id, posicion, nombre, round(score, 6) AS score FROM rk",
    "match_response": f"""WITH {_RANKED}, t AS (SELECT * FROM rk WHERE posicion <= 3)
SELECT offer_id, 200 AS status, any_value(titulo) AS titulo, count(*)::INT AS total, max(nombre) FILTER (posicion = 1) AS primero, max(nombre) FILTER (posicion = 3) AS tercero,
  max(avisos[1]) FILTER (posicion = 1) AS aviso, 2 AS segunda, NULL AS detail FROM t GROUP BY offer_id
UNION ALL SELECT unnest([7, 9, 10, 11]), 400, NULL, NULL, NULL, NULL, NULL, NULL, 'El campo ''texto'' esta vacio.' UNION ALL SELECT 8, 409, NULL, NULL, NULL, NULL, NULL, NULL, 'No hay candidatos con embedding.'""",
    "top_zero": f"WITH {_RANKED} SELECT offer_id, posicion, nombre FROM rk WHERE posicion = 1",
    "shown_ranking": f"""WITH {_RANKED} SELECT offer_id, posicion, posicion = 1 AS es_lider, nombre, round(degrees(acos(greatest(-1, least(1, score)))), 4) AS grados, array_to_string(avisos, ' · ') AS aviso,
  extracto AS cita, round(greatest(score_ajustado, 0) * 100, 4) AS percent FROM rk WHERE posicion <= 8""",
    "console_table": f"""WITH {_RANKED}, t AS (SELECT *, greatest(max(length(nombre)) OVER (PARTITION BY offer_id), 9) AS w FROM rk WHERE posicion <= 8)
SELECT offer_id, posicion, rpad(posicion::VARCHAR, 4, ' ') || rpad(nombre, (w + 4)::INT, ' ') || lpad(printf('%.4f', score), 10, ' ') || '  ' || {_BAR.format('score')} AS linea FROM t""",
    "ranking_measurement": f"""WITH {_RANKED}, t AS (SELECT *, CASE id % 20 WHEN 0 THEN 'Beatriz ' WHEN 1 THEN 'Javier ' ELSE 'Otra ' END || id AS quien, id % 20 < 2 AS control FROM rk),
m AS (SELECT offer_id, max(quien) FILTER (posicion = 1) AS ganador, max(quien) FILTER (raw_pos = 1) AS antes, count(*) FILTER (control) AS controles,
  (sum(raw_pos) FILTER (control))::BIGINT AS sin_filtro, (sum(posicion) FILTER (control))::BIGINT AS con_filtro FROM t GROUP BY offer_id)
SELECT m.offer_id, ganador, nullif(antes, ganador) AS antes, controles, sin_filtro, con_filtro,
  coalesce(nullif(concat_ws(',', ra || 'a', (['FP', 'Grado', 'Master'])[rt::INT], ([{_CODES}])[ri::INT]), ''), '-') AS pide FROM m JOIN ask ON ask.offer_id = m.offer_id""",
    "fragment_index": f"""WITH {_RANKED} SELECT c.id AS cand_id, CASE WHEN c.fragmentos IS NULL OR {_DOT.format("c.fragmentos[1]", "o.v")} >= {_DOT.format("c.fragmentos[2]", "o.v")} THEN 0 ELSE 1 END AS indice
FROM cand c, off o WHERE o.offer_id = 1""",
    "ingest_batch": f"""WITH {_CAND}, nam AS (SELECT * FROM (WITH {_NAMES}, z AS (SELECT doc_id, nombre, puesto, doc_id || '_' || archivo AS archivo FROM tt)
  SELECT doc_id, CASE WHEN nombre IS NOT NULL THEN nombre || coalesce(' - ' || puesto, '') ELSE {_FILE} END AS nombre FROM z)),
b AS (SELECT id, archivo, CASE WHEN id % 17 <> 5 THEN texto_cv END AS texto_cv FROM cand),
k AS (SELECT c.archivo, texto_cv, n.nombre, row_number() OVER (PARTITION BY texto_cv IS NULL ORDER BY c.archivo)::INT AS id FROM b c JOIN nam n ON n.doc_id = c.id)
SELECT archivo, CASE WHEN texto_cv IS NULL THEN 422 ELSE 200 END AS status, CASE WHEN texto_cv IS NOT NULL THEN id END AS id, CASE WHEN texto_cv IS NOT NULL THEN nombre END AS nombre,
  length(texto_cv)::INT AS caracteres, CASE WHEN texto_cv IS NOT NULL THEN 2 END AS dimension, CASE WHEN texto_cv IS NULL THEN archivo || ': sin texto extraible, se omite.' END AS aviso FROM k""",
    "ingest_count": f"WITH {_CAND} SELECT count(texto_cv) FILTER (id % 17 <> 5) AS guardados, count(*) - count(texto_cv) FILTER (id % 17 <> 5) AS omitidos FROM cand",
    "text_preview": r"SELECT doc_id, substr(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')[1:8], ' '), 1, 60) AS inicio, coalesce(length(text), 0)::INT AS chars FROM documents",
    "nfc_compose": "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents",
    "plain_text": r"WITH t AS (SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '^\s+|\s+$', '', 'g')) AS h FROM documents) SELECT doc_id, h AS por_formas, h AS por_tabla FROM t",
    "profile_extraction": "SELECT c_custkey AS doc_id, anios, titulacion, ingles FROM customer JOIN (VALUES " + ", ".join(map(str, profiles.EXPECTED)) + f") AS t(n, anios, titulacion, ingles) ON n = c_custkey % {len(profiles.EXPECTED)}",
    "coverage_report": f"WITH {_PROFILE} SELECT doc_id, coalesce(anios::VARCHAR, '-') AS anios, coalesce((['FP', 'Grado', 'Master'])[titulacion::INT], '-') AS titulacion, coalesce(([{_CODES}])[ingles::INT], '-') AS ingles FROM profile",
    "chunk_pack": f"SELECT doc_id, pos, md5(chunk) AS h, length(chunk)::INT AS chars FROM ({_chunks('documents', 126)})",
    "rank_explained": f"""WITH {_RANKED}, ck AS ({_chunks('(SELECT id AS doc_id, texto_cv AS text FROM cand)', 12)}),
x AS (SELECT rk.offer_id, rk.posicion, rk.id, ck.chunk, row_number() OVER (PARTITION BY rk.offer_id, rk.id ORDER BY {_DOT.format('e.embedding', 'o.v')} DESC, ck.pos) AS n
  FROM rk JOIN off o ON o.offer_id = rk.offer_id JOIN ck ON ck.doc_id = rk.id JOIN embeddings e ON e.vec_id = (rk.id::BIGINT * 7 + ck.pos * 13) % 400 WHERE rk.posicion <= 20)
SELECT offer_id, posicion, id AS cand_id, chunk AS extracto FROM x WHERE n = 1""",
    "health_count": "SELECT count(embedding) AS candidatos, max(len(embedding))::INT AS dimension FROM embeddings",
    "semi_text_fetch": "SELECT doc_id AS id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "quote_extract": rf"""WITH f AS (SELECT doc_id, {_FLAT} AS t FROM documents),
h AS (SELECT doc_id, t, substr(t, 1, 220) AS s FROM f),
m AS (SELECT doc_id, t, NOT regexp_matches(s, '^{_CAPS}') AND regexp_matches(s, '{_EDGE}{_CAPS}') AS found, length(regexp_extract(s, '(?s)^(.*?){_EDGE}{_CAPS}', 1)) AS before FROM h),
c AS (SELECT doc_id, CASE WHEN found THEN substr(t, before + 2) ELSE t END AS t FROM m)
SELECT doc_id, md5(CASE WHEN length(t) > 320 THEN regexp_replace(substr(t, 1, 320), '(?s)^(.*) .*$', '\1') || '...' ELSE t END) AS h FROM c""",
    "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages",
    "char_totals": "SELECT count(*) AS docs, sum(length(text))::BIGINT AS chars, floor(sum(length(text)) / count(*))::BIGINT AS mean_chars, max(length(source)) AS widest FROM documents",
    "vector_json": "SELECT vec_id, len(embedding) AS dim, true AS same, round(list_sum(embedding::DOUBLE[]), 5) AS suma FROM embeddings",
}
