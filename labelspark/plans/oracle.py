"""Equivalent SQL for the registered queries, written for DuckDB.

The statements restate each rule in set form, independently of the Spark expressions, so both
sides can be compared value by value.
"""

from __future__ import annotations

import json
import re
from importlib import resources

from labelspark import fixed_values as V
from labelspark.plans import derived as D
from labelspark.settings import THRESHOLDS

ORACLE: dict[str, str] = {}

SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
BREAKS = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
W = " ".join(V.OFFICIAL_WARNING.split())


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def loose(x: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), "
        rf"'{SPACES}+', ' ', 'g'))"
    )


def spaced(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{SPACES}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def lines(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({x}, '{BREAKS}'), "
        f"lambda y: {strip('y')}), lambda y: y <> '')"
    )


def solid(x: str) -> str:
    return f"length(replace({x}, ' ', ''))"


LAB = f"lab AS ({D.plain(D.labels_sql())})"
CLA = f"cla AS ({D.plain(D.claims_sql())})"
JOINED = (
    f"{LAB}, {CLA}, src AS (SELECT l.ordinal AS id, l.filename, l.confidence, l.text, c.brand, "
    "c.alcohol_content, c.net_contents, c.class_type FROM lab l JOIN cla c "
    "ON c.row_number = l.ordinal)"
)


def similarity_ctes(p: str, pairs: str, windows: str = "false") -> str:
    """CTEs ending in ``{p}_score(a, b, ratio, best)`` for the (a, b) rows of ``pairs``.

    ``windows`` is a condition on (a, b) for which window scores count as well. Needles stay
    under 120 characters, one HUGEINT.
    """
    return f"""
{p}_pair AS (SELECT row_number() OVER () AS pid, a, b, {windows} AS wide FROM ({pairs}) q),
{p}_side AS (
  SELECT pid, a, b, wide, false AS rev,
    CASE WHEN length(a) <= length(b) THEN a ELSE b END AS nd,
    CASE WHEN length(a) <= length(b) THEN b ELSE a END AS hy FROM {p}_pair
  UNION ALL
  SELECT pid, a, b, wide, true, b, a FROM {p}_pair WHERE length(a) = length(b) AND wide),
{p}_mask AS (
  SELECT pid, rev, ch, sum(1::HUGEINT << (k - 1))::HUGEINT AS mask FROM (
    SELECT pid, rev, unnest(string_split(nd, '')) AS ch,
      unnest(range(1, length(nd) + 1)) AS k FROM {p}_side) GROUP BY ALL),
{p}_hay AS (
  SELECT h.pid, h.rev, list(coalesce(m.mask, 0::HUGEINT) ORDER BY h.k) AS masks FROM (
    SELECT pid, rev, unnest(string_split(hy, '')) AS ch,
      unnest(range(1, length(hy) + 1)) AS k FROM {p}_side) h
  LEFT JOIN {p}_mask m ON m.pid = h.pid AND m.rev = h.rev AND m.ch = h.ch GROUP BY ALL),
{p}_full AS (
  SELECT s.*, h.masks, length(s.nd) AS m, length(s.hy) AS n,
    (1::HUGEINT << length(s.nd)) - 1 AS ones FROM {p}_side s JOIN {p}_hay h
  ON h.pid = s.pid AND h.rev = s.rev),
{p}_ratio AS (
  SELECT pid, 200.0::DOUBLE * (m - bit_count(list_reduce(masks,
    lambda s, x: ((s + (s & x)) | (s - (s & x))) & ones, ones))) / (m + n) AS ratio
  FROM {p}_full WHERE NOT rev),
{p}_cut AS (
  SELECT pid, ones, m, masks[greatest(i, 1): least(i + m - 1, n)] AS part,
    least(i + m - 1, n) - greatest(i, 1) + 1 AS size
  FROM (SELECT *, unnest(range(2 - m, n + 1)) AS i FROM {p}_full WHERE wide)),
{p}_window AS (
  SELECT pid, max(200.0::DOUBLE * (m - bit_count(list_reduce(part,
    lambda s, x: ((s + (s & x)) | (s - (s & x))) & ones, ones))) / (m + size)) AS best
  FROM {p}_cut GROUP BY pid),
{p}_score AS (
  SELECT p.a, p.b, r.ratio, greatest(r.ratio, coalesce(w.best, 0)) AS best
  FROM {p}_pair p JOIN {p}_ratio r ON r.pid = p.pid LEFT JOIN {p}_window w ON w.pid = p.pid)"""


def best_line_ctes(p: str, claim: str, src: str = "src") -> str:
    """CTEs ending in ``{p}_best(id, score, line)``; ids without any score get 0 and ''."""
    wide = f"{solid('a')} >= 5 AND {solid('b')} >= {solid('a')}"
    return f"""
{p}_line AS (
  SELECT id, {loose(claim)} AS a, unnest(c) AS line, unnest(range(1, len(c) + 1)) AS pos FROM (
    SELECT *, list_append({lines('text')}, {strip('text')}) AS c FROM {src})),
{p}_norm AS (SELECT *, {loose('line')} AS b FROM {p}_line),
{similarity_ctes(p, f"SELECT DISTINCT a, b FROM {p}_norm WHERE a <> '' AND b <> ''", wide)},
{p}_best AS (
  SELECT s.id, coalesce(t.score, 0) AS score, coalesce(t.line, '') AS line FROM {src} s LEFT JOIN (
    SELECT n.id, n.line, c.best AS score, row_number() OVER (
      PARTITION BY n.id ORDER BY c.best DESC, n.pos) AS rn
    FROM {p}_norm n JOIN {p}_score c ON c.a = n.a AND c.b = n.b WHERE c.best > 0) t
  ON t.id = s.id AND t.rn = 1)"""


def pct(x: str) -> str:
    return f"printf('%.0f', {x})"


def g(x: str) -> str:
    return f"printf('%g', {x})"


# --- single matchers: each yields (id, filename, field, passed, expected, found, ...) -----

def brand_cte() -> str:
    return best_line_ctes("br", "brand") + f""",
f_brand AS (SELECT s.id, s.filename, 1 AS ord, 'brand' AS field, 'Brand name' AS label,
  b.score >= 95 AS passed, s.brand AS expected,
  CASE WHEN b.line = '' THEN {quote(V.MSG_NOT_FOUND)} ELSE b.line END AS found,
  concat('similarity ', {pct('b.score')}, '/100 (threshold 95)') AS detail,
  false AS inconclusive, '' AS review_kind FROM src s JOIN br_best b ON b.id = s.id)"""


NUM = r"\d+(?:\.\d+)?"
ALC = rf"(?i)(?:alc(?:ohol)?\.?(?:\s*/?\s*vol)?\.?\s*)({NUM})"
PROOF = rf"(?i)({NUM})\s*proof"
PCT = rf"({NUM})\s*%"


def candidate_ctes(src: str = "src") -> str:
    """``cand(id, grp, pos, value, label)`` in reading order, then ``abv(id, k, value, label)``."""
    return f"""
pct_hit AS (
  SELECT id, text, i, raw, hit,
    list_sum(list_transform(cut[1:i], lambda y: length(y)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda y: length(y))), 0) AS start
  FROM (SELECT id, text, unnest(range(1, len(raws) + 1)) AS i, unnest(raws) AS raw,
      unnest(hits) AS hit, hits, cut FROM (
    SELECT id, text, regexp_extract_all(text, '{PCT}', 1) AS raws,
      regexp_extract_all(text, '{PCT}', 0) AS hits,
      string_split_regex(text, '{PCT}') AS cut FROM {src}))),
pct_near AS (
  SELECT *, lower(substr(text, greatest(start - 12, 0)::BIGINT + 1,
    (start + length(hit) + 12 - greatest(start - 12, 0))::BIGINT)) AS around FROM pct_hit),
stated AS (
  SELECT id, 1 AS grp, i, raw::DOUBLE AS value, concat({g('raw::DOUBLE')}, '%') AS label
  FROM pct_near WHERE contains(around, 'alc') OR contains(around, 'abv') OR contains(around, 'vol')
  UNION ALL
  SELECT id, 2, i, raw::DOUBLE, concat({g('raw::DOUBLE')}, '% (ALC)') FROM (
    SELECT id, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS raw FROM (
      SELECT id, regexp_extract_all(text, '{ALC}', 1) AS r FROM {src}))
  UNION ALL
  SELECT id, 3, i, raw::DOUBLE / 2, concat(raw, ' proof (= ', {g('raw::DOUBLE / 2')}, '% ABV)')
  FROM (SELECT id, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS raw FROM (
      SELECT id, regexp_extract_all(text, '{PROOF}', 1) AS r FROM {src}))),
cand AS (
  SELECT * FROM stated UNION ALL
  SELECT id, 4, i, raw::DOUBLE, concat({g('raw::DOUBLE')}, '%') FROM pct_hit
  WHERE id NOT IN (SELECT id FROM stated)),
abv_first AS (
  SELECT *, row_number() OVER (PARTITION BY id, value ORDER BY grp, i) AS rn FROM cand),
abv AS (
  SELECT id, value, label, row_number() OVER (PARTITION BY id ORDER BY grp, i) AS k
  FROM abv_first WHERE rn = 1)"""


def abv_cte() -> str:
    return candidate_ctes() + f""",
abv_claim AS (SELECT id, TRY_CAST(nullif(regexp_extract(alcohol_content, '{NUM}'), '') AS DOUBLE)
  AS claimed FROM src),
abv_agg AS (
  SELECT s.id, c.claimed, count(a.value) AS n, string_agg(a.label, ', ' ORDER BY a.k) AS all_found,
    arg_min(a.label, a.k) FILTER (abs(a.value - c.claimed) <= 0.05) AS hit
  FROM src s JOIN abv_claim c ON c.id = s.id LEFT JOIN abv a ON a.id = s.id GROUP BY ALL),
f_abv AS (SELECT s.id, s.filename, 2 AS ord, 'alcohol_content' AS field,
  'Alcohol content' AS label, (hit IS NOT NULL) AS passed,
  CASE WHEN claimed IS NULL THEN CASE WHEN alcohol_content = '' THEN '(none)'
    ELSE alcohol_content END ELSE concat({g('claimed')}, '% ABV') END AS expected,
  CASE WHEN claimed IS NULL THEN {quote(V.MSG_ABV_CLAIM_BAD)} WHEN hit IS NOT NULL THEN hit
    WHEN n > 0 THEN all_found ELSE {quote(V.MSG_ABV_NONE_FOUND)} END AS found,
  CASE WHEN claimed IS NULL THEN concat('could not parse a numeric ABV from the claimed value ''',
      alcohol_content, '''') WHEN hit IS NOT NULL THEN {quote(V.MSG_ABV_MATCH)}
    WHEN n > 0 THEN {quote(V.MSG_ABV_DIFFERS)} ELSE {quote(V.MSG_ABV_NONE_DETAIL)} END AS detail,
  false AS inconclusive, '' AS review_kind FROM src s JOIN abv_agg a ON a.id = s.id)"""


UNITS = "(VALUES " + ", ".join(f"('{u}', {f})" for u, f in V.UNIT_ML.items()) + ") u(unit, factor)"


def net_rows(src: str, column: str) -> str:
    """(id, k, ml, display) rows of the volume statements in ``column``."""
    pattern = V.NET_PATTERN
    return f"""
  SELECT id, k, num * factor AS ml, concat(raw, ' ', unit_raw) AS display FROM (
    SELECT id, k, raw, unit_raw, CASE WHEN raw LIKE '%,%' AND raw NOT LIKE '%.%' THEN
      CASE WHEN length(split_part(raw, ',', 2)) = 3 THEN replace(raw, ',', '')::DOUBLE
        ELSE replace(raw, ',', '.')::DOUBLE END ELSE raw::DOUBLE END AS num
    FROM (SELECT id, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS raw, unnest(b) AS unit_raw
      FROM (SELECT id, regexp_extract_all({column}, '{pattern}', 1) AS a,
        regexp_extract_all({column}, '{pattern}', 2) AS b FROM {src}))) x
  JOIN {UNITS} ON u.unit = lower(x.unit_raw)"""


def net_cte() -> str:
    return f"""
net_want AS (SELECT * FROM ({net_rows('src', 'net_contents')}) WHERE k = 1),
net_have AS ({net_rows('src', 'text')}),
net_agg AS (
  SELECT s.id, w.ml AS want, w.display AS shown, count(h.ml) AS n,
    string_agg(h.display, ', ' ORDER BY h.k) AS all_found,
    arg_min(h.display, h.k) FILTER (abs(h.ml - w.ml) <= 0.5) AS hit
  FROM src s LEFT JOIN net_want w ON w.id = s.id LEFT JOIN net_have h ON h.id = s.id GROUP BY ALL),
f_net AS (SELECT s.id, s.filename, 4 AS ord, 'net_contents' AS field, 'Net contents' AS label,
  (want IS NOT NULL AND hit IS NOT NULL) AS passed,
  CASE WHEN want IS NULL THEN net_contents ELSE shown END AS expected,
  CASE WHEN want IS NULL THEN {quote(V.MSG_NET_CLAIM_BAD)} WHEN hit IS NOT NULL THEN hit
    WHEN n > 0 THEN all_found ELSE {quote(V.MSG_NET_NONE_FOUND)} END AS found,
  CASE WHEN want IS NULL THEN concat('could not parse a metric volume from the claimed value ''',
      net_contents, '''') WHEN hit IS NOT NULL THEN {quote(V.MSG_NET_MATCH)}
    WHEN n > 0 THEN {quote(V.MSG_NET_DIFFERS)} ELSE {quote(V.MSG_NET_NONE_DETAIL)} END AS detail,
  (want IS NOT NULL AND n = 0) AS inconclusive, '' AS review_kind
  FROM src s JOIN net_agg a ON a.id = s.id WHERE trim(s.net_contents) <> '')"""


def _official_masks() -> str:
    table: dict[str, int] = {}
    for i, ch in enumerate(W):
        table[ch] = table.get(ch, 0) | (1 << i)
    low = (1 << 100) - 1
    rows = ", ".join(
        f"({quote(ch)}, {m & low}::HUGEINT, {(m >> 100) & low}::HUGEINT, {m >> 200}::HUGEINT)"
        for ch, m in table.items()
    )
    return f"(VALUES {rows}) om(ch, a, b, c)"


LOW = (1 << 100) - 1
TOP = (1 << (len(W) - 200)) - 1
WINDOW = int(len(W) * 1.2)
HEADER = V.WARNING_HEADER


def _word(i: str, carry: str, ones: int) -> str:
    """Next state of one 100-bit word, masked."""
    return f"(((s.{i} + (s.{i} & x.{i}) + {carry}) & {ones}) | (s.{i} - (s.{i} & x.{i})))"


def window_ctes(src: str = "src") -> str:
    """``win(id, norm, w)`` and ``wsim(w, sim, complete)`` for the distinct windows."""
    c0 = f"((s.a + (s.a & x.a)) >> 100)"
    c1 = f"((s.b + (s.b & x.b) + {c0}) >> 100)"
    words = sorted({x for x in W.lower().replace(":", " ").replace("(", " ").replace(")", " ")
                    .replace(",", " ").replace(".", " ").split() if len(x) >= 3})
    word_rows = ", ".join(f"({quote(x)})" for x in words)
    return f"""
win AS (
  SELECT id, norm, CASE WHEN hit > 0 THEN substr(norm, hit, {WINDOW}) END AS w FROM (
    SELECT *, strpos(lower(norm), '{HEADER.lower()}') AS hit FROM (
      SELECT id, {spaced('text')} AS norm FROM {src}))),
wdis AS (SELECT row_number() OVER () AS wid, w FROM (SELECT DISTINCT w FROM win WHERE w IS NOT NULL)),
wbit AS (
  SELECT p.wid, list(struct_pack(a := coalesce(om.a, 0::HUGEINT), b := coalesce(om.b, 0::HUGEINT),
    c := coalesce(om.c, 0::HUGEINT)) ORDER BY p.k) AS bits
  FROM (SELECT wid, unnest(string_split(w, '')) AS ch, unnest(range(1, length(w) + 1)) AS k
    FROM wdis) p LEFT JOIN {_official_masks()} ON om.ch = p.ch GROUP BY p.wid),
wlcs AS (
  SELECT wid, list_reduce(bits, lambda s, x: struct_pack(
    a := {_word('a', '0', LOW)}, b := {_word('b', c0, LOW)}, c := {_word('c', c1, TOP)}),
    struct_pack(a := {LOW}::HUGEINT, b := {LOW}::HUGEINT, c := {TOP}::HUGEINT)) AS s FROM wbit),
ww AS (SELECT DISTINCT wid, unnest(string_split({loose('w')}, ' ')) AS word FROM wdis),
ow AS (SELECT * FROM (VALUES {word_rows}) o(word)),
{similarity_ctes('wo', "SELECT DISTINCT ow.word AS a, ww.word AS b FROM ow, ww WHERE ww.word <> ''")},
whave AS (
  SELECT ww.wid, count(DISTINCT c.a) AS n FROM ww JOIN wo_score c ON c.b = ww.word
  WHERE c.ratio >= 80 GROUP BY ww.wid),
wsim AS (
  SELECT d.w, 200.0::DOUBLE * ({len(W)} - bit_count(l.s.a) - bit_count(l.s.b) - bit_count(l.s.c))
    / ({len(W)} + length(d.w)) AS sim, coalesce(h.n, 0) = {len(words)} AS complete
  FROM wdis d JOIN wlcs l ON l.wid = d.wid LEFT JOIN whave h ON h.wid = d.wid)"""


def warning_cte(confidence: str = "s.confidence") -> str:
    percent = pct("v.sim")
    rules = [
        (f"w.w IS NULL AND {confidence} >= 55", "false", V.MSG_WARN_ABSENT,
         quote(V.MSG_WARN_ABSENT_DETAIL), "true", "absent"),
        ("w.w IS NULL", "false", V.MSG_WARN_UNREAD, quote(V.MSG_WARN_UNREAD_DETAIL), "true",
         "unreadable"),
        ("caps AND v.sim >= 99 AND v.complete", "true", V.MSG_WARN_PASS,
         f"concat('matches 27 CFR 16.21 (', {percent}, '% similarity, ALL CAPS)')", "false", ""),
        ("caps AND v.sim >= 85", "false", V.MSG_WARN_CLOSE,
         f"concat('close to 27 CFR 16.21 but below the confidence cutoff (', {percent}, "
         "'% vs 99% needed)')", "true", "unreadable"),
        ("caps", "false", V.MSG_WARN_WORDING,
         f"concat('wording differs from 27 CFR 16.21 (', {percent}, '% similarity)')",
         "false", ""),
        ("v.sim >= 85", "false", V.MSG_WARN_CASE, quote(V.MSG_WARN_CASE_DETAIL), "false", ""),
        ("true", "false", V.MSG_WARN_HEADER, quote(V.MSG_WARN_HEADER_DETAIL), "true",
         "unreadable"),
    ]

    def ladder(pick) -> str:
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {pick(r)}" for r in rules) + " END"

    return window_ctes() + f""",
f_warn AS (SELECT s.id, s.filename, 3 AS ord, 'government_warning' AS field,
  'Government warning' AS label, {ladder(lambda r: r[1])} AS passed,
  {quote(V.OFFICIAL_WARNING)} AS expected, {ladder(lambda r: quote(r[2]))} AS found,
  {ladder(lambda r: r[3])} AS detail, {ladder(lambda r: r[4])} AS inconclusive,
  {ladder(lambda r: quote(r[5]))} AS review_kind
  FROM (SELECT *, contains({spaced('text')}, '{HEADER}') AS caps FROM src) s
  JOIN win w ON w.id = s.id LEFT JOIN wsim v ON v.w = w.w)"""


def _dictionary() -> list[dict]:
    raw = resources.files("labelspark").joinpath("data", "designations.json").read_text("utf-8")
    return json.loads(raw)["designations"]


def dictionary_cte() -> str:
    rows = []
    for i, e in enumerate(_dictionary()):
        low, high = e.get("abv_min"), e.get("abv_max")
        for name in [e["designation"], *e["aliases"]]:
            rows.append(
                f"({i}, {quote(e['designation'])}, '{e['beverage_type']}', '{e['section']}', "
                f"{'NULL' if low is None else low}::DOUBLE, "
                f"{'NULL' if high is None else high}::DOUBLE, "
                f"'{e.get('composition_section') or e['section']}', {quote(name)})"
            )
    return (
        "dic AS (SELECT *, " + loose("name") + " AS phrase, len(string_split(" + loose("name")
        + ", ' ')) AS size FROM (VALUES " + ", ".join(rows)
        + ") d(ordinal, entry, kind, section, low, high, comp, name))"
    )


def recognition_ctes(claims: str) -> str:
    """``rec(designation, asked, recognized, entry, kind, section, ..., message)`` for the
    distinct (designation, asked) rows of ``claims``; phrases match as padded substrings."""
    return dictionary_cte() + f""",
rk AS (SELECT DISTINCT designation, asked, {loose('designation')} AS norm FROM ({claims}) q),
rh AS (
  SELECT k.designation, k.asked, d.*, row_number() OVER (PARTITION BY k.designation, k.asked
    ORDER BY d.size DESC, d.ordinal) AS rn, min(d.kind) OVER (PARTITION BY k.designation, k.asked)
    AS kmin, max(d.kind) OVER (PARTITION BY k.designation, k.asked) AS kmax
  FROM rk k JOIN dic d ON contains(concat(' ', k.norm, ' '), concat(' ', d.phrase, ' '))
  WHERE k.asked = '' OR k.asked = d.kind),
rec AS (
  SELECT k.designation, k.asked, (h.entry IS NOT NULL AND NOT (k.asked = '' AND kmin <> kmax))
    AS recognized, h.entry, h.kind, h.section, h.low, h.high, h.comp,
    CASE WHEN k.norm = '' THEN 'No class/type designation was provided.'
      WHEN h.entry IS NULL THEN concat('''', k.designation, ''' is not a recognized 27 CFR '
        'class/type designation — recommend human review against the standards of identity.')
      WHEN k.asked = '' AND kmin <> kmax THEN concat('''', k.designation,
        ''' is ambiguous across beverage types — recommend human review.')
      ELSE concat('''', k.designation, ''' is a recognized ', h.kind, ' class/type (27 CFR §',
        h.section, ').') END AS message
  FROM rk k LEFT JOIN rh h ON h.designation = k.designation AND h.asked = k.asked AND h.rn = 1)"""


def presence_cte() -> str:
    detail = f"concat('similarity ', {pct('b.score')}, '/100 (threshold 90)')"
    wide = f"b.score >= 60 AND {solid(loose('s.class_type'))} >= 5"
    return best_line_ctes("ct", "class_type", "csrc") + f""",
f_presence AS (SELECT s.id, s.filename, 5 AS ord, 'class_type' AS field, 'Class/type' AS label,
  b.score >= 90 AS passed, s.class_type AS expected,
  CASE WHEN b.score >= 90 OR ({wide} AND b.line <> '') THEN b.line
    ELSE {quote(V.MSG_NOT_FOUND)} END AS found,
  CASE WHEN b.score >= 90 THEN {detail}
    WHEN {wide} THEN concat({detail}, ' — designation on the label differs')
    ELSE concat({detail}, '; deferring to review') END AS detail,
  NOT (b.score >= 90 OR ({wide})) AS inconclusive, '' AS review_kind
  FROM csrc s JOIN ct_best b ON b.id = s.id)"""


CSRC = "csrc AS (SELECT * FROM src WHERE trim(class_type) <> '')"


def class_cte() -> str:
    return (
        CSRC + ", " + presence_cte() + ", "
        + recognition_ctes("SELECT class_type AS designation, '' AS asked FROM src") + """,
f_class AS (SELECT p.id, p.filename, p.ord, p.field, p.label, (r.recognized AND p.passed) AS passed,
  p.expected, p.found,
  CASE WHEN r.recognized THEN concat(p.detail, ' — recognized: 27 CFR §', r.section)
    ELSE r.message END AS detail,
  (NOT r.recognized OR p.inconclusive) AS inconclusive, '' AS review_kind
  FROM f_presence p JOIN rec r ON r.designation = p.expected AND r.asked = '')"""
    )


READABLE = rf"length(regexp_replace(text, '{SPACES}', '', 'g')) >= 12"


def verify_ctes(src: str, gate: bool = True) -> str:
    """``fields`` and ``verified(id, filename, readable, needs_review, overall_pass, status)``.

    ``src`` is a CTE text defining ``raw`` with the claim columns joined to the label columns.
    """
    keep = READABLE if gate else "true"
    return f"""{src.replace("raw AS (", "raw AS MATERIALIZED (")},
src AS (SELECT * FROM raw WHERE {keep}),
{brand_cte()}, {abv_cte()}, {warning_cte()}, {net_cte()}, {class_cte()},
fields AS MATERIALIZED (SELECT * FROM f_brand UNION ALL SELECT * FROM f_abv UNION ALL SELECT * FROM f_warn
  UNION ALL SELECT * FROM f_net UNION ALL SELECT * FROM f_class),
judged AS MATERIALIZED (
  SELECT r.id, r.filename, r.confidence, any_value({keep}) AS readable,
    (any_value({keep}) AND (any_value(r.confidence) < 55
      OR coalesce(bool_or(f.inconclusive), false))) AS needs_review,
    coalesce(bool_and(f.passed), false) AS all_ok, count(f.field) AS n_fields,
    count(*) FILTER (f.passed = false) AS flagged_count,
    string_agg(concat(f.field, '=', CASE WHEN f.passed THEN 'PASS' WHEN f.inconclusive THEN 'REVIEW'
      ELSE 'FLAG' END), ',' ORDER BY f.ord) FILTER (f.field IS NOT NULL) AS verdicts
  FROM raw r LEFT JOIN fields f ON f.id = r.id GROUP BY r.id, r.filename, r.confidence),
verified AS (
  SELECT *, (readable AND NOT needs_review AND all_ok) AS overall_pass,
    CASE WHEN NOT readable THEN 'unreadable' WHEN needs_review THEN 'needs_review'
      WHEN all_ok THEN 'pass' ELSE 'flag' END AS status FROM judged)"""


RAW_JOINED = JOINED.replace("src AS (", "raw AS (")
KEYED = """
kc AS (SELECT lower(trim(filename)) AS key, count(*) AS copies, min(row_number) AS claim_row,
  any_value(brand) AS brand, any_value(alcohol_content) AS alcohol_content,
  any_value(net_contents) AS net_contents, any_value(class_type) AS class_type
  FROM cla GROUP BY 1),
kj AS (SELECT l.*, k.copies, k.claim_row, k.brand, k.alcohol_content, k.net_contents, k.class_type,
  lower(trim(l.filename)) AS key FROM lab l LEFT JOIN kc k ON k.key = lower(trim(l.filename))),
alone AS (SELECT * FROM kc WHERE key NOT IN (SELECT lower(trim(filename)) FROM lab))"""
RAW_BATCH = (
    f"{LAB}, {CLA}, {KEYED}, raw AS (SELECT ordinal AS id, filename, confidence, text, brand, "
    "alcohol_content, net_contents, class_type FROM kj WHERE copies = 1)"
)
BATCH_ROWS = f"""
rows_all AS (
  SELECT id AS ordinal, filename, status,
    CASE WHEN readable THEN '' ELSE {quote(V.MSG_UNREADABLE)} END AS message FROM verified
  UNION ALL
  SELECT ordinal, filename, CASE WHEN copies IS NULL THEN 'no_application_data'
    ELSE 'duplicate_application_data' END, CASE WHEN copies IS NULL THEN {quote(V.MSG_NO_CLAIM)}
    ELSE {quote(V.MSG_DUP_WITH_IMAGE)} END FROM kj WHERE copies IS NULL OR copies > 1
  UNION ALL
  SELECT -1, key, CASE WHEN copies > 1 THEN 'duplicate_application_data' ELSE 'no_image' END,
    CASE WHEN copies > 1 THEN {quote(V.MSG_DUP_NO_IMAGE)} ELSE {quote(V.MSG_NO_IMAGE)} END
  FROM alone)"""


def batch_sql(tail: str) -> str:
    return f"WITH {verify_ctes(RAW_BATCH)}, {BATCH_ROWS} {tail}"


def joined_sql(tail: str) -> str:
    return f"WITH {verify_ctes(RAW_JOINED)} {tail}"


FIELD = "filename, passed, expected, found, detail, inconclusive, review_kind"

ORACLE["prj01_normalize_loose"] = f"SELECT doc_id, {loose('text')} AS loose FROM documents"
ORACLE["prj02_normalize_whitespace"] = f"SELECT doc_id, {spaced('text')} AS spaced FROM documents"
ORACLE["prj03_is_readable"] = rf"""
WITH {LAB}, b AS (SELECT filename, text FROM lab UNION ALL
  SELECT CAST(doc_id AS VARCHAR), text FROM documents)
SELECT filename, length(regexp_replace(text, '{SPACES}', '', 'g')) AS chars,
  length(regexp_replace(text, '{SPACES}', '', 'g')) >= 12 AS readable FROM b"""
ORACLE["prj04_candidate_lines"] = f"""
SELECT doc_id, unnest(range(0, len(c))) AS pos, unnest(c) AS line FROM (
  SELECT doc_id, list_append({lines('text')}, {strip('text')}) AS c FROM documents)"""
ORACLE["mat01_best_line"] = f"""WITH {JOINED}, {best_line_ctes('br', 'brand')}
SELECT s.filename, round(b.score, 6) AS score, b.line FROM src s JOIN br_best b ON b.id = s.id"""
ORACLE["mat02_brand"] = f"WITH {JOINED}, {brand_cte()} SELECT {FIELD} FROM f_brand"
ORACLE["mat03_abv_candidates"] = f"""
WITH {JOINED}, {candidate_ctes()}
SELECT s.filename, a.k - 1 AS pos, round(a.value, 6) AS value, a.label
FROM abv a JOIN src s ON s.id = a.id"""
ORACLE["mat04_alcohol_content"] = f"WITH {JOINED}, {abv_cte()} SELECT {FIELD} FROM f_abv"
ORACLE["mat05_warning_window"] = f"""
WITH {LAB}, n AS (SELECT filename, {spaced('text')} AS t FROM lab)
SELECT filename, CASE WHEN strpos(lower(t), '{HEADER.lower()}') > 0
  THEN substr(t, strpos(lower(t), '{HEADER.lower()}'), {WINDOW}) ELSE '(none)' END AS window FROM n"""
ORACLE["mat06_official_words"] = f"""WITH {JOINED}, {window_ctes()}
SELECT s.filename, v.complete FROM src s JOIN win w ON w.id = s.id JOIN wsim v ON v.w = w.w"""
ORACLE["mat07_warning"] = f"WITH {JOINED}, {warning_cte()} SELECT {FIELD} FROM f_warn"
ORACLE["mat08_net_candidates"] = f"""WITH {JOINED}, h AS ({net_rows('src', 'text')})
SELECT s.filename, h.k - 1 AS pos, round(h.ml, 6) AS ml, h.display
FROM h JOIN src s ON s.id = h.id"""
ORACLE["mat09_net_contents"] = f"WITH {JOINED}, {net_cte()} SELECT {FIELD} FROM f_net"
ORACLE["mat10_class_presence"] = (
    f"WITH {JOINED}, {CSRC}, {presence_cte()} SELECT {FIELD} FROM f_presence"
)
ORACLE["mat11_class_adjudicated"] = f"WITH {JOINED}, {class_cte()} SELECT {FIELD} FROM f_class"
ORACLE["mat12_verify_table"] = joined_sql(
    "SELECT filename, readable, needs_review, overall_pass, status, n_fields, flagged_count, "
    "coalesce(verdicts, '') AS verdicts FROM verified"
)
EDITED = RAW_JOINED.replace("c.alcohol_content", "'5.0' AS alcohol_content").replace(
    "c.net_contents", "'1 L' AS net_contents"
)
ORACLE["mat13_reverify_texts"] = f"""WITH {verify_ctes(EDITED)}
SELECT v.filename, CASE WHEN v.readable THEN '' ELSE
  'No label text to verify — please paste the label text first.' END AS error, v.status,
  coalesce(f.field, '') AS field, coalesce(f.found, '') AS found
FROM verified v LEFT JOIN fields f ON f.id = v.id"""
ORACLE["mat14_warning_only"] = (
    f"WITH {JOINED}, {warning_cte()} "
    "SELECT filename, passed, found, detail, inconclusive, review_kind FROM f_warn"
)
ORACLE["prj05_needs_review"] = joined_sql("SELECT filename, needs_review FROM verified")
ORACLE["prj06_overall_pass"] = joined_sql("""
SELECT v.filename, v.overall_pass, v.flagged_count, coalesce(b.passed, false) AS brand_ok,
  coalesce(w.passed, false) AS warning_ok FROM verified v
LEFT JOIN f_brand b ON b.id = v.id LEFT JOIN f_warn w ON w.id = v.id""")
ORACLE["prj07_row_status"] = batch_sql("SELECT filename, status, message FROM rows_all")
ORACLE["prj08_field_verdicts"] = batch_sql("""
SELECT filename, field, CASE WHEN passed THEN 'PASS' WHEN inconclusive THEN 'REVIEW'
  ELSE 'FLAG' END AS verdict FROM fields""")
ORACLE["prj09_needs_attention"] = batch_sql(
    "SELECT filename, status FROM rows_all WHERE status <> 'pass'"
)
ORACLE["prj10_result_record"] = joined_sql("""
SELECT v.filename, v.readable, v.overall_pass, v.needs_review,
  CAST(round_even(v.confidence + 0.5, 0) AS BIGINT) AS confidence, '' AS message, f.field, f.label,
  f.passed, f.expected, f.found, f.detail FROM verified v JOIN fields f ON f.id = v.id""")
ORACLE["prj12_citation"] = f"""
SELECT doc_id, concat('27 CFR ', section, paragraph) AS citation, section, source_url,
  beverage_type FROM ({D.plain(D.CORPUS)}) c"""
ORACLE["prj14_member_predicate"] = r"""
WITH m AS (SELECT page_id, concat(CASE WHEN page_id % 5 = 0 THEN '__MACOSX/'
    WHEN page_id % 7 = 0 THEN 'a\b\.' ELSE 'set/' END,
  regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'),
  CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.jpeg' END,
  CASE WHEN page_id % 11 = 0 THEN '/' ELSE '' END) AS member FROM pages),
b AS (SELECT *, list_last(string_split(replace(member, '\', '/'), '/')) AS base FROM m)
SELECT page_id, base AS basename, (NOT ends_with(member, '/') AND NOT
  starts_with(member, '__MACOSX/') AND base <> '' AND NOT starts_with(base, '.') AND
  regexp_matches(lower(base), '\.(png|jpg|jpeg|webp|gif|bmp|tif|tiff)$')) AS is_image FROM b"""
ORACLE["prj15_optional_fields"] = joined_sql("""
SELECT v.filename, (trim(r.net_contents) <> '') AS has_net, (trim(r.class_type) <> '') AS has_class
FROM verified v JOIN raw r ON r.id = v.id WHERE v.readable""")
ORACLE["jn01_batch_join"] = f"""WITH {LAB}, {CLA}, {KEYED}
SELECT key, CASE WHEN copies IS NULL THEN 'no_application_data' WHEN copies > 1 THEN
  'duplicate_application_data' ELSE 'ok' END AS join_status FROM kj
UNION ALL SELECT key, CASE WHEN copies > 1 THEN 'duplicate_application_data' ELSE 'no_image' END
FROM alone"""
ORACLE["jn02_unique_claims"] = f"""WITH {LAB}, {CLA}, {KEYED}
SELECT key, brand, alcohol_content, net_contents, class_type FROM kc WHERE copies = 1"""
ORACLE["jn02_duplicate_keys"] = (
    f"WITH {LAB}, {CLA}, {KEYED} SELECT key, copies FROM kc WHERE copies > 1"
)
ORACLE["jn03_missing_parts"] = """
SELECT l_partkey, count(*) AS rows FROM lineitem WHERE NOT EXISTS (
  SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY l_partkey"""
ORACLE["jn03_missing_labels"] = """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
ORACLE["jn05_band_join"] = f"""
WITH {JOINED}, {candidate_ctes()},
c AS (SELECT TRY_CAST(nullif(regexp_extract(alcohol_content, '{NUM}'), '') AS DOUBLE) AS value
  FROM cla),
l AS (SELECT value, count(*) AS n FROM abv GROUP BY value),
r AS (SELECT value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY value)
SELECT l.value AS left_value, r.value AS right_value, l.n * r.n AS row_pairs
FROM l JOIN r ON abs(l.value - r.value) <= 0.5"""
ORACLE["jn06_claim_lines"] = f"""
WITH {JOINED}, ln AS (SELECT filename, {loose('brand')} AS a, unnest(range(0, len(c))) AS pos,
  unnest(c) AS line FROM (SELECT *, {lines('text')} AS c FROM src)),
nn AS (SELECT *, {loose('line')} AS b FROM ln),
{similarity_ctes('jl', "SELECT DISTINCT a, b FROM nn WHERE b <> ''")}
SELECT n.filename, n.pos, round(coalesce(s.ratio, 0), 6) AS score FROM nn n
LEFT JOIN jl_score s ON s.a = n.a AND s.b = n.b"""
ORACLE["agg01_batch_summary"] = batch_sql("""
SELECT count(*) AS total, count(*) FILTER (status = 'pass') AS passed,
  count(*) FILTER (status = 'flag') AS flagged,
  count(*) FILTER (status = 'needs_review') AS needs_review,
  count(*) FILTER (status NOT IN ('pass', 'flag', 'needs_review')) AS errors FROM rows_all""")
ORACLE["srt04_report_order"] = f"""WITH {LAB}, {CLA}, {KEYED}
SELECT 0 AS section, ordinal, filename FROM lab UNION ALL
SELECT CASE WHEN copies > 1 THEN 2 ELSE 1 END, CASE WHEN copies > 1 THEN 0 ELSE claim_row END, key
FROM alone ORDER BY 1, 2, 3"""


def _verdict_of(field: str) -> str:
    return (
        f"coalesce(max(CASE WHEN f.passed THEN 'PASS' WHEN f.inconclusive THEN 'REVIEW' "
        f"ELSE 'FLAG' END) FILTER (f.field = '{field}'), '') AS {field}"
    )


ORACLE["snk01_results_export"] = batch_sql(
    "SELECT r.filename, upper(r.status) AS overall, "
    + ", ".join(_verdict_of(x) for x in ["brand", "alcohol_content", "government_warning",
                                         "net_contents", "class_type"])
    + " FROM rows_all r LEFT JOIN fields f ON f.id = r.ordinal GROUP BY r.ordinal, r.filename, "
      "r.status"
)


def _reason(part: int) -> str:
    arms = []
    for row in sorted(V.REASONS, key=lambda r: r[1] == ""):
        kind = f" AND review_kind = '{row[1]}'" if row[1] else ""
        arms.append(f"WHEN st = '{row[2]}' AND field = '{row[0]}'{kind} THEN {quote(row[part])}")
    i = part - 3
    arms.append(f"WHEN st = 'REVIEW' THEN {quote(V.GENERIC_REVIEW[i])}")
    return "CASE " + " ".join(arms) + f" ELSE {quote(V.GENERIC_FLAG[i])} END"


_CITES = "CASE field " + " ".join(
    f"WHEN '{k}' THEN {quote(v)}" for k, v in V.FIELD_CITATIONS.items()
) + " ELSE '' END"
ORACLE["std05_reasons"] = batch_sql(f"""
SELECT filename, field, st AS status, {_reason(3)} AS reason,
  concat({_reason(4)}, ' (', detail, ')') AS what_to_check, {_CITES} AS citation
FROM (SELECT *, CASE WHEN inconclusive THEN 'REVIEW' ELSE 'FLAG' END AS st FROM fields
  WHERE NOT passed)""")


def _designations(tail: str) -> str:
    from labelspark.plans.queries import DESIGNATION_CLAIMS

    proof = r"(?i)(\d+(?:\.\d+)?)\s*proof"
    return f"""
WITH dc AS (SELECT *, coalesce(
    TRY_CAST(nullif(regexp_extract(claimed_abv, '{proof}', 1), '') AS DOUBLE) / 2,
    TRY_CAST(nullif(regexp_extract(claimed_abv, '{NUM}'), '') AS DOUBLE)) AS abv
  FROM ({D.plain(DESIGNATION_CLAIMS)}) q),
{recognition_ctes('SELECT designation, beverage_type AS asked FROM dc')},
dj AS (SELECT d.*, r.* EXCLUDE (designation, asked) FROM dc d JOIN rec r
  ON r.designation = d.designation AND r.asked = d.beverage_type) {tail}"""


_RANGE = f"""CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN concat('range of ', {g('low')}, '-',
  {g('high')}, '% ABV') WHEN low IS NOT NULL THEN concat('range of not less than ', {g('low')},
  '% ABV') ELSE concat('range of not over ', {g('high')}, '% ABV') END"""
COMPOSITION = f"""
cj AS (SELECT *, (recognized AND abv IS NOT NULL AND (low IS NOT NULL OR high IS NOT NULL))
  AS checked, coalesce(abv < low, false) OR coalesce(abv > high, false) AS outside FROM dj),
cm AS (SELECT *, CASE WHEN checked AND outside THEN 'REVIEW' ELSE 'OK' END AS comp_status,
  CASE WHEN NOT checked THEN '' WHEN outside THEN concat('the claimed ', {g('abv')},
    '% ABV is outside the typical ', {_RANGE}, ' for ''', entry, ''' under 27 CFR §', comp,
    '; please verify. This is advisory; it is never an auto-rejection.')
  ELSE concat('the claimed ', {g('abv')}, '% ABV is within the typical ', {_RANGE}, ' for ''',
    entry, ''' (27 CFR §', comp, ').') END AS comp_message FROM cj)"""
ORACLE["agg02_reconstruct_text"] = """
WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS line_num, unnest(p) AS line FROM (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT doc_id, line_num, unnest(range(0, len(p))) AS word_num, unnest(p) AS word FROM (
  SELECT *, string_split(line, ' ') AS p FROM l)),
k AS (SELECT *, CAST((doc_id * 31 + word_num * 7) % 101 - 1 AS DOUBLE) AS conf FROM w
  WHERE regexp_replace(word, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]', '', 'g') <> ''),
j AS (SELECT doc_id, line_num, string_agg(word, ' ' ORDER BY word_num) AS line FROM k GROUP BY ALL)
SELECT CAST(j.doc_id AS VARCHAR) AS label_id, string_agg(line, chr(10) ORDER BY line_num) AS text,
  round(coalesce(any_value(c.conf), 0), 6) AS confidence FROM j LEFT JOIN (
    SELECT doc_id, avg(conf) AS conf FROM k WHERE conf >= 0 GROUP BY 1) c ON c.doc_id = j.doc_id
GROUP BY j.doc_id"""
ORACLE["agg03_first_per_value"] = f"""
WITH {LAB}, src AS (SELECT ordinal AS id, filename, concat_ws(' ', text, text) AS text FROM lab),
{candidate_ctes()}
SELECT s.filename, round(a.value, 6) AS value, a.label FROM abv a JOIN src s ON s.id = a.id"""
ORACLE["src11_word_scan"] = """
WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS line_num, unnest(p) AS line FROM (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT doc_id, line_num, unnest(range(0, len(p))) AS word_num FROM (
  SELECT *, string_split(line, ' ') AS p FROM l))
SELECT line_num // 20 AS block_num, count(*) AS words,
  count(*) FILTER ((doc_id * 31 + word_num * 7) % 101 - 1 >= 0) AS real_words FROM w GROUP BY 1"""


def finish() -> dict[str, str]:
    """Statements that share text with the query module are built last."""
    out = dict(ORACLE)
    out["std01_recognize"] = _designations(
        "SELECT claim_id, recognized, CASE WHEN recognized THEN entry ELSE '' END AS entry, "
        "CASE WHEN recognized THEN section ELSE '' END AS section, message FROM dj"
    )
    out["std02_composition"] = _designations(
        f", {COMPOSITION} SELECT claim_id, comp_status AS status, checked, "
        "comp_message AS message FROM cm"
    )
    out["std03_claimed_abv"] = _designations("SELECT claim_id, coalesce(abv, -1) AS abv FROM dj")
    return out


# --- second part -------------------------------------------------------------------------

CORPUS = f"corpus AS ({D.plain(D.CORPUS)})"
ASKED = f"asked AS ({D.plain(D.QUESTIONS)})"
STOP = "(" + ", ".join(quote(w) for w in V.STOPWORDS) + ")"


def fold(t: str) -> str:
    return (f"CASE WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') "
            f"THEN left({t}, length({t}) - 1) ELSE {t} END")


def token_rows(source: str, key: str, text: str) -> str:
    """(key, pos, raw, term) rows of every token."""
    return (
        f"SELECT {key}, pos, raw, {fold('raw')} AS term FROM (SELECT {key}, "
        f"unnest(range(1, len(r) + 1)) AS pos, unnest(r) AS raw FROM (SELECT {key}, "
        f"regexp_extract_all(lower({text}), '[a-z0-9.]+') AS r FROM {source}))"
    )


CONTENT = f"raw NOT IN {STOP} AND length(raw) > 1"
INDEX = f"""{CORPUS}, {ASKED},
dt AS ({token_rows('corpus', 'doc_id', "concat(text, ' ', repeat(concat(heading, ' '), 3))")}),
dc AS (SELECT DISTINCT doc_id, term FROM ({token_rows('corpus', 'doc_id',
    "concat(text, ' ', heading)")}) q WHERE {CONTENT}),
dl AS (SELECT c.doc_id, c.ordinal, count(d.term) AS dl FROM corpus c LEFT JOIN dt d
  ON d.doc_id = c.doc_id GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
cdf AS (SELECT term, count(*) AS content_df FROM dc GROUP BY term),
ridf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw_idf FROM df, st),
midf AS (SELECT avg(raw_idf) AS mean_idf FROM ridf),
idf AS (SELECT term, CASE WHEN raw_idf < 0 THEN 0.25 * mean_idf ELSE raw_idf END AS idf
  FROM ridf, midf),
qt AS (SELECT query_id, term, count(*) AS repeats FROM ({token_rows('asked', 'query_id',
    'question')}) q GROUP BY ALL),
qc AS (SELECT DISTINCT query_id, term FROM ({token_rows('asked', 'query_id', 'question')}) q
  WHERE {CONTENT}),
qn AS (SELECT a.query_id, count(q.term) AS n_terms FROM asked a LEFT JOIN qc q
  ON q.query_id = a.query_id GROUP BY ALL),
sc AS (SELECT qt.query_id, tf.doc_id, round(sum(repeats * idf * tf * 2.5
    / (tf + 1.5 * (0.25 + 0.75 * dl.dl / avgdl))), 9) AS bm25
  FROM qt JOIN tf ON tf.term = qt.term JOIN idf ON idf.term = qt.term
  JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
mt AS (SELECT qc.query_id, dc.doc_id, count(*) AS matched FROM qc JOIN dc ON dc.term = qc.term
  GROUP BY ALL)"""
# Every passage ranked for every question, zero scores included.
RANKED = f"""{INDEX},
al AS (SELECT a.query_id, d.doc_id, d.ordinal, coalesce(s.bm25, 0) AS bm25,
  coalesce(m.matched, 0) AS matched FROM asked a, dl d
  LEFT JOIN sc s ON s.query_id = a.query_id AND s.doc_id = d.doc_id
  LEFT JOIN mt m ON m.query_id = a.query_id AND m.doc_id = d.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, bm25 DESC,
  ordinal) AS rank FROM al),
hit AS (SELECT r.*, q.n_terms, CASE WHEN n_terms > 0 THEN matched / n_terms ELSE 0.0::DOUBLE END
  AS coverage FROM rk r JOIN qn q ON q.query_id = r.query_id)"""
EXEMPT = "('" + "', '".join(
    sorted({k[:-1] if len(k) > 3 and k.endswith("s") and not k.endswith("ss") else k
            for k, _ in V.EXPANSIONS})) + "')"
OOV = f"""oov AS (SELECT query_id, term FROM qc WHERE term NOT IN (SELECT term FROM dc)
  AND term NOT IN {EXEMPT})"""
SUPPORT = ("CASE WHEN matched = 0 OR (n_terms >= 3 AND matched < 2) THEN false "
           "ELSE coverage >= 0.5 END")
SCOPED = f"""{RANKED}, {OOV},
sp AS (SELECT h.*, c.beverage_type, (a.beverage_type = '' OR c.beverage_type =
    lower(a.beverage_type) OR c.beverage_type = 'all') AS inside
  FROM hit h JOIN corpus c ON c.doc_id = h.doc_id JOIN asked a ON a.query_id = h.query_id
  WHERE rank <= 4),
kp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM sp s
  WHERE inside OR NOT EXISTS (SELECT 1 FROM sp t WHERE t.query_id = s.query_id AND t.inside)),
tp AS (SELECT *, coverage AS top FROM kp WHERE place = 1)"""
USED = """
us AS (SELECT k.*, t.coverage AS top, k.coverage >= greatest(0.5, t.coverage * 0.5) AS good
  FROM kp k JOIN tp t ON t.query_id = k.query_id),
ud AS (SELECT *, row_number() OVER (PARTITION BY query_id, good ORDER BY place) AS nth,
  bool_or(good) OVER (PARTITION BY query_id) AS any_good FROM us),
used AS (SELECT * FROM ud WHERE (good AND nth <= 3) OR (NOT any_good AND place = 1))"""
ANSWERS = f"""{SCOPED}, {USED},
okq AS (SELECT query_id FROM tp WHERE ({SUPPORT}) AND query_id NOT IN (SELECT query_id FROM oov)),
ap AS (SELECT u.query_id, string_agg(concat('27 CFR ', section, paragraph, ' — ', c.text),
    chr(10) || chr(10) ORDER BY place) AS body,
  string_agg(concat('27 CFR ', section, paragraph), '; ' ORDER BY place) AS cites,
  list(section) AS sections FROM used u JOIN corpus c ON c.doc_id = u.doc_id
  WHERE u.query_id IN (SELECT query_id FROM okq) GROUP BY u.query_id),
ans AS (SELECT a.query_id, CASE WHEN p.body IS NULL THEN 'refused' ELSE 'answered' END AS status,
  CASE WHEN p.body IS NULL THEN {quote(V.REFUSAL)} ELSE
    concat('Based only on the regulations on file:', chr(10), chr(10), p.body) END AS answer,
  coalesce(p.cites, '') AS citations, coalesce(p.sections, []) AS sections
  FROM asked a LEFT JOIN ap p ON p.query_id = a.query_id)"""

ORACLE["ret01_tokens"] = f"""
SELECT d.doc_id, coalesce(t.tokens, '') AS tokens FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS tokens FROM (
    {token_rows('documents', 'doc_id', 'text')}) GROUP BY 1) t ON t.doc_id = d.doc_id"""
ORACLE["ret02_content_terms"] = f"""
SELECT d.doc_id, coalesce(t.terms, '') AS terms FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM (
    {token_rows('documents', 'doc_id', 'text')}) WHERE {CONTENT} GROUP BY 1) t
ON t.doc_id = d.doc_id"""
ORACLE["agg04_document_frequency"] = f"""WITH {INDEX}
SELECT df.term, df.df, coalesce(content_df, 0) AS content_df FROM df
LEFT JOIN cdf ON cdf.term = df.term"""
ORACLE["agg05_corpus_statistics"] = f"""WITH {INDEX}
SELECT n AS n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM st, midf"""
ORACLE["agg06_corpus_fingerprint"] = f"""
WITH {CORPUS}, h AS (SELECT sha256(concat(CAST(ordinal AS VARCHAR), chr(0), heading, '. ', text))
  AS d FROM corpus)
SELECT sha256(concat_ws(':', 'letters', CAST(count(*) AS VARCHAR), """ + ", ".join(
    f"CAST(sum(CAST(concat('0x', substr(d, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)"
    for i in range(8)
) + ")) AS fingerprint FROM h"
ORACLE["ret03_bm25"] = f"""WITH {INDEX}
SELECT s.query_id, count(*) AS passages, round(sum(bm25), 4) AS mass, round(max(bm25), 6) AS top,
  CAST(sum(coalesce(matched, 0)) AS BIGINT) AS matched FROM sc s
LEFT JOIN mt m ON m.query_id = s.query_id AND m.doc_id = s.doc_id GROUP BY s.query_id"""
ORACLE["ret04_coverage"] = f"""WITH {RANKED}
SELECT query_id, doc_id, matched, n_terms, round(coverage, 6) AS coverage FROM hit WHERE rank <= 4"""
ORACLE["srt02_lexical_top_k"] = f"""WITH {RANKED}
SELECT query_id, doc_id, rank, round(bm25, 6) AS bm25 FROM hit WHERE rank <= 10"""
_LETTERS = ", ".join(
    f"(length(lower(@t)) - length(replace(lower(@t), '{x}', '')))::DOUBLE"
    for x in "abcdefghijklmnopqrstuvwxyz"
)


def _unit(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda y: y * y)))"
    return f"list_transform({v}, lambda z: z / CASE WHEN {n} = 0 THEN 1 ELSE {n} END)"


FUSED = f"""{RANKED},
dv AS (SELECT doc_id, ordinal, {_unit('v')} AS u FROM (SELECT doc_id, ordinal,
  [{_LETTERS.replace('@t', 'text')}] AS v FROM corpus)),
qv AS (SELECT query_id, {_unit('v')} AS u FROM (SELECT query_id,
  [{_LETTERS.replace('@t', 'question')}] AS v FROM asked)),
sm AS (SELECT query_id, doc_id, ordinal, round(list_dot_product(q.u, d.u), 12) AS sim
  FROM qv q, dv d),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ordinal) - 1
  AS dense_rank FROM sm),
fu AS (SELECT r.query_id, r.doc_id, r.ordinal, r.rank - 1 AS lex_rank, d.dense_rank,
  1.0::DOUBLE / (60 + r.rank - 1) + 1.0::DOUBLE / (60 + d.dense_rank) AS fused
  FROM rk r JOIN dr d ON d.query_id = r.query_id AND d.doc_id = r.doc_id),
ft AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ordinal) AS rn FROM fu)"""
ORACLE["ret06_rank_fusion"] = f"""WITH {FUSED}
SELECT query_id, doc_id, rn AS rank, lex_rank, dense_rank, round(fused, 9) AS fused FROM ft WHERE rn <= 4"""
# The answers over fused hits: other ranks, and a close vector supports what words don't.
_FUSED_HITS = f"""{FUSED},
hs AS (SELECT h.query_id, h.doc_id, h.matched, h.n_terms, h.coverage, f.rn AS rank, d.sim AS dense_sim FROM ft f
  JOIN hit h ON h.query_id = f.query_id AND h.doc_id = f.doc_id
  JOIN dr d ON d.query_id = f.query_id AND d.doc_id = f.doc_id WHERE f.rn <= 4)"""
_CLOSE = f"dense_sim >= {THRESHOLDS.min_dense_sim}"
_FUSED_SUPPORT = (f"CASE WHEN matched = 0 OR (n_terms >= 3 AND matched < 2) THEN {_CLOSE} "
                  f"ELSE coverage >= {THRESHOLDS.min_coverage} OR {_CLOSE} END")
ORACLE["udf03_fused_answers"] = "WITH " + ANSWERS.replace(RANKED, _FUSED_HITS).replace(
    "FROM hit h", "FROM hs h").replace(SUPPORT, _FUSED_SUPPORT) + """
SELECT query_id, status, answer, citations FROM ans"""
ORACLE["ret07_support_gate"] = f"""WITH {RANKED}
SELECT query_id, doc_id, {SUPPORT} AS supported FROM hit WHERE rank = 1"""
ORACLE["ret08_distinguishing_terms"] = f"WITH {INDEX}, {OOV} SELECT query_id, term FROM oov"
ORACLE["prj13_scope_filter"] = f"WITH {SCOPED} SELECT query_id, doc_id, beverage_type FROM kp"
ORACLE["win03_used_hits"] = (
    f"WITH {RANKED}, kp AS (SELECT *, rank AS place FROM hit WHERE rank <= 4), "
    f"tp AS (SELECT * FROM kp WHERE place = 1), {USED} SELECT query_id, doc_id, place FROM used"
)
ORACLE["ret09_answers"] = (
    f"WITH {ANSWERS} SELECT query_id, status, answer, citations FROM ans"
)
_EXPAND = " || ".join(
    f"CASE WHEN contains(lower(t), '{k}') THEN ' {v}' ELSE '' END" for k, v in V.EXPANSIONS
)
ORACLE["ret10_expand_query"] = f"""
WITH {CLA}, b AS (SELECT row_number, concat_ws(' ', brand, CASE row_number % 4
  WHEN 0 THEN 'Title case header' WHEN 1 THEN 'ABV wording' ELSE 'class' END) AS t FROM cla)
SELECT row_number, t || {_EXPAND} AS expanded FROM b"""
ORACLE["jn09_postings_join"] = f"""WITH {INDEX}
SELECT qt.term, count(*) AS queries, max(df.df) AS passages, CAST(sum(repeats) AS BIGINT) AS repeats
FROM qt JOIN df ON df.term = qt.term GROUP BY qt.term"""
ORACLE["set01_term_intersection"] = f"""
WITH {CORPUS}, {ASKED}, q AS (SELECT DISTINCT query_id, term FROM ({token_rows('asked', 'query_id',
    'question')}) x WHERE {CONTENT}),
d AS (SELECT DISTINCT doc_id, term FROM ({token_rows('corpus', 'doc_id', 'text')}) x WHERE {CONTENT}),
b AS (SELECT query_id, doc_id, count(*) AS shared FROM q JOIN d ON d.term = q.term GROUP BY ALL),
p AS (SELECT query_id, count(*) AS documents, sum(shared) AS shared, max(shared) AS most FROM b GROUP BY 1),
n AS (SELECT a.query_id, count(q.term) AS n FROM asked a LEFT JOIN q ON q.query_id = a.query_id GROUP BY 1)
SELECT n.query_id, CAST(coalesce(documents, 0) AS BIGINT) AS documents, CAST(coalesce(shared, 0) AS BIGINT) AS shared,
  CAST(coalesce(most, 0) AS BIGINT) AS most, CAST(n - coalesce(most, 0) AS BIGINT) AS least_missing
FROM n LEFT JOIN p ON p.query_id = n.query_id"""
VECTORS = f"""
vx AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x,
  unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
ce AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS c FROM vx GROUP BY label),
eu AS (SELECT vec_id AS doc_id, label, {_unit('e')} AS u FROM (
  SELECT *, list_transform(embedding, lambda y: y::DOUBLE) AS e FROM embeddings)),
cu AS (SELECT query_id, {_unit('c')} AS u FROM ce),
vs AS (SELECT query_id, doc_id, label, round(list_dot_product(c.u, e.u), 12) AS sim FROM cu c, eu e),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM vs)"""
ORACLE["srt03_dense_top_k"] = f"""WITH {VECTORS}
SELECT query_id, doc_id, round(sim, 6) AS sim, rank FROM vr WHERE rank <= 10"""
ORACLE["srt03_all_vectors"] = f"""WITH {VECTORS},
av AS (SELECT a.doc_id AS query_id, b.doc_id, round(list_dot_product(a.u, b.u), 12) AS sim FROM eu a, eu b)
SELECT query_id, doc_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM av) WHERE rank <= 3"""
ORACLE["ret05_cosine"] = f"""WITH {VECTORS}
SELECT doc_id, round(sim, 6) AS similarity FROM vs WHERE query_id = label"""
ORACLE["jn10_vector_join"] = f"""WITH {VECTORS}
SELECT doc_id, count(*) AS queries FROM vr WHERE rank <= 3 GROUP BY doc_id"""
_TOKENS = """SELECT doc_id, len(regexp_extract_all(lower(@t), '[a-z0-9.]+'))::DOUBLE AS tokens FROM """
ORACLE["udf02_embedder"] = _TOKENS.replace("@t", "text") + "documents"
ORACLE["snk04_persisted_vectors"] = (
    f"WITH {CORPUS} " + _TOKENS.replace("@t", "concat(heading, '. ', text)") + "corpus"
)

# --- audit -------------------------------------------------------------------------------


def _json(c: str) -> str:
    e = c
    for a, b in (("\\", "\\\\"), ('"', '\\"')):
        e = f"replace({e}, '{a}', '{b}')"
    for code, b in ((8, "\\b"), (9, "\\t"), (10, "\\n"), (12, "\\f"), (13, "\\r")):
        e = f"replace({e}, chr({code}), '{b}')"
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE concat('\"', {e}, '\"') END"


def _canon(prefix: str = "") -> str:
    return "concat('[', concat_ws(',', " + ", ".join(
        _json(prefix + c) for c in V.AUDIT_CONTENT) + "), ']')"


def _genesis() -> str:
    from labelspark.operators.audit import GENESIS

    return quote(GENESIS)


AUD = f"""au AS ({D.plain(D.micros(D.AUDIT, 'duckdb'))}),
ag AS (SELECT * REPLACE ({strip('reason')} AS reason) FROM au WHERE {strip('reason')} <> '')"""
CONTENT_COLS = ", ".join(V.AUDIT_CONTENT)


def _chain(source: str = "ag") -> str:
    return f"""
ac AS (SELECT *, {_canon()} AS content, row_number() OVER (PARTITION BY chain ORDER BY id) AS rn
  FROM {source}),
ch AS (
  SELECT chain, id, rn, {_genesis()} AS prev_hash, sha256(concat({_genesis()}, content)) AS row_hash
  FROM ac WHERE rn = 1
  UNION ALL
  SELECT a.chain, a.id, a.rn, c.row_hash, sha256(concat(c.row_hash, a.content))
  FROM ch c JOIN ac a ON a.chain = c.chain AND a.rn = c.rn + 1),
full_rows AS (SELECT a.* EXCLUDE (content, rn), c.prev_hash, c.row_hash FROM ac a
  JOIN ch c ON c.chain = a.chain AND c.id = a.id),
marks AS (SELECT chain, count(*) AS row_count, arg_max(row_hash, id) AS head_hash FROM full_rows
  GROUP BY chain)"""


def _tamper() -> str:
    return f"""
sn AS (SELECT f.*, m.head_hash, f.chain::BIGINT % 7 AS kind, f.row_hash = m.head_hash AS tail,
  (f.id // 2) % 10 AS spot FROM full_rows f JOIN marks m ON m.chain = f.chain),
ed AS (SELECT * REPLACE (CASE WHEN (kind = 1 AND spot = 3) OR (kind = 5 AND tail) THEN 'edited'
    ELSE reason END AS reason) FROM sn
  WHERE NOT (kind = 2 AND spot = 4) AND NOT (kind = 3 AND tail) AND kind <> 6),
bad AS (
  SELECT chain, id, {CONTENT_COLS}, prev_hash, CASE WHEN kind = 5 AND tail THEN
    sha256(concat(prev_hash, {_canon()})) ELSE row_hash END AS row_hash FROM ed
  UNION ALL
  SELECT chain, id + 1, {CONTENT_COLS}, row_hash, sha256(concat(row_hash, {_canon()})) FROM sn
  WHERE kind = 4 AND spot = 5),
lk AS (SELECT *, coalesce(lag(row_hash) OVER (PARTITION BY chain ORDER BY id), {_genesis()}) AS want,
  sha256(concat(prev_hash, {_canon()})) <> row_hash AS altered FROM bad),
fb AS (SELECT chain, count(*) AS n, min(id) FILTER (altered OR prev_hash <> want) AS at_id,
  arg_min(altered, id) FILTER (altered OR prev_hash <> want) AS was_altered,
  max(id) AS last_id, arg_max(row_hash, id) AS last_hash FROM lk GROUP BY chain),
rp AS (SELECT m.chain, coalesce(n, 0) AS n, row_count, head_hash, at_id, was_altered, last_id,
  last_hash FROM marks m LEFT JOIN fb ON fb.chain = m.chain),
kd AS (SELECT *, CASE WHEN n = 0 THEN 'gone' WHEN at_id IS NOT NULL THEN
    CASE WHEN was_altered THEN 'altered' WHEN n > row_count THEN 'inserted' ELSE 'deleted' END
  WHEN n < row_count THEN 'short' WHEN n > row_count THEN 'long'
  WHEN last_hash <> head_hash THEN 'tail' ELSE '' END AS k FROM rp),
report AS (SELECT chain, k = '' AS ok, CASE k WHEN 'gone' THEN 'truncated' WHEN 'short' THEN
    'truncated' WHEN 'long' THEN 'inserted' WHEN 'tail' THEN 'altered' ELSE k END AS kind,
  CASE k WHEN 'gone' THEN 1 WHEN 'short' THEN n + 1 WHEN 'long' THEN row_count + 1
    WHEN 'tail' THEN last_id WHEN '' THEN -1 ELSE at_id END AS broken_position,
  CASE k WHEN 'gone' THEN concat('all ', row_count, ' row(s) missing — chain truncated')
    WHEN 'altered' THEN concat('row ', at_id, ': content does not match its hash — altered')
    WHEN 'inserted' THEN concat('row ', at_id, ': prev_hash does not link to the prior row — inserted')
    WHEN 'deleted' THEN concat('row ', at_id, ': prev_hash does not link to the prior row — deleted')
    WHEN 'short' THEN concat('chain valid but ', row_count - n,
      ' tail row(s) missing vs. checkpoint — truncated')
    WHEN 'long' THEN 'more rows than the checkpoint records — inserted at tail'
    WHEN 'tail' THEN concat('row ', last_id,
      ': tail hash does not match the checkpoint head — altered')
    ELSE concat('chain intact (', n, ' rows)') END AS message FROM kd)"""


def audit_statements() -> dict[str, str]:
    chain = f"WITH RECURSIVE {AUD}, {_chain()}"
    tampered = f"{chain}, {_tamper()}"
    defuse = ", ".join(
        f"CASE WHEN regexp_matches(coalesce({c}::VARCHAR, ''), '^[=+\\-@\\t\\r]') THEN "
        f"concat('''', {c}::VARCHAR) ELSE coalesce({c}::VARCHAR, '') END AS {c}"
        for c in V.AUDIT_COLUMNS
    )
    split = AUD + (", asp AS (SELECT * REPLACE (concat(chain, '#', CAST(id // 4000 AS VARCHAR)) "
                   "AS chain) FROM ag)")
    status = "upper(trim(CASE id % 3 WHEN 0 THEN ' pass ' WHEN 1 THEN 'Flag' ELSE 'maybe' END))"
    blank = f"{strip('reason')} = ''"
    error = (f"CASE WHEN {blank} THEN 'An override needs a written reason; none was given.' "
             f"WHEN {status} NOT IN ('PASS', 'FLAG') THEN 'new_status must be PASS or FLAG, got ''maybe''.' END")
    value = strip("reason")
    return {
        "aud01_canonical": f"WITH {AUD} SELECT id, {_canon()} AS content FROM ag",
        "aud02_row_hash":
            f"WITH {AUD} SELECT id, sha256(concat({_genesis()}, {_canon()})) AS hash FROM ag",
        "aud03_chain_build": f"{chain} SELECT chain, id, prev_hash, row_hash FROM ch",
        "aud03_rejected_rows":
            f"WITH {AUD} SELECT id, 'an audit reason is required' AS error FROM au WHERE {blank}",
        "aud03_split_chains": f"WITH RECURSIVE {split}, {_chain('asp')} "
                              "SELECT chain, row_count, head_hash FROM marks",
        "agg09_checkpoints": f"{chain} SELECT chain, row_count, head_hash FROM marks",
        "win01_chain_links": f"{tampered} SELECT chain, id, prev_hash = want AS linked FROM lk",
        "aud04_verify_chains":
            f"{tampered} SELECT chain, ok, kind, broken_position, message FROM report",
        "aud06_integrity_gate": f"{tampered} SELECT count(*) AS chains, "
                                "count(*) FILTER (NOT ok) AS broken, bool_and(ok) AS ok FROM report",
        "aud05_override_records": f"""WITH {AUD}, o AS (SELECT *, {error} AS err FROM au)
SELECT id, coalesce(err, 'ok') AS outcome, CASE WHEN err IS NULL THEN 'override' ELSE '' END AS action,
  CASE WHEN err IS NOT NULL THEN '' ELSE coalesce(target_result_id, 'unknown') END AS target_result_id,
  CASE WHEN err IS NULL THEN {status} ELSE '' END AS new_verdict,
  CASE WHEN err IS NULL THEN {value} ELSE '' END AS reason FROM o""",
        "aud05_manual_records": f"""WITH {AUD}
SELECT id, CASE WHEN {blank} THEN '' ELSE coalesce(target_result_id, 'current') END AS target_result_id,
  CASE WHEN {blank} THEN '' ELSE concat(action, '=', {value}) END AS new_verdict,
  CASE WHEN {blank} THEN 'Provide the value you read off the label.' ELSE
    concat('OCR could not read ', action, '; human entered ''', {value}, '''') END AS reason FROM au""",
        "snk02_audit_export": f"{chain} SELECT {defuse} FROM full_rows",
        "srt01_recent_rows": f"WITH {AUD} SELECT id, ts, actor, action, new_verdict, reason FROM ag "
                             "ORDER BY id DESC LIMIT 20",
        "src10_audit_scan": f"{chain} SELECT id, actor, row_hash FROM full_rows",
        "str01_audit_append": f"{chain} SELECT chain, id, prev_hash, row_hash FROM ch",
    }


UP = f"up AS ({D.plain(D.UPLOADS)})"
QUOTA = f"""
WITH RECURSIVE {UP},
o AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY seq) AS rn FROM up
  WHERE size <= 45000),
q AS (
  SELECT thread, seq, rn, size <= 100000 AS accepted, CASE WHEN size <= 100000 THEN size ELSE 0 END
    AS used FROM o WHERE rn = 1
  UNION ALL
  SELECT o.thread, o.seq, o.rn, q.used + o.size <= 100000,
    CASE WHEN q.used + o.size <= 100000 THEN q.used + o.size ELSE q.used END
  FROM q JOIN o ON o.thread = q.thread AND o.rn = q.rn + 1)
SELECT thread, seq, accepted, CASE WHEN accepted THEN '' ELSE
  'this chat has reached its 50 MB upload limit' END AS reason FROM q
UNION ALL SELECT thread, seq, false, 'too large — 10 MB max per file' FROM up WHERE size > 45000"""
ORACLE["win07_quota_admission"] = QUOTA
ORACLE["str03_quota_stream"] = QUOTA
ORACLE["agg08_thread_bytes"] = f"WITH {UP} SELECT thread, sum(size) AS bytes FROM up GROUP BY 1"

# --- evaluation --------------------------------------------------------------------------

EXPECTED = f"truth AS ({D.plain(D.EXPECTED.replace('@base', D.PART_BASE))})"


def _cell(field: str, truth: str) -> str:
    return (f"CASE WHEN NOT readable THEN 'unreadable' WHEN {field} = {truth} THEN 'ok' "
            f"WHEN {field} THEN 'WRONG(got True)' ELSE 'WRONG(got False)' END")


def board_ctes(src: str = RAW_JOINED) -> str:
    return f"""{verify_ctes(src)}, {EXPECTED},
bd AS (SELECT v.*, t.exp_brand, t.exp_alcohol, t.exp_warning, t.kind, b.passed AS b, a.passed AS a,
  w.passed AS w FROM verified v JOIN truth t ON t.filename = v.filename
  LEFT JOIN f_brand b ON b.id = v.id LEFT JOIN f_abv a ON a.id = v.id
  LEFT JOIN f_warn w ON w.id = v.id),
board AS (SELECT *, CASE WHEN NOT readable OR needs_review THEN 'review'
    WHEN b = exp_brand AND a = exp_alcohol AND w = exp_warning THEN 'correct' ELSE 'WRONG' END
  AS outcome, exp_brand AND exp_alcohol AND exp_warning AS compliant FROM bd)"""


BOARD_AGG = """count(*) AS total, count(*) FILTER (outcome = 'correct') AS conf_correct,
  count(*) FILTER (outcome = 'WRONG') AS conf_wrong, count(*) FILTER (outcome = 'review') AS review,
  count(*) FILTER (compliant) AS compliant,
  count(*) FILTER (outcome = 'WRONG' AND compliant) AS false_pos,
  count(*) FILTER (outcome = 'WRONG' AND NOT compliant) AS false_neg,
  count(*) FILTER (kind = 'clean' AND b = exp_brand) + count(*) FILTER (kind = 'clean' AND
    a = exp_alcohol) + count(*) FILTER (kind = 'clean' AND w = exp_warning) AS clean_c,
  3 * count(*) FILTER (kind = 'clean' AND readable) AS clean_t"""
ORACLE["evl01_case_outcomes"] = f"""WITH {board_ctes()}
SELECT filename, outcome, {_cell('b', 'exp_brand')} AS brand_cell,
  {_cell('a', 'exp_alcohol')} AS alcohol_content_cell,
  {_cell('w', 'exp_warning')} AS government_warning_cell FROM board"""
ORACLE["evl01_score_board"] = f"WITH {board_ctes()} SELECT kind, {BOARD_AGG} FROM board GROUP BY kind"
ORACLE["evl02_headline_rates"] = f"""WITH {board_ctes()}, s AS (SELECT {BOARD_AGG} FROM board)
SELECT conf_correct + conf_wrong AS conf_total,
  round(100.0::DOUBLE * (total - conf_wrong) / greatest(total, 1), 6) AS correctness,
  round(100.0::DOUBLE * (conf_correct + conf_wrong) / greatest(total, 1), 6) AS coverage,
  round(100.0::DOUBLE * conf_wrong / greatest(conf_correct + conf_wrong, 1), 6) AS margin_of_error,
  round(100.0::DOUBLE * false_pos / greatest(compliant, 1), 6) AS false_pos_rate,
  round(100.0::DOUBLE * clean_c / greatest(clean_t, 1), 6) AS clean_accuracy FROM s"""
_BEFORE = ("count(*) AS cases, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER "
           "(outcome = 'WRONG') AS wrong, count(*) FILTER (outcome = 'review') AS review")
ORACLE["evl03_before_after"] = f"""
SELECT * FROM (WITH {board_ctes()} SELECT 'filed' AS config, {_BEFORE} FROM board)
UNION ALL SELECT * FROM (WITH {board_ctes(RAW_JOINED.replace('c.alcohol_content',
    "'5.0' AS alcohol_content"))} SELECT 'edited' AS config, {_BEFORE} FROM board)"""
ORACLE["set03_cohort_union"] = batch_sql(f""", {EXPECTED}
SELECT CASE WHEN status IN ('no_application_data', 'duplicate_application_data', 'no_image') THEN 'unmatched'
  ELSE kind END AS cohort, status, count(*) AS cases
FROM rows_all r LEFT JOIN truth t ON t.filename = r.filename GROUP BY 1, 2""")
GOLDEN = f"""{ANSWERS},
gold AS (SELECT a.query_id, CASE WHEN a.query_id % 4 = 0 THEN NULL ELSE c.section END AS section
  FROM asked a LEFT JOIN corpus c ON c.doc_id = a.query_id),
gc AS (SELECT g.query_id, n.status, coalesce(CASE WHEN g.section IS NULL THEN status = 'refused'
    ELSE list_contains(n.sections, g.section) END, false) AS hit,
  g.section IS NULL OR status = 'answered' AS cited,
  g.section IS NULL OR coalesce(t.verbatim, true) AS faithful
  FROM gold g JOIN ans n ON n.query_id = g.query_id LEFT JOIN (
    SELECT u.query_id, bool_and(contains(a.answer, c.text)) AS verbatim FROM used u
    JOIN corpus c ON c.doc_id = u.doc_id JOIN ans a ON a.query_id = u.query_id
    WHERE a.status = 'answered' GROUP BY u.query_id) t ON t.query_id = g.query_id)"""
ORACLE["jn07_golden_answers"] = f"WITH {GOLDEN} SELECT query_id, status, hit, faithful, cited FROM gc"
ORACLE["evl04_retrieval_metrics"] = f"""WITH {GOLDEN}
SELECT count(*) AS n, round(avg(hit::INT), 6) AS hit_rate,
  round(avg(faithful::INT), 6) AS faithfulness, round(avg(cited::INT), 6) AS citation_rate FROM gc"""


def _grid(points: list[tuple[str, dict]]) -> str:
    names = list(points[0][1])
    rows = ", ".join(
        f"({quote(text)}, " + ", ".join(str(p[n]).lower() if isinstance(p[n], bool)
                                        else f"{p[n]}::DOUBLE" for n in names) + ")"
        for text, p in points
    )
    return f"(VALUES {rows}) gp(params, {', '.join(names)})"


def sweep_statements() -> dict[str, str]:
    from labelspark.operators import sweep as S

    def points(grid):
        return _grid(S.labelled_points(grid))

    refuse = points({"min_coverage": V.MIN_COVERAGE_GRID, "min_dense_sim": V.MIN_DENSE_SIM_GRID})
    cuts = points({"brand_cut": [80.0, 90.0, 95.0], "read_cut": [45.0, 55.0]})
    rules = points(S.ABLATION_GRID)
    rank = "row_number() OVER (ORDER BY feasible DESC, score DESC, params DESC) AS rank"
    return {
        "evl14_rule_ablation": f"""WITH {JOINED}, {best_line_ctes('br', 'brand')},
{candidate_ctes()}, {window_ctes()}, {EXPECTED},
bp AS (SELECT n.id, max(c.ratio) AS plain, max(c.best) AS best FROM br_norm n
  JOIN br_score c ON c.a = n.a AND c.b = n.b GROUP BY n.id),
cl AS (SELECT id, TRY_CAST(nullif(regexp_extract(alcohol_content, '{NUM}'), '') AS DOUBLE) AS claimed
  FROM src),
stc AS (SELECT s.id, count(*) AS n, bool_or(abs(value - claimed) <= 0.05) AS near,
  bool_or(abs(value - claimed) <= 0.05) FILTER (grp > 1) AS near_stated
  FROM stated s JOIN cl ON cl.id = s.id GROUP BY s.id),
pcc AS (SELECT p.id, bool_or(abs(raw::DOUBLE - claimed) <= 0.05) AS near FROM pct_hit p
  JOIN cl ON cl.id = p.id GROUP BY p.id),
sg AS (SELECT s.id, t.exp_brand, t.exp_alcohol, t.exp_warning,
  coalesce(b.best >= 95, false) AS bw, coalesce(b.plain >= 95, false) AS bpl,
  coalesce(v.sim >= 99 AND contains(w.norm, '{HEADER}'), false) AS wc,
  coalesce(v.sim >= 99 AND v.complete, false) AS wwords,
  coalesce(stc.n, 0) > 0 AS has_ctx, coalesce(stc.near, false) AS ctx,
  coalesce(pcc.near, false) AS bare,
  coalesce(pcc.near, false) OR coalesce(stc.near_stated, false) AS anyhow
  FROM src s JOIN truth t ON t.filename = s.filename LEFT JOIN bp b ON b.id = s.id
  JOIN win w ON w.id = s.id LEFT JOIN wsim v ON v.w = w.w LEFT JOIN stc ON stc.id = s.id
  LEFT JOIN pcc ON pcc.id = s.id),
ev AS (SELECT params, (CASE WHEN windows THEN bw ELSE bpl END) = exp_brand
    AND (CASE WHEN context THEN CASE WHEN has_ctx THEN ctx ELSE fallback AND bare END
      ELSE anyhow END) = exp_alcohol
    AND (wc AND (NOT words OR wwords)) = exp_warning AS hit FROM sg, {rules}),
pt AS (SELECT params, count(*) FILTER (hit) AS right_cases, count(*) AS cases FROM ev GROUP BY params)
SELECT *, row_number() OVER (ORDER BY right_cases DESC, params DESC) AS rank FROM pt""",
        "evl13_refuse_sweep": f"""WITH {SCOPED},
sg AS (SELECT *, query_id % 8 = 0 AS probe, query_id NOT IN (SELECT query_id FROM oov) AS faithful
  FROM tp),
ev AS (SELECT params, probe, query_id % 8 = 4 AS must, faithful AND CASE WHEN matched = 0 OR
  (n_terms >= 3 AND matched < 2) THEN false ELSE coverage >= min_coverage END AS yes
  FROM sg, {refuse}),
pt AS (SELECT params, round(count(*) FILTER (probe AND NOT yes) / count(*) FILTER (probe), 6) AS score,
  bool_and(probe OR CASE WHEN must THEN NOT yes ELSE yes END) AS feasible,
  count(*) FILTER (NOT probe AND NOT must AND yes) AS golden_answered,
  count(*) FILTER (NOT probe AND must AND NOT yes) AS golden_refused,
  count(*) FILTER (probe AND NOT yes) AS probe_refused FROM ev GROUP BY params)
SELECT *, {rank} FROM pt""",
        "evl12_grid_sweep": f"""WITH {JOINED}, {best_line_ctes('br', 'brand')}, {EXPECTED},
sg AS (SELECT s.confidence, b.score AS brand_score, t.exp_brand FROM src s JOIN br_best b
  ON b.id = s.id JOIN truth t ON t.filename = s.filename),
pt AS (SELECT params, round(avg(((brand_score >= brand_cut) = exp_brand)::INT), 6) AS score,
  count(*) FILTER (confidence >= read_cut AND brand_score >= brand_cut AND NOT exp_brand) = 0
  AS feasible FROM sg, {cuts} GROUP BY params)
SELECT params, score, feasible, {rank} FROM pt""",
    }


ORACLE["win08_sweep_rank"] = """
WITH b AS (SELECT concat('size=', CAST(p_size AS VARCHAR)) AS params, count(*)::DOUBLE AS score,
  max(p_retailprice) > 1500 AS feasible FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY feasible DESC, score DESC, params DESC) AS rank FROM b)
SELECT params, rank, rank = 1 AND feasible AS best FROM r"""

# --- transcripts -------------------------------------------------------------------------


def transcript_statements() -> dict[str, str]:
    from labelspark.plans import queries_more as Q

    steps = D.plain(Q.steps_sql()).replace("{{", "{").replace("}}", "}")
    cases = D.plain(Q.CASES).replace("{{", "{").replace("}}", "}")
    words = {"PASS": 4, "FLAG": 4, "NEEDS REVIEW": 12}
    first = "least(" + ", ".join(
        f"CASE WHEN strpos(msg, '{w}') > 0 THEN strpos(msg, '{w}') ELSE 1000000000 END"
        for w in words) + ")"
    base = f"""WITH sp AS ({steps}), cs AS ({cases}),
sj AS (SELECT s.*, c.expected_tool FROM sp s JOIN cs c ON c.case_id = s.case_id),
vf AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY step) AS rn FROM sj
  WHERE kind = 'tool_result' AND tool IN ('verify_label', 'verify_text', 'batch_verify')),
fm AS (SELECT case_id, text, row_number() OVER (PARTITION BY case_id ORDER BY step DESC) AS rn
  FROM sj WHERE kind = 'message'),
fc AS (SELECT c.*, v.result AS verify_result, m.text AS final_message,
  coalesce(r.routed, false) AS routed, r.interrupt_at, r.result_at, r.lookups, r.faults
  FROM cs c LEFT JOIN vf v ON v.case_id = c.case_id AND v.rn = 1
  LEFT JOIN fm m ON m.case_id = c.case_id AND m.rn = 1
  LEFT JOIN (SELECT case_id, bool_or(kind = 'tool_call' AND tool = expected_tool) AS routed,
    min(step) FILTER (kind = 'interrupt') AS interrupt_at,
    min(step) FILTER (kind = 'tool_result' AND tool = expected_tool) AS result_at,
    count(*) FILTER (kind = 'tool_result' AND tool = 'regulatory_lookup') AS lookups,
    count(*) FILTER (kind = 'tool_result' AND tool = 'regulatory_lookup' AND NOT (
      (json_extract_string(result, '$.status') = 'answered' AND json_array_length(result, '$.citations') > 0)
      OR (json_extract_string(result, '$.status') = 'refused' AND
        json_array_length(result, '$.citations') = 0))) AS faults
    FROM sj GROUP BY case_id) r ON r.case_id = c.case_id),
wd AS (SELECT *, upper(coalesce(final_message, '')) AS msg,
  json_extract_string(verify_result, '$.overall_pass') AS op,
  json_extract_string(verify_result, '$.needs_review') AS nr,
  ground_truth IS NULL OR (
    json_extract_string(verify_result, '$.overall_pass') =
      json_extract_string(ground_truth, '$.overall_pass')
    AND json_extract_string(verify_result, '$.needs_review') =
      json_extract_string(ground_truth, '$.needs_review')) AS same FROM fc),
ws AS (SELECT *, CASE WHEN op IS NULL THEN NULL WHEN op = 'true' THEN 'PASS'
  WHEN nr = 'true' THEN 'NEEDS REVIEW' ELSE 'FLAG' END AS want, {first} AS at_pos FROM wd),
oc AS (SELECT case_id, msg, want, unnest(range(1, length(msg) + 1)) AS p FROM ws WHERE want IS NOT NULL),
ng AS (SELECT case_id, bool_or(regexp_matches(substr(msg, greatest(p - 25, 1)::BIGINT,
    (p - greatest(p - 25, 1))::BIGINT), '\\b(NOT|NO|NONE|NEVER|WITHOUT)\\b|N''T')) AS negated FROM oc
  WHERE substr(msg, p, length(want)) = want GROUP BY case_id),
gd AS (SELECT w.*, routed AS tool_routing,
  coalesce(same AND want IS NOT NULL AND strpos(msg, want) = at_pos AND
    NOT coalesce(n.negated, false), false) AS verdict_verbatim,
  interrupt_at IS NOT NULL AND NOT coalesce(interrupt_at > result_at, false) AS gate_ok,
  coalesce(lookups > 0 AND faults = 0, false) AS cite_or_refuse,
  judge IS NOT NULL AS judged, judge NOT LIKE '%2.5%' AS judge_ok
  FROM ws w LEFT JOIN ng n ON n.case_id = w.case_id),
gr AS (SELECT *, CASE WHEN is_write AND NOT contains(invariants, 'confirm_gate') THEN false
    WHEN contains(invariants, 'confirm_gate') THEN gate_ok END AS confirm_gate FROM gd),
gp AS (SELECT *, tool_routing AND (NOT contains(invariants, 'verdict_verbatim') OR verdict_verbatim)
  AND coalesce(confirm_gate, true) AND (NOT contains(invariants, 'cite_or_refuse') OR cite_or_refuse)
  AND (NOT judged OR judge_ok) AS passed FROM gr)"""
    entries = ("list_transform(list_sort(list_filter(json_keys(result), lambda k: k NOT IN "
               "('elapsed_ms', 'fields'))), lambda k: concat(k, '=', "
               "trim(json_extract(result, '$.' || k)::VARCHAR, '\"')))")
    return {
        "evl05_tool_routing": f"{base} SELECT case_id, tool_routing FROM gp",
        "evl06_verdict_verbatim": f"{base} SELECT case_id, verdict_verbatim FROM gp "
                                  "WHERE contains(invariants, 'verdict_verbatim')",
        "evl07_confirm_gate":
            f"{base} SELECT case_id, confirm_gate FROM gp WHERE confirm_gate IS NOT NULL",
        "evl08_cite_or_refuse": f"{base} SELECT case_id, cite_or_refuse FROM gp "
                                "WHERE contains(invariants, 'cite_or_refuse')",
        "evl09_judge_floor": f"{base} SELECT case_id, judge_ok FROM gp WHERE judged",
        "evl11_case_grades": f"{base} SELECT case_id, passed FROM gp",
        "evl11_gate_summary": f"{base} SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, "
                              "count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS ok FROM gp",
        "win04_final_message":
            f"{base} SELECT case_id, coalesce(final_message, '') AS final_message FROM fc",
        "win05_interrupt_order": f"{base} SELECT case_id, coalesce(interrupt_at, -1) AS interrupt_at, "
                                 "coalesce(result_at, -1) AS result_at FROM fc",
        "win06_first_verification":
            f"{base} SELECT case_id, coalesce(verify_result, '') AS verify_result FROM fc",
        "jn08_truth_join": f"{base} SELECT case_id, same FROM wd WHERE verify_result IS NOT NULL "
                           "AND ground_truth IS NOT NULL",
        "prj11_verdict_projection": f"{base} SELECT case_id, step, array_to_string({entries}, ';') "
                                    "AS core FROM sp WHERE kind = 'tool_result'",
        "prj16_short_summary": f"""{base} SELECT case_id, step, CASE
  WHEN json_extract_string(result, '$.overall_pass') IS NOT NULL THEN concat(CASE
    WHEN json_extract_string(result, '$.overall_pass') = 'true' THEN 'PASS'
    WHEN json_extract_string(result, '$.needs_review') = 'true' THEN 'NEEDS REVIEW' ELSE 'FLAG' END,
    ' (', json_extract_string(result, '$.confidence'), '% confidence)')
  WHEN json_extract_string(result, '$.ok') = 'true' THEN concat('override recorded → ',
    json_extract_string(result, '$.new_status'), ' (audit #',
    json_extract_string(result, '$.recorded_id'), ')')
  ELSE result[1:120] END AS summary FROM sp WHERE kind = 'tool_result'""",
        "snk03_transcript_documents": f"{base} SELECT case_id, count(*) AS steps, "
                                      "count(*) FILTER (kind = 'message') AS messages FROM sp GROUP BY 1",
        "src09_transcript_scan":
            f"{base} SELECT case_id, expected_tool, invariants, is_write FROM cs",
    }


ORACLE["prj17_flatten_updates"] = """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS update_idx, role, turn % 5 = 4 AS stop
  FROM conversations)
SELECT case_id, update_idx, 0 AS sub_idx, 'interrupt' AS kind, '' AS tool FROM c WHERE stop
UNION ALL SELECT case_id, update_idx, 0, 'tool_result', 'verify_label' FROM c
  WHERE NOT stop AND role <> 'assistant'
UNION ALL SELECT case_id, update_idx, i, 'tool_call', 'verify_label' FROM c, range(2) r(i)
  WHERE NOT stop AND role = 'assistant'
UNION ALL SELECT case_id, update_idx, 2, 'message', '' FROM c WHERE NOT stop AND role = 'assistant'"""
ORACLE["evl10_parse_scores"] = """
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN -1 ELSE conv_id % 5 END AS faithfulness,
  -1 AS clarity, CASE WHEN turn % 4 = 3 THEN -1 ELSE turn % 6 END AS calibration,
  CASE WHEN turn % 4 = 3 THEN '' ELSE 'ok' END AS justification FROM conversations"""

# --- sources and streams -----------------------------------------------------------------

ORACLE["src02_label_files"] = """
SELECT ((doc_id % 50) + 50) % 50 AS bucket, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes
FROM documents GROUP BY 1"""
ORACLE["src01_claims_csv"] = f"""WITH {CLA}
SELECT lower(trim(filename)) AS filename, brand, alcohol_content, net_contents, '' AS class_type
FROM cla"""
ARCHIVES = """
ar AS (SELECT doc_id // 20 AS a, doc_id, strlen(text) AS size, doc_id % 3 <> 0 AND doc_id % 7 <> 0
  AS image FROM documents),
ag AS (SELECT a, (a % 9) <> 0 AS valid, count(*) FILTER (image) AS images,
  coalesce(max(size) FILTER (image), 0) AS largest, coalesce(sum(size) FILTER (image), 0) AS total
  FROM ar GROUP BY a),
ax AS (SELECT a, CASE WHEN valid THEN images ELSE 0 END AS images,
  CASE WHEN valid THEN largest ELSE 0 END AS largest,
  CAST(CASE WHEN valid THEN total ELSE 0 END AS BIGINT) AS total,
  CASE WHEN NOT valid THEN 'That doesn''t look like a valid .zip file.'
    WHEN images = 0 THEN 'No image files were found in the zip.'
    WHEN largest > 20000 THEN 'A file in the zip is too large — 10 MB max per image.'
    WHEN total > 100000 THEN 'The zip''s contents are too large to process (over the size limit).'
    ELSE '' END AS reject_reason FROM ag)"""
ORACLE["agg07_archive_guards"] = f"""WITH {ARCHIVES}
SELECT CAST(a AS VARCHAR) AS archive, images, largest, total, reject_reason FROM ax"""
ORACLE["src03_archive_members"] = f"""WITH {ARCHIVES}
SELECT CAST(ar.a AS VARCHAR) AS archive, concat(CAST(doc_id AS VARCHAR), '.PNG') AS filename, size
FROM ar JOIN ax ON ax.a = ar.a WHERE image AND reject_reason = ''"""
ORACLE["src04_corpus_json"] = """
SELECT CAST(doc_id // 50 AS VARCHAR) AS file, row_number() OVER (PARTITION BY doc_id // 50
  ORDER BY doc_id) - 1 AS ordinal, source AS section, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'all'
  END AS beverage_type, concat('doc:', CAST(doc_id AS VARCHAR)) AS source_url,
  length(text) AS chars FROM documents"""
ORACLE["src05_designations_json"] = f"""
WITH n AS (SELECT concat(p_name, ' ', p_type) AS name, p_size FROM part
  UNION ALL SELECT concat(p_brand, '-', p_name), p_size FROM part)
SELECT {loose('name')} AS phrase, count(*) AS entries,
  max(len(string_split({loose('name')}, ' '))) AS tokens, max(p_size)::DOUBLE AS abv_min
FROM n GROUP BY 1"""
ORACLE["src06_section_map_json"] = """
SELECT CAST(p_partkey AS VARCHAR) AS section, p_type AS part, p_name AS heading FROM part"""
ORACLE["src07_golden_json"] = """
SELECT text AS question, CAST(item_id AS VARCHAR) AS section, '' AS bt FROM benchmark"""
ORACLE["src08_sidecars"] = """
SELECT concat('p', p_partkey) AS name, concat('p', p_partkey, '.JPG') AS image, p_name AS brand,
  CASE WHEN p_partkey % 3 = 0 THEN '5.0' ELSE CAST(p_size AS VARCHAR) END AS alcohol_content,
  p_partkey % 4 <> 0 AS exp_brand, true AS exp_alcohol, p_partkey % 4 <> 0 AS exp_warning
FROM part WHERE p_partkey % 5 <> 0"""
ORACLE["str04_verify_stream"] = batch_sql("SELECT filename, status FROM rows_all WHERE ordinal >= 0")
_first_finish = finish


def finish() -> dict[str, str]:  # noqa: F811
    from labelspark.plans.queries_more import GATE_EVENTS

    out = dict(ORACLE)
    out.update(_first_finish())
    out.update(audit_statements())
    out.update(sweep_statements())
    out.update(transcript_statements())
    gate = f"""
WITH e AS ({D.plain(GATE_EVENTS)}),
t AS (SELECT thread, turn, count(*) AS seen, max(calls) AS calls,
  min(CASE WHEN name <> 'verify_label' THEN seq END) AS asked FROM e WHERE kind = 'call' GROUP BY thread, turn),
d AS (SELECT t.*, (SELECT min(d.seq) FROM e d WHERE d.kind = 'decision' AND d.thread = t.thread
  AND d.seq > t.asked) AS at_seq FROM t),
o AS (SELECT d.thread, d.turn, CASE WHEN asked IS NULL THEN CASE WHEN seen >= d.calls THEN 'read' END
  WHEN at_seq IS NOT NULL THEN CASE WHEN lower(trim(s.text)) LIKE 'approve%' THEN 'approved' ELSE 'cancelled' END
  END AS outcome FROM d LEFT JOIN e s ON s.thread = d.thread AND s.seq = d.at_seq)
SELECT e.thread, e.turn, e.seq, e.name, outcome <> 'cancelled' AS released, outcome
FROM e JOIN o ON o.thread = e.thread AND o.turn = e.turn WHERE e.kind = 'call' AND outcome IS NOT NULL"""
    out["str02_approval_gate"] = out["str02_approval_gate_batch"] = gate
    out["aud04_ladder"] = out["aud04_verify_chains"]
    return out


# --- the bundled passages ----------------------------------------------------------------

def _own_passages() -> str:
    """The bundled regulation passages as the corpus of an index."""
    text = resources.files("labelspark").joinpath("data", "regulations.json").read_text("utf-8")
    names = ("beverage_type", "section", "paragraph", "source_url", "heading", "text")
    rows = ", ".join(
        f"({i}::BIGINT, {i}::BIGINT, " + ", ".join(quote(c.get(n, "all" if n == "beverage_type" else "")) for n in names) + ")"
        for i, c in enumerate(json.loads(text)["chunks"]))
    return f"corpus AS (SELECT * FROM (VALUES {rows}) t(doc_id, ordinal, {', '.join(names)}))"


def _own(ctes: str, asked: str) -> str:
    """Index CTEs over the bundled passages and other questions, their names marked as such."""
    made = ctes.replace(CORPUS, _own_passages()).replace(ASKED, f"asked AS ({asked})")
    for name in ("corpus", "asked", "dt", "dc", "dl", "tf", "st", "df", "cdf", "ridf", "midf", "idf", "qt", "qc", "qn", "sc",
                 "mt", "al", "rk", "hit"):
        made = re.sub(rf"\b{name}\b", f"own_{name}", made)
    return made


def _expanded(c: str) -> str:
    return f"{c} || " + _EXPAND.replace("lower(t)", f"lower({c})")


def explained_ctes() -> str:
    """``own_rule`` (key, rule): the controlling passage of each (key, field, reason) row of ``flagged``."""
    subject = "replace(field, '_', ' ')"
    whole = f"concat({subject}, ' ', coalesce(reason, ''))"
    return _own(RANKED, f"SELECT DISTINCT key AS query_id, {_expanded(whole)} AS question FROM flagged") + f""",
own_sq AS (SELECT DISTINCT key, term FROM ({token_rows(f"(SELECT DISTINCT key, {subject} AS subject FROM flagged)", 'key', 'subject')}) q
  WHERE {CONTENT}),
own_bad AS (SELECT DISTINCT key FROM own_sq WHERE term NOT IN (SELECT term FROM own_dc) AND term NOT IN {EXEMPT}),
own_rule AS (SELECT h.query_id AS key, concat('27 CFR ', c.section, c.paragraph) AS rule FROM own_hit h
  JOIN own_corpus c ON c.doc_id = h.doc_id
  WHERE h.rank = 1 AND ({SUPPORT}) AND h.query_id NOT IN (SELECT key FROM own_bad))"""


ORACLE["ret11_regulatory_lookup"] = "WITH " + ANSWERS.replace(CORPUS, _own_passages()).replace(
    ASKED, """asked AS (SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN 'alcohol content statement for wine'
    WHEN 1 THEN 'age statement for whisky' ELSE concat('label rule for ', p_name) END AS question,
  CASE WHEN p_partkey % 2 = 0 THEN 'wine' ELSE '' END AS beverage_type FROM part)""").replace(
    "list(section) AS sections", "string_agg(section, ',' ORDER BY place) AS sections").replace(
    "coalesce(p.sections, [])", "coalesce(p.sections, '')") + " SELECT query_id, status, sections FROM ans"
ORACLE["jn04_attach_regulations"] = joined_sql(f""",
flagged AS (SELECT DISTINCT concat(field, chr(1), detail) AS key, field, detail AS reason FROM fields WHERE NOT passed),
{explained_ctes()}
SELECT f.filename, f.field, f.passed, coalesce(r.rule, '') AS rule FROM fields f
LEFT JOIN own_rule r ON NOT f.passed AND r.key = concat(f.field, chr(1), f.detail)""")
_second_finish = finish


def finish() -> dict[str, str]:  # noqa: F811
    out = _second_finish()
    kind = "coalesce(nullif(beverage_type, ''), CASE WHEN recognized THEN kind END, '')"
    reason = f"trim(concat({kind}, ' ', coalesce(designation, '')))"
    out["std04_advisory"] = _designations(f""", {COMPOSITION},
flagged AS (SELECT DISTINCT {reason} AS key, 'class type designation' AS field, {reason} AS reason FROM cm),
{explained_ctes()}
SELECT claim_id AS query_id, CASE WHEN recognized AND comp_status = 'OK' THEN 'OK' ELSE 'REVIEW' END AS status,
  CASE WHEN recognized THEN message ELSE concat(message, ' This is advisory; it is never an auto-rejection.') END AS assessment,
  CASE WHEN recognized THEN section ELSE '' END AS section, coalesce(rule, '') AS citation, comp_status AS composition_status
FROM cm LEFT JOIN own_rule ON key = {reason}""")
    return out
