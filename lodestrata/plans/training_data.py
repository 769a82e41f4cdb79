"""Queries of the general training-data operators, each over its whole tables."""

from __future__ import annotations

from lodestrata.functions.units import canonical_aliases
from lodestrata.operators.bad_rows import EMPTY_WORDS, NUMBER_COLUMNS, rejected_rows
from lodestrata.operators.proximity import surroundings
from lodestrata.operators.table_diff import SHEET_FIELDS, sheet_issues
from lodestrata.operators.unit_convert import measured_ppb
from lodestrata.session import read

QUERIES = {
    "p2_found": lambda s, d: surroundings(read(s, d, "usmin_sn"), read(s, d, "sedau"), read(s, d, "tracts")),
    "p4_found": lambda s, d: measured_ppb(read(s, d, "measurements")),
    "p5_found": lambda s, d: sheet_issues(read(s, d, "golden_sheet"), read(s, d, "extraction_sheet")),
    "p7_found": lambda s, d: rejected_rows(read(s, d, "raw_appendix"), read(s, d, "raw_files")),
}

SQL: dict[str, str] = {}



def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


_POINTS = (
    "SELECT rec_id AS id, latitude AS lat, longitude AS lon FROM (SELECT rec_id, latitude, longitude FROM usmin_sn UNION ALL SELECT rec_id, latitude, longitude FROM sedau) "
    "WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)"
)
SQL["p2_found"] = f"""
WITH p AS ({_POINTS}),
near AS (SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.0181
  WHERE 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 2),
rings AS (SELECT tract_id, unnest(range(len(r))) AS ring, unnest(r) AS body FROM (SELECT tract_id, regexp_extract_all(wkt, '\\(([^()]+)\\)', 1) AS r FROM tracts)),
pts AS (SELECT tract_id, ring, string_split(body, ',') AS s FROM rings),
xy AS (SELECT tract_id, ring, unnest(range(len(s))) AS i, string_split(trim(unnest(s), ' '), ' ') AS c FROM pts),
v AS (SELECT tract_id, ring, i, c[1]::DOUBLE AS x, c[2]::DOUBLE AS y FROM xy),
e AS (SELECT a.tract_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.tract_id = b.tract_id AND a.ring = b.ring AND b.i = a.i + 1),
inside AS (SELECT p.id, e.tract_id FROM p JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, id_a, id_b FROM near UNION ALL SELECT 'inside', id, tract_id FROM inside
"""


def _clean(x: str) -> str:
    return "nullif(" + _trim(f"regexp_replace({x}, '[ \\t]+', ' ', 'g')") + ", '')"


def _latest(table: str) -> str:
    texts = ["sample_name", "deposit_name", "deposit_type_original", "mineral", "analytical_method"]
    fields = ", ".join([f"{_clean(t)} AS {t}" for t in texts] + [f for f in SHEET_FIELDS if f not in texts])
    return (
        f"SELECT * FROM (SELECT upper({_trim('analysis_id')}) AS k, {fields}, row_number() OVER (PARTITION BY upper({_trim('analysis_id')}) ORDER BY last_update DESC NULLS LAST, row_id DESC) AS r "
        f"FROM {table} WHERE analysis_id IS NOT NULL) WHERE r = 1"
    )


def _differ(f: str) -> str:
    if f.endswith("_ppm"):
        return f"CASE WHEN g.{f} IS NULL OR e.{f} IS NULL THEN (g.{f} IS NULL) <> (e.{f} IS NULL) ELSE abs(g.{f} - e.{f}) > 1e-9 * greatest(abs(g.{f}), abs(e.{f})) END"
    return f"g.{f} IS DISTINCT FROM e.{f}"


SQL["p5_found"] = (
    f"WITH g AS ({_latest('golden_sheet')}), e AS ({_latest('extraction_sheet')}), j AS (SELECT coalesce(g.k, e.k) AS k, g.k IS NULL AS no_g, e.k IS NULL AS no_e, "
    + ", ".join(f"{_differ(f)} AS d_{f}" for f in SHEET_FIELDS)
    + " FROM g FULL JOIN e ON g.k = e.k) SELECT k AS analysis_id, 'only_golden' AS issue FROM j WHERE no_e UNION ALL SELECT k, 'only_extraction' FROM j WHERE no_g"
    + "".join(f" UNION ALL SELECT k, '{f}' FROM j WHERE NOT no_g AND NOT no_e AND d_{f}" for f in SHEET_FIELDS)
)


def _by_delim(make) -> str:
    return "CASE delim " + " ".join(f"WHEN {sql} THEN {make(cls)}" for sql, cls in (("','", ","), ("';'", ";"), ("chr(9)", "\\t"), ("'|'", "|"))) + " END"


_QUOTED = '"[^"]*(?:""[^"]*)*"'
SQL["p7_found"] = f"""
WITH l AS (SELECT a.line_id, regexp_replace(a.line, '\\r+$', '') AS l, f.* FROM raw_appendix a JOIN raw_files f ON a.file_id = f.file_id WHERE a.line_no BETWEEN f.first_line AND f.last_line),
q AS (SELECT *, {_by_delim(lambda c: f"regexp_full_match(l, '(?:{_QUOTED}|[^\"{c}]*)(?:[{c}](?:{_QUOTED}|[^\"{c}]*))*', 's')")} AS sound,
  {_by_delim(lambda c: f"regexp_extract_all(l || delim, '({_QUOTED}|[^\"{c}]*)[{c}]', 1)")} AS raw FROM l WHERE trim(regexp_replace(l, '[\\s\\x{{00A0}}]+', '', 'g')) <> ''),
c AS (SELECT *, CASE WHEN sound THEN list_transform(raw, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS cells FROM q),
b AS (SELECT *, cells[list_position(columns, sample_id_col)] AS sid,
  len(list_filter(range(1, len(columns) + 1), lambda i: list_contains({NUMBER_COLUMNS}, columns[i]) AND NOT ({_trim("cells[i]")} IN ({", ".join(f"'{w}'" for w in EMPTY_WORDS)})
    OR regexp_full_match({_trim("cells[i]")}, CASE WHEN delim = ';' THEN '(?:<\\s*)?[-+]?[0-9]+(?:,[0-9]+)?(?:[eE][-+]?[0-9]+)?' ELSE '(?:<\\s*)?[-+]?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?' END)))) AS bad FROM c)
SELECT line_id, reason FROM (SELECT line_id, CASE WHEN NOT sound THEN 'broken_quote' WHEN len(cells) <> n_cols THEN 'column_count'
  WHEN NOT regexp_full_match(trim(cells[1], ' '), '\\+?0*[1-9][0-9]*') OR {_trim("sid")} = '' OR contains(sid, chr(65533)) OR bad > 0 THEN 'invalid_value' END AS reason FROM b) WHERE reason IS NOT NULL
"""

_FOLD = "regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(lower({0}), '‰', 'permil'), 'µ', 'u'), 'μ', 'u'), '⁻', '-'), '¹', '1'), '³', '3'), '×', 'x'), '·', ''), '[\\s._]+', '', 'g')"
_UNITS = ", ".join(f"('{k}', {v!r})" for k, v in sorted(canonical_aliases().items()))
_SCALED = "regexp_replace(regexp_replace(u, '^x?103|^x?10\\^3|^thousand', ''), '^x', '')"
_HEAD = "regexp_extract({}, '^[A-Za-z]{{1,2}}(?:66)?(?:_mean)?[\\s_,]*(?:in\\s+)?[(\\[]?(.*?)[)\\]]?$', 1)"
_NOTE = "coalesce(nullif(regexp_extract({0}, '(?i)^units: *([^,;]+)', 1), ''), nullif(regexp_extract({0}, '(?i)(?:All concentrations in|values reported as|Concentrations are given in) +([^,;]+)', 1), ''), nullif(regexp_extract({0}, '^([^;,:]{{1,40}});', 1), ''))"
SQL["p4_found"] = f"""
WITH units(u, ppb) AS (VALUES {_UNITS}),
m AS (SELECT DISTINCT meas_id, original_value AS v, unit, column_header, note, regexp_extract(original_value, '^([^0-9]*)([0-9][0-9.,]*(?:[eE][-+]?[0-9]+)?)', 2) AS d,
  regexp_extract(original_value, '^([^0-9]*)', 1) AS before FROM measurements WHERE original_value IS NOT NULL),
n AS (SELECT *, substr(v, length(before) + length(d) + 1) AS rest, regexp_replace(d, '[.,]+$', '') AS t FROM m WHERE d <> '' AND NOT regexp_matches(v, '^\\s*[<>]') AND NOT regexp_matches(before, '[-−–]$') AND NOT starts_with(substr(v, length(before) + length(d) + 1), '^')),
x AS (SELECT *, try_cast(CASE WHEN NOT contains(t, ',') THEN t WHEN regexp_matches(t, '^[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]*)?(?:[eE].*)?$') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END AS DOUBLE) AS num,
  regexp_replace(regexp_replace(rest, '^\\s*(?:±\\s*[0-9.,]+(?:[eE][-+]?[0-9]+)?)?[\\s*†]*(?:\\([0-9]*σ\\))?[\\s*†]*', ''), '\\s+$', '') AS own FROM n),
s AS (SELECT meas_id, num, unnest([1, 2, 3, 4]) AS place, unnest([own, unit, {_HEAD.format('column_header')}, {_NOTE.format('note')}]) AS written FROM x),
f AS (SELECT *, {_FOLD.format('written')} AS u FROM s WHERE written IS NOT NULL AND written <> ''),
k AS (SELECT f.meas_id, f.num, f.place, f.u, coalesce(a.ppb, b.ppb * 1000) AS ppb FROM f LEFT JOIN units a ON a.u = f.u LEFT JOIN units b ON b.u = {_SCALED.replace('u,', 'f.u,')} AND {_SCALED.replace('u,', 'f.u,')} <> f.u),
r AS (SELECT meas_id, num, arg_min(u, place) AS u, arg_min(ppb, place) AS ppb FROM k WHERE ppb IS NOT NULL GROUP BY ALL)
SELECT DISTINCT meas_id, round(num * ppb)::BIGINT AS value_ppb FROM r WHERE u <> 'ppm' AND num IS NOT NULL
"""
