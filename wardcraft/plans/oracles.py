"""DuckDB SQL for the queries of queries.py, written by itself: it shares the domain tables and the distance formulas, not the operators."""

from __future__ import annotations

import numpy as np

from wardcraft.functions.crs import A, F_INV, FALSE, K0, LAT0, LON0, SHIFT, WGS84
from wardcraft.functions.geometry import box_box, crosses_ray, param, point_box, point_segment, point_segment_squared, segment_box, segment_segment, to_3857
from wardcraft.functions.rules import RANGE, SINGLE
from wardcraft.functions.text import ACCENTED, PLAIN
from wardcraft.plans.queries import CELL, CORRIDOR, DISC, GROW, RADIUS
from wardcraft.plans.views import with_views

# expressions ---------------------------------------------------------------------------------------


def _norm(x: str) -> str:
    bare = rf"regexp_replace(coalesce({x}, ''), '\s*\(.*?\)', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(translate(lower({bare}), '{ACCENTED}', '{PLAIN}'), '\p{{M}}+', '', 'g'), '\s+', ' ', 'g'))"


def _int(x: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN TRY_CAST(trim({x}) AS BIGINT) END)"


def _number(x: str) -> str:
    return rf"(CASE WHEN regexp_full_match(trim({x}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def _token(x: str) -> str:
    return rf"trim(regexp_replace(upper(coalesce({x}, '')), '\s+', ' ', 'g'))"


def _first_int(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({x}, '\d+'), '') AS BIGINT)"


_HN_RANGE = r"(\d+)\s*[-–]\s*(\d+)"
#: Covers of addresses: a and b are a range's ends, n the leading number.
COVER = rf"""
hn0 AS (SELECT *, regexp_full_match(trim(addr_housenumber), '{_HN_RANGE}') AS is_r, TRY_CAST(nullif(regexp_extract(trim(addr_housenumber), '^{_HN_RANGE}$', 1), '') AS BIGINT) AS a,
  TRY_CAST(nullif(regexp_extract(trim(addr_housenumber), '^{_HN_RANGE}$', 2), '') AS BIGINT) AS b, TRY_CAST(nullif(regexp_extract(trim(addr_housenumber), '^\d+'), '') AS BIGINT) AS n FROM v_addr),
hn AS (SELECT *, CASE WHEN is_r THEN least(a, b) ELSE n END AS lo, CASE WHEN is_r THEN greatest(a, b) ELSE n END AS hi,
  CASE WHEN is_r AND a % 2 = b % 2 THEN 2 WHEN is_r OR n IS NOT NULL THEN 1 END AS step, CASE WHEN is_r AND a % 2 = b % 2 THEN CASE WHEN a % 2 = 0 THEN 'even' ELSE 'odd' END END AS inferred,
  {_norm('addr_street')} AS street_norm, {_first_int('addr_housenumber')} AS hn_int FROM hn0)"""


def _covered(parity: str, starts: str, ends: str, singles: str) -> str:
    """Whether a cover (lo, hi, step, inferred) passes; tested by listing the covered numbers."""
    numbers = "CASE WHEN step = 2 THEN generate_series(lo, hi, 2) ELSE generate_series(lo, hi) END"
    s, e = _int(f"({starts})[i]"), _int(f"({ends})[i]")
    hits = f"len(list_filter(generate_series(1, len({starts})), lambda i: coalesce(len(list_filter({numbers}, lambda k: k >= least({s}, {e}) AND k <= greatest({s}, {e}))), 0) > 0 AND {s} IS NOT NULL AND {e} IS NOT NULL)) > 0"
    ones = f"list_filter(list_transform({singles}, lambda x: {_int('x')}), lambda x: x IS NOT NULL)"
    return f"""(lo IS NOT NULL AND NOT (coalesce(inferred, '') = 'even' AND coalesce({parity}, '') = 'odd') AND NOT (coalesce(inferred, '') = 'odd' AND coalesce({parity}, '') = 'even')
  AND (coalesce({parity}, '') <> 'odd' OR len(list_filter({numbers}, lambda k: k % 2 = 1)) > 0) AND (coalesce({parity}, '') <> 'even' OR len(list_filter({numbers}, lambda k: k % 2 = 0)) > 0)
  AND (len({starts}) = 0 OR {hits}) AND (len({ones}) = 0 OR list_has_any({numbers}, {ones})))"""


PARTS = r"""
parts0 AS (SELECT row_id, list_filter(list_transform(string_split(coalesce(numar_imobil, ''), '#'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM v_rsv),
parts AS (SELECT row_id, unnest(ps) AS part, unnest(range(len(ps))) AS part_no FROM parts0)"""


def _spec_columns(p: str) -> str:
    ends = f"list_transform(list_concat(regexp_extract_all({p}, '{RANGE}', 1), regexp_extract_all({p}, '{RANGE}', 2)), lambda x: {_token('x')})"
    return f"""regexp_extract_all({p}, '{RANGE}', 1) AS starts, regexp_extract_all({p}, '{RANGE}', 2) AS ends,
  list_filter(regexp_extract_all({p}, '{SINGLE}', 1), lambda s: NOT list_contains({ends}, {_token('s')})) AS singles"""


_RANGES = "list_aggregate(list_transform(generate_series(1, len(starts)), lambda i: starts[i] || '~' || ends[i]), 'string_agg', ';')"

BLOCKS = f"""
num AS (SELECT * REPLACE (trim(judet) AS judet), {_number('nr_sv')} AS n FROM v_rsv),
filled AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY judet ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS f FROM num),
blocks AS (SELECT *, CASE WHEN f = floor(f) THEN CAST(f AS BIGINT) END AS sv, n IS NOT DISTINCT FROM f AS explicit FROM filled),
rr AS (SELECT judet, sv, row_id, {_int('cod_artera')} AS cod_artera, trim(artera) AS street, nullif(trim(numar_imobil), '') AS raw, starts_with(lower(trim(artera)), 'domiciliul') AS is_note
  FROM blocks WHERE sv IS NOT NULL AND trim(artera) <> '')"""

SPECS = rf"""{BLOCKS},
cellp AS (SELECT judet, sv, row_id, street, list_filter(list_transform(string_split(coalesce(raw, ''), '#'), lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(lower(p), 'nr\.\s*-\s*$')) AS ps FROM rr WHERE NOT is_note),
onep AS (SELECT judet, sv, row_id, street, unnest(ps) AS p, unnest(range(len(ps))) AS spec_no FROM cellp),
spec0 AS (SELECT *, contains(lower(p), 'integral') AS whole, CASE WHEN contains(lower(p), 'numere impare') THEN 'odd' WHEN contains(lower(p), 'numere pare') THEN 'even' END AS par, {_spec_columns('p')} FROM onep),
specs AS (SELECT judet, sv, row_id, spec_no, street, {_norm('street')} AS street_norm, CASE WHEN whole THEN 'integral' WHEN len(starts) = 0 AND len(singles) = 0 AND par IS NULL THEN 'note' ELSE 'numbers' END AS kind,
  CASE WHEN NOT whole THEN par END AS parity, CASE WHEN NOT whole THEN starts END AS starts, CASE WHEN NOT whole THEN ends END AS ends, CASE WHEN NOT whole THEN singles END AS singles FROM spec0)"""

LINKS = """
norms AS (SELECT DISTINCT street_norm AS rule_norm FROM specs{where}), streets AS (SELECT DISTINCT street_norm FROM hn),
links AS (SELECT rule_norm, street_norm FROM norms JOIN streets ON rule_norm = street_norm
  UNION ALL SELECT rule_norm, street_norm FROM norms, streets WHERE rule_norm <> '' AND rule_norm NOT IN (SELECT street_norm FROM streets) AND regexp_matches(street_norm, rule_norm))"""

MATCHED = f"""{SPECS},{COVER},{LINKS.format(where=" WHERE kind IN ('integral', 'numbers')")},
pairs AS (SELECT s.judet, s.sv, s.row_id AS rule_no, s.spec_no, h.* FROM specs s JOIN links l ON s.street_norm = l.rule_norm JOIN hn h ON h.street_norm = l.street_norm
  WHERE s.kind = 'integral' OR s.kind = 'numbers' AND {_covered('s.parity', 's.starts', 's.ends', 's.singles')})"""

_PREF = "CASE WHEN starts_with(addr_id, 'way:') THEN 0 WHEN starts_with(addr_id, 'relation:') THEN 1 WHEN starts_with(addr_id, 'node:') THEN 2 ELSE 3 END"
_ALL = f"""{with_views('v_addr', 'v_rsv')},{MATCHED},
best AS (SELECT *, row_number() OVER (PARTITION BY judet, sv, street_norm, hn_int ORDER BY {_PREF}, addr_id NULLS LAST) AS r FROM pairs)
SELECT judet, sv, addr_id, addr_street, addr_housenumber, hn_int AS addr_housenumber_int, street_norm FROM best WHERE r = 1"""

# geometry ------------------------------------------------------------------------------------------

SEG = """
ve AS (SELECT line_id, seq, x AS x0, y AS y0, lead(x) OVER (PARTITION BY line_id ORDER BY seq) AS x1, lead(y) OVER (PARTITION BY line_id ORDER BY seq) AS y1 FROM v_vert),
sl AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM ve WHERE x1 IS NOT NULL),
seg AS (SELECT line_id, row_number() OVER w - 1 AS seg_no, x0, y0, x1, y1, len, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m0 FROM sl WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""
_P, _S = ("p.x", "p.y"), ("s.x0", "s.y0", "s.x1", "s.y1")
MEASURES = f"""
mall AS (SELECT p.pt_id, p.line_id, s.seg_no, {point_segment(*_P, *_S)} AS d, s.m0 + {param(*_P, *_S)} * s.len AS m FROM v_pt p JOIN seg s ON p.line_id = s.line_id),
meas AS (SELECT pt_id, line_id, d, m FROM (SELECT *, row_number() OVER (PARTITION BY pt_id, line_id ORDER BY d, seg_no) AS r FROM mall) t WHERE r = 1)"""
_B = ("b.x0", "b.y0", "b.x1", "b.y1")
CORRIDOR_SQL = f"corr AS (SELECT DISTINCT b.* FROM v_bld b, seg s WHERE {segment_box(_S, _B)} <= {CORRIDOR})"


def _near(radius: float) -> str:
    return f"""
near AS (SELECT p.pt_id, b.bld_id, {point_box(*_P, *_B)} AS d FROM v_pt p JOIN v_bld b ON b.x0 <= p.x + {radius} AND b.x1 >= p.x - {radius} AND b.y0 <= p.y + {radius} AND b.y1 >= p.y - {radius}),
best AS (SELECT pt_id, bld_id, d FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d, bld_id) AS r FROM near WHERE d <= {radius}) t WHERE r = 1),
nsq AS (SELECT pt_id, count(*) AS n_square FROM near GROUP BY 1)"""


SEED = f"{with_views('v_pt', 'v_bld', 'v_vert')},{SEG},{CORRIDOR_SQL},{_near(6.0)}"


def _grid(source: str, keep: str, pad: float, x0: str, y0: str, x1: str, y1: str) -> str:
    span = lambda a, b: f"unnest(range(CAST(floor(({a} - {pad}) / {CELL}) AS BIGINT), CAST(floor(({b} + {pad}) / {CELL}) AS BIGINT) + 1))"
    return f"(SELECT *, {span(y0, y1)} AS cj FROM (SELECT {keep}, {span(x0, x1)} AS ci FROM {source}) g0) g"


_CX, _CY = f"((ci + 0.5e0) * {CELL})", f"((cj + 0.5e0) * {CELL})"
CELLS = f"""{with_views('v_pt', 'v_vert')},{SEG},
discs AS (SELECT DISTINCT key, ci, cj FROM {_grid('v_pt', '*', DISC, 'x', 'y', 'x', 'y')} WHERE ({_CX} - x) * ({_CX} - x) + ({_CY} - y) * ({_CY} - y) <= {DISC * DISC}),
tube AS (SELECT DISTINCT line_id AS key, ci, cj FROM {_grid('seg', '*', CORRIDOR, 'least(x0, x1)', 'least(y0, y1)', 'greatest(x0, x1)', 'greatest(y0, y1)')} WHERE {point_segment(_CX, _CY, 'x0', 'y0', 'x1', 'y1')} <= {CORRIDOR})"""
_AREA = f"SELECT key, CAST(count(*) * {CELL} * {CELL} AS DOUBLE) AS area FROM (%s) t GROUP BY key"



def _list(items) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in items) + "] AS VARCHAR[])"


_hn_test = lambda p, r, s: _covered(p, _list(a for a, _ in r), _list(b for _, b in r), _list(s))

ADDR, RSV = with_views("v_addr"), with_views("v_rsv")

_JSON = f"""{RSV},{SPECS},
sp AS (SELECT judet, sv, row_id, list(struct_pack(kind := kind, parity := parity, ranges := CASE WHEN starts IS NOT NULL THEN list_transform(generate_series(1, len(starts)), lambda i: struct_pack("start" := starts[i], "end" := ends[i])) END, singles := singles, raw := CASE WHEN kind <> 'integral' THEN p END) ORDER BY spec_no) AS specs
  FROM specs JOIN onep USING (judet, sv, row_id, spec_no) GROUP BY 1, 2, 3),
ru AS (SELECT judet, sv, list(struct_pack(cod_artera := cod_artera, street := street, raw := raw, specs := coalesce(specs, [])) ORDER BY row_id) AS rules FROM rr LEFT JOIN sp USING (judet, sv, row_id) WHERE NOT is_note GROUP BY 1, 2),
nt AS (SELECT judet, sv, list(struct_pack(street := street, raw := raw) ORDER BY row_id) AS notes FROM rr WHERE is_note GROUP BY 1, 2),
hd AS (SELECT *, row_number() OVER (PARTITION BY judet, sv ORDER BY explicit DESC, row_id) AS r FROM blocks WHERE sv IS NOT NULL)
SELECT judet, sv, CAST(to_json(struct_pack(judet := judet, sv := sv, uat := nullif(trim(uat), ''), polling_place := struct_pack(sediu_sv := nullif(trim(sediu_sv), ''), adresa_sv := nullif(trim(adresa_sv), ''), adresa_sv_descriptiva := nullif(trim(adresa_sv_descriptiva), ''), localitate_sat := nullif(trim(localitate_sat), '')),
  rules := coalesce(rules, []), notes := notes, source := struct_pack(xlsx_path := CAST(NULL AS VARCHAR), sheet_name := '0'))) AS VARCHAR) AS json FROM hd LEFT JOIN ru USING (judet, sv) LEFT JOIN nt USING (judet, sv) WHERE r = 1"""

ORACLE_SQL = {
    "normalize_street": f"{ADDR} SELECT row_id, {_norm('addr_street')} AS norm FROM v_addr",
    "normalize_text": f"SELECT doc_id, md5({_norm('text')}) AS norm_md5 FROM documents",
    "weak_norm": f"{ADDR} SELECT row_id, lower(trim(coalesce(addr_street, ''))) AS norm FROM v_addr",
    "slug": rf"{ADDR} SELECT row_id, regexp_replace(regexp_replace(lower(trim(addr_street)), '\s+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS slug FROM v_addr",
    "safe_str_int": f"{RSV} SELECT row_id, nullif(trim(adresa_sv_descriptiva), '') AS s, {_int('cod_artera')} AS i, {_number('nr_sv')} AS n FROM v_rsv",
    "num_token": f"{ADDR} SELECT row_id, {_token('addr_housenumber')} AS token FROM v_addr",
    "hn_info": f"{ADDR},{COVER} SELECT row_id, lo, hi, CAST(step AS BIGINT) AS step, inferred, coalesce(is_r, false) AS is_range FROM hn",
    "hn_int": f"{ADDR} SELECT row_id, {_first_int('addr_housenumber')} AS n FROM v_addr",
    "hn_covers_range": f"{ADDR},{COVER} SELECT row_id, {_hn_test(chr(39) + 'odd' + chr(39), [('11', '29')], [])} AS odd, {_hn_test(chr(39) + 'even' + chr(39), [('30', '8'), ('1', '2 B')], [])} AS even, {_hn_test('NULL', [], ['7', '12', '9 A'])} AS singles, {_hn_test(chr(39) + 'odd' + chr(39), [('1', 'x')], [])} AS void FROM hn",
    "rule_split": f"{RSV},{PARTS} SELECT row_id, part_no, part FROM parts",
    "rule_ranges_all": f"{RSV},{PARTS}, s AS (SELECT row_id, part_no, {_spec_columns('part')} FROM parts) SELECT row_id, part_no, coalesce({_RANGES}, '') AS ranges FROM s",
    "rule_singles_all": f"{RSV},{PARTS}, s AS (SELECT row_id, part_no, {_spec_columns('part')} FROM parts) SELECT row_id, part_no, coalesce(list_aggregate(singles, 'string_agg', ';'), '') AS singles FROM s",
    "rule_parse_flat": f"{RSV},{SPECS} SELECT judet, sv, row_id, spec_no, street_norm, kind, parity, CASE WHEN kind <> 'integral' THEN coalesce({_RANGES}, '') END AS ranges, CASE WHEN kind <> 'integral' THEN coalesce(list_aggregate(singles, 'string_agg', ';'), '') END AS singles FROM specs",
    "sv_ffill": f"{RSV},{BLOCKS} SELECT row_id, judet, sv FROM blocks",
    "event_ffill": "SELECT event_id AS row_id, CAST(user_id % 5 AS VARCHAR) AS judet, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sv FROM events",
    "sv_header": f"{RSV},{BLOCKS} SELECT judet, sv, row_id, nullif(trim(uat), '') AS uat, nullif(trim(sediu_sv), '') AS sediu_sv, nullif(trim(adresa_sv), '') AS adresa_sv, nullif(trim(adresa_sv_descriptiva), '') AS adresa_sv_descriptiva, nullif(trim(localitate_sat), '') AS localitate_sat FROM (SELECT *, row_number() OVER (PARTITION BY judet, sv ORDER BY explicit DESC, row_id) AS r FROM blocks WHERE sv IS NOT NULL) t WHERE r = 1",
    "sv_rules": f"{RSV},{SPECS}, k AS (SELECT judet, sv, row_id, count(*) AS n FROM specs GROUP BY ALL) SELECT rr.judet, rr.sv, row_number() OVER (PARTITION BY rr.judet, rr.sv ORDER BY rr.row_id) - 1 AS rule_no, cod_artera, street, raw, coalesce(n, 0) AS n_specs FROM rr LEFT JOIN k USING (judet, sv, row_id) WHERE NOT is_note",
    "sv_notes": f"{RSV},{BLOCKS} SELECT judet, sv, row_id, street, raw FROM rr WHERE is_note",
    "sv_notes_lag": f"{RSV},{BLOCKS} SELECT a.judet, a.sv, a.row_id, a.street, (SELECT arg_max(struct_pack(raw := b.raw), b.row_id) FROM rr b WHERE b.judet = a.judet AND b.sv = a.sv AND b.row_id < a.row_id AND NOT b.is_note).raw AS raw FROM rr a WHERE is_note",
    "equi_match": f"{with_views('v_addr', 'v_rsv')},{SPECS},{COVER},{LINKS.format(where='')} SELECT rule_norm FROM links WHERE rule_norm = street_norm",
    "fallback_match": f"{with_views('v_addr', 'v_rsv')},{SPECS},{COVER},{LINKS.format(where='')} SELECT rule_norm, street_norm FROM links WHERE rule_norm <> street_norm",
    "match_pairs": f"{with_views('v_addr', 'v_rsv')},{MATCHED} SELECT judet, sv, rule_no, spec_no, addr_id FROM pairs",
    "match_all": _ALL,
    "match_one": f"SELECT * FROM ({_ALL}) t WHERE judet = 'B' AND sv = 2",
    "dedupe_address": f"{ADDR},{COVER} SELECT street_norm, hn_int AS addr_housenumber_int, addr_id FROM (SELECT *, row_number() OVER (PARTITION BY street_norm, hn_int ORDER BY {_PREF}, addr_id NULLS LAST) AS r FROM hn) t WHERE r = 1",
    "dedupe_no_id": f"{ADDR},{COVER} SELECT street_norm, hn_int AS addr_housenumber_int, min(row_id) AS row_id FROM hn GROUP BY 1, 2",
    "report_sorted": f"""SELECT judet, sv, addr_street, addr_housenumber, addr_housenumber_int, addr_id,
  row_number() OVER (PARTITION BY judet, sv ORDER BY addr_street NULLS LAST, addr_housenumber_int NULLS LAST, addr_id NULLS LAST) AS place,
  row_number() OVER (PARTITION BY judet, sv ORDER BY addr_street NULLS LAST, addr_housenumber NULLS LAST, addr_id NULLS LAST) AS place_by_text FROM ({_ALL}) t""",
    "id_source": f"{with_views('v_edge_raw')} SELECT osmid, CASE WHEN etype IS NULL THEN CAST(osmid AS VARCHAR) ELSE etype || ':' || CAST(osmid AS VARCHAR) END AS id, CASE WHEN etype = 'node' THEN 'node' WHEN etype IN ('way', 'relation') THEN 'building' ELSE 'other' END AS source FROM v_edge_raw",
    "list_flatten": "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CASE WHEN n_regionkey <> 2 THEN string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) END AS ids FROM nation GROUP BY n_regionkey",
    "length_fallback": f"{with_views('v_edge_raw')} SELECT osmid, TRY_CAST(length AS DOUBLE) AS own, CAST(-1 AS DOUBLE) AS computed FROM v_edge_raw",
    "missing_and_renamed": f"{with_views('v_edge_raw')} SELECT osmid, etype AS addr_type, CAST(NULL AS VARCHAR) AS highway, length AS picked FROM v_edge_raw",
    "crs_pick": f"{with_views('v_layers')} SELECT coalesce((SELECT crs FROM v_layers WHERE name IN ('main_streets', 'streets', 'main_roads', 'roads') AND crs IS NOT NULL ORDER BY list_position(['main_streets', 'streets', 'main_roads', 'roads'], name) LIMIT 1), 'EPSG:9999', 'EPSG:4326') AS crs",
    "boundary_pick": f"{with_views('v_layers')} SELECT name FROM v_layers WHERE contains(lower(geom_type), 'polygon') ORDER BY CASE WHEN contains(lower(name), 'boundary') THEN 0 ELSE 1 END, ord LIMIT 1",
    "bbox": f"{with_views('v_pt')} SELECT key, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_pt GROUP BY key",
    "mercator": "{v} SELECT pt_id, round({x}, 3) AS mx, round({y}, 3) AS my FROM v_pt".format(v=with_views("v_pt"), x=to_3857("(x / 10e0 + 20)", "(y / 40e0 + 40)")[0], y=to_3857("(x / 10e0 + 20)", "(y / 40e0 + 40)")[1]),
    "line_length": f"{with_views('v_vert')},{SEG} SELECT line_id, round(max(m0 + len), 4) AS len, count(*) AS n FROM seg GROUP BY line_id",
    "longest_part": f"{with_views('v_vert')},{SEG} SELECT line_id, seg_no AS part_no, round(len, 4) AS len FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY round(len, 4) DESC, seg_no) AS r FROM seg) t WHERE r = 1",
    "poly_area_centroid": f"{with_views('v_edge')} SELECT poly_id, round(abs(a), 4) AS area, round(sx / (6 * a), 4) AS cx, round(sy / (6 * a), 4) AS cy FROM (SELECT poly_id, sum((x0 * y1 - x1 * y0) / 2) AS a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS sx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS sy FROM v_edge GROUP BY poly_id) t",
    "pip_count": f"{with_views('v_pt', 'v_edge')} SELECT poly_id, count(*) AS n FROM (SELECT s.poly_id, p.pt_id FROM v_pt p, v_edge s WHERE {crosses_ray(*_P, *_S)} GROUP BY 1, 2 HAVING count(*) % 2 = 1) t GROUP BY poly_id",
    "project_measure": f"{with_views('v_pt', 'v_vert')},{SEG},{MEASURES} SELECT pt_id, line_id, round(d, 4) AS d, round(m, 4) AS m FROM meas",
    "interpolate_samples": f"""{with_views('v_pt', 'v_vert')},{SEG},{MEASURES},
e AS (SELECT line_id, greatest(0, min(m) - 10) AS a, least((SELECT max(m0 + len) FROM seg s WHERE s.line_id = meas.line_id), max(m) + 10) AS b FROM meas GROUP BY line_id),
spot AS (SELECT line_id, i, a + (b - a) * i / 299 AS m FROM e, range(300) r(i)),
hit AS (SELECT spot.*, s.x0, s.y0, s.x1, s.y1, s.m0, s.len, row_number() OVER (PARTITION BY spot.line_id, i ORDER BY s.seg_no DESC) AS r FROM spot JOIN seg s ON spot.line_id = s.line_id AND spot.m >= s.m0)
SELECT line_id, i, round(m, 4) AS m, round(x0 + least(1, (m - m0) / len) * (x1 - x0), 4) AS x, round(y0 + least(1, (m - m0) / len) * (y1 - y0), 4) AS y FROM hit WHERE r = 1""",
    "corridor_semijoin": f"{with_views('v_bld', 'v_vert')},{SEG},{CORRIDOR_SQL} SELECT bld_id FROM corr",
    "knn_seed": f"{with_views('v_pt', 'v_bld')},{_near(RADIUS)} SELECT pt_id, coalesce(n_square, 0) AS n_square, bld_id, round(d, 4) AS d FROM v_pt LEFT JOIN nsq USING (pt_id) LEFT JOIN best USING (pt_id)",
    "knn_reject_reason": f"{SEED} SELECT p.pt_id, CASE WHEN n_square IS NULL THEN 'no_hits_in_bbox' WHEN best.bld_id IS NULL THEN 'no_building_within_max_seed_dist' WHEN best.bld_id NOT IN (SELECT bld_id FROM corr) THEN 'nearest_not_in_corridor' ELSE 'seed' END AS reason FROM v_pt p LEFT JOIN nsq USING (pt_id) LEFT JOIN best USING (pt_id)",
    "grow_semijoin": f"{SEED}, seeds AS (SELECT DISTINCT b.* FROM v_bld b JOIN best USING (bld_id) JOIN corr USING (bld_id)) SELECT DISTINCT c.bld_id FROM corr c, seeds s WHERE {box_box(_S, ('c.x0', 'c.y0', 'c.x1', 'c.y1'))} <= {GROW}",
    "knn_polygon": f"""{with_views('v_pt', 'v_bld', 'v_bedge')}, sq AS (SELECT p.pt_id, p.x, p.y, b.bld_id FROM v_pt p JOIN v_bld b ON b.x0 <= p.x + {RADIUS} AND b.x1 >= p.x - {RADIUS} AND b.y0 <= p.y + {RADIUS} AND b.y1 >= p.y - {RADIUS}),
far AS (SELECT p.pt_id, bld_id, CASE WHEN sum(CASE WHEN {crosses_ray(*_P, *_S)} THEN 1 ELSE 0 END) % 2 = 1 THEN 0e0 ELSE sqrt(min({point_segment_squared(*_P, *_S)})) END AS d FROM sq p JOIN v_bedge s USING (bld_id) GROUP BY 1, 2),
best AS (SELECT pt_id, bld_id, d FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d, bld_id) AS r FROM far WHERE d <= {RADIUS}) t WHERE r = 1), nsq AS (SELECT pt_id, count(*) AS n_square FROM sq GROUP BY 1)
SELECT pt_id, coalesce(n_square, 0) AS n_square, bld_id, round(d, 4) AS d FROM v_pt LEFT JOIN nsq USING (pt_id) LEFT JOIN best USING (pt_id)""",
    "corridor_polygon": f"""{with_views('v_vert', 'v_bedge')},{SEG} SELECT bld_id FROM (SELECT b.bld_id, s.line_id, s.seg_no, sum(CASE WHEN {crosses_ray('s.x0', 's.y0', *_B)} THEN 1 ELSE 0 END) % 2 AS held, min({segment_segment(_S, _B)}) AS d FROM v_bedge b, seg s GROUP BY 1, 2, 3) t GROUP BY 1 HAVING min(CASE WHEN held = 1 THEN 0 ELSE d END) <= {CORRIDOR}""",
    "grow_polygon": f"""{with_views('v_bedge')}, w AS (SELECT *, min(x0) OVER o AS lx, min(y0) OVER o AS ly, max(x0) OVER o AS hx, max(y0) OVER o AS hy, row_number() OVER (PARTITION BY bld_id ORDER BY x0, y0, x1, y1) AS e FROM v_bedge WINDOW o AS (PARTITION BY bld_id)),
near AS (SELECT c.bld_id, s.bld_id AS seed, min({segment_segment(_S, ('c.x0', 'c.y0', 'c.x1', 'c.y1'))}) AS d FROM w c JOIN w s ON s.bld_id % 97 = 0 AND c.lx <= s.hx + {GROW} AND c.hx >= s.lx - {GROW} AND c.ly <= s.hy + {GROW} AND c.hy >= s.ly - {GROW} GROUP BY 1, 2),
held AS (SELECT c.bld_id FROM w c JOIN w s ON s.bld_id % 97 = 0 AND s.e = 1 AND s.x0 BETWEEN c.lx AND c.hx AND s.y0 BETWEEN c.ly AND c.hy WHERE {crosses_ray('s.x0', 's.y0', 'c.x0', 'c.y0', 'c.x1', 'c.y1')} GROUP BY c.bld_id, s.bld_id HAVING count(*) % 2 = 1
  UNION ALL SELECT s.bld_id FROM w s JOIN w c ON c.bld_id % 97 = 0 AND s.e = 1 AND s.x0 BETWEEN c.lx AND c.hx AND s.y0 BETWEEN c.ly AND c.hy WHERE {crosses_ray('s.x0', 's.y0', 'c.x0', 'c.y0', 'c.x1', 'c.y1')} GROUP BY c.bld_id, s.bld_id HAVING count(*) % 2 = 1)
SELECT bld_id FROM near WHERE d <= {GROW} UNION SELECT bld_id FROM held""",
    "near_parts": f"""{with_views('v_pt', 'v_vert')},{SEG},
pq AS (SELECT s.line_id, s.m0, s.len, (s.x1 - s.x0) * (s.x0 - p.x) + (s.y1 - s.y0) * (s.y0 - p.y) AS p, (s.x0 - p.x) * (s.x0 - p.x) + (s.y0 - p.y) * (s.y0 - p.y) - 2.25e0 AS r FROM seg s JOIN v_pt p ON s.line_id = p.line_id),
iv AS (SELECT line_id, m0 + greatest(0, (-p - sqrt(p * p - len * len * r)) / len) AS a, m0 + least(len, (-p + sqrt(p * p - len * len * r)) / len) AS b FROM pq WHERE len > 0 AND p * p >= len * len * r AND -p - sqrt(p * p - len * len * r) <= len * len AND -p + sqrt(p * p - len * len * r) >= 0),
st AS (SELECT DISTINCT i.line_id, i.a FROM iv i WHERE NOT EXISTS (SELECT 1 FROM iv j WHERE j.line_id = i.line_id AND j.a < i.a AND j.b >= i.a - 1e-9)),
pa AS (SELECT line_id, a, lead(a) OVER (PARTITION BY line_id ORDER BY a) AS nxt FROM st)
SELECT pa.line_id, round(pa.a, 4) AS a, round(max(i.b), 4) AS b FROM pa JOIN iv i ON i.line_id = pa.line_id AND i.a >= pa.a AND (nxt IS NULL OR i.a < nxt) GROUP BY pa.line_id, pa.a""",
    "cell_polygon": f"""{with_views('v_edge')}, g AS (SELECT poly_id, ci, cj FROM (SELECT poly_id, min(x0) AS x0, max(x0) AS x1, min(y0) AS y0, max(y0) AS y1 FROM v_edge GROUP BY 1) b, range(250) i(ci), range(100) j(cj) WHERE {_CX} BETWEEN x0 AND x1 AND {_CY} BETWEEN y0 AND y1)
SELECT poly_id, CAST(count(*) * {CELL} * {CELL} AS DOUBLE) AS area FROM (SELECT g.poly_id, ci, cj FROM g JOIN v_edge e USING (poly_id) WHERE {crosses_ray(_CX, _CY, 'e.x0', 'e.y0', 'e.x1', 'e.y1')} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) t GROUP BY 1""",
    "cell_union": f"{CELLS} " + _AREA % "SELECT * FROM discs UNION SELECT * FROM tube",
    "cell_intersect": f"{CELLS} " + _AREA % "SELECT * FROM discs INTERSECT SELECT * FROM tube",
    "cell_difference": f"{CELLS} " + _AREA % "SELECT * FROM tube EXCEPT SELECT * FROM discs",
}

# outlines, overlay and graphs --------------------------------------------------------------------


def _measured(size: float) -> str:
    """From s(key, ci, cj), the cells of shapes: area, corners, length of the outline, and parts less holes by Euler's formula."""
    return f"""
pairs AS (SELECT s.key, count(r.key) AS across, count(t.key) AS up, count(CASE WHEN r.key IS NOT NULL AND t.key IS NOT NULL AND q.key IS NOT NULL THEN 1 END) AS blocks, count(*) AS n
  FROM s LEFT JOIN s r ON r.key = s.key AND r.ci = s.ci + 1 AND r.cj = s.cj LEFT JOIN s t ON t.key = s.key AND t.ci = s.ci AND t.cj = s.cj + 1 LEFT JOIN s q ON q.key = s.key AND q.ci = s.ci + 1 AND q.cj = s.cj + 1 GROUP BY 1),
spots AS (SELECT key, ci, cj, count(*) AS k, sum(d) AS d FROM (SELECT key, ci, cj, 0 AS d FROM s UNION ALL SELECT key, ci + 1, cj + 1, 0 FROM s UNION ALL SELECT key, ci + 1, cj, 1 FROM s UNION ALL SELECT key, ci, cj + 1, 1 FROM s) t GROUP BY 1, 2, 3),
turns AS (SELECT key, sum(CASE WHEN k IN (1, 3) THEN 1 WHEN k = 2 AND d <> 1 THEN 2 ELSE 0 END) AS corners FROM spots GROUP BY 1)
SELECT key, round(CAST(n * {size * size} AS DOUBLE), 3) AS area, CAST(corners AS BIGINT) AS corners, CAST(n - across - up + blocks AS BIGINT) AS euler, round(CAST((4 * n - 2 * across - 2 * up) * {size} AS DOUBLE), 3) AS perimeter FROM pairs JOIN turns USING (key)"""


_ROAD = SEG.replace("v_vert", "v_road")


def _in_polygons(shapes: str, area: bool) -> str:
    """Pairs of a polygon and a shape of which edges meet, or of which one holds an end of the other."""
    inside = lambda px, py, e: f"sum(CASE WHEN {crosses_ray(px, py, *(f'{e}.{c}' for c in ('x0', 'y0', 'x1', 'y1')))} THEN 1 ELSE 0 END) % 2 = 1"
    around = f" UNION SELECT poly_id, id FROM corner c, shapes s GROUP BY poly_id, id HAVING {inside('min(c.p.x0)', 'min(c.p.y0)', 's')}" if area else ""
    around = around.replace("min(c.p.x0)", "c.p.x0").replace("min(c.p.y0)", "c.p.y0")
    return f"""{shapes},
first AS (SELECT id, min(struct_pack(x0 := x0, y0 := y0)) AS p FROM shapes GROUP BY id), corner AS (SELECT poly_id, min(struct_pack(x0 := x0, y0 := y0)) AS p FROM v_edge GROUP BY poly_id)
SELECT poly_id, id FROM shapes s, v_edge e WHERE {segment_segment(_S, ('e.x0', 'e.y0', 'e.x1', 'e.y1'))} = 0
UNION SELECT poly_id, id FROM first f, v_edge e GROUP BY poly_id, id HAVING {inside('f.p.x0', 'f.p.y0', 'e')}{around}"""


def _stereo70(places: str) -> str:
    """From p0(pt_id, lo, la), radians of 4326: the seven parameters undone, latitude by four rounds of the classic iteration, then the oblique stereographic by conformal latitudes."""
    k, (rx, ry, rz) = 1 + SHIFT[6] / 1e6, (np.radians(s / 3600) for s in SHIFT[3:6])
    m = np.linalg.inv(k * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]))
    (a1, f1), (a2, f2) = WGS84, (A, F_INV)
    e1, e2 = 2 / f1 - 1 / f1**2, 2 / f2 - 1 / f2**2
    row = lambda r: " + ".join(f"({float(v)!r}) * ({c} - ({t}))" for v, c, t in zip(r, "gx gy gz".split(), SHIFT[:3], strict=True)).replace("'", "")
    turn = lambda la: f"atan2(qz + {e2!r} * {a2!r} / sqrt(1 - {e2!r} * pow(sin({la}), 2)) * sin({la}), qp)"
    return f"""{places},
p1 AS (SELECT pt_id, n * cos(la) * cos(lo) AS gx, n * cos(la) * sin(lo) AS gy, n * (1 - {e1!r}) * sin(la) AS gz FROM (SELECT *, {a1!r} / sqrt(1 - {e1!r} * pow(sin(la), 2)) AS n FROM p0) t),
p2 AS (SELECT pt_id, {row(m[0])} AS qx, {row(m[1])} AS qy, {row(m[2])} AS qz FROM p1),
p3 AS (SELECT *, atan2(qy, qx) AS lo, sqrt(qx * qx + qy * qy) AS qp FROM p2), p4 AS (SELECT *, atan2(qz, qp * (1 - {e2!r})) AS l0 FROM p3),
p5 AS (SELECT *, {turn('l0')} AS l1 FROM p4), p6 AS (SELECT *, {turn('l1')} AS l2 FROM p5), p7 AS (SELECT *, {turn('l2')} AS l3 FROM p6), p8 AS (SELECT *, {turn('l3')} AS la FROM p7),
c0 AS (SELECT sqrt({e2!r}) AS e, radians({LAT0!r}) AS la0, radians({LON0!r}) AS lo0),
c1 AS (SELECT *, {a2!r} * (1 - e * e) / pow(1 - e * e * pow(sin(la0), 2), 1.5) AS rho, {a2!r} / sqrt(1 - e * e * pow(sin(la0), 2)) AS nu, sqrt(1 + e * e * pow(cos(la0), 4) / (1 - e * e)) AS n FROM c0),
c2 AS (SELECT *, sqrt(rho * nu) AS r, pow((1 + sin(la0)) / (1 - sin(la0)) * pow((1 - e * sin(la0)) / (1 + e * sin(la0)), e), n) AS w1 FROM c1),
c3 AS (SELECT *, (n + sin(la0)) * (1 - (w1 - 1) / (w1 + 1)) / ((n - sin(la0)) * (1 + (w1 - 1) / (w1 + 1))) AS c FROM c2), c4 AS (SELECT *, asin((c * w1 - 1) / (c * w1 + 1)) AS x0 FROM c3),
p9 AS (SELECT pt_id, r, x0, n * (lo - lo0) AS dl, c * pow((1 + sin(la)) / (1 - sin(la)) * pow((1 - e * sin(la)) / (1 + e * sin(la)), e), n) AS w FROM p8, c4),
p10 AS (SELECT *, asin((w - 1) / (w + 1)) AS xi FROM p9), p11 AS (SELECT *, 1 + sin(xi) * sin(x0) + cos(xi) * cos(x0) * cos(dl) AS b FROM p10)
SELECT pt_id, round({FALSE!r} + 2 * r * {K0!r} * cos(xi) * sin(dl) / b, 2) AS sx, round({FALSE!r} + 2 * r * {K0!r} * (sin(xi) * cos(x0) - cos(xi) * sin(x0) * cos(dl)) / b, 2) AS sy FROM p11"""


def _v1(c: float, near: float, outer: float, inner: float, least: float) -> str:
    """The first recipe cell by cell: streets cut to their longest stretch near points, bands, parts by reaching from row to row, houses on the side with most points."""
    x, y = f"((ci + 0.5e0) * {c})", f"((cj + 0.5e0) * {c})"
    cut = lambda p, m: f"CASE WHEN {m} <= m0 THEN {p}0 WHEN {m} >= m0 + len THEN {p}1 ELSE {p}0 + ({p}1 - {p}0) * ({m} - m0) / len END"
    span = lambda lo, hi, pad: f"unnest(range(CAST(floor(({lo} - {pad}) / {c}) AS BIGINT), CAST(floor(({hi} + {pad}) / {c}) AS BIGINT) + 1))"
    return f"""{with_views('v_pt', 'v_vert', 'v_bedge').replace('WITH', 'WITH RECURSIVE', 1)},{SEG},
pq AS (SELECT s.line_id, s.m0, s.len, (s.x1 - s.x0) * (s.x0 - p.x) + (s.y1 - s.y0) * (s.y0 - p.y) AS p, (s.x0 - p.x) * (s.x0 - p.x) + (s.y0 - p.y) * (s.y0 - p.y) - {near * near} AS r FROM seg s JOIN v_pt p ON s.line_id = p.line_id),
iv AS (SELECT DISTINCT line_id, m0 + greatest(0, (-p - sqrt(p * p - len * len * r)) / len) AS a, m0 + least(len, (-p + sqrt(p * p - len * len * r)) / len) AS b FROM pq WHERE len > 0 AND p * p >= len * len * r AND -p - sqrt(p * p - len * len * r) <= len * len AND -p + sqrt(p * p - len * len * r) >= 0),
far AS (SELECT *, max(b) OVER (PARTITION BY line_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv),
grp AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM far),
longest AS (SELECT line_id, a, b FROM (SELECT line_id, min(a) AS a, max(b) AS b, row_number() OVER (PARTITION BY line_id ORDER BY max(b) - min(a) DESC, min(a)) AS r FROM grp GROUP BY line_id, part) t WHERE r = 1 AND b - a >= {least}),
street AS (SELECT line_id AS key, {cut('x', 'a')} AS x0, {cut('y', 'a')} AS y0, {cut('x', 'b')} AS x1, {cut('y', 'b')} AS y1 FROM seg JOIN longest USING (line_id) WHERE m0 < b AND m0 + len > a
  UNION ALL SELECT line_id, x0, y0, x1, y1 FROM seg WHERE line_id NOT IN (SELECT line_id FROM longest)),
wide AS (SELECT key, ci, cj, min(d) AS d FROM (SELECT key, ci, cj, {point_segment(x, y, 'x0', 'y0', 'x1', 'y1')} AS d FROM (SELECT *, {span('least(y0, y1)', 'greatest(y0, y1)', outer)} AS cj FROM (SELECT *, {span('least(x0, x1)', 'greatest(x0, x1)', outer)} AS ci FROM street) a) b) t GROUP BY 1, 2, 3),
band AS (SELECT key, ci, cj, ci - row_number() OVER (PARTITION BY key, cj ORDER BY ci) AS g FROM wide WHERE d <= {outer} AND d > {inner}),
runs AS (SELECT key, cj, min(ci) AS a, max(ci) AS b FROM band GROUP BY key, cj, g),
beside AS (SELECT r.key, r.cj, r.a, s.cj AS tj, s.a AS ta FROM runs r JOIN runs s ON s.key = r.key AND s.cj IN (r.cj - 1, r.cj + 1) AND s.a <= r.b AND r.a <= s.b),
reach AS (SELECT key, cj, a, a AS ra, cj AS rj FROM runs UNION SELECT b.key, b.tj, b.ta, ra, rj FROM reach r JOIN beside b ON b.key = r.key AND b.cj = r.cj AND b.a = r.a),
part AS (SELECT key, cj, a, min(struct_pack(a := ra, j := rj)) AS p FROM reach GROUP BY 1, 2, 3),
held AS (SELECT r.key, q.p, count(v.pt_id) AS n FROM runs r JOIN part q USING (key, cj, a) LEFT JOIN v_pt v ON v.key = r.key AND floor(v.y / {c}) = r.cj AND floor(v.x / {c}) BETWEEN r.a AND r.b GROUP BY 1, 2),
side AS (SELECT r.* FROM runs r JOIN part q USING (key, cj, a) JOIN (SELECT key, p FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, p) AS r FROM held) t WHERE r = 1) h ON h.key = r.key AND h.p = q.p),
spots AS (SELECT bld_id, ci, {span('y0', 'y1', 0)} AS cj FROM (SELECT bld_id, y0, y1, {span('x0', 'x1', 0)} AS ci FROM (SELECT bld_id, min(least(x0, x1)) AS x0, min(least(y0, y1)) AS y0, max(greatest(x0, x1)) AS x1, max(greatest(y0, y1)) AS y1 FROM v_bedge GROUP BY 1) a) b),
filled AS (SELECT bld_id, ci, cj FROM spots JOIN v_bedge e USING (bld_id) WHERE {crosses_ray(x, y, 'e.x0', 'e.y0', 'e.x1', 'e.y1')} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
found AS (SELECT DISTINCT s.key, f.bld_id FROM filled f JOIN side s ON s.cj = f.cj AND f.ci BETWEEN s.a AND s.b),
edge AS (SELECT * FROM (VALUES (0e0, 0e0, 950e0, 0e0), (950e0, 0e0, 900e0, 390e0), (900e0, 390e0, 0e0, 390e0), (0e0, 390e0, 0e0, 0e0)) t(x0, y0, x1, y1)),
houses AS (SELECT DISTINCT key, ci, cj FROM found JOIN filled USING (bld_id))
SELECT key, CAST(count(*) * {c * c} AS DOUBLE) AS area FROM (SELECT key, ci, cj FROM houses, edge e WHERE {crosses_ray(x, y, 'e.x0', 'e.y0', 'e.x1', 'e.y1')} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) t GROUP BY key"""


def _v3(c: float, local: float = 500.0, pad: float = 10.0, frontage: float = 35.0, most: float = 350.0, grow: float = 18.0, divider: float = 22.0, around: float = 350.0, fill: float = 14.0, strip: float = 25.0, clamp: float = 140.0, n: int = 300) -> str:
    """The second recipe cell by cell: sampled streets, corridor, nearest houses, growth, the region by the seeds' centroid, houses and strip, the largest part."""
    x, y = f"((ci + 0.5e0) * {c})", f"((cj + 0.5e0) * {c})"
    span = lambda lo, hi, pad: f"unnest(range(CAST(floor(({lo} - {pad}) / {c}) AS BIGINT), CAST(floor(({hi} + {pad}) / {c}) AS BIGINT) + 1))"
    _e, _f = (tuple(f"{t}.{k}" for k in ("x0", "y0", "x1", "y1")) for t in "ef")
    cells = lambda source, r: f"(SELECT *, {span('ly', 'hy', r)} AS cj FROM (SELECT *, {span('lx', 'hx', r)} AS ci FROM {source}) a) b"
    islands = lambda name, source: f"""
{name}_r AS (SELECT key, cj, min(ci) AS a, max(ci) AS b FROM (SELECT key, ci, cj, ci - row_number() OVER (PARTITION BY key, cj ORDER BY ci) AS g FROM {source}) t GROUP BY key, cj, g),
{name}_n AS (SELECT r.key, r.cj, r.a, s.cj AS tj, s.a AS ta FROM {name}_r r JOIN {name}_r s ON s.key = r.key AND s.cj IN (r.cj - 1, r.cj + 1) AND s.a <= r.b AND r.a <= s.b),
{name}_x AS (SELECT key, cj, a, a AS ra, cj AS rj FROM {name}_r UNION SELECT b.key, b.tj, b.ta, ra, rj FROM {name}_x r JOIN {name}_n b ON b.key = r.key AND b.cj = r.cj AND b.a = r.a),
{name} AS (SELECT r.key, r.cj, r.a, r.b, q.p FROM {name}_r r JOIN (SELECT key, cj, a, min(struct_pack(a := ra, j := rj)) AS p FROM {name}_x GROUP BY 1, 2, 3) q USING (key, cj, a))"""  # noqa: E731
    return f"""{with_views('v_pt', 'v_vert', 'v_bedge').replace('WITH', 'WITH RECURSIVE', 1)},{SEG},
kept AS (SELECT * FROM seg WHERE (line_id, seg_no) IN (SELECT (s.line_id, s.seg_no) FROM seg s JOIN v_pt p ON s.line_id = p.line_id WHERE {point_segment(*_P, *_S)} <= {local})),
meas0 AS (SELECT p.pt_id, p.line_id, s.seg_no, {point_segment(*_P, *_S)} AS d, s.m0 + {param(*_P, *_S)} * s.len AS m FROM v_pt p JOIN kept s ON p.line_id = s.line_id),
meas AS (SELECT line_id, m FROM (SELECT *, row_number() OVER (PARTITION BY pt_id, line_id ORDER BY d, seg_no) AS r FROM meas0) t WHERE r = 1),
ends AS (SELECT line_id, greatest(0, min(m) - {pad}) AS a, least((SELECT max(m0 + len) FROM kept s WHERE s.line_id = meas.line_id), max(m) + {pad}) AS b FROM meas GROUP BY line_id),
spot AS (SELECT line_id, i, a + (b - a) * i / {n - 1} AS m FROM ends, range({n}) r(i)),
hit AS (SELECT spot.*, s.x0, s.y0, s.x1, s.y1, s.m0, s.len, row_number() OVER (PARTITION BY spot.line_id, i ORDER BY s.seg_no DESC) AS r FROM spot JOIN kept s ON spot.line_id = s.line_id AND spot.m >= s.m0),
samp AS (SELECT line_id AS key, i, x0 + least(1, (m - m0) / len) * (x1 - x0) AS x, y0 + least(1, (m - m0) / len) * (y1 - y0) AS y FROM hit WHERE r = 1),
street AS (SELECT *, least(x0, x1) AS lx, least(y0, y1) AS ly, greatest(x0, x1) AS hx, greatest(y0, y1) AS hy FROM (SELECT key, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM samp WINDOW w AS (PARTITION BY key ORDER BY i)) t WHERE x1 IS NOT NULL),
house AS (SELECT *, min(least(x0, x1)) OVER w AS lx, min(least(y0, y1)) OVER w AS ly, max(greatest(x0, x1)) OVER w AS hx, max(greatest(y0, y1)) OVER w AS hy, row_number() OVER (PARTITION BY bld_id ORDER BY x0, y0, x1, y1) AS e FROM v_bedge WINDOW w AS (PARTITION BY bld_id)),
corr AS (SELECT DISTINCT bld_id FROM (SELECT b.bld_id, min({segment_segment(_S, ('b.x0', 'b.y0', 'b.x1', 'b.y1'))}) AS d, sum(CASE WHEN {crosses_ray('s.x0', 's.y0', 'b.x0', 'b.y0', 'b.x1', 'b.y1')} THEN 1 ELSE 0 END) % 2 AS held
  FROM house b JOIN street s ON b.lx <= s.hx + {frontage} AND b.hx >= s.lx - {frontage} AND b.ly <= s.hy + {frontage} AND b.hy >= s.ly - {frontage} GROUP BY b.bld_id, s.key, s.x0, s.y0, s.x1, s.y1) t WHERE d <= {frontage} OR held = 1),
dist AS (SELECT p.pt_id, p.key, s.bld_id, CASE WHEN sum(CASE WHEN {crosses_ray(*_P, *_S)} THEN 1 ELSE 0 END) % 2 = 1 THEN 0e0 ELSE sqrt(min({point_segment_squared(*_P, *_S)})) END AS d FROM v_pt p JOIN house s ON s.lx <= p.x + {most} AND s.hx >= p.x - {most} AND s.ly <= p.y + {most} AND s.hy >= p.y - {most} GROUP BY 1, 2, 3),
seed AS (SELECT DISTINCT key, bld_id FROM (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d, bld_id) AS r FROM dist WHERE d <= {most}) t WHERE r = 1 AND bld_id IN (SELECT bld_id FROM corr)),
grown AS (SELECT DISTINCT key, bld_id FROM (SELECT q.key, e.bld_id, f.bld_id AS s, min({segment_segment(_e, _f)}) AS d FROM house e JOIN house f ON e.lx <= f.hx + {grow} AND e.hx >= f.lx - {grow} AND e.ly <= f.hy + {grow} AND e.hy >= f.ly - {grow} JOIN seed q ON q.bld_id = f.bld_id WHERE e.bld_id IN (SELECT bld_id FROM corr) GROUP BY 1, 2, 3
  UNION ALL SELECT q.key, e.bld_id, f.bld_id, 0e0 FROM house e JOIN house f ON f.e = 1 AND f.x0 BETWEEN e.lx AND e.hx AND f.y0 BETWEEN e.ly AND e.hy JOIN seed q ON q.bld_id = f.bld_id WHERE e.bld_id IN (SELECT bld_id FROM corr) AND {crosses_ray('f.x0', 'f.y0', *_e)} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1
  UNION ALL SELECT q.key, e.bld_id, f.bld_id, 0e0 FROM house e JOIN house f ON e.e = 1 AND e.x0 BETWEEN f.lx AND f.hx AND e.y0 BETWEEN f.ly AND f.hy JOIN seed q ON q.bld_id = f.bld_id WHERE e.bld_id IN (SELECT bld_id FROM corr) AND {crosses_ray('e.x0', 'e.y0', *_f)} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) t WHERE d <= {grow}),
pts AS (SELECT key, x, y, x AS lx, x AS hx, y AS ly, y AS hy FROM v_pt),
near AS (SELECT DISTINCT key, ci, cj FROM {cells('street', divider)} WHERE {point_segment(x, y, 'x0', 'y0', 'x1', 'y1')} <= {divider}),
round_ AS (SELECT key, ci, cj FROM (SELECT DISTINCT key, ci, cj FROM {cells('pts', around)} WHERE ({x} - x) * ({x} - x) + ({y} - y) * ({y} - y) <= {around * around}) t EXCEPT SELECT key, ci, cj FROM near),{islands('region', 'round_')},
ring AS (SELECT key, abs(a) AS area, sx / (6 * a) AS cx, sy / (6 * a) AS cy FROM (SELECT key, bld_id, sum((x0 * y1 - x1 * y0) / 2) AS a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS sx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS sy FROM seed JOIN house USING (bld_id) GROUP BY 1, 2) t),
centre AS (SELECT key, sum(area * cx) / sum(area) AS sx, sum(area * cy) / sum(area) AS sy FROM ring GROUP BY 1),
gap AS (SELECT key, p, min(pow(greatest((a + 0.5e0) * {c} - sx, 0e0, sx - (b + 0.5e0) * {c}), 2) + pow((cj + 0.5e0) * {c} - sy, 2)) AS d FROM region JOIN centre USING (key) GROUP BY 1, 2),
side AS (SELECT r.key, r.cj, r.a, r.b FROM region r JOIN (SELECT key, p FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, p) AS r FROM gap) t WHERE r = 1) g ON g.key = r.key AND g.p = r.p),
body AS (SELECT bld_id, min(lx) AS lx, min(ly) AS ly, max(hx) AS hx, max(hy) AS hy FROM house GROUP BY 1),
filled AS (SELECT t.bld_id, ci, cj, count(CASE WHEN {crosses_ray(x, y, *_e)} THEN 1 END) % 2 = 1 AS own, min({point_segment(x, y, *_e)}) AS d FROM (SELECT * FROM {cells('body', fill)}) t JOIN house e ON e.bld_id = t.bld_id GROUP BY 1, 2, 3),
met AS (SELECT DISTINCT g.key, g.bld_id FROM grown g JOIN filled f ON f.bld_id = g.bld_id AND f.own JOIN side s ON s.key = g.key AND s.cj = f.cj AND f.ci BETWEEN s.a AND s.b),
band AS (SELECT DISTINCT t.key, t.ci, t.cj FROM (SELECT * FROM {cells('street', strip)}) t JOIN side s ON s.key = t.key AND s.cj = t.cj AND t.ci BETWEEN s.a AND s.b WHERE {point_segment(x.replace('ci', 't.ci'), y.replace('cj', 't.cj'), 'x0', 'y0', 'x1', 'y1')} <= {strip}),
clamp AS (SELECT DISTINCT key, ci, cj FROM {cells('pts', clamp)} WHERE ({x} - x) * ({x} - x) + ({y} - y) * ({y} - y) <= {clamp * clamp}),
edge AS (SELECT * FROM (VALUES (0e0, 0e0, 950e0, 0e0), (950e0, 0e0, 900e0, 390e0), (900e0, 390e0, 0e0, 390e0), (0e0, 390e0, 0e0, 0e0)) t(x0, y0, x1, y1)),
both_ AS (SELECT DISTINCT key, ci, cj FROM (SELECT key, ci, cj FROM met JOIN filled USING (bld_id) WHERE own OR d <= {fill} UNION ALL SELECT * FROM band) t),
shape AS (SELECT key, ci, cj FROM both_ JOIN clamp USING (key, ci, cj), edge e WHERE {crosses_ray(x, y, *_e)} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),{islands('part', 'shape')}
SELECT key, CAST(max(n) * {c * c} AS DOUBLE) AS area FROM (SELECT key, p, sum(b - a + 1) AS n FROM part GROUP BY 1, 2) t GROUP BY key"""


_BOTH_WAYS = """
dir AS (SELECT osmid, pos, u, v, oneway, length, false AS reversed FROM v_piece WHERE oneway IS DISTINCT FROM '-1' UNION ALL SELECT osmid, pos, v, u, oneway, length, true FROM v_piece WHERE oneway IS NULL OR oneway NOT IN ('yes'))"""
ORACLE_SQL |= {
    "cell_rings": f"""{with_views('v_road', 'v_pt')},{_ROAD},
tube AS (SELECT DISTINCT line_id AS key, ci, cj FROM {_grid('seg', '*', CORRIDOR, 'least(x0, x1)', 'least(y0, y1)', 'greatest(x0, x1)', 'greatest(y0, y1)')} WHERE {point_segment(_CX, _CY, 'x0', 'y0', 'x1', 'y1')} <= {CORRIDOR}),
discs AS (SELECT DISTINCT pt_id % 40 AS key, ci, cj FROM {_grid('v_pt', '*', DISC, 'x', 'y', 'x', 'y')} WHERE ({_CX} - x) * ({_CX} - x) + ({_CY} - y) * ({_CY} - y) <= {DISC * DISC}),
s AS (SELECT * FROM tube EXCEPT SELECT * FROM discs),{_measured(CELL)}""",
    "dissolve_boxes": f"""{with_views('v_bld')}, s AS (SELECT DISTINCT key, ci, cj FROM (SELECT key, ci, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS cj FROM (SELECT bld_id % 16 AS key, y0, y1, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS ci FROM v_bld) a) b),{_measured(1.0)}""",
    "repair_bowties": "SELECT CAST(p_partkey AS BIGINT) AS key, round((4 + p_partkey % 13) * (6 + p_partkey % 3) * (6 + p_partkey % 3) / 20e0, 3) AS area, CAST(3 AS BIGINT) AS corners, CAST(1 AS BIGINT) AS euler FROM part",
    "street_directed": f"{with_views('v_piece')},{_BOTH_WAYS} SELECT u, v, row_number() OVER (PARTITION BY u, v ORDER BY osmid, pos, reversed) - 1 AS key, osmid, reversed FROM dir",
    "street_simplified": f"""{with_views('v_piece').replace('WITH', 'WITH RECURSIVE', 1)},{_BOTH_WAYS},
e AS (SELECT *, row_number() OVER () AS id FROM dir),
nb AS (SELECT node, other, sum(o) AS o, sum(i) AS i FROM (SELECT u AS node, v AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT v, u, 0, 1 FROM e) t GROUP BY 1, 2),
pass AS (SELECT node FROM nb GROUP BY 1 HAVING count(*) = 2 AND max(greatest(o, i)) = 1 AND sum(o) = sum(i) AND NOT bool_or(other = node)),
walk AS (SELECT id AS of, u AS first, u, v, length, [osmid] AS ways, 1 AS n FROM e WHERE u NOT IN (SELECT node FROM pass)
  UNION ALL SELECT w.of, w.first, e.u, e.v, w.length + e.length, list_append(w.ways, e.osmid), w.n + 1 FROM walk w JOIN e ON e.u = w.v AND e.v <> w.u WHERE w.v IN (SELECT node FROM pass))
SELECT first AS u, v, CAST(n AS BIGINT) AS n_pieces, length, array_to_string(list_sort(list_distinct(ways)), ',') AS osmid FROM walk WHERE v NOT IN (SELECT node FROM pass)""",
    "long_line_measure": f"{with_views('v_pt', 'v_long')},{SEG.replace('v_vert', 'v_long')},{MEASURES} SELECT pt_id, line_id, round(d, 4) AS d, round(m, 4) AS m FROM meas",
    "lines_in_polygons": _in_polygons(f"{with_views('v_road', 'v_edge')},{_ROAD}, shapes AS (SELECT line_id AS id, x0, y0, x1, y1 FROM seg)", False),
    "houses_in_polygons": _in_polygons(f"{with_views('v_bedge', 'v_edge')}, shapes AS (SELECT bld_id AS id, x0, y0, x1, y1 FROM v_bedge)", True),
    "stereo70": _stereo70(f"{with_views('v_pt')}, p0 AS (SELECT pt_id, radians(x / 150e0 + 21) AS lo, radians(y / 150e0 + 44) AS la FROM v_pt)"),
    "cell_largest_part": f"""{CELLS.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT * FROM tube EXCEPT SELECT * FROM discs), steps AS (SELECT unnest([1, -1, 0, 0]) AS di, unnest([0, 0, 1, -1]) AS dj),
beside AS (SELECT a.key, a.ci, a.cj, b.ci AS ni, b.cj AS nj FROM (SELECT key, ci, cj, ci + di AS xi, cj + dj AS xj FROM s, steps) a JOIN s b ON b.key = a.key AND b.ci = a.xi AND b.cj = a.xj),
reach AS (SELECT key, ci, cj, ci AS ri, cj AS rj FROM s UNION SELECT b.key, b.ni, b.nj, ri, rj FROM reach r JOIN beside b ON b.key = r.key AND b.ci = r.ci AND b.cj = r.cj),
part AS (SELECT key, ci, cj, min(struct_pack(i := ri, j := rj)) AS p FROM reach GROUP BY 1, 2, 3)
SELECT key, CAST(max(n) * {CELL * CELL} AS DOUBLE) AS area FROM (SELECT key, p, count(*) AS n FROM part GROUP BY 1, 2) t GROUP BY key""",
    "sections_json": _JSON,
    "polygon_v1_cells": _v1(5.0, 250.0, 180.0, 15.0, 20.0),
    "polygon_v3_cells": _v3(5.0),
}
