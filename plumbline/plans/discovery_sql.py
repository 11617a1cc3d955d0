"""DuckDB SQL of discovered items (B18-B28), written apart from the operators: joins on numbered labels, one branch a grammar."""

from __future__ import annotations

from plumbline.operators import discovery as d


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regex(pattern: str) -> str:
    return quoted(pattern.replace("(?iU)", "(?i)"))


def listed(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


WORD, MARK, CLEAN = regex(d.WORD), regex(d.MARK), "'(),:;·.'"
SPEC = f"(upper(x) IN {listed(d.SPEC_WORDS)} OR (regexp_matches(upper(x), '[^/.]') AND len(list_filter(string_split(replace(upper(x), '.', '/'), '/'), lambda y: y <> '' AND y NOT IN {listed(d.SPEC_WORDS)})) = 0))"
STOPS = f"(upper(x) = '' OR upper(x) IN {listed(d.BOUNDARY)} OR (NOT regexp_matches(upper(x), {MARK}) AND (regexp_matches(x, '[0-9]') OR NOT regexp_matches(x, {WORD}))))"
FURNITURE = f"(length(text) < 3 OR regexp_matches(text, {regex(d.FURNITURE)}) OR regexp_matches(text, {regex(d.REFERENCE)}) OR (length(text) > 110 AND len(string_split(text, ' ')) > 15))"


def labels(table: str) -> str:
    """CTEs up to ``l``: labels with cleaned tokens, whether each ends a phrase, the block's name and the words below."""
    return rf"""
b0 AS (SELECT drawing_id, block_id, line_no, grid_ref, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM {table}),
b1 AS (SELECT *, list_transform(string_split(text, ' '), lambda x: trim(x, {CLEAN})) AS tk, {FURNITURE} AS furniture, row_number() OVER (PARTITION BY drawing_id, block_id ORDER BY line_no) AS rn FROM b0),
b2 AS (SELECT *, list_transform(tk, lambda x: {STOPS}) AS stops, CASE WHEN furniture OR length(text) > 60 THEN '' ELSE array_to_string(list_slice(list_filter(tk, lambda x: x <> '' AND upper(x) NOT IN {listed(d.BOUNDARY)} AND NOT {SPEC} AND (regexp_matches(x, {WORD}) OR regexp_matches(upper(x), {MARK}))), 1, 5), ' ') END AS own FROM b1),
names AS (SELECT drawing_id, block_id, rn, own, row_number() OVER (PARTITION BY drawing_id, block_id ORDER BY rn) AS k FROM b2 WHERE own <> '' AND NOT regexp_matches(own, '[0-9]')),
l AS (SELECT b2.*, coalesce(CASE WHEN n1.rn = b2.rn THEN n2.own ELSE n1.own END, '') AS context, coalesce(nx.own, '') AS below FROM b2
  LEFT JOIN names n1 ON n1.drawing_id = b2.drawing_id AND n1.block_id = b2.block_id AND n1.k = 1 LEFT JOIN names n2 ON n2.drawing_id = b2.drawing_id AND n2.block_id = b2.block_id AND n2.k = 2
  LEFT JOIN names nx ON nx.drawing_id = b2.drawing_id AND nx.block_id = b2.block_id AND nx.rn = b2.rn + 1)"""


def matches(at: int, name: str, pattern: str, groups: int) -> str:
    """CTEs h<at>: a grammar's matches with their place, the phrase after and the phrase before."""
    p = regex(pattern)
    got = ", ".join(f"regexp_extract(m, {p}, {g}) AS t{g}, TRY_CAST(nullif(regexp_extract(m, {p}, {g}), '') AS DOUBLE) AS n{g}" for g in range(1, groups + 1))
    count = lambda s: f"len(list_filter(string_split({s}, ' '), lambda x: x <> ''))"
    return f"""
p{at} AS (SELECT *, unnest(regexp_extract_all(text, {p})) AS m, unnest(list_slice(regexp_split_to_array(text, {p}), 1, len(regexp_extract_all(text, {p})))) AS gap, unnest(range(0, len(regexp_extract_all(text, {p})))) AS nth FROM l WHERE NOT furniture),
q{at} AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY drawing_id, block_id, line_no ORDER BY nth) AS BIGINT) AS e FROM p{at}),
r{at} AS (SELECT *, {count("substr(text, 1, e - length(m))")} AS first, {count("substr(text, 1, e)")} AS last FROM q{at}),
s{at} AS (SELECT *, list_slice(tk, last + 1, last + 7) AS fw, list_slice(stops, last + 1, last + 7) AS fs, list_reverse(list_slice(tk, greatest(first - 6, 1), first)) AS bw, list_reverse(list_slice(stops, greatest(first - 6, 1), first)) AS bs FROM r{at}),
h{at} AS (SELECT *, {at} AS grammar, array_to_string(list_slice(fw, 1, least(5, coalesce(nullif(list_position(fs, true), 0) - 1, len(fw)))), ' ') AS after,
  CASE WHEN first = 0 THEN '' ELSE array_to_string(list_reverse(list_slice(bw, 1, least(5, coalesce(nullif(list_position(bs, true), 0) - 1, len(bw))))), ' ') END AS before, {got} FROM s{at})"""


FORWARD = (
    "CASE WHEN after <> '' AND ends_with(upper(text), upper(list_last(string_split(after, ' ')))) THEN array_to_string(list_slice(list_concat(string_split(after, ' '), "
    "list_filter(string_split(below, ' '), lambda x: x <> '' AND NOT list_contains(string_split(upper(after), ' '), upper(x)))), 1, 7), ' ') ELSE after END"
)
TITLED = f"array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN regexp_matches(upper(w), {MARK}) OR (length(w) <= 3 AND w = upper(w) AND w <> lower(w)) THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ')"


def pick(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')"


def text_of(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def spec(**sizes: str) -> str:
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{n}":' || CAST({x} AS VARCHAR)""" for n, x in sorted(sizes.items())) + ") || '}'"


def items(table: str) -> str:
    """The whole statement, from the CTE before ``table`` on: discovered items merged by kind, description and sizes."""
    in_box = "n1 BETWEEN 50 AND 100000 AND n2 BETWEEN 50 AND 100000 AND (n3 IS NULL OR n3 BETWEEN 50 AND 100000)"
    bars = "(" + ", ".join(str(x) for x in d.DIAMETERS) + ")"
    whose = "CASE WHEN name = '' THEN '' ELSE ' (' || title || ')' END"
    size2, size3 = f"{text_of('n1')} || 'x' || {text_of('n2')}", f"{text_of('n1')} || 'x' || {text_of('n2')} || 'x' || {text_of('n3')}"
    body = "bx.n1 IS NOT NULL AND bx.n3 IS NULL"
    lined = f"h.*, {TITLED.replace('name', 'h.name')} AS title"
    named = lambda at, name: f"(SELECT *, {name} AS name FROM h{at}) h"
    branch = {
        "box": f"SELECT CASE WHEN n3 IS NULL THEN 'box2' ELSE 'box3' END AS kind, title || ' ' || CASE WHEN n3 IS NULL THEN {size2} ELSE {size3} END AS description, CASE WHEN n3 IS NULL THEN {spec(length_mm='n1', width_mm='n2')} ELSE {spec(length_mm='n1', width_mm='n2', height_mm='n3')} END AS spec_json,"
        f" CASE WHEN n3 IS NULL THEN round(n1 * n2 / 1e6, 4) ELSE round(n1 * n2 * n3 / 1e9, 4) END AS qty, CASE WHEN n3 IS NULL THEN {size2} || ' mm, plan area per unit' ELSE {size3} || ' mm, per unit' END AS basis, h.* FROM (SELECT {lined} FROM {named(0, pick('before', 'after', 'context'))}) h WHERE name <> '' AND {in_box}",
        "thickness": f"SELECT CASE WHEN {body} THEN 'box3' ELSE 'thickness' END, title || ', ' || {text_of('h.n1')} || ' mm thick', CASE WHEN {body} THEN {spec(length_mm='bx.n1', width_mm='bx.n2', thickness_mm='h.n1')} ELSE {spec(thickness_mm='h.n1')} END,"
        f" CASE WHEN {body} THEN round(bx.n1 * bx.n2 * h.n1 / 1e9, 4) END, CASE WHEN {body} THEN {text_of('bx.n1')} || 'x' || {text_of('bx.n2')} || 'x' || {text_of('h.n1')} || ' mm, per unit' ELSE {text_of('h.n1')} || ' mm thick — area not stated on this sheet' END, h.*"
        f" FROM (SELECT {lined} FROM {named(1, pick(FORWARD, 'before', 'context'))}) h LEFT JOIN bx ON bx.drawing_id = h.drawing_id AND bx.block_id = h.block_id AND bx.line_no = h.line_no WHERE h.name <> '' AND h.n1 BETWEEN 1 AND 3000",
        "diameter": f"SELECT 'diameter', title || ', ' || {text_of('n1')} || ' mm dia', {spec(diameter_mm='n1')}, CAST(NULL AS DOUBLE), {text_of('n1')} || ' mm dia — count not stated on this sheet', h.* FROM (SELECT {lined} FROM {named(2, pick(FORWARD, 'context'))}) h WHERE name <> '' AND n1 BETWEEN 5 AND 2000",
        "rebar": f"SELECT 'rebar', 'D' || {text_of('n2')} || ' bars — ' || {text_of('n1')} || ' Nos per element' || {whose}, {spec(count='n1', diameter_mm='n2')}, n1, trim(m) || ' — bars per element', h.* FROM (SELECT {lined} FROM {named(3, 'after')}) h WHERE n1 BETWEEN 1 AND 200 AND n2 IN {bars}",
        "rebar_spacing": f"SELECT 'rebar_spacing', 'D' || {text_of('n1')} || ' bars @ ' || {text_of('n2')} || ' c/c' || {whose}, {spec(diameter_mm='n1', spacing_mm='n2')}, CAST(NULL AS DOUBLE), 'D' || {text_of('n1')} || ' @ ' || {text_of('n2')} || ' c/c — run length not stated', h.*"
        f" FROM (SELECT {lined} FROM {named(4, 'after')}) h WHERE n1 IN {bars} AND n2 BETWEEN 50 AND 500",
        "assembly": f"SELECT 'assembly', 'Anchor assembly ' || upper(t1) || ' M' || {text_of('n4')} || ' x ' || {text_of('n5')} || ' (grade ' || upper(t3) || ')', {spec(count='n2', size_mm='n4', length_mm='n5', nuts='n6')}, n2, m || ' — ' || {text_of('n2')} || ' bolts per set', h.* FROM (SELECT *, '' AS name, '' AS title FROM h5) h",
        "compaction": f"SELECT 'compaction', title || ', ' || {text_of('n1')} || '% compaction', {spec(percent='n1')}, CAST(NULL AS DOUBLE), {text_of('n1')} || '% compaction — volume not stated on this sheet', h.* FROM (SELECT {lined} FROM {named(6, pick(FORWARD, 'context'))}) h WHERE name <> '' AND n1 BETWEEN 50 AND 100",
        "set": f"SELECT 'set', title || ' — ' || {text_of('n1')} || ' Nos per set', {spec(per_set='n1')}, n1, {text_of('n1')} || ' Nos per set', h.* FROM (SELECT {lined} FROM {named(7, pick('before', 'context'))}) h WHERE name <> ''",
    }
    columns = "kind, description, spec_json, qty, basis, drawing_id, block_id, line_no, grid_ref, text, grammar, nth"
    found = [f"i{k} AS (SELECT {columns} FROM ({branch[n]}) x(kind, description, spec_json, qty, basis))" for k, n in enumerate(d.NAMES)]
    box = f"bx AS (SELECT drawing_id, block_id, line_no, n1, n2, n3 FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, block_id, line_no ORDER BY nth) AS k FROM h0 WHERE {in_box} AND {pick('before', 'after', 'context')} <> '') WHERE k = 1)"
    uoms = " ".join(f"WHEN '{k}' THEN '{u}'" for k, u in d.UOM.items())
    key = "drawing_id, kind, lower(description), spec_json"
    return ",\n".join([labels(table).strip(), *[matches(k, *g).strip() for k, g in enumerate(d.GRAMMARS)], box, *found]) + f""",
i AS ({" UNION ALL ".join(f"SELECT * FROM i{k}" for k in range(len(d.NAMES)))}),
j AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY block_id, line_no, grammar, nth) AS k FROM i),
one AS (SELECT * FROM j WHERE k = 1),
tx AS (SELECT drawing_id, kind, name, spec_json, string_agg(text, ' | ' ORDER BY k) AS texts FROM (SELECT drawing_id, kind, lower(description) AS name, spec_json, text, min(k) AS k FROM j GROUP BY ALL) GROUP BY ALL),
px AS (SELECT drawing_id, kind, name, spec_json, string_agg(grid_ref, ', ' ORDER BY k) AS places FROM (SELECT drawing_id, kind, lower(description) AS name, spec_json, grid_ref, min(k) AS k FROM j WHERE grid_ref <> '' GROUP BY ALL) GROUP BY ALL),
nn AS (SELECT drawing_id, kind, lower(description) AS name, spec_json, count(*) AS n FROM j GROUP BY ALL)
SELECT one.drawing_id, one.kind, one.description, one.spec_json, CASE one.kind {uoms} END AS uom, one.qty, one.basis, nn.n AS occurrences, tx.texts, coalesce(px.places, '') AS places
FROM one JOIN nn ON nn.drawing_id = one.drawing_id AND nn.kind = one.kind AND nn.name = lower(one.description) AND nn.spec_json = one.spec_json
JOIN tx ON tx.drawing_id = one.drawing_id AND tx.kind = one.kind AND tx.name = lower(one.description) AND tx.spec_json = one.spec_json
LEFT JOIN px ON px.drawing_id = one.drawing_id AND px.kind = one.kind AND px.name = lower(one.description) AND px.spec_json = one.spec_json"""
