"""SQL texts shared by the twins of several queries.

The twins are relational (long tables, joins, grouping) where the Spark side
works inside the row, so the two forms check each other.
"""

from __future__ import annotations

from auditlake.catalog import derived
from auditlake.functions import rulebook as rb


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Rule pattern for an engine without lookahead; same searches match."""
    return lit(pattern.replace("(?![a-zA-Z])", "(?:[^a-zA-Z]|$)"))


def values(rows: list[tuple]) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else lit(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(c) for c in r) + ")" for r in rows) + ")"


def case_map(mapping: dict[str, str], key: str, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {default} END"


def str_list(items: list[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


# --- rule tables ----------------------------------------------------------

SINKS = values(
    [
        (lang, cat, fn.rstrip("("), rb.RISK_ORDER[rb.RISK.get(cat, "medium")])
        for lang, cats in rb.SINKS.items() for cat, fns in cats.items() for fn in fns
    ]
) + " AS sinks(language, category, name, prio)"

SANITIZERS = [(lang, i, p, label) for lang, rules in rb.SANITIZERS.items() for i, (p, label) in enumerate(rules)]


def sanitizer_list(code: str, language: str) -> str:
    """List expression of matching labels, in rule order."""
    arms = []
    for lang in rb.SANITIZERS:
        items = ", ".join(
            f"CASE WHEN regexp_matches({code}, {re2(p)}) THEN {lit(label)} END" for ln, _, p, label in SANITIZERS if ln == lang
        )
        arms.append(f"WHEN {lit(lang)} THEN list_filter([{items}], lambda x: x IS NOT NULL)")
    return f"CASE {language} {' '.join(arms)} ELSE [] END"


# --- syntax ---------------------------------------------------------------

_STR = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"' + r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_NOISE_C = _STR + r"|//[^\n]*|/\*[\s\S]*?\*/"
_NOISE_PY = r"(\b[rR]?[fF](?:" + _STR + r'))|"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + _STR + r"|#[^\n]*"


def _nested(depth: int) -> str:
    flat = r"[^()]*"
    return flat if depth == 0 else rf"{flat}(?:\({_nested(depth - 1)}\){flat})*"


_HEADER_C = r"^(?:\s*@[\w.]+\s*(?:\([^()]*\))?)*[^(){};=]*?([A-Za-z_]\w*)\s*\((" + _nested(1) + r")\)[^(){};=]*\{"
_HEADER_PY = r"^([\s\S]*?)\bdef\s+([A-Za-z_]\w*)\s*\((" + _nested(1) + r")\)[^:\n]*:"
_ASSIGN_C = r"([A-Za-z_]\w*)\s*(?:\[[^\]\n]*\])?\s*=\s*([^=;{}\s][^;{}]*)"
_ASSIGN_PY = r"(?m)^[ \t]*([A-Za-z_]\w*)[\w.]*\s*=\s*([^=\n\s][^\n]*)"
_KEYWORDS = [
    "if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "and", "or", "not", "in", "is", "lambda",
    "elif", "except", "with", "assert", "new", "synchronized", "def", "class", "case", "defined",
]


def calls_of(source: str, text: str, key: str) -> str:
    """Long call table of ``text``: key, language, pos, name, args, idents."""
    return f"""
  SELECT {key}, language, pos, name, args, regexp_extract_all(args, '[A-Za-z_]\\w*') AS idents,
         [name, regexp_extract(name, '([^.]+\\.[^.]+)$', 1), regexp_extract(name, '([^.]*)$', 1)] AS suffixes
  FROM (
    SELECT {key}, language, pos, regexp_extract(p[pos], '([A-Za-z_][\\w.]*)\\s*$', 1) AS name,
           regexp_extract(array_to_string(p[pos + 1:], '('), {lit('^(' + _nested(4) + ')')}, 1) AS args
    FROM (SELECT {key}, language, p, unnest(range(1, len(p))) AS pos
          FROM (SELECT {key}, language, string_split({text}, '(') AS p FROM {source}) x) y
  ) z
  WHERE name <> '' AND NOT list_contains({str_list(_KEYWORDS)}, regexp_extract(name, '([^.]*)$', 1))"""


SYNTAX = f"""
code AS {derived.cte(derived.CODE)},
cleaned AS (
  SELECT *, CASE WHEN language = 'python' THEN regexp_replace(code, {lit(_NOISE_PY)}, '\\1 ', 'g')
                 ELSE regexp_replace(code, {lit(_NOISE_C)}, ' ', 'g') END AS clean FROM code),
parsed AS (
  SELECT *, CASE WHEN language = 'python' THEN regexp_extract(clean, {lit(_HEADER_PY)}, 2)
                 ELSE regexp_extract(clean, {lit(_HEADER_C)}, 1) END AS fn_name,
         CASE WHEN language = 'python' THEN regexp_extract(clean, {lit(_HEADER_PY)}, 3)
              ELSE regexp_extract(clean, {lit(_HEADER_C)}, 2) END AS params_text,
         CASE WHEN language = 'python' THEN regexp_replace(clean, {lit(_HEADER_PY)}, '\\1')
              ELSE regexp_replace(clean, {lit(_HEADER_C)}, '') END AS body
  FROM cleaned),
calls AS ({calls_of("parsed", "body", "sample_id")}),
params AS (
  SELECT sample_id, i, ident FROM (
    SELECT sample_id, i, CASE WHEN language = 'python' THEN regexp_extract(p[i], '([A-Za-z_]\\w*)', 1)
                              ELSE regexp_extract(p[i], '([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\]\\s*)*$', 1) END AS ident
    FROM (SELECT sample_id, language, p, unnest(range(1, len(p) + 1)) AS i
          FROM (SELECT sample_id, language, string_split(params_text, ',') AS p FROM parsed) a) b) c
  WHERE ident NOT IN ('', 'void')),
assigns AS (
  SELECT sample_id, language, pos, lhs[pos] AS lhs, rhs[pos] AS rhs,
         regexp_extract(rhs[pos], '^([A-Za-z_][\\w.]*)\\s*\\(', 1) AS head_call,
         sample_id || '#' || pos AS assign_id
  FROM (SELECT *, unnest(range(1, len(lhs) + 1)) AS pos FROM (
    SELECT sample_id, language,
           CASE WHEN language = 'python' THEN regexp_extract_all(body, {lit(_ASSIGN_PY)}, 1) ELSE regexp_extract_all(body, {lit(_ASSIGN_C)}, 1) END AS lhs,
           CASE WHEN language = 'python' THEN regexp_extract_all(body, {lit(_ASSIGN_PY)}, 2) ELSE regexp_extract_all(body, {lit(_ASSIGN_C)}, 2) END AS rhs
    FROM parsed) a) b)"""

SINK_CALLS = f"""
sinks AS (SELECT * FROM {SINKS}),
sink_calls AS (
  SELECT c.sample_id, c.pos, c.name AS called, c.idents, s.name, s.category, s.prio
  FROM (SELECT *, unnest(list_distinct(suffixes)) AS suffix FROM calls) c
  JOIN sinks s ON s.language = c.language AND s.name = c.suffix),
picked AS (
  SELECT sample_id, name AS sink_type, category AS sink_category FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY prio, -length(name), name, category) AS rn FROM sink_calls) a
  WHERE rn = 1)"""

_SOURCE_CALLS = values(
    [(lang, fn) for lang, kinds in rb.SOURCES.items() for fn in kinds["function_calls"]]
) + " AS sc(language, name)"
_SOURCE_OBJECTS = values(
    [(lang, i, o) for lang, kinds in rb.SOURCES.items() for i, o in enumerate(kinds.get("objects", []))]
) + " AS so(language, ord, obj)"
_VARS = str_list(rb.SOURCES["c"]["variables"])

FLOW = f"""
objects AS (SELECT * FROM {_SOURCE_OBJECTS}),
body_objects AS (
  SELECT p.sample_id, arg_min(o.obj, o.ord) AS obj FROM parsed p JOIN objects o ON o.language = p.language AND contains(p.body, o.obj)
  GROUP BY p.sample_id),
rhs_objects AS (
  SELECT a.sample_id, a.pos, a.lhs, arg_min(o.obj, o.ord) AS obj FROM assigns a JOIN objects o ON o.language = a.language AND contains(a.rhs, o.obj)
  GROUP BY ALL),
mentions AS (
  SELECT a.sample_id, 1 AS kind, a.pos AS ord, a.lhs AS var, 'function:' || a.head_call AS type
  FROM assigns a JOIN {_SOURCE_CALLS} ON sc.language = a.language AND sc.name = a.head_call
  UNION ALL SELECT sample_id, 2, 0, 'unknown_var', 'object:' || obj FROM body_objects
  UNION ALL SELECT sample_id, 2, pos, lhs, 'object:' || obj FROM rhs_objects
  UNION ALL SELECT p.sample_id, 3, p.i, p.ident, 'parameter_source' FROM params p JOIN parsed f ON f.sample_id = p.sample_id AND f.language = 'c'
            WHERE list_contains({_VARS}, p.ident)
  UNION ALL SELECT sample_id, 3, 1000 + i, v, 'parameter_source' FROM (
     SELECT sample_id, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS i FROM (
       SELECT sample_id, regexp_extract_all(body, '\\b({"|".join(rb.SOURCES["c"]["variables"])})\\b', 1) AS vs FROM parsed WHERE language = 'c') a) b
  UNION ALL SELECT sample_id, 4, i, ident, 'function_parameter' FROM params),
direct AS (
  SELECT sample_id, kind, ord, var, type FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, var ORDER BY kind, ord) AS rn FROM mentions) a WHERE rn = 1),
assign_rhs AS (SELECT assign_id, language, rhs FROM assigns),
rhs_calls AS ({calls_of("assign_rhs", "rhs", "assign_id")}),
helper_calls AS (
  SELECT r.* FROM rhs_calls r
  WHERE NOT EXISTS (SELECT 1 FROM sinks s WHERE s.language = r.language AND list_contains(r.suffixes, s.name))),
derived_sources AS (
  SELECT sample_id, 5 AS kind, apos AS ord, lhs AS var, 'cross_function:' || var || '→' || name AS type FROM (
    SELECT a.sample_id, a.pos AS apos, a.lhs, h.name, d.var,
           row_number() OVER (PARTITION BY a.sample_id, a.lhs ORDER BY a.pos, h.pos, d.kind, d.ord) AS rn
    FROM assigns a JOIN helper_calls h ON h.assign_id = a.assign_id
    JOIN direct d ON d.sample_id = a.sample_id AND list_contains(h.idents, d.var)
    WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.sample_id = a.sample_id AND x.var = a.lhs)) q WHERE rn = 1),
all_sources AS (SELECT * FROM direct UNION ALL SELECT * FROM derived_sources),
first_call AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rn FROM sink_calls) a WHERE rn = 1),
flows AS (
  SELECT sample_id, called, var, type,
         CASE WHEN NOT hit THEN 'co_present' WHEN starts_with(type, 'cross_function:') THEN 'one_hop' ELSE 'direct' END AS kind
  FROM (
    SELECT c.sample_id, c.called, s.var, s.type, list_contains(c.idents, s.var) AS hit,
           row_number() OVER (PARTITION BY c.sample_id ORDER BY CASE WHEN list_contains(c.idents, s.var) THEN 0 ELSE 1 END, s.kind, s.ord) AS rn
    FROM first_call c JOIN all_sources s ON s.sample_id = c.sample_id) a
  WHERE rn = 1)"""

_RELEVANT = {c: v + rb.EXTRA_RELEVANT.get(c, []) for c, v in rb.STRONG_SIGNALS.items()}


def category_lists(table: dict[str, list[str]], key: str) -> str:
    whens = " ".join(f"WHEN {lit(c)} THEN {str_list(v)}" for c, v in table.items())
    return f"CASE {key} {whens} ELSE [] END"


def _down(risk: str) -> str:
    return f"CASE {risk} WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE {risk} END"


SLICES = f"""
labelled AS (
  SELECT p.sample_id, p.row_ord, p.user_id, p.file, p.language, p.code, p.label, p.fn_name, k.sink_type,
         coalesce(k.sink_category, 'generic') AS sink_category,
         CASE WHEN k.sink_type IS NULL THEN [] ELSE {sanitizer_list("p.code", "p.language")} END AS sanitizers,
         f.called, f.var, f.type, f.kind
  FROM parsed p LEFT JOIN picked k ON k.sample_id = p.sample_id LEFT JOIN flows f ON f.sample_id = p.sample_id),
weighed AS (
  SELECT *, {case_map(rb.RISK, "sink_category", "'medium'")} AS base_risk,
         len(list_filter(sanitizers, lambda x: list_contains({category_lists(_RELEVANT, "sink_category")}, x))) AS n_relevant,
         list_has_any(sanitizers, {category_lists(rb.STRONG_SIGNALS, "sink_category")}) AS has_strong,
         (called IS NOT NULL) AS has_flow
  FROM labelled),
slices AS (
  SELECT *,
         CASE WHEN sink_type IS NULL THEN 'medium'
              WHEN has_strong OR n_relevant >= 2 THEN 'low'
              WHEN NOT has_flow AND NOT list_contains({str_list(rb.SELF_CONTAINED)}, sink_category)
                THEN CASE WHEN n_relevant = 1 THEN {_down("(" + _down("base_risk") + ")")} ELSE {_down("base_risk")} END
              WHEN n_relevant = 1 THEN {_down("base_risk")} ELSE base_risk END AS risk_level,
         CASE WHEN sink_type IS NOT NULL AND has_flow THEN var ELSE '' END AS source_var,
         CASE WHEN sink_type IS NOT NULL AND has_flow THEN type ELSE 'unknown' END AS source_type,
         CASE WHEN sink_type IS NULL THEN '' WHEN has_flow THEN var || ' (' || type || ') → ' || called
              ELSE '? → ' || sink_type END AS dataflow_path,
         CASE WHEN sink_type IS NOT NULL AND has_flow THEN kind ELSE 'none' END AS flow_kind,
         CASE WHEN sink_type IS NULL THEN 0.0::DOUBLE WHEN NOT has_flow THEN 0.3::DOUBLE
              ELSE round(0.7::DOUBLE + CASE WHEN var <> 'unknown_var' THEN 0.15::DOUBLE ELSE 0 END
                         - CASE WHEN len(sanitizers) > 0 THEN 0.2::DOUBLE ELSE 0 END, 2) END AS ast_confidence
  FROM weighed)"""

SCAN = f"WITH {SYNTAX}, {SINK_CALLS}, {FLOW}, {SLICES}"
