"""Findings of several tools, consensus, blind spots, code windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog import derived, sqltext as sq
from auditlake.catalog.registry import query, table
from auditlake.catalog.scan_queries import code, slices
from auditlake.functions import rulebook as rb
from auditlake.session import cut_lineage
from auditlake.operators import extract, findings as fo, windows
from auditlake.sources import readers

_F = derived.cte(derived.FINDINGS)


def finding_rows(spark, sf):
    return derived.derive(spark, sf, derived.FINDINGS)


# --- scanner reports ------------------------------------------------------------


@query(
    "sarif_findings",
    f"""
WITH d AS (SELECT json(doc) AS j FROM {derived.cte(derived.SARIF)} s),
r AS (SELECT unnest(CAST(j->'$.runs[0].results' AS JSON[])) AS r FROM d),
l AS (SELECT r, unnest(CAST(r->'$.locations' AS JSON[])) AS loc FROM r)
SELECT coalesce(loc->>'$.physicalLocation.artifactLocation.uri', '') AS uri, 'codeql' AS tool, r->>'$.ruleId' AS type,
       greatest(1, coalesce(nullif(CAST(loc->>'$.physicalLocation.region.startLine' AS INT), 0), 1) - 8) AS line,
       CAST(loc->>'$.physicalLocation.region.startColumn' AS INT) AS "column",
       r->>'$.level' AS severity, substr(r->>'$.message.text', 1, 200) AS message
FROM l""",
)
def sarif_findings(spark, sf):
    return readers.scanner_texts(derived.derive(spark, sf, derived.SARIF), "doc", "sarif")


_TWO_TOOLS = f"""
WITH s AS (SELECT unnest(CAST(json(doc)->'$.results' AS JSON[])) AS r FROM {derived.cte(derived.SEMGREP)} x),
b AS (SELECT unnest(CAST(json(doc)->'$.results' AS JSON[])) AS r FROM {derived.cte(derived.BANDIT)} x),
u AS (
  SELECT 'semgrep' AS tool, r->>'$.path' AS uri, r->>'$.check_id' AS type, CAST(r->>'$.start.line' AS INT) AS line,
         coalesce(r->>'$.extra.severity', 'WARNING') AS severity, r->>'$.extra.message' AS message, NULL AS confidence FROM s
  UNION ALL
  SELECT 'bandit', r->>'$.filename', r->>'$.test_id', CAST(r->>'$.line_number' AS INT), coalesce(r->>'$.issue_severity', 'medium'),
         r->>'$.issue_text', coalesce(r->>'$.issue_confidence', 'medium') FROM b)
SELECT tool, uri, type, severity, confidence, count(*) AS n, min(line) AS first_line, max(message) AS last_message FROM u GROUP BY ALL"""


@query("scanner_union", _TWO_TOOLS)
def scanner_union(spark, sf):
    s = readers.scanner_texts(derived.derive(spark, sf, derived.SEMGREP), "doc", "semgrep")
    b = readers.scanner_texts(derived.derive(spark, sf, derived.BANDIT), "doc", "bandit")
    return fo.unify(s, b).groupBy("tool", "uri", "type", "severity", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("message").alias("last_message")
    )


_NAMED = f"""
SELECT sample_id, 'fn_' || substr(md5(CASE WHEN language = 'c' THEN {" || chr(10) || ".join(sq.lit(x) for x in rb.C_WRAPPER.split(chr(10)))} || code ELSE trim(code) END), 1, 12)
       || CASE language WHEN 'c' THEN '.c' WHEN 'python' THEN '.py' ELSE '.txt' END AS uri, row_ord FROM {derived.cte(derived.CODE)} c"""


@query(
    "findings_by_content",
    f"""
WITH named AS ({_NAMED}),
reported AS (SELECT uri, 'rule' || (min(row_ord) % 7) AS rule, count(*) AS copies FROM named GROUP BY uri HAVING min(row_ord) % 2 = 0)
SELECT n.sample_id, n.uri, r.rule, r.copies FROM named n LEFT JOIN reported r ON r.uri = n.uri""",
)
def findings_by_content(spark, sf):
    """Tool output keyed by content name, back on every copy of the code."""
    samples = code(spark, sf)
    named = samples.select(extract.wrapped_name(F.col("code"), F.col("language")).alias("uri"), "row_ord")
    reported = named.groupBy("uri").agg(F.min("row_ord").alias("m"), F.count(F.lit(1)).alias("copies"))
    reported = reported.filter(F.col("m") % 2 == 0).select(
        F.concat(F.lit("work/"), "uri").alias("uri"), F.concat(F.lit("rule"), F.col("m") % 7).alias("rule"), "copies"
    )
    return fo.attach_by_content(samples, reported).select("sample_id", "uri", "rule", "copies")


# --- consensus and coverage ---------------------------------------------------

_CONSENSUS = f"""
f AS {_F},
per_type AS (SELECT sample_id, type, count(*) AS n, count(DISTINCT tool) AS tools FROM f GROUP BY ALL),
per_sample AS (SELECT sample_id, count(*) AS finding_count, count(DISTINCT tool) AS tool_count, count(DISTINCT type) AS type_count,
                      string_agg(DISTINCT type, ', ' ORDER BY type) AS types, list_sort(list_distinct(list(tool))) AS tools,
                      list_distinct(list(type)) AS type_list FROM f GROUP BY sample_id),
modal AS (SELECT sample_id, type FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, type) AS rn FROM per_type) x WHERE rn = 1),
cross_tool AS (SELECT sample_id, bool_or(tools >= 2) AS cross_tool FROM per_type GROUP BY sample_id),
con AS (
  SELECT s.sample_id, finding_count, tool_count, tools, type_list, c.cross_tool,
         CASE WHEN tool_count >= 2 AND type_count < finding_count THEN 'high' WHEN tool_count = 1 AND finding_count >= 2 THEN 'medium'
              WHEN tool_count >= 2 THEN 'conflict' ELSE 'low' END AS level, m.type AS modal, types
  FROM per_sample s JOIN modal m ON m.sample_id = s.sample_id JOIN cross_tool c ON c.sample_id = s.sample_id)"""


@query(
    "tool_consensus",
    f"""WITH {_CONSENSUS}
SELECT sample_id, finding_count, tool_count, level, cross_tool, CASE WHEN level <> 'conflict' THEN modal END AS agreed_area,
       CASE level WHEN 'high' THEN tool_count || ' tools agree on sink area' WHEN 'medium' THEN 'single tool with multiple findings'
            WHEN 'conflict' THEN 'tools disagree: ' || types ELSE 'single finding or weak signal' END AS detail
FROM con""",
)
def tool_consensus(spark, sf):
    return fo.consensus(finding_rows(spark, sf)).select(
        "sample_id", "finding_count", "tool_count", "level", "cross_tool", "agreed_area", "detail"
    )


def _map_list(table: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"{sq.lit(k)}: {sq.str_list(v)}" for k, v in table.items()) + "}"


@query(
    "blind_spots",
    f"""WITH {_CONSENSUS},
cov AS (SELECT * FROM {sq.values([(t, c) for t, v in rb.TOOL_COVERS.items() for c in v])} AS c(tool, class)),
gaps AS (SELECT * FROM {sq.values([('', i, c) for i, c in enumerate(rb.UNIVERSAL_BLIND_SPOTS)] + [(t, 100 + i, c) for t, v in rb.TOOL_BLIND_SPOTS.items() for i, c in enumerate(v)])} AS g(tool, ord, class)),
ran AS (SELECT sample_id, unnest(tools) AS tool FROM con),
covered AS (SELECT r.sample_id, c.class FROM ran r JOIN cov c ON c.tool = r.tool UNION SELECT sample_id, unnest(type_list) FROM con),
wanted AS (SELECT sample_id, class, min(rank) AS rank FROM (
   SELECT c.sample_id, g.class, g.ord + CASE WHEN g.tool = '' THEN 0 ELSE 1000 * list_position(c.tools, g.tool) END AS rank
   FROM con c JOIN gaps g ON g.tool = '' OR list_contains(c.tools, g.tool)) x GROUP BY sample_id, class)
SELECT w.sample_id, string_agg(w.class, ', ' ORDER BY w.rank) AS blind_spots, count(*) AS n FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.sample_id = w.sample_id AND c.class = w.class) GROUP BY w.sample_id""",
)
def blind_spots(spark, sf):
    con = fo.consensus(finding_rows(spark, sf))
    spots = con.select("sample_id", fo.blind_spots(F.col("tools"), F.col("types")).alias("b")).filter(F.size("b") > 0)
    return spots.select("sample_id", F.array_join("b", ", ").alias("blind_spots"), F.size("b").alias("n"))


# External findings about the scanned functions themselves: one per function
# whose label is set, from the tool expected for its language.
_EXTERNAL_SQL = """
ext AS (SELECT sample_id, CASE language WHEN 'c' THEN 'codeql' ELSE 'semgrep' END AS tool, 'path_traversal' AS type FROM slices WHERE label
        UNION ALL SELECT sample_id, 'semgrep', sink_category FROM slices WHERE label AND language = 'python')"""


@query(
    "tool_report",
    sq.SCAN + f""", {_EXTERNAL_SQL},
everything AS (SELECT sample_id, 'codeslicer' AS tool, sink_category AS type FROM slices WHERE sink_type IS NOT NULL UNION ALL SELECT * FROM ext),
per AS (SELECT sample_id, count(*) AS n, count(DISTINCT tool) AS t, count(DISTINCT type) AS k, list_sort(list_distinct(list(tool))) AS tools,
               list_distinct(list(type)) AS types FROM everything GROUP BY sample_id),
rep AS (SELECT s.sample_id, s.language, s.sink_type, coalesce(p.n, 0) AS n, coalesce(p.t, 0) AS t, coalesce(p.k, 0) AS k, coalesce(p.types, []) AS types,
               list_distinct(['codeslicer'] || coalesce(p.tools, [])) AS run0 FROM slices s LEFT JOIN per p ON p.sample_id = s.sample_id),
ran AS (SELECT *, ['codeslicer'] || list_sort(list_filter(run0, lambda x: x <> 'codeslicer')) AS tools_run FROM rep)
SELECT sample_id, language, array_to_string(tools_run, ',') AS tools_run,
       CASE WHEN language = 'c' AND NOT list_contains(tools_run, 'codeql') THEN 'codeql (not run)'
            WHEN language = 'python' AND NOT list_contains(tools_run, 'semgrep') THEN 'semgrep (not run)' ELSE '' END AS tools_failed,
       n AS finding_count,
       CASE WHEN n = 0 THEN 'no_signal' WHEN t >= 2 AND k < n THEN 'high' WHEN t = 1 AND n >= 2 THEN 'medium' WHEN t >= 2 THEN 'conflict' ELSE 'low' END AS level,
       len(list_filter({sq.str_list(rb.UNIVERSAL_BLIND_SPOTS)}, lambda b: NOT list_contains(types, b)
           AND NOT list_contains(flatten(list_transform(tools_run, lambda r: {_map_list(rb.TOOL_COVERS)}[r])), b))) AS universal_gaps
FROM ran""",
)
def tool_report(spark, sf):
    s = cut_lineage(slices(spark, sf))  # scanned once, read for the reports and for the external findings
    tool = F.when(F.col("language") == "c", "codeql").otherwise("semgrep")
    reported = F.array_compact(
        F.array(
            F.struct(tool.alias("tool"), F.lit("path_traversal").alias("type")),
            F.when(F.col("language") == "python", F.struct(F.lit("semgrep").alias("tool"), F.col("sink_category").alias("type"))),
        )
    )
    ext = s.filter("label").select("sample_id", F.explode(reported).alias("f")).select("sample_id", "f.*")
    r = fo.tool_reports(s, ext)
    gaps = F.size(F.array_intersect("blind_spots", F.array(*[F.lit(x) for x in rb.UNIVERSAL_BLIND_SPOTS])))
    return r.select(
        "sample_id", "language", F.array_join("tools_run", ",").alias("tools_run"), F.array_join("tools_failed", ",").alias("tools_failed"),
        "finding_count", F.col("consensus.level").alias("level"), gaps.alias("universal_gaps"),
    )


@query(
    "findings_text",
    f"""
SELECT sample_id, string_agg(t || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END, chr(10) ORDER BY line, tool, type, t) AS findings_summary
FROM (SELECT sample_id, line, tool, type, '  [' || tool || '] ' || type || ' @ line ' || line || ': ' || substr(message, 1, 120) AS t, count(*) AS n
      FROM {_F} f GROUP BY ALL) x GROUP BY sample_id""",
)
def findings_text(spark, sf):
    return fo.findings_text(finding_rows(spark, sf), most_lines=100_000)


@query(
    "findings_blocks",
    f"""
WITH l AS (SELECT sample_id, line, tool, type, '  [' || tool || '] ' || type || ' @ line ' || line || ': ' || substr(message, 1, 120) AS t, count(*) AS n FROM {_F} f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line, tool, type, t) - 1 AS place FROM l)
SELECT sample_id, place // 2 AS block, string_agg(t || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END, chr(10) ORDER BY place) AS findings_summary
FROM r GROUP BY sample_id, place // 2""",
)
def findings_blocks(spark, sf):
    """All lines in rows of two, so that most samples have several blocks."""
    return fo.findings_blocks(finding_rows(spark, sf), lines=2)


@query(
    "merge_nearby_findings",
    f"""
WITH d AS (SELECT sample_id, type AS cwe, line, count(*) AS n FROM {_F} f GROUP BY ALL),
m AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY sample_id, cwe ORDER BY line) <= 2 THEN 0 ELSE 1 END AS fresh FROM d),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY sample_id, cwe ORDER BY line ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT sample_id, cwe, min(line) AS line_from, max(line) AS line_to, CAST(sum(n) AS BIGINT) AS finding_count FROM g GROUP BY sample_id, cwe, grp""",
)
def merge_nearby_findings(spark, sf):
    return fo.merge_nearby(finding_rows(spark, sf).withColumnRenamed("type", "cwe"))


# --- windows --------------------------------------------------------------------
# Documents are the text, their orders' finding lines the focus.

_FOCUS = f"""
focus AS (SELECT CAST(sample_id AS BIGINT) AS doc_id, line, tool FROM {_F} f),
tools AS (SELECT doc_id, count(DISTINCT tool) AS tool_count FROM focus GROUP BY doc_id),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
foci AS (SELECT DISTINCT doc_id, line AS fl FROM focus WHERE line > 0),
wanted AS (SELECT l.doc_id, f.fl, unnest(range(greatest(0, f.fl - 1 - 5), least(len(l.ls), f.fl + 5))) AS i, l.ls
           FROM lines l JOIN foci f ON f.doc_id = l.doc_id),
owned AS (SELECT doc_id, i, min(fl) AS fl, any_value(ls) AS ls FROM wanted GROUP BY doc_id, i),
parts AS (SELECT doc_id, fl, 0 AS k, i, ls[i + 1] AS t FROM owned
          UNION ALL SELECT f.doc_id, f.fl, 1, 0, '# --- focus line ' || f.fl || ' ---' FROM foci f JOIN lines l ON l.doc_id = f.doc_id),
joined AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY fl, k, i) AS w FROM parts GROUP BY doc_id),
narrow AS (SELECT l.doc_id, CASE WHEN j.w IS NULL THEN substr(l.text, 1, 2000) WHEN length(j.w) > 3000 THEN substr(j.w, 1, 3000) || chr(10) || '# ... (truncated)'
                  ELSE j.w END AS w FROM lines l LEFT JOIN joined j ON j.doc_id = l.doc_id)"""


def _documents_with_focus(spark, sf, max_chars=3000):
    focus = windows.focus_lines(finding_rows(spark, sf), max_chars=max_chars).withColumn("doc_id", F.col("sample_id").cast("bigint")).drop("sample_id")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    return docs.join(focus, "doc_id", "left")


@query("focus_windows", f"WITH {_FOCUS} SELECT doc_id, w AS code_window, length(w) AS chars FROM narrow")
def focus_windows(spark, sf):
    df = windows.code_window(_documents_with_focus(spark, sf), {"mode": "iris"})
    return df.select("doc_id", "code_window", F.length("code_window").alias("chars"))


@query("focus_windows_wide", f"WITH {_FOCUS.replace('3000', '700')} SELECT doc_id, w AS code_window, length(w) AS chars FROM narrow")
def focus_windows_wide(spark, sf):
    """A preset with another window size."""
    df = windows.code_window(_documents_with_focus(spark, sf, 700), {"mode": "iris", "iris_max_chars": 700})
    return df.select("doc_id", "code_window", F.length("code_window").alias("chars"))


@query(
    "dynamic_window",
    f"""WITH {_FOCUS}
SELECT l.doc_id, coalesce(t.tool_count, 0) AS tool_count,
       md5(CASE WHEN t.tool_count >= 2 THEN n.w WHEN t.tool_count = 1 THEN substr(l.text, 1, 3000) ELSE l.text END) AS window_md5
FROM lines l LEFT JOIN tools t ON t.doc_id = l.doc_id JOIN narrow n ON n.doc_id = l.doc_id""",
)
def dynamic_window(spark, sf):
    df = windows.code_window(_documents_with_focus(spark, sf), {"mode": "dynamic"})
    return df.select("doc_id", F.coalesce("tool_count", F.lit(0)).alias("tool_count"), F.md5("code_window").alias("window_md5"))


@query(
    "requested_window",
    sq.SCAN + """,
w AS (SELECT sample_id, sink_type, code, 1 + row_ord % 6 AS ln, CASE WHEN user_id % 2 = 0 THEN 'iris' ELSE 'medium' END AS s, string_split(code, chr(10)) AS ls FROM slices)
SELECT sample_id, CASE WHEN s = 'iris' AND sink_type IS NOT NULL THEN array_to_string(ls[greatest(0, ln - 1 - 1) + 1 : least(len(ls), ln + 1)], chr(10)) ELSE code END AS code_window
FROM w""",
)
def requested_window(spark, sf):
    df = slices(spark, sf)
    suggestion = F.when(F.col("user_id") % 2 == 0, "iris").otherwise("medium")
    return df.select(
        "sample_id",
        windows.requested_window(
            F.col("code"), suggestion, F.col("sink_type"), (1 + F.col("row_ord") % 6).cast("int"), lines=1
        ).alias("code_window"),
    )


@query(
    "highlight_lines",
    """
SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN l_linenumber % 2 = 0 THEN range(l_linenumber, CAST(l_quantity AS INT) + 1)
       ELSE [l_linenumber, 99, CAST(l_quantity AS INT)] END, ',') AS lines FROM lineitem""",
)
def highlight_lines(spark, sf):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    given = F.when(n % 2 == 0, F.array(n, q)).otherwise(F.array(n, F.lit(99), q))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(windows.highlight(given), ",").alias("lines")
    )
