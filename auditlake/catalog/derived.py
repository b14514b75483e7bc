"""Audit tables derived row by row from the given tables.

The given tables hold no source code, findings or model answers, so each is
derived by a projection: one event becomes one function, one line item one
finding, and so on.  The projection is SQL text that both engines run, with
``{table}`` standing for a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from auditlake.catalog.registry import table
from auditlake.session import spread

_SPECIAL = {"\n": "chr(10)", "{": "chr(123)", "}": "chr(125)", "'": "chr(39)", "\\": "chr(92)"}


def text(value: str) -> str:
    """SQL expression of a text literal (special characters by code)."""
    parts = []
    for piece in re.split(r"([\n{}'\\])", value):
        if piece in _SPECIAL:
            parts.append(_SPECIAL[piece])
        elif piece:
            parts.append(f"'{piece}'")
    return "(" + (" || ".join(parts) or "''") + ")"


def choose(selector: str, options: list[str]) -> str:
    """Text chosen by ``selector`` (an integer expression) modulo the options."""
    whens = " ".join(f"WHEN {i} THEN {text(o)}" for i, o in enumerate(options[:-1]))
    return f"CASE ({selector}) % {len(options)} {whens} ELSE {text(options[-1])} END"


# ---------------------------------------------------------------- functions --
_C = [
    ("s", ["// strcpy(old, input) was here\n", "", "/* system(input)\n   free(x) */\n", ""]),
    (None, "static int fn_@(char *input, int n) {\n  char buf[64];\n"),
    ("s", ["", '  char *s1 = getenv("HOME");\n', "  char *s1 = recv(n);\n", "  use(argv, n);\n"]),
    ("h", ["  char *t = pack_copy(input, n);\n", "  char *t = trim_copy(s1);\n", "  char *t = zero();\n"]),
    ("g", [
        "", "  if (strlen(input) < sizeof(buf)) n = 1;\n", "  if (n > 10) return 0;\n",
        "  if (input == NULL) { return 0; }\n", '  log_note("system(x) is only text");\n',
    ]),
    ("b", [
        "  strcpy(buf, t);\n", "  system(t);\n", "  printf(t);\n", '  printf("%s", t);\n',
        "  t = malloc(n * n);\n  for (i = 0; i <= n; i++) buf[n + 1] = 0;\n", "  memcpy(buf, input, sizeof(buf));\n",
        "  free(t); t = NULL;\n", "  helper(t);\n", "  if (access(t, 0)) { fopen(t, mode(n)); }\n",
    ]),
    (None, "  return 0;\n}"),
]
_PY = [
    (None, "def fn_@(data, n):\n"),
    ("s", ['    """eval(data) in a docstring"""\n', "", "    # os.system(data)\n", ""]),
    ("s", ["", '    s1 = input("x")\n', "    s1 = request.args\n", "    s1 = os.environ\n"]),
    ("h", ["    t = merge(data, n)\n", "    t = clean(s1)\n", "    t = n\n"]),
    ("g", [
        "", "    data = data.strip()\n", "    if data in allowed: n = 1\n", "    x = int(n)\n", "    t = shlex.quote(t)\n",
    ]),
    ("b", [
        "    os.system(t)\n", "    eval(t)\n", "    pickle.loads(t)\n", "    cursor.execute(t)\n",
        "    cursor.execute(sql, (t,))\n", "    open(t)\n", "    json.loads(t)\n", "    requests.get(t)\n",
        "    subprocess.run([t])\n",
    ]),
    (None, "    return t"),
]
_JAVA = [
    ("s", ["@Override\n", "", "// readObject(data)\n", ""]),
    (None, "public String fn_@(String data, int n) {\n"),
    ("s", [
        "", '  String s1 = request.getParameter("q");\n', '  String s1 = System.getenv("P");\n', '  log("out.println(x)");\n',
    ]),
    ("h", ["  String t = wrap(data, n);\n", "  String t = tidy(s1);\n", "  String t = blank();\n"]),
    ("g", [
        "", "  PreparedStatement ps = none(n);\n", "  if (data != null && n > 1) n = 2;\n",
        "  try { check(n); } catch (Exception e) { n = 0; }\n", "  t = helper.escapeHtml(t);\n",
    ]),
    ("b", [
        "  new ProcessBuilder(t);\n", "  Statement.executeQuery(t);\n", "  out.println(t);\n", "  readObject(t);\n",
        "  Paths.get(t);\n", "  XMLReader.parse(t);\n", "  helper(t);\n", "  URL.openStream(t);\n", "  new File(t);\n",
    ]),
    (None, "  return t;\n}"),
]


def _function(parts: list) -> str:
    out = []
    for selector, value in parts:
        if selector is None:
            before, _, after = value.partition("@")
            out.append(text(before) + (f" || CAST(user_id AS VARCHAR(20)) || {text(after)}" if "@" in value else ""))
        else:
            out.append(choose(selector, value))
    return " || ".join(out)


CODE = f"""
SELECT sample_id, row_ord, user_id, file, language,
       CASE language WHEN 'c' THEN {_function(_C)} WHEN 'python' THEN {_function(_PY)} ELSE {_function(_JAVA)} END AS code,
       label, event_type
FROM (
  SELECT concat('e', event_id) AS sample_id, event_id AS row_ord, user_id, event_type,
         CASE event_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'python' ELSE 'java' END AS language,
         concat('src', chr(92), 'm', user_id % 20, '/', event_type,
                CASE event_id % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.py' ELSE '.java' END) AS file,
         CAST(floor(event_id / 3) AS BIGINT) AS b, user_id AS s,
         CAST(floor(value * 10) AS BIGINT) AS g, CAST(floor(value) AS BIGINT) AS h,
         (CAST(floor(value * 100) AS BIGINT) % 10 < 4) AS label
  FROM {{events}}
) e
"""

# Calls nested 0 to 9 deep, a function pointer and a generic type among the parameters.
DEEP_CODE = f"""
SELECT concat('deep', event_id) AS sample_id, CASE event_id % 2 WHEN 0 THEN 'c' ELSE 'java' END AS language, event_id % 10 AS k,
       CASE event_id % 2 WHEN 0 THEN {text('void deep(char *q, void (*cb)(int, char), int n) {') } || chr(10) || '  system('
            ELSE {text('void deep(Map<String, List<Integer>> m, String q) {')} || chr(10) || '  readObject(' END
       || repeat('w(', CAST(event_id % 10 AS INT)) || 'q' || repeat(')', CAST(event_id % 10 AS INT)) || ');' || chr(10) || chr(125) AS code
FROM {{events}}
"""

# -------------------------------------------------------------- whole files --
# One function between a class, an old-style definition, a decorator, module code.
_AROUND = {
    "python": ("import os\n\nclass K:\n    @wrap(\n        1)\n    def method(self, q):\n        os.system(q)\n\n", "\n\nos.system(X)\n"),
    "java": ("class A {\n  void run(String d) {\n    readObject(d);\n  }\n", "\n}\n"),
    "c": ("#include <a.h>\nint old(a, b)\n  char *a; int b;\n{\n  return strcpy(a, b);\n}\n", "\nint last = 1;\n"),
}
FILES = f"""
SELECT concat(file, '/', row_ord) AS file, language, code,
       CASE language {" ".join(f"WHEN '{k}' THEN {text(a)} || code || {text(b)}" for k, (a, b) in _AROUND.items())} END AS content
FROM ({CODE}) c0
"""

# ----------------------------------------------------------------- findings --
FINDINGS = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS sample_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'codeslicer' WHEN 1 THEN 'codeql' ELSE 'semgrep' END AS tool,
       CASE l_partkey % 8 WHEN 0 THEN 'buffer_overflow' WHEN 1 THEN 'command_injection' WHEN 2 THEN 'xss'
            WHEN 3 THEN 'logic_flaws' WHEN 4 THEN 'resource_leak' WHEN 5 THEN 'use_after_free'
            WHEN 6 THEN 'TOCTOU' ELSE 'sql_injection' END AS type,
       CAST((l_linenumber * 7 + CAST(l_quantity AS INT)) % 60 AS INT) AS line,
       CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'R' THEN 'warning' ELSE 'note' END AS severity,
       concat('issue ', l_partkey % 5, ' in part ', l_partkey) AS message
FROM {lineitem}
"""

# -------------------------------------------------------------------- votes --
# One line item is one reviewer's answer on a sample (the order).
VOTES = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS sample_id, l_linenumber AS turn,
       CASE l_linenumber % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'adversarial' ELSE 'cot' END AS reviewer,
       CAST(CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 7 END AS DOUBLE) / 10 AS temperature,
       (l_returnflag <> 'N') AS has_vulnerability,
       CASE l_returnflag WHEN 'A' THEN 'vulnerable' WHEN 'R' THEN 'safe' ELSE 'unclear' END AS verdict,
       CASE l_returnflag WHEN 'A' THEN 'confirmed_vuln' WHEN 'R' THEN 'false_positive' ELSE 'uncertain' END AS review,
       CAST(CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 10 AS confidence
FROM {lineitem}
"""

# ----------------------------------------------------- answers of all stages --
# Reviewer 2 and 3 answers per sample; some samples lack one or the other.
STAGE_ANSWERS = """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS sample_id,
       CASE l_linenumber % 2 WHEN 1 THEN 'r2' ELSE 'r3' END AS stage,
       CASE l_returnflag WHEN 'A' THEN 'confirmed_vuln' WHEN 'R' THEN 'false_positive' ELSE 'undecided' END AS verdict,
       CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS has_vulnerability,
       CAST(CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 10 AS confidence,
       CASE l_partkey % 5 WHEN 0 THEN 'copies input outside the window' WHEN 1 THEN 'this might be a problem'
            WHEN 2 THEN 'short' WHEN 3 THEN 'a concrete overflow that could be reached' ELSE '' END AS reasoning,
       CASE l_partkey % 4 WHEN 0 THEN 'CWE-120' WHEN 1 THEN 'CWE-78' ELSE '' END AS cwe
FROM {lineitem}
"""

RESULTS = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS sample_id,
       CASE WHEN o_orderstatus = 'F' THEN 'vuln' ELSE 'safe' END AS final_verdict,
       CASE o_custkey % 4 WHEN 0 THEN 'llm_full_pipeline' WHEN 1 THEN 'tool_aware_a1_screened'
            WHEN 2 THEN 'static_deterministic' ELSE 'llm_agent2_uncertain' END AS final_method,
       CAST(o_custkey % 101 AS DOUBLE) / 100 AS final_confidence,
       CASE o_orderkey % 6 WHEN 0 THEN 'this might be a problem' WHEN 1 THEN 'short' WHEN 2 THEN ''
            WHEN 3 THEN 'a concrete copy without any bound that could be reached from outside'
            WHEN 4 THEN 'maybe' ELSE 'possibly reachable, see the loop over the header fields in detail' END AS reasoning,
       CAST(o_custkey % 4 AS INT) AS pattern_count
FROM {orders}
"""

# ---------------------------------------------------------------- responses --
_JSON = (
    text('{"has_vulnerability": ') + " || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || "
    + text(', "vulnerability_type": "') + " || event_type || " + text('", "confidence": ')
    + " || CAST(event_id % 13 AS VARCHAR(4)) || '.' || CAST(event_id % 10 AS VARCHAR(4)) || "
    + text(', "line_numbers": [') + " || CAST(user_id AS VARCHAR(20)) || "
    + text(', "7", "x"], "reasoning": "seen ') + " || event_type || " + text('"}')
)
_STRAY = (
    text('{"has_vulnerability": true, "confidence": 0.') + " || CAST(event_id % 10 AS VARCHAR(4)) || "
    + text('","vulnerability_type": "') + " || event_type || " + text('"}')
)
_CUT = (
    text('{"has_vulnerability": true, "confidence": 0.5, "vulnerability_type": "') + " || event_type || "
    + text('", "reasoning": "the text stops he')
)
_DEEP_CUT = (
    text('{"has_vulnerability": true, "found": [{"at": {"lines": [1, {"text": "}, ] ,{"}]}}, []], "confidence": 0.5, "vulnerability_type": "') + " || event_type || "
    + text('", "more": {"a": [1, {"b": "x", "c": ')
)
RESPONSES = f"""
SELECT concat('e', event_id) AS sample_id, event_id, event_type, user_id,
  CASE event_id % 9
    WHEN 0 THEN {_JSON}
    WHEN 1 THEN {text("Here you are:" + chr(10) + "```json" + chr(10))} || {_JSON} || {text(chr(10) + "```" + chr(10) + "done")}
    WHEN 2 THEN {text("<think>maybe {not} json</think>" + chr(10))} || {_JSON}
    WHEN 3 THEN {text("My answer is ")} || {_JSON} || {text(" as asked")}
    WHEN 4 THEN {_STRAY}
    WHEN 5 THEN CASE WHEN event_id % 2 = 0 THEN {_CUT} ELSE {_DEEP_CUT} END
    WHEN 6 THEN {text("I could not decide about this function.")}
    WHEN 7 THEN {text("<think>never closed ")} || {_JSON}
    ELSE {text("Response" + chr(10))} || {_JSON}
  END AS raw
FROM {{events}}
"""

# ------------------------------------------------------- dependencies, feeds --
DEPENDENCIES = """
SELECT concat('proj', l_orderkey) AS project, 'requirements.txt' AS manifest,
       concat('pkg', CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_partkey END) AS name,
       CASE WHEN l_linenumber = 7 THEN concat(l_linenumber, CASE WHEN l_suppkey % 3 = 2 THEN '.0-local' ELSE concat('.0rc', l_suppkey % 3) END)
            ELSE concat(l_linenumber, '.', CAST(l_quantity AS INT) % 12, CASE WHEN l_suppkey % 2 = 0 THEN '.0' ELSE '' END) END AS version,
       CASE WHEN CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_partkey END % 4 = 0 THEN 'Maven' ELSE 'PyPI' END AS ecosystem
FROM {lineitem}
"""

_FIXED = "CAST(p_size % 3 + 2 AS VARCHAR(4)) || '.' || CAST(p_size % 12 AS VARCHAR(4))"
_FIX_EVENT = f"""{text('{"fixed": "')} || CASE p_size % 4 WHEN 2 THEN 'v' ELSE '' END || {_FIXED} || CASE p_size % 4 WHEN 2 THEN 'rc1' WHEN 3 THEN '.post-x' ELSE '' END || {text('"}')}"""
_FROM_EVENT = f"""{text('{"introduced": "')} || CAST(p_size % 3 AS VARCHAR(4)) || '.0' || {text('"}')}"""
_AGAIN_EVENT = text('{"introduced": "5.10"}')
# Events out of order, bounds with v and rc, bounds that can't be compared, and a range of commits.
_RANGE = (
    f"CASE WHEN p_size % 4 = 1 THEN {_FIX_EVENT} || ', ' || {_AGAIN_EVENT} || ', ' || {_FROM_EVENT} ELSE {_FROM_EVENT} || ', ' || {_FIX_EVENT} || ', ' || {_AGAIN_EVENT} END"
)
_COMMITS = text(']}, {"type": "GIT", "events": [{"introduced": "0"}')
ADVISORIES = f"""
SELECT p_partkey AS row_ord,
  {text('{"id": "ADV-')} || CAST(p_partkey AS VARCHAR(20)) || {text('", "aliases": [')}
  || CASE WHEN p_size % 2 = 0 THEN {text('"CVE-2024-')} || CAST(p_partkey AS VARCHAR(20)) || {text('"')} ELSE '' END
  || {text('], "summary": "')} || p_name || {text('", "severity": [{"type": "CVSS_V2", "score": "1"}, {"type": "CVSS_V3", "score": "')}
  || CAST(p_size % 10 AS VARCHAR(4)) || {text('"}], ')}
  || CASE WHEN p_size % 5 = 0 THEN '' ELSE {text('"database_specific": {"severity": "')} || p_type || {text('"}, ')} END
  || {text('"affected": [{"package": {"name": "pkg')} || CAST(p_partkey AS VARCHAR(20)) || {text('", "ecosystem": "')}
  || CASE WHEN p_partkey % 4 = 0 THEN 'Maven' ELSE 'PyPI' END || {text('"}, "ranges": [{"type": "ECOSYSTEM", "events": [')}
  || {_RANGE} || {_COMMITS} || {text(']}], "versions": ["')} || CASE WHEN p_size % 2 = 0 THEN '7.0rc1' ELSE 'v7.0.0-rc1' END || {text('"]}], "references": [{"url": "https://example.org/')}
  || CAST(p_partkey AS VARCHAR(20)) || {text('"}]}')} AS doc
FROM {{part}}
"""

EXPLOITED = f"""
SELECT {text('{"vulnerabilities": [{"cveID": "')} || CASE WHEN p_size % 10 = 0 THEN '' ELSE 'CVE-2023-' || CAST(p_partkey AS VARCHAR(20)) END
  || {text('", "vendorProject": "')} || p_brand || {text('", "product": "')} || p_name
  || {text('", "shortDescription": "flaw in ')} || p_name || {text('", "cwes": [')}
  || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN {text('"CWE-78"')} WHEN 2 THEN {text('"CWE-79", "CWE-22"')} ELSE {text('"CWE-1"')} END
  || {text('], "dateAdded": "2024-01-')} || CAST(10 + p_size % 20 AS VARCHAR(4)) || {text('", "dueDate": "2024-03-01", "notes": "')}
  || CASE WHEN p_size % 3 = 0 THEN 'see vendor' ELSE '' END || {text('"}]}')} AS doc
FROM {{part}}
"""

FEED = f"""
SELECT {text('{"vulnerabilities": [{"cve": {"id": "CVE-2022-')} || CAST(p_partkey AS VARCHAR(20))
  || {text('", "published": "2022-05-01", "vulnStatus": "Analyzed", "descriptions": [{"lang": "es", "value": "fallo"}')}
  || CASE WHEN p_size % 3 = 0 THEN '' ELSE {text(', {"lang": "en", "value": "bug in ')} || p_name || {text('"}')} END
  || {text('], "weaknesses": [{"description": [{"value": "')}
  || CASE p_size % 3 WHEN 0 THEN 'NVD-CWE-noinfo' WHEN 1 THEN 'CWE-416' ELSE 'CWE-502' END
  || {text('"}]}, {"description": [{"value": "CWE-20"}, {"value": "CWE-200"}, {"value": "CWE-9"}]}], "metrics": {')}
  || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN {text('"cvssMetricV31": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "HIGH"}}]')}
     ELSE {text('"cvssMetricV30": [{"cvssData": {"baseScore": 4.3, "baseSeverity": "MEDIUM"}}]')} END
  || {text('}}}]}')} AS doc
FROM {{part}}
"""

CVE_ROWS = """
SELECT o_orderkey AS row_ord,
       CASE WHEN o_custkey % 7 = 0 THEN concat('GHSA-', o_custkey) ELSE concat('CVE-2021-', o_custkey) END AS cve_id,
       CASE o_custkey % 4 WHEN 0 THEN 'CWE-264' WHEN 1 THEN 'CWE-78' WHEN 2 THEN '' ELSE 'CWE-999' END AS cwe_id,
       CASE WHEN o_custkey % 5 = 0 THEN 'too short' ELSE concat('Order ', o_orderkey, ' describes a flaw at length: ', o_orderpriority) END AS summary,
       CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('project', o_custkey % 11) END AS project,
       CASE WHEN o_custkey % 2 = 0 THEN 'C' ELSE '' END AS lang,
       CASE WHEN o_custkey % 2 = 0 THEN concat(o_custkey % 10, '.5') ELSE '' END AS score,
       CASE WHEN o_custkey % 6 = 0 THEN '' ELSE '2021-06-01' END AS publish_date
FROM {orders}
"""

# ----------------------------------------------------------- scanner reports --
SARIF = f"""
SELECT l_orderkey, l_linenumber,
  {text('{"runs": [{"results": [{"ruleId": "cpp/r')} || CAST(l_partkey % 9 AS VARCHAR(4)) || {text('", "level": "')}
  || CASE l_returnflag WHEN 'A' THEN 'error' ELSE 'warning' END || {text('", "message": {"text": "part ')} || CAST(l_partkey AS VARCHAR(20))
  || {text('"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/fn_')} || CAST(l_suppkey AS VARCHAR(20))
  || {text('.c"}, "region": {"startLine": ')} || CAST(l_linenumber * 4 AS VARCHAR(4)) || {text(', "startColumn": 3}}}')}
  || CASE WHEN l_linenumber % 2 = 0 THEN {text(', {"physicalLocation": {"artifactLocation": {"uri": "src/b.c"}, "region": {"startLine": 0}}}')} ELSE '' END
  || {text(']}]}]}')} AS doc
FROM {{lineitem}}
"""

SEMGREP = f"""
SELECT {text('{"results": [{"path": "src/s')} || CAST(l_suppkey AS VARCHAR(20)) || {text('.py", "check_id": "py.r')} || CAST(l_partkey % 9 AS VARCHAR(4))
  || {text('", "start": {"line": ')} || CAST(l_linenumber AS VARCHAR(4)) || {text('}, "extra": {"message": "part ')} || CAST(l_partkey AS VARCHAR(20)) || {text('"')}
  || CASE WHEN l_returnflag = 'A' THEN {text(', "severity": "ERROR"')} ELSE '' END || {text('}}]}')} AS doc
FROM {{lineitem}}
"""

BANDIT = f"""
SELECT {text('{"results": [{"filename": "src/s')} || CAST(l_suppkey AS VARCHAR(20)) || {text('.py", "test_id": "B')} || CAST(300 + l_partkey % 9 AS VARCHAR(4))
  || {text('", "line_number": ')} || CAST(l_linenumber AS VARCHAR(4)) || {text(', "issue_text": "part ')} || CAST(l_partkey AS VARCHAR(20)) || {text('"')}
  || CASE WHEN l_returnflag = 'A' THEN {text(', "issue_severity": "HIGH", "issue_confidence": "LOW"')} ELSE '' END || {text('}]}')} AS doc
FROM {{lineitem}}
"""

# ------------------------------------------------------------------ reports --
# One customer's orders are one evaluation run: truth by status, prediction by price.
RUN_ROWS = """
SELECT o_custkey, o_orderkey, (o_orderstatus = 'F') AS label, (o_totalprice > 250000) AS pred, o_orderdate
FROM {orders}
"""

_TABLES = re.compile(r"\{(\w+)\}")

#: Rows of a table for a task, where parsing what is derived from a row costs far more than moving it.
TASK_ROWS = {"events": 50_000}


def derive(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """The derived table in Spark.

    A source table that comes as fewer partitions than there are cores (a test
    file) is spread first, since what is derived from a row is then parsed.  An event becomes
    a function or an answer, so events are dealt out by rows.
    """
    names = set(_TABLES.findall(sql))
    return spark.sql(sql, **{n: spread(table(spark, sf, n), TASK_ROWS.get(n)) for n in names})


def cte(sql: str) -> str:
    """The derived table as SQL over the registered views."""
    return "(" + _TABLES.sub(r"\1", sql).strip() + ")"
