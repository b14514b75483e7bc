"""Ground truth against predictions, samples, configurations, saved reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog import derived, sqltext as sq
from auditlake.catalog.registry import query, table
from auditlake.catalog.scan_queries import TEXT_RULES, code, slices
from auditlake.functions import rulebook as rb
from auditlake.plans import triage
from auditlake.operators import cwe, evaluate as ev, history as hs, responses as rs, sampling as sp, static_scan, votes as vt
from auditlake.session import spread
from auditlake.sources import readers


def _text_predictions(spark, sf):
    """Documents a text rule matches, as predictions."""
    labels = static_scan.rule_labels(F.col("text"), TEXT_RULES)
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").cast("string").alias("sample_id"), "lang", "source", "n_chars", (F.size(labels) > 0).alias("pred")
    )


def _text_truth(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("sample_id"), (F.col("toxic") == 1).alias("label"), (F.col("quality") == 1).alias("quality")
    )


_PRED = "(" + " OR ".join(f"regexp_matches(text, {sq.lit(p)})" for p, _ in TEXT_RULES) + ")"
_SCORES = """
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS fpr,
round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END, 4) AS accuracy,
round(CASE WHEN tp + fp + fn + tn > 0 THEN (fp + fn) / (tp + fp + fn + tn) ELSE 0.0 END, 4) AS error_rate"""
_COUNTS = """count(*) FILTER (label AND pred) AS tp, count(*) FILTER (NOT label AND pred) AS fp,
count(*) FILTER (label AND NOT pred) AS fn, count(*) FILTER (NOT label AND NOT pred) AS tn"""
_UNION = f"""
t AS (SELECT doc_id, bool_or(toxic = 1) AS label FROM labels GROUP BY doc_id),
p AS (SELECT doc_id, bool_or({_PRED}) AS pred FROM documents GROUP BY doc_id),
pairs AS (SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(label, false) AS label, coalesce(pred, false) AS pred,
                 t.doc_id IS NOT NULL AS in_truth, p.doc_id IS NOT NULL AS in_pred FROM t FULL JOIN p ON t.doc_id = p.doc_id)"""


@query("confusion_union", f"WITH {_UNION}, c AS (SELECT {_COUNTS} FROM pairs) SELECT *, {_SCORES} FROM c")
def confusion_union(spark, sf):
    return ev.metrics(ev.pair(_text_truth(spark, sf), _text_predictions(spark, sf), ["sample_id"], universe="union"))


@query("confusion_truth", f"WITH {_UNION}, c AS (SELECT {_COUNTS} FROM pairs WHERE in_truth) SELECT *, {_SCORES} FROM c")
def confusion_truth(spark, sf):
    return ev.metrics(ev.pair(_text_truth(spark, sf), _text_predictions(spark, sf), ["sample_id"], universe="truth"))


@query("confusion_answered", f"WITH {_UNION}, c AS (SELECT {_COUNTS} FROM pairs WHERE in_truth AND in_pred) SELECT *, {_SCORES} FROM c")
def confusion_answered(spark, sf):
    return ev.metrics(ev.pair(_text_truth(spark, sf), _text_predictions(spark, sf), ["sample_id"], universe="answered"))


@query(
    "confusion_by_location",
    f"""
WITH code AS {derived.cte(derived.CODE)},
k AS (SELECT regexp_extract(replace(file, chr(92), '/'), '([^/]*)$', 1) AS f, 'fn_' || user_id AS fn, label, row_ord, regexp_matches(code, 'printf|eval|readObject') AS hit FROM code),
t AS (SELECT f, fn, arg_max(label, row_ord) AS label FROM k GROUP BY f, fn),
p AS (SELECT f, fn, arg_max(hit, row_ord) AS pred FROM k GROUP BY f, fn),
pairs AS (SELECT t.label, p.pred FROM t JOIN p ON p.f = t.f AND p.fn = t.fn), c AS (SELECT {_COUNTS} FROM pairs)
SELECT *, {_SCORES} FROM c""",
)
def confusion_by_location(spark, sf):
    """Matching by (file basename, function); the last row of a key counts."""
    rows = code(spark, sf).withColumn("function_name", F.concat(F.lit("fn_"), "user_id"))
    rows = ev.location_key(rows).withColumn("pred", F.col("code").rlike("printf|eval|readObject"))
    key = ["file_key", "function_key"]
    return ev.metrics(
        ev.pair(rows.select(*key, "label", "row_ord"), rows.select(*key, "pred", "row_ord"), key, universe="union", order="row_ord")
    )


@query(
    "scan_quality",
    sq.SCAN + f", pairs AS (SELECT language, label, risk_level <> 'low' AS pred FROM slices), c AS (SELECT language, {_COUNTS} FROM pairs GROUP BY ROLLUP (language)) SELECT *, {_SCORES} FROM c",
)
def scan_quality(spark, sf):
    """How good is the rule scan: anything above low risk counts as a finding."""
    pairs = slices(spark, sf).select("language", "label", (F.col("risk_level") != "low").alias("pred"))
    return ev.metrics_with_total(pairs, "language")


@query(
    "metrics_by_subset",
    f"""
WITH pairs AS (SELECT d.lang, l.toxic = 1 AS label, {_PRED} AS pred FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT lang, {_COUNTS} FROM pairs GROUP BY ROLLUP (lang)) SELECT *, {_SCORES} FROM c""",
)
def metrics_by_subset(spark, sf):
    pairs = _text_truth(spark, sf).join(_text_predictions(spark, sf), "sample_id")
    return ev.metrics_with_total(pairs, "lang")


@query(
    "metrics_by_length",
    f"""
WITH pairs AS (SELECT l.toxic = 1 AS label, {_PRED} AS pred, n_chars, contains(text, 'http') AS has_sink, l.quality = 1 AS third
               FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 1000 THEN '500-1000' WHEN n_chars < 2000 THEN '1000-2000' WHEN n_chars < 3000 THEN '2000-3000' ELSE '>=3000' END AS bucket,
             {_COUNTS}, count(*) AS n, round(count(*) FILTER (has_sink) / count(*), 4) AS sink_share, round(count(*) FILTER (third) / count(*), 4) AS third_share
      FROM pairs GROUP BY 1)
SELECT *, {_SCORES} FROM c""",
)
def metrics_by_length(spark, sf):
    sinks = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("text").contains("http").alias("has_sink"), "n_chars",
        (F.size(static_scan.rule_labels(F.col("text"), TEXT_RULES)) > 0).alias("pred"),
    )
    pairs = _text_truth(spark, sf).withColumnRenamed("quality", "third_review").join(sinks, "sample_id")
    return ev.by_length(pairs)


@query(
    "any_vulnerable",
    "SELECT l_orderkey AS sample_id, bool_or(l_returnflag = 'R') AS pred FROM lineitem GROUP BY l_orderkey",
)
def any_vulnerable(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_returnflag") == "R").alias("pred"))
    return vt.any_vulnerable(rows)


@query(
    "method_distribution",
    f"SELECT final_method, count(*) AS n FROM {derived.cte(derived.RESULTS)} r GROUP BY final_method",
)
def method_distribution(spark, sf):
    return ev.method_distribution(derived.derive(spark, sf, derived.RESULTS))


@query(
    "label_balance",
    "SELECT count(*) FILTER (toxic = 1) AS vulnerable, count(*) FILTER (toxic <> 1) AS safe, count(*) AS total FROM labels",
)
def label_balance(spark, sf):
    return ev.label_balance(_text_truth(spark, sf))


@query(
    "call_costs",
    """
SELECT o_orderpriority AS preset, CAST(sum(o_custkey % 4) AS BIGINT) AS calls, round(sum(o_custkey % 4) / count(*), 4) AS calls_per_sample,
       round(sum(o_custkey % 9000) / count(*) / 1000, 4) AS seconds_per_sample FROM orders GROUP BY o_orderpriority""",
)
def call_costs(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("preset"), (F.col("o_custkey") % 4).alias("llm_calls"), (F.col("o_custkey") % 9000).alias("elapsed_ms")
    )
    return ev.call_costs(rows, "preset")


# Six configurations: different price thresholds decide "vulnerable".
_CONFIGS = [("A", 20000), ("B", 30000), ("C", 40000), ("D", 50000), ("E", 60000), ("F", 80000)]
_PRICE = "l_extendedprice"


def _config_pairs(spark, sf):
    c = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("config"), (F.col(_PRICE) > v).alias("pred"), F.lit(i).alias("llm_calls"))
                for i, (n, v) in enumerate(_CONFIGS)
            ]
        )
    ).alias("c")
    return table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("label"), c).select("label", "c.*")


_ABL = f"""
pairs AS (SELECT k.config, k.calls, l_returnflag = 'R' AS label, {_PRICE} > k.at_least AS pred
          FROM lineitem CROSS JOIN {sq.values([(n, v, i) for i, (n, v) in enumerate(_CONFIGS)])} AS k(config, at_least, calls)),
c AS (SELECT config, {_COUNTS}, CAST(sum(calls) AS BIGINT) AS calls FROM pairs GROUP BY config),
scored AS (SELECT *, {_SCORES} FROM c)"""


@query(
    "ablation_delta",
    f"WITH {_ABL} SELECT s.*, round(s.f1 - (SELECT f1 FROM scored WHERE config = 'A'), 4) AS delta_f1 FROM scored s",
)
def ablation_delta(spark, sf):
    return ev.ablation(_config_pairs(spark, sf), "A")


@query(
    "run_comparison",
    f"""WITH {_ABL},
long AS (SELECT config, unnest(['precision', 'recall', 'f1', 'fpr']) AS metric, unnest([precision, recall, f1, fpr]) AS v FROM scored)
SELECT a.metric, a.v AS value_a, b.v AS value_b, round(b.v - a.v, 4) AS delta FROM long a JOIN long b ON b.metric = a.metric AND b.config = 'C' WHERE a.config = 'A'""",
)
def run_comparison(spark, sf):
    scored = ev.scores(_config_pairs(spark, sf).groupBy("config").agg(*ev.counts()))
    long = ev.long_metrics(scored, "config")
    return ev.compare_reports(long.filter("config = 'A'"), long.filter("config = 'C'"))


@query(
    "agreement",
    f"""
SELECT count(*) AS samples, count(*) FILTER (({_PRICE} > 30000) = ({_PRICE} > 40000)) AS agree,
       round(count(*) FILTER (({_PRICE} > 30000) = ({_PRICE} > 40000)) / count(*), 4) AS agreement FROM lineitem""",
)
def agreement(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("string"), "l_extendedprice").alias("sample_id"),
        F.col(_PRICE),
    )
    a = rows.select("sample_id", (F.col(_PRICE) > 30000).alias("verdict"))
    b = rows.select("sample_id", (F.col(_PRICE) > 40000).alias("verdict"))
    return ev.agreement(a.distinct(), b.distinct())


@query(
    "result_filters",
    f"""WITH {_UNION}
SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM (
  SELECT doc_id, unnest(CASE WHEN label = pred THEN ['correct'] WHEN label THEN ['wrong', 'FN'] ELSE ['wrong', 'FP'] END) AS kind FROM pairs) x GROUP BY kind""",
)
def result_filters(spark, sf):
    pairs = ev.pair(_text_truth(spark, sf), _text_predictions(spark, sf), ["sample_id"])
    kinds = F.array_compact(F.array(*[F.when(ev.outcome(k), F.lit(k)) for k in ("correct", "wrong", "FN", "FP")]))
    return pairs.select(F.col("sample_id").cast("bigint").alias("doc_id"), F.explode(kinds).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")
    )


# --- samples --------------------------------------------------------------------


@query(
    "stratified_first_n",
    """
SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) e WHERE rn <= 100""",
)
def stratified_first_n(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    return sp.stratified(rows, "event_type", ["event_id"], 100)


@query(
    "two_factor_sample",
    f"""
WITH c AS {derived.cte(derived.CODE)}, f AS (SELECT sample_id, row_ord, label, regexp_matches(code, {sq.lit(chr(92) + "b(" + "|".join(rb.SAMPLING_SINK_NAMES) + ")" + chr(92) + "s*" + chr(92) + "(")}) AS has_sink FROM c)
SELECT sample_id, label, has_sink FROM (SELECT *, row_number() OVER (PARTITION BY label, has_sink ORDER BY row_ord) AS rn FROM f) x WHERE rn <= 7""",
)
def two_factor_sample(spark, sf):
    rows = code(spark, sf).select("sample_id", "row_ord", "label", static_scan.calls_sampled_sink(F.col("code")).alias("has_sink"))
    return sp.two_factor(rows, ["label", "has_sink"], ["row_ord"], 30).select("sample_id", "label", "has_sink")


@query(
    "seeded_sample",
    """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS rn FROM documents) d WHERE rn <= 20""",
)
def seeded_sample(spark, sf):
    return sp.seeded(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 42, 20)


@query(
    "keep_first_dedupe",
    """
SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1""",
)
def keep_first_dedupe(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("h"))
    return sp.keep_first(rows, ["h"], ["doc_id"]).drop("h")


@query(
    "good_bad_pairs",
    """
SELECT o_orderkey, label, length(code) AS chars FROM (
  SELECT o_orderkey, true AS label, concat('strcpy(buf, order_', o_orderkey, ')', CASE WHEN o_custkey % 2 = 0 THEN ';' ELSE '; /* checked */' END) AS code FROM orders
  UNION ALL SELECT o_orderkey, false, concat('copy(', o_orderkey, ')', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '; /* bounded copy */' END) FROM orders) x
WHERE length(code) > 20""",
)
def good_bad_pairs(spark, sf):
    o = table(spark, sf, "orders")
    pairs = o.select(
        "o_orderkey",
        F.concat(F.lit("copy("), "o_orderkey", F.lit(")"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise("; /* bounded copy */")).alias("good"),
        F.concat(F.lit("strcpy(buf, order_"), "o_orderkey", F.lit(")"), F.when(F.col("o_custkey") % 2 == 0, ";").otherwise("; /* checked */")).alias("bad"),
    )
    return readers.good_bad_pairs(pairs).select("o_orderkey", "label", F.length("code").alias("chars"))


# --- saved reports: one customer's orders are one run ----------------------------

_REPORTS = f"""
runs AS {derived.cte(derived.RUN_ROWS)},
c AS (SELECT o_custkey, {_COUNTS}, count(*) AS sample_count, max(o_orderdate) AS last FROM runs GROUP BY o_custkey),
reports AS (SELECT 'r' || c.o_custkey AS report_id, substr(CAST(c.last AS VARCHAR), 1, 10) AS timestamp, k.c_mktsegment AS dataset, 'v' || (1 + c.o_custkey % 4) AS preset,
            c.sample_count, {_SCORES}, sample_count * 100 AS size_bytes FROM c JOIN customer k ON k.c_custkey = c.o_custkey)"""


def _reports(spark, sf):
    runs = derived.derive(spark, sf, derived.RUN_ROWS)
    scored = ev.scores(runs.groupBy("o_custkey").agg(*ev.counts(), F.count(F.lit(1)).alias("sample_count"), F.max("o_orderdate").alias("last")))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("dataset"))
    return scored.join(cust, "o_custkey").select(
        F.concat(F.lit("r"), "o_custkey").alias("report_id"), F.substring(F.col("last").cast("string"), 1, 10).alias("timestamp"), "dataset",
        F.concat(F.lit("v"), (1 + F.col("o_custkey") % 4)).alias("preset"), "sample_count", "precision", "recall", "f1", "fpr",
        (F.col("sample_count") * 100).alias("size_bytes"),
    )


@query(
    "report_history",
    f"WITH {_REPORTS} SELECT report_id, timestamp, dataset, preset, sample_count, f1 FROM reports WHERE contains(lower(timestamp), 'mach') OR contains(lower(dataset), 'mach') OR contains(lower(preset), 'mach')",
)
def report_history(spark, sf):
    found = hs.search(_reports(spark, sf), " MACH ")
    return hs.listing(found, "f1").select("report_id", "timestamp", "dataset", "preset", "sample_count", "f1")


@query(
    "report_overview",
    f"WITH {_REPORTS} SELECT count(*) AS reports, max(timestamp) AS newest, max(f1) AS best_f1, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM reports",
)
def report_overview(spark, sf):
    return hs.overview(_reports(spark, sf))


@query(
    "report_metrics_delta",
    f"""WITH {_REPORTS}, long AS (SELECT report_id, dataset, unnest(['precision', 'recall', 'f1', 'fpr']) AS metric, unnest([precision, recall, f1, fpr]) AS v FROM reports),
base AS (SELECT dataset, metric, arg_min(v, report_id) AS base FROM long GROUP BY dataset, metric)
SELECT l.report_id, l.metric, b.base AS value_a, l.v AS value_b, round(l.v - b.base, 4) AS delta FROM long l JOIN base b ON b.dataset = l.dataset AND b.metric = l.metric""",
)
def report_metrics_delta(spark, sf):
    """Every report against the first report of its dataset."""
    r = _reports(spark, sf)
    long = r.unpivot(["report_id", "dataset"], ["precision", "recall", "f1", "fpr"], "metric", "v")
    base = long.groupBy("dataset", "metric").agg(F.min_by("v", "report_id").alias("value_a"))
    return long.join(base, ["dataset", "metric"]).select(
        "report_id", "metric", "value_a", F.col("v").alias("value_b"), F.round(F.col("v") - F.col("value_a"), 4).alias("delta")
    )


@query(
    "activity_feed",
    """
SELECT type, time, detail FROM (
  SELECT * FROM (SELECT 'scan' AS type, substr(CAST(ts AS VARCHAR), 1, 19) AS time, concat(event_type, ' by ', user_id, ' #', event_id) AS detail FROM events ORDER BY time DESC, detail LIMIT 10) a
  UNION ALL SELECT * FROM (SELECT 'evaluation' AS type, substr(CAST(o_orderdate AS VARCHAR), 1, 19) AS time, concat('order ', o_orderkey) AS detail FROM orders ORDER BY time DESC, detail LIMIT 5) b) u
ORDER BY time DESC, type, detail LIMIT 8""",
)
def activity_feed(spark, sf):
    scans = table(spark, sf, "events").select(
        F.lit("scan").alias("type"), F.substring(F.col("ts").cast("string"), 1, 19).alias("time"),
        F.concat("event_type", F.lit(" by "), "user_id", F.lit(" #"), "event_id").alias("detail"),
    )
    reports = table(spark, sf, "orders").select(
        F.lit("evaluation").alias("type"), F.substring(F.col("o_orderdate").cast("string"), 1, 19).alias("time"),
        F.concat(F.lit("order "), "o_orderkey").alias("detail"),
    )
    return hs.activity(scans, reports)


# --- scan report ------------------------------------------------------------------

_FINDING_RESULTS = f"""
res AS (SELECT sample_id, row_number() OVER () AS x, type, severity, CAST((line * 7) % 100 AS DOUBLE) / 100 AS confidence, severity <> 'note' AS hv, message FROM {derived.cte(derived.FINDINGS)} f),
val AS (SELECT sample_id, type, CASE severity WHEN 'error' THEN 'HIGH' WHEN 'warning' THEN 'MEDIUM' ELSE 'LOW' END AS severity, confidence, hv AND confidence >= 0.6 AS has_vulnerability, message FROM res)"""


def _scan_results(spark, sf):
    f = derived.derive(spark, sf, derived.FINDINGS)
    rows = f.select(
        "sample_id", "type", F.when(F.col("severity") == "error", "HIGH").when(F.col("severity") == "warning", "MEDIUM").otherwise("LOW").alias("severity"),
        (((F.col("line") * 7) % 100).cast("double") / 100).alias("confidence"), (F.col("severity") != "note").alias("has_vulnerability"), "message",
    )
    return rs.confidence_filter(rows)


@query(
    "scan_report_summary",
    f"""WITH {_FINDING_RESULTS}
SELECT count(*) AS total, count(*) FILTER (has_vulnerability) AS vulnerable, count(*) FILTER (has_vulnerability AND severity = 'HIGH') AS high,
       count(*) FILTER (has_vulnerability AND severity = 'MEDIUM') AS medium, count(*) FILTER (has_vulnerability AND severity = 'LOW') AS low,
       count(*) FILTER (has_vulnerability AND severity = 'INFO') AS info, count(*) FILTER (NOT has_vulnerability) AS safe FROM val""",
)
def scan_report_summary(spark, sf):
    return hs.severity_counts(_scan_results(spark, sf))


@query(
    "scan_report_top",
    f"""WITH {_FINDING_RESULTS}, m AS (SELECT * FROM {sq.values([(k, c) for k, c in rb.CWE_BY_TYPE])} AS m(key, cwe))
SELECT v.sample_id, v.type, v.confidence, v.message, coalesce(m.cwe, v.type) AS cwe
FROM (SELECT * FROM val WHERE has_vulnerability ORDER BY confidence DESC, sample_id, message, type LIMIT 30) v LEFT JOIN m ON m.key = lower(v.type)""",
)
def scan_report_top(spark, sf):
    rows = hs.top_vulnerable(_scan_results(spark, sf), n=30, ties=("sample_id", "message", "type"))
    return rows.select("sample_id", "type", "confidence", "message", cwe.map_type(F.col("type"))["cwe"].alias("cwe"))


@query(
    "static_baselines",
    sq.SCAN + f""",
d AS (SELECT *, CASE WHEN sink_type IS NULL OR risk_level = 'low' THEN 'safe' WHEN risk_level = 'high' THEN 'vuln' ELSE 'uncertain' END AS decision FROM slices),
pairs AS (SELECT 'A' AS config, label, risk_level <> 'low' AS pred FROM slices UNION ALL SELECT 'A_high', label, risk_level = 'high' FROM slices
          UNION ALL SELECT 'B', label, CASE decision WHEN 'uncertain' THEN row_ord % 2 = 0 ELSE decision = 'vuln' END FROM d
          UNION ALL SELECT 'C', label, CASE decision WHEN 'uncertain' THEN row_ord % 2 = 0 AND row_ord % 5 <> 0 ELSE decision = 'vuln' END FROM d),
c AS (SELECT config, {_COUNTS} FROM pairs GROUP BY config) SELECT *, {_SCORES} FROM c""",
)
def static_baselines(spark, sf):
    """Static only (A), static high only, static decision then screen (B), and the whole chain (C); one scan, one aggregate.

    The screen finds even rows suspicious, the second reviewer rejects every fifth.
    """
    risk, even = F.col("risk_level"), F.col("row_ord") % 2 == 0
    decision = F.when(F.col("sink_type").isNull() | (risk == "low"), "safe").when(risk == "high", "vuln").otherwise("uncertain")
    s = triage.staged(slices(spark, sf), decision, screen=even, verify=F.col("row_ord") % 5 != 0)
    configs = F.array(
        F.struct(F.lit("A").alias("config"), (risk != "low").alias("pred")), F.struct(F.lit("A_high").alias("config"), (risk == "high").alias("pred")),
        F.struct(F.lit("B").alias("config"), F.col("by_screen").alias("pred")), F.struct(F.lit("C").alias("config"), F.col("by_chain").alias("pred")),
    )
    return ev.metrics(s.select("label", F.explode(configs).alias("c")).select("label", "c.*"), "config")


@query(
    "confusion_without_skipped",
    f"""
WITH r AS (SELECT o_orderstatus = 'F' AS label, CASE o_custkey % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'vuln' WHEN 2 THEN 'vuln' ELSE 'safe' END AS verdict FROM orders),
pairs AS (SELECT label, verdict = 'vuln' AS pred FROM r WHERE verdict <> 'skip'), c AS (SELECT {_COUNTS} FROM pairs) SELECT *, {_SCORES} FROM c""",
)
def confusion_without_skipped(spark, sf):
    m = F.col("o_custkey") % 5
    rows = table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").alias("label"), F.when(m == 0, "skip").when(m.isin(1, 2), "vuln").otherwise("safe").alias("verdict")
    )
    return ev.metrics(ev.without_skipped(rows).withColumn("pred", F.col("verdict") == "vuln"))


@query(
    "representative_slice",
    f"""
SELECT sample_id, line, tool, type FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line, tool, type, message, severity) AS rn FROM {derived.cte(derived.FINDINGS)} f) x WHERE rn = 1""",
)
def representative_slice(spark, sf):
    """The first entry of a sample (by line) stands for it."""
    f = derived.derive(spark, sf, derived.FINDINGS)
    return sp.keep_first(f, ["sample_id"], ["line", "tool", "type", "message", "severity"]).select("sample_id", "line", "tool", "type")
