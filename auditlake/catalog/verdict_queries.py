"""Responses, votes, stage resolution, post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog import derived, sqltext as sq
from auditlake.catalog.registry import query, table
from auditlake.catalog.scan_queries import ARITHMETIC, safe_usage_sql, slices
from auditlake.functions import rulebook as rb
from auditlake.operators import cwe, postprocess as pp, responses as rs, votes as vt
from auditlake.plans import triage

_R = derived.cte(derived.RESPONSES)
_V = derived.cte(derived.VOTES)


def response_rows(spark, sf):
    return derived.derive(spark, sf, derived.RESPONSES)


def vote_rows(spark, sf):
    return derived.derive(spark, sf, derived.VOTES)


# --- responses --------------------------------------------------------------------

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LADDER = f"""
raw AS {_R},
t1 AS (SELECT *, regexp_replace(regexp_replace(raw, '<think>[\\s\\S]*?</think>', '', 'g'), '<think>[\\s\\S]*$', '') AS a FROM raw),
t2 AS (SELECT *, {_TRIM.format("regexp_replace(a, '^\\s*(?:response|Response)\\s*\\n?', '')")} AS t FROM t1),
t3 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '^```(?:json)?\\s*', ''), '\\s*```\\s*$', ''), '(\\d+\\.\\d+)",', '\\1,', 'g') AS fx FROM t2),
rungs AS (
  SELECT sample_id, i AS ord, 'fenced' AS rung, c[i] AS x FROM (SELECT sample_id, c, unnest(range(1, len(c) + 1)) AS i FROM (
      SELECT sample_id, regexp_extract_all(t, '```(?:json)?\\s*([\\s\\S]*?)\\s*```', 1) AS c FROM t3) p) q
  UNION ALL SELECT sample_id, 1000, 'open_fence', regexp_extract(t, '(\\{{[\\s\\S]*\\}})', 1) FROM t3 WHERE starts_with(t, '```')
  UNION ALL SELECT sample_id, 1001, 'whole', t FROM t3
  UNION ALL SELECT sample_id, 1002, 'braces', regexp_extract(t, '(\\{{[\\s\\S]*\\}})', 1) FROM t3
  UNION ALL SELECT sample_id, 1003, 'stray_quote', coalesce(nullif(regexp_extract(fx, '(\\{{[\\s\\S]*\\}})', 1), ''), fx) FROM t3
  UNION ALL SELECT sample_id, 1004 + length(fx) - i, 'salvaged', substr(fx, strpos(fx, '{{'), i - strpos(fx, '{{')) || '}}' FROM (  -- every comma, the last first
      SELECT sample_id, fx, unnest(range(1, length(fx) + 1)) AS i FROM t3) p WHERE substr(fx, i, 1) = ',' AND i > strpos(fx, '{{') AND strpos(fx, '{{') > 0),
good AS (SELECT sample_id, ord, rung, {_TRIM.format("x")} AS x FROM rungs),
best AS (SELECT sample_id, rung, x FROM (
   SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS rn FROM good WHERE starts_with(x, '{{') AND json_valid(x)) z WHERE rn = 1),
parsed AS (SELECT r.sample_id, r.event_id, r.event_type, b.x AS json, coalesce(b.rung, 'quarantine') AS parsed_from
           FROM raw r LEFT JOIN best b ON b.sample_id = r.sample_id)"""


@query("response_ladder", f"WITH {_LADDER} SELECT sample_id, parsed_from, json FROM parsed")
def response_ladder(spark, sf):
    return rs.parse(response_rows(spark, sf)).select("sample_id", "parsed_from", "json")


@query(
    "verdict_fields",
    f"""WITH {_LADDER}
SELECT sample_id, parsed_from, coalesce(json->>'$.has_vulnerability', 'false') = 'true' AS has_vulnerability,
       coalesce(json->>'$.vulnerability_type', 'UNKNOWN') AS vulnerability_type,
       round(greatest(0.0, least(1.0, coalesce(CAST(json->>'$.confidence' AS DOUBLE), 0.0))), 4) AS confidence,
       array_to_string(list_filter(coalesce(CAST(json->'$.line_numbers' AS VARCHAR[]), []), lambda x: regexp_matches(x, '^-?\\d+$')), ',') AS line_numbers
FROM parsed WHERE json IS NOT NULL""",
)
def verdict_fields(spark, sf):
    v = rs.verdicts(response_rows(spark, sf)).filter("v is not null")
    return v.select(
        "sample_id", "parsed_from", "v.has_vulnerability", "v.vulnerability_type", "v.confidence",
        F.array_join("v.line_numbers", ",").alias("line_numbers"),
    )


@query(
    "parse_failure_rate",
    f"""WITH {_LADDER}
SELECT event_type, count(*) AS responses, count(*) FILTER (parsed_from = 'quarantine') AS unreadable,
       round(count(*) FILTER (parsed_from = 'quarantine') / count(*), 4) AS failure_rate FROM parsed GROUP BY event_type""",
)
def parse_failure_rate(spark, sf):
    return rs.parse_rate(rs.parse(response_rows(spark, sf)), "event_type")


@query(
    "json_fields",
    """
SELECT event_type, count(*) AS events, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_total, max(CAST(props->>'$.k' AS BIGINT)) AS k_max
FROM events GROUP BY event_type""",
)
def json_fields(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("p.k").alias("k_total"), F.max("p.k").alias("k_max")
    )


@query(
    "confidence_filter",
    f"""WITH {_LADDER}, v AS (
  SELECT sample_id, coalesce(json->>'$.has_vulnerability', 'false') = 'true' AS hv,
         round(greatest(0.0, least(1.0, coalesce(CAST(json->>'$.confidence' AS DOUBLE), 0.0))), 4) AS confidence FROM parsed WHERE json IS NOT NULL)
SELECT CASE WHEN hv AND confidence < 0.6 THEN 'FILTERED_LOW_CONFIDENCE' WHEN hv THEN 'CONFIRMED' END AS status,
       (hv AND confidence >= 0.6) AS has_vulnerability, count(*) AS n FROM v GROUP BY ALL""",
)
def confidence_filter(spark, sf):
    v = rs.verdicts(response_rows(spark, sf)).filter("v is not null").select(
        "sample_id", "v.has_vulnerability", "v.confidence"
    )
    return rs.confidence_filter(v).groupBy("status", "has_vulnerability").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fallback_verdicts",
    f"""WITH {_LADDER}
SELECT sample_id, stage, CASE stage WHEN 'verify' THEN 'uncertain' ELSE 'vuln' END AS verdict,
       CASE stage WHEN 'verify' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM (SELECT sample_id, CASE event_id % 2 WHEN 0 THEN 'verify' ELSE 'full_scan' END AS stage FROM parsed WHERE parsed_from = 'quarantine') q""",
)
def fallback_verdicts(spark, sf):
    q = rs.parse(response_rows(spark, sf)).filter("parsed_from = 'quarantine'")
    q = q.withColumn("stage", F.when(F.col("event_id") % 2 == 0, "verify").otherwise("full_scan"))
    return q.select("sample_id", "stage", rs.fallback(F.col("stage")).alias("f")).select("sample_id", "stage", "f.*")


_SWEEP = (
    derived.text('{"findings": [{"vulnerability_type": "') + " || event_type || "
    + derived.text('", "severity": "HIGH", "line": 3}, {"vulnerability_type": "xss", "severity": "LOW", "line": ')
    + " || CAST(user_id AS VARCHAR(20)) || " + derived.text("}]}")
)
SWEEP = f"SELECT concat('src/', event_id) AS file, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE {_SWEEP} END AS raw FROM {{events}}"


@query(
    "full_file_findings",
    f"""
WITH r AS {derived.cte(SWEEP)}, f AS (SELECT file, CAST(raw->'$.findings' AS JSON[]) AS fs FROM r WHERE json_valid(raw)),
e AS (SELECT file, fs, unnest(range(0, len(fs))) AS ord FROM f)
SELECT file, ord, fs[ord + 1]->>'$.vulnerability_type' AS vulnerability_type, fs[ord + 1]->>'$.severity' AS severity,
       fs[ord + 1]->>'$.line' AS line, 'llm_full_sweep' AS detection_method FROM e""",
)
def full_file_findings(spark, sf):
    v = rs.verdicts(derived.derive(spark, sf, SWEEP))
    return rs.explode_findings(v, "file").select("file", "ord", "vulnerability_type", "severity", "line", "detection_method")


CHECKS = (
    "SELECT concat('e', event_id) AS sample_id, CASE event_id % 4 "
    f"WHEN 0 THEN {derived.text('{\"confirmed\": false, \"false_positive_reason\": \"guarded\", \"adjusted_confidence\": 0.2}')} "
    f"WHEN 1 THEN {derived.text('{\"confirmed\": true, \"adjusted_severity\": \"LOW\", \"refined_description\": \"clearer\"}')} "
    f"WHEN 2 THEN {derived.text('{\"adjusted_confidence\": 0.9}')} ELSE 'no json' END AS raw FROM {{events}}"
)


@query(
    "self_check",
    f"""WITH {_LADDER}, v AS (
  SELECT sample_id, coalesce(json->>'$.has_vulnerability', 'false') = 'true' AS hv,
         round(greatest(0.0, least(1.0, coalesce(CAST(json->>'$.confidence' AS DOUBLE), 0.0))), 4) AS confidence FROM parsed WHERE json IS NOT NULL),
c AS (SELECT sample_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM {derived.cte(CHECKS)} x)
SELECT v.sample_id, CASE WHEN j->>'$.confirmed' = 'false' THEN false ELSE hv END AS has_vulnerability,
       coalesce(CAST(j->>'$.adjusted_confidence' AS DOUBLE), confidence) AS confidence, j->>'$.adjusted_severity' AS severity,
       coalesce(j->>'$.refined_description', '') AS description,
       CASE WHEN j->>'$.confirmed' = 'false' THEN coalesce(j->>'$.false_positive_reason', '') END AS false_positive_reason
FROM v LEFT JOIN c ON c.sample_id = v.sample_id""",
)
def self_check(spark, sf):
    deep = rs.verdicts(response_rows(spark, sf)).filter("v is not null").select("sample_id", "v")
    check = rs.verdicts(derived.derive(spark, sf, CHECKS)).filter("v is not null").select("sample_id", "v")
    return rs.apply_self_check(deep, check)


# --- votes ----------------------------------------------------------------------


@query(
    "majority_vote",
    f"""
WITH v AS {_V}, f AS (SELECT *, CASE reviewer WHEN 'strict' THEN 0 WHEN 'adversarial' THEN 1 ELSE 2 END AS o FROM v WHERE has_vulnerability),
c AS (SELECT sample_id, count(*) FILTER (confidence >= 0.75) AS agent_votes, max(confidence) AS confidence,
             max(confidence) FILTER (reviewer = 'strict') AS strict_confidence, max(confidence) FILTER (reviewer = 'adversarial') AS adversarial_confidence,
             max(confidence) FILTER (reviewer = 'cot') AS cot_confidence FROM f GROUP BY sample_id)
SELECT c.sample_id, agent_votes, c.confidence, 'multi_agent_' || agent_votes || 'v' AS detection_method, strict_confidence, adversarial_confidence, cot_confidence,
       (SELECT arg_min(f.reviewer, f.o) FROM f WHERE f.sample_id = c.sample_id AND f.confidence = c.confidence) AS best_reviewer
FROM c WHERE agent_votes >= 2""",
)
def majority_vote(spark, sf):
    return vt.majority(vote_rows(spark, sf))


@query(
    "weighted_vote",
    f"""
WITH v AS {_V}, w AS (SELECT *, CASE temperature WHEN 0.3 THEN 0.8::DOUBLE WHEN 0.7 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS wt FROM v),
t AS (SELECT sample_id, sum(CASE WHEN verdict = 'vulnerable' THEN wt ELSE 0 END) AS vs, sum(CASE WHEN verdict = 'safe' THEN wt ELSE 0 END) AS ss,
             count(*) FILTER (verdict = 'vulnerable') AS vc, count(*) FILTER (verdict <> 'vulnerable') AS sc, max(confidence) AS sconf FROM w GROUP BY sample_id),
k AS (SELECT *, CASE WHEN vc >= 2 THEN 'confirmed' WHEN vs >= 1.5 AND vs > ss THEN 'weighted' WHEN ss >= 1.5 OR vs < 0.5 THEN 'false_positive' ELSE 'uncertain' END AS c FROM t)
SELECT sample_id, vc AS vuln_count, sc AS safe_count, round(vs, 4) AS vuln_score, round(ss, 4) AS safe_score,
       CASE c WHEN 'false_positive' THEN 'safe' ELSE 'vuln' END AS final_verdict, 'llm_voting_' || c AS final_method,
       CASE c WHEN 'confirmed' THEN sconf WHEN 'weighted' THEN 0.6::DOUBLE WHEN 'false_positive' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS final_confidence
FROM k""",
)
def weighted_vote(spark, sf):
    votes = vote_rows(spark, sf).withColumn("screen_confidence", F.col("confidence"))
    out = vt.temperature_vote(votes, weights={0.3: 0.8, 0.7: 0.5})
    return out.withColumns({"vuln_score": F.round("vuln_score", 4), "safe_score": F.round("safe_score", 4)})


@query(
    "temperature_vote",
    f"""
WITH v AS {_V}, t AS (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, count(v.verdict) FILTER (v.verdict = 'vulnerable') AS vc,
                             count(v.verdict) FILTER (v.verdict <> 'vulnerable') AS sc, count(v.verdict) FILTER (v.verdict = 'safe') AS ss
     FROM orders LEFT JOIN v ON v.sample_id = CAST(o_orderkey AS VARCHAR) GROUP BY 1)
SELECT final_method, final_verdict, count(*) AS samples FROM (
  SELECT CASE WHEN vc + sc = 0 THEN 'llm_voting_no_votes' WHEN vc >= 2 THEN 'llm_voting_confirmed' WHEN vc >= 1.5 AND vc > ss THEN 'llm_voting_weighted'
              WHEN ss >= 1.5 OR vc < 0.5 THEN 'llm_voting_false_positive' ELSE 'llm_voting_uncertain' END AS final_method,
         CASE WHEN vc + sc = 0 OR vc >= 2 THEN 'vuln' WHEN ss >= 1.5 OR vc < 0.5 THEN 'safe' ELSE 'vuln' END AS final_verdict FROM t) x GROUP BY ALL""",
)
def temperature_vote(spark, sf):
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"))
    votes = vote_rows(spark, sf).withColumn("screen_confidence", F.col("confidence"))
    return vt.temperature_vote(votes, samples=samples).groupBy("final_method", "final_verdict").agg(
        F.count(F.lit(1)).alias("samples")
    )


@query(
    "confidence_vote",
    f"""
SELECT sample_id, round(vw, 4) AS vuln_weight, round(tw, 4) AS total_weight, confidence,
       CASE WHEN tw > 0 AND round(vw / tw, 9) >= 0.5 THEN 'confirmed_vuln' ELSE 'false_positive' END AS verdict
FROM (SELECT sample_id, sum(CASE WHEN review = 'confirmed_vuln' THEN confidence ELSE 0 END) AS vw, sum(confidence) AS tw, max(confidence) AS confidence
      FROM {_V} v GROUP BY sample_id) t""",
)
def confidence_vote(spark, sf):
    votes = vote_rows(spark, sf).select("sample_id", F.col("review").alias("verdict"), "confidence")
    out = vt.confidence_vote(votes)
    return out.withColumns({"vuln_weight": F.round("vuln_weight", 4), "total_weight": F.round("total_weight", 4)})


# --- stages to a final verdict --------------------------------------------------
# The line items of an order answer the four stages in turn; stages without a
# line item were not answered.

_STAGES_SQL = """
st AS (SELECT l_orderkey AS k,
  max(CASE WHEN l_linenumber % 4 = 1 THEN 1 ELSE 0 END) AS has1, max(CASE WHEN l_linenumber % 4 = 2 THEN 1 ELSE 0 END) AS has2,
  max(CASE WHEN l_linenumber % 4 = 3 THEN 1 ELSE 0 END) AS has3, max(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END) AS has4,
  max(CASE WHEN l_linenumber % 4 = 1 AND l_returnflag <> 'N' THEN 1 ELSE 0 END) AS suspicious,
  max(CASE WHEN l_linenumber % 4 = 1 AND l_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS full_window,
  max(CASE WHEN l_linenumber % 4 = 1 THEN l_partkey % 3 END) AS risk,
  max(CASE WHEN l_linenumber % 4 = 1 THEN CAST(round(l_discount * 100) AS INT) END) AS c1,
  max(CASE WHEN l_linenumber % 4 = 2 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS v2,
  max(CASE WHEN l_linenumber % 4 = 2 THEN CAST(round(l_discount * 100) AS INT) END) AS c2,
  max(CASE WHEN l_linenumber % 4 = 3 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS vf,
  max(CASE WHEN l_linenumber % 4 = 3 THEN CAST(round(l_discount * 100) AS INT) END) AS cf,
  max(CASE WHEN l_linenumber % 4 = 0 AND l_returnflag <> 'R' THEN 1 ELSE 0 END) AS v3,
  max(CASE WHEN l_linenumber % 4 = 0 THEN CAST(round(l_discount * 100) AS INT) END) AS c3
 FROM {lineitem} GROUP BY l_orderkey)"""

_STAGE_ROWS = "WITH " + _STAGES_SQL + " SELECT CAST(k AS VARCHAR(20)) AS sample_id, * FROM st"


def _stage_structs(spark, sf):
    """One row per order with the stage answers a1, a2, fs, a3 as structs."""
    st = derived.derive(spark, sf, _STAGE_ROWS)

    def conf(c):
        return F.col(c).cast("double") / 10

    risk = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("risk").cast("int") + 1)
    return st.select(
        "sample_id",
        F.when(
            F.col("has1") == 1,
            F.struct(
                F.when(F.col("suspicious") == 1, "suspicious").otherwise("safe").alias("initial_verdict"),
                F.when(F.col("suspicious") == 1, "suspicious").otherwise("safe").alias("verdict"),
                F.when(F.col("full_window") == 1, "full").otherwise("iris").alias("window_suggestion"),
                risk.alias("blind_spot_risk"), conf("c1").alias("confidence"),
                (F.col("suspicious") == 1).alias("has_vulnerability"),
            ),
        ).alias("a1"),
        F.when(
            F.col("has2") == 1,
            F.struct(F.when(F.col("v2") == 1, "vulnerable").otherwise("safe").alias("verdict"), conf("c2").alias("confidence")),
        ).alias("a2"),
        F.when(
            F.col("has3") == 1,
            F.struct(F.when(F.col("vf") == 1, "vulnerable").otherwise("safe").alias("verdict"), conf("cf").alias("confidence")),
        ).alias("fs"),
        F.when(
            F.col("has4") == 1,
            F.struct(
                (F.col("v3") == 1).alias("has_vulnerability"), F.lit(False).alias("no_findings"), conf("c3").alias("confidence")
            ),
        ).alias("a3"),
    )


def _stage_cte() -> str:
    return derived._TABLES.sub(r"\1", _STAGES_SQL).strip()


@query(
    "tool_aware_resolution",
    f"""
WITH {_stage_cte()},
n AS (SELECT *, CASE WHEN has1 = 0 THEN 'failed' WHEN suspicious = 1 AND full_window = 1 THEN 'scan' WHEN suspicious = 1 THEN 'verify'
                     WHEN risk IN (0, 1) AND full_window = 1 THEN 'scan' WHEN risk IN (0, 1) THEN 'screened_third' ELSE 'screened' END AS path,
             CASE WHEN has2 = 0 THEN 'uncertain' WHEN v2 = 1 THEN 'confirmed' ELSE 'rejected' END AS second FROM st),
m AS (SELECT *, (path = 'screened_third' OR (path = 'verify' AND (second <> 'confirmed' OR risk = 0))) AS third,
        CASE path WHEN 'failed' THEN 'tool_aware_a1_failed' WHEN 'scan' THEN CASE WHEN has3 = 0 THEN 'tool_aware_full_scan_parse_failed' WHEN vf = 1 THEN 'tool_aware_full_scan_vuln' ELSE 'tool_aware_full_scan_safe' END
             WHEN 'verify' THEN CASE second WHEN 'rejected' THEN 'tool_aware_a2_false_positive' WHEN 'uncertain' THEN 'tool_aware_a2_uncertain' ELSE 'tool_aware_full_pipeline' END
             ELSE 'tool_aware_a1_screened' END AS method0,
        CASE path WHEN 'failed' THEN 3 WHEN 'scan' THEN CASE WHEN has3 = 0 THEN 3 ELSE cf END WHEN 'verify' THEN CASE second WHEN 'uncertain' THEN 5 ELSE c2 END ELSE c1 END AS conf0
      FROM n),
o AS (SELECT *, (third AND has4 = 1 AND v3 = 1 AND c3 >= 7) AS overturn FROM m)
SELECT CAST(k AS VARCHAR) AS sample_id, method0 || CASE WHEN overturn THEN '_a3_blind_spot' ELSE '' END AS final_method,
       CASE WHEN overturn THEN 'vuln' WHEN path IN ('screened', 'screened_third') OR (path = 'verify' AND second = 'rejected') OR (path = 'scan' AND has3 = 1 AND vf = 0) THEN 'safe' ELSE 'vuln' END AS final_verdict,
       CAST(CASE WHEN overturn THEN c3 ELSE conf0 END AS DOUBLE) / 10 AS final_confidence,
       1 + CASE WHEN path IN ('scan', 'verify') THEN 1 ELSE 0 END + CASE WHEN third THEN 1 ELSE 0 END AS llm_calls
FROM o""",
)
def tool_aware_resolution(spark, sf):
    return triage.resolve_tool_aware(_stage_structs(spark, sf)).select(
        "sample_id", "final_method", "final_verdict", "final_confidence", "llm_calls"
    )


_LATER = {
    "verify": "plain {sample_id}", "verify:confirm_it": "Confirm {sample_id}? {focus}", "full_scan": "All of {sample_id}, known: {cases}",
    "blind_spot": "{prior_verdict} {sample_id}, look elsewhere",
}


@query(
    "later_stage_requests",
    f"""
WITH {_stage_cte()},
n AS (SELECT *, CASE WHEN has1 = 0 THEN 'failed' WHEN suspicious = 1 AND full_window = 1 THEN 'scan' WHEN suspicious = 1 THEN 'verify'
                     WHEN risk IN (0, 1) AND full_window = 1 THEN 'scan' WHEN risk IN (0, 1) THEN 'screened_third' ELSE 'screened' END AS path FROM st),
w AS (SELECT *, (path = 'screened_third' OR (path = 'verify' AND (has2 = 0 OR v2 = 0 OR risk = 0))) AS third FROM n),
r AS (SELECT k, 'verify' AS stage, 'Confirm ' || k || '? ' AS prompt, 1024 AS max_tokens FROM w WHERE path = 'verify'
      UNION ALL SELECT k, 'full_scan', 'All of ' || k || ', known: none', 1024 FROM w WHERE path = 'scan'
      UNION ALL SELECT k, 'blind_spot', CASE WHEN suspicious = 1 THEN 'suspicious' ELSE 'safe' END || ' ' || k || ', look elsewhere', 512 FROM w WHERE third)
SELECT CAST(k AS VARCHAR) AS sample_id, stage, prompt, max_tokens FROM r""",
)
def later_stage_requests(spark, sf):
    """Verify, full-scan and blind-spot requests of the samples that need them, worded by the preset's bias."""
    asked = triage.needs_tool_aware(_stage_structs(spark, sf))
    return triage.later_requests(asked, {"llm": {"agent2_bias": "confirm_it"}}, _LATER).select("sample_id", "stage", "prompt", "max_tokens")


@query(
    "chain_resolution",
    f"""
WITH {_stage_cte()},
n AS (SELECT *, CASE WHEN has2 = 0 THEN 'uncertain' WHEN v2 = 1 THEN 'confirmed' ELSE 'rejected' END AS second FROM st),
m AS (SELECT *, CASE WHEN has1 = 0 THEN 'llm_parse_failure' WHEN suspicious = 0 THEN 'llm_agent1_screened' WHEN second = 'rejected' THEN 'llm_agent2_false_positive'
                     WHEN second = 'uncertain' THEN 'llm_agent2_uncertain' ELSE 'llm_full_pipeline' END AS method0 FROM n),
o AS (SELECT *, (method0 IN ('llm_agent2_false_positive', 'llm_agent2_uncertain') AND has4 = 1 AND v3 = 1 AND c3 >= 7) AS overturn FROM m)
SELECT method0 || CASE WHEN overturn THEN '_a3_blind_spot' ELSE '' END AS final_method,
       CASE WHEN overturn THEN 'vuln' WHEN method0 IN ('llm_agent1_screened', 'llm_agent2_false_positive') THEN 'safe' ELSE 'vuln' END AS final_verdict,
       count(*) AS samples, CAST(sum(1 + CASE WHEN has1 = 1 AND suspicious = 1 THEN 1 ELSE 0 END + CASE WHEN method0 IN ('llm_agent2_false_positive', 'llm_agent2_uncertain') THEN 1 ELSE 0 END) AS BIGINT) AS llm_calls
FROM o GROUP BY ALL""",
)
def chain_resolution(spark, sf):
    out = triage.resolve_chain(_stage_structs(spark, sf), third_enabled=True)
    return out.groupBy("final_method", "final_verdict").agg(F.count(F.lit(1)).alias("samples"), F.sum("llm_calls").alias("llm_calls"))


@query(
    "single_pass_resolution",
    f"""WITH {_stage_cte()}
SELECT CASE WHEN has1 = 0 THEN 'llm_parse_failure' ELSE 'llm_single_pass' END AS final_method,
       CASE WHEN has1 = 0 OR suspicious = 1 THEN 'vuln' ELSE 'safe' END AS final_verdict, count(*) AS samples FROM st GROUP BY ALL""",
)
def single_pass_resolution(spark, sf):
    return triage.resolve_single(_stage_structs(spark, sf)).groupBy("final_method", "final_verdict").agg(
        F.count(F.lit(1)).alias("samples")
    )


# --- post-processing ------------------------------------------------------------


def _results(spark, sf):
    """Orders as results, with reviewer 2 and 3 from the line items."""
    res = derived.derive(spark, sf, derived.RESULTS)
    answers = derived.derive(spark, sf, derived.STAGE_ANSWERS)
    return res.join(pp.by_stage(answers, ("r2", "r3")), "sample_id", "left")


_RES = f"""
res AS {derived.cte(derived.RESULTS)}, ans AS {derived.cte(derived.STAGE_ANSWERS)},
a2 AS (SELECT sample_id, verdict AS v2, has_vulnerability AS h2, confidence AS c2, reasoning AS t2, cwe AS w2 FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY verdict DESC, has_vulnerability DESC NULLS LAST, confidence DESC, reasoning DESC, cwe DESC) AS rn FROM ans WHERE stage = 'r2') x WHERE rn = 1),
a3 AS (SELECT sample_id, verdict AS v3, has_vulnerability AS h3, confidence AS c3, reasoning AS t3, cwe AS w3 FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY verdict DESC, has_vulnerability DESC NULLS LAST, confidence DESC, reasoning DESC, cwe DESC) AS rn FROM ans WHERE stage = 'r3') x WHERE rn = 1),
j AS (SELECT r.*, a2.* EXCLUDE (sample_id), a3.* EXCLUDE (sample_id), (a2.sample_id IS NOT NULL) AS has2, (a3.sample_id IS NOT NULL) AS has3
      FROM res r LEFT JOIN a2 ON a2.sample_id = r.sample_id LEFT JOIN a3 ON a3.sample_id = r.sample_id)"""

_BOOL = "CASE WHEN {v} IN ('vulnerable','confirmed_vuln','vuln') THEN true WHEN {v} IN ('safe','false_positive') THEN false ELSE {h} END"


@query(
    "reviewer_conflicts",
    f"""WITH {_RES}, b AS (SELECT *, {_BOOL.format(v="v2", h="h2")} AS b2, {_BOOL.format(v="v3", h="h3")} AS b3 FROM j WHERE has2 AND has3)
SELECT sample_id, CASE WHEN b2 THEN 'vuln' ELSE 'safe' END AS r2_reads, CASE WHEN b3 THEN 'vuln' ELSE 'safe' END AS r3_reads
FROM b WHERE b2 IS DISTINCT FROM b3""",
)
def reviewer_conflicts(spark, sf):
    return pp.conflicts(_results(spark, sf)).select("sample_id", "r2_reads", "r3_reads")


@query(
    "arbiter_requests",
    f"""WITH {_RES}, b AS (SELECT *, {_BOOL.format(v="v2", h="h2")} AS b2, {_BOOL.format(v="v3", h="h3")} AS b3 FROM j WHERE has2 AND has3)
SELECT sample_id, CASE WHEN b2 THEN 'vuln' ELSE 'safe' END || ': ' || t2 || ' / ' || CASE WHEN b3 THEN 'vuln' ELSE 'safe' END || ': ' || t3 AS prompt
FROM b WHERE b2 IS DISTINCT FROM b3""",
)
def arbiter_requests(spark, sf):
    asked = triage.arbiter_requests(pp.conflicts(_results(spark, sf)), {}, {"arbiter": "{r2_reads}: {r2_reasoning} / {r3_reads}: {r3_reasoning}"})
    return asked.select("sample_id", "prompt")


_CAL = f"""{_RES},
d AS (SELECT *, coalesce(has3 AND h3, false) AS found, coalesce(c3, 0.5) AS conf3, lower(coalesce(t2, '')) AS l2, lower(coalesce(t3, '')) AS l3 FROM j),
ind AS (SELECT *, ((coalesce(w2, '') <> '' AND coalesce(w3, '') <> '' AND w2 <> w3)
        OR (regexp_matches(l3, '{"|".join(rb.OTHER_AREA_WORDS)}') AND l3 <> substr(l2, 1, 50))) AS independent FROM d),
cs AS (SELECT *, CASE WHEN found AND final_verdict = 'vuln' AND independent AND conf3 < 0.7 THEN 'A3_blind_spot_weak_reverted'
                      WHEN found AND final_verdict = 'vuln' AND independent THEN 'A3_blind_spot_independent'
                      WHEN found AND final_verdict = 'vuln' AND conf3 < 0.85 THEN 'A3_overlap_weak_reverted'
                      WHEN found AND final_verdict = 'vuln' THEN 'A3_overlap_strong_accepted'
                      WHEN found AND final_verdict = 'safe' THEN 'A3_finding_weak_no_overturn'
                      WHEN NOT has3 AND final_verdict = 'vuln' AND has2 THEN 'A3_skipped_A2_confident' END AS c FROM ind),
f1 AS (SELECT *, CASE c WHEN 'A3_blind_spot_weak_reverted' THEN greatest(final_confidence - 0.05::DOUBLE, 0.3::DOUBLE) WHEN 'A3_blind_spot_independent' THEN least(final_confidence + 0.1::DOUBLE, 0.98::DOUBLE)
                        WHEN 'A3_overlap_weak_reverted' THEN greatest(final_confidence - 0.1::DOUBLE, 0.25::DOUBLE) WHEN 'A3_overlap_strong_accepted' THEN conf3
                        WHEN 'A3_finding_weak_no_overturn' THEN greatest(final_confidence - 0.05::DOUBLE, 0.35::DOUBLE) ELSE final_confidence END AS g1,
              CASE WHEN c LIKE '%_reverted' THEN 'safe' ELSE final_verdict END AS fv,
              (reasoning <> '' AND regexp_matches(lower(reasoning), '{"|".join(rb.VAGUE_WORDS)}') AND NOT contains(lower(reasoning), 'concrete')) AS vague,
              (reasoning <> '' AND length(reasoning) < 20) AS short FROM cs),
f2 AS (SELECT *, CASE WHEN vague THEN greatest(g1 - 0.1::DOUBLE, 0.25::DOUBLE) ELSE g1 END AS g2 FROM f1),
f3 AS (SELECT *, CASE WHEN short THEN greatest(g2 - 0.15::DOUBLE, 0.2::DOUBLE) ELSE g2 END AS g3, (pattern_count >= 2 AND fv = 'vuln') AS bonus FROM f2),
cal AS (SELECT *, round(CASE WHEN bonus THEN least(g3 + 0.05::DOUBLE, 0.95::DOUBLE) ELSE g3 END, 4) AS fc,
               concat_ws(',', c, CASE WHEN vague THEN 'vague' END, CASE WHEN short THEN 'short' END, CASE WHEN bonus THEN 'tool_consensus' END) AS notes FROM f3)"""


@query("calibration", f"WITH {_CAL} SELECT sample_id, fv AS final_verdict, fc AS final_confidence, notes AS calibration_notes FROM cal")
def calibration(spark, sf):
    return pp.calibrate(_results(spark, sf)).select(
        "sample_id", "final_verdict", "final_confidence", F.array_join("calibration_notes", ",").alias("calibration_notes")
    )


@query(
    "quality_flags",
    f"""WITH {_CAL},
q AS (SELECT *, (fv = 'vuln' AND length(reasoning) < 10) AS bare FROM cal),
q2 AS (SELECT *, CASE WHEN bare THEN least(fc, 0.4::DOUBLE) ELSE fc END AS k FROM q),
q3 AS (SELECT *, (k > 0.95 AND length(reasoning) < 50) AS over FROM q2)
SELECT sample_id, fv AS final_verdict, CASE WHEN over THEN 0.85::DOUBLE ELSE k END AS final_confidence,
       concat_ws(',', CASE WHEN bare THEN 'vuln_verdict_without_reasoning' END, CASE WHEN over THEN 'overconfident_short_reasoning' END,
                 CASE WHEN fv = 'vuln' AND has2 AND v2 = 'false_positive' AND NOT has3 THEN 'vuln_despite_a2_safe_no_a3' END) AS quality_warnings
FROM q3""",
)
def quality_flags(spark, sf):
    out = pp.chain(_results(spark, sf), rb.PRESETS["v1"]["post_process"])
    return out.select(
        "sample_id", "final_verdict", "final_confidence", F.array_join("quality_warnings", ",").alias("quality_warnings")
    )


@query(
    "arbitration",
    f"""WITH {_RES}, b AS (SELECT *, {_BOOL.format(v="v2", h="h2")} AS b2, {_BOOL.format(v="v3", h="h3")} AS b3 FROM j),
arb AS (SELECT *, (has2 AND has3 AND b2 IS DISTINCT FROM b3 AND CAST(sample_id AS BIGINT) % 3 <> 0) AS answered FROM b)
SELECT sample_id, CASE WHEN answered THEN CASE WHEN c3 > c2 THEN CASE WHEN b3 THEN 'vuln' ELSE 'safe' END ELSE CASE WHEN b2 THEN 'vuln' ELSE 'safe' END END ELSE final_verdict END AS final_verdict,
       CASE WHEN answered THEN greatest(c2, c3) ELSE final_confidence END AS final_confidence,
       final_method || CASE WHEN answered THEN '_arbitrated' ELSE '' END AS final_method,
       reasoning || CASE WHEN answered THEN ' [ARBITRATOR: higher confidence]' ELSE '' END AS reasoning
FROM arb""",
)
def arbitration(spark, sf):
    """Conflicts answered by the more confident reviewer (every third request unanswered)."""
    res = _results(spark, sf)
    asked = pp.conflicts(res).filter(F.col("sample_id").cast("bigint") % 3 != 0)
    answers = asked.select(
        "sample_id",
        F.when(F.col("r3.confidence") > F.col("r2.confidence"), F.col("r3_reads")).otherwise(F.col("r2_reads")).alias("arb_verdict"),
        F.greatest("r2.confidence", "r3.confidence").alias("arb_confidence"),
        F.lit("higher confidence").alias("arb_reasoning"),
    )
    return pp.apply_arbitration(res, answers).select("sample_id", "final_verdict", "final_confidence", "final_method", "reasoning")


def _legacy_rows(spark, sf):
    return slices(spark, sf).select(
        "sample_id", "code", "sink_type",
        F.when(F.col("label"), "vuln").otherwise("safe").alias("final_verdict"), F.lit("llm_single_pass").alias("final_method"),
        (F.col("row_ord") % 10).cast("double").alias("c10"),
    ).withColumn("final_confidence", F.col("c10") / 10)


@query(
    "legacy_overrides",
    sq.SCAN + f""",
r AS (SELECT *, CASE WHEN label THEN 'vuln' ELSE 'safe' END AS v0, CAST(row_ord % 10 AS DOUBLE) / 10 AS c0, {safe_usage_sql()} AS safe_usage, {ARITHMETIC} AS arith FROM slices),
s AS (SELECT *, (v0 = 'vuln' AND sink_type IS NOT NULL AND safe_usage) AS h1 FROM r),
t AS (SELECT *, (arith IS NOT NULL AND (v0 = 'safe' OR h1)) AS h2 FROM s)
SELECT sample_id, CASE WHEN h2 THEN 'vuln' WHEN h1 THEN 'safe' ELSE v0 END AS final_verdict,
       'llm_single_pass' || CASE WHEN h1 THEN '_safe_pattern_override' ELSE '' END || CASE WHEN h2 THEN '_numeric_vuln_override' ELSE '' END AS final_method,
       round(CASE WHEN h2 THEN 0.85::DOUBLE WHEN h1 THEN greatest(c0 - 0.2::DOUBLE, 0.3::DOUBLE) ELSE c0 END, 4) AS final_confidence,
       CASE WHEN h2 THEN 'CWE-190-' || arith END AS vulnerability_type
FROM t""",
)
def legacy_overrides(spark, sf):
    rows = _legacy_rows(spark, sf)
    out = pp.arithmetic_override(pp.safe_pattern_override(rows))
    return out.select("sample_id", "final_verdict", "final_method", F.round("final_confidence", 4).alias("final_confidence"), "vulnerability_type")


# --- CWE ---------------------------------------------------------------------------

_KEYS = sq.values([(i, k, c) for i, (k, c) in enumerate(rb.CWE_BY_TYPE)]) + " AS m(ord, key, cwe)"
_TYPES = """
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN concat('cwe-', p_size) WHEN 3 THEN 'SQL Injection'
       WHEN 4 THEN concat('possible buffer overflow in ', p_name) WHEN 5 THEN 'injection' WHEN 6 THEN p_type WHEN 7 THEN ' Double Free ' ELSE concat(p_name, ' race condition') END AS t
FROM {part}
"""


@query(
    "cwe_fuzzy_map",
    f"""
WITH t AS {derived.cte(_TYPES)}, m AS (SELECT * FROM {_KEYS}), n AS (SELECT *, trim(lower(t)) AS norm FROM t),
e AS (SELECT n.id, any_value(m.cwe) AS cwe FROM n JOIN m ON m.key = n.norm GROUP BY n.id),
z AS (SELECT n.id, arg_min(m.cwe, m.ord) AS cwe FROM n JOIN m ON contains(n.norm, m.key) OR contains(m.key, n.norm) GROUP BY n.id)
SELECT n.id, n.t AS vulnerability_type,
       CASE WHEN t IN ('', 'UNKNOWN') THEN 'UNKNOWN' WHEN starts_with(upper(t), 'CWE-') THEN upper(t) ELSE coalesce(e.cwe, z.cwe, t) END AS cwe,
       CASE WHEN t IN ('', 'UNKNOWN') THEN 0.0::DOUBLE WHEN starts_with(upper(t), 'CWE-') THEN 0.9::DOUBLE WHEN e.cwe IS NOT NULL THEN 0.85::DOUBLE
            WHEN z.cwe IS NOT NULL THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM n LEFT JOIN e ON e.id = n.id LEFT JOIN z ON z.id = n.id""",
)
def cwe_fuzzy_map(spark, sf):
    rows = derived.derive(spark, sf, _TYPES)
    return rows.select("id", F.col("t").alias("vulnerability_type"), cwe.map_type(F.col("t")).alias("m")).select("id", "vulnerability_type", "m.*")


@query(
    "no_sink_review",
    sq.SCAN + f""", {_LADDER}
SELECT s.sample_id, s.fn_name AS function_name, 'llm_strict' AS detection_method, p.json->>'$.vulnerability_type' AS vulnerability_type,
       round(greatest(0.0, least(1.0, CAST(p.json->>'$.confidence' AS DOUBLE))), 4) AS confidence
FROM slices s JOIN parsed p ON p.sample_id = s.sample_id WHERE s.sink_type IS NULL AND p.json->>'$.has_vulnerability' = 'true'""".replace("parsed AS (SELECT r.", "presp AS (SELECT r.").replace("JOIN parsed p ON", "JOIN presp p ON"),
)
def no_sink_review(spark, sf):
    return triage.no_sink_findings(slices(spark, sf), rs.verdicts(response_rows(spark, sf)), "strict")


@query(
    "slice_review",
    sq.SCAN + f""", {_LADDER}
SELECT s.sample_id, CASE WHEN p.json->>'$.has_vulnerability' = 'true' THEN 'VULN (LLM-cot)' ELSE 'SAFE (LLM-cot)' END AS status,
       CASE WHEN p.json->>'$.has_vulnerability' = 'true' THEN s.risk_level ELSE 'low' END AS risk_level
FROM slices s JOIN parsed p ON p.sample_id = s.sample_id WHERE p.json IS NOT NULL""".replace("parsed AS (SELECT r.", "presp AS (SELECT r.").replace("JOIN parsed p ON", "JOIN presp p ON"),
)
def slice_review(spark, sf):
    v = slices(spark, sf).join(rs.verdicts(response_rows(spark, sf)).select("sample_id", "v"), "sample_id")
    return triage.review_slices(v, "cot").select("sample_id", "status", "risk_level")
