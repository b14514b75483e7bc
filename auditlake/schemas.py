"""Explicit schemas of the audit tables (nothing is inferred)."""

from __future__ import annotations

SOURCE_FILES = "file string, language string, content string"

SLICES = (
    "sample_id string, file string, function_name string, language string, code string, "
    "line_start int, line_end int, sink_type string, sink_category string, risk_level string, "
    "sanitizers array<string>, sanitization_confidence double, source_var string, "
    "source_type string, dataflow_path string, flow_kind string, ast_confidence double"
)

FINDINGS = (
    "sample_id string, tool string, type string, line int, column int, severity string, message string"
)

LABELLED = (
    "sample_id string, file string, function_name string, cwe string, label boolean, "
    "code string, project string, dataset string"
)

REQUESTS = (
    "request_id string, sample_id string, stage string, strategy string, temperature double, "
    "max_tokens int, prompt string, system string"
)

RESPONSES = "request_id string, raw string, created_at timestamp"

DEPENDENCIES = "project string, manifest string, name string, version string, ecosystem string"

KB_DOCS = (
    "id string, type string, document string, metadata map<string,string>, cve_id string, "
    "cwe_id string, vuln_type string, language string, source string, exploited boolean, "
    "cvss_score double, published string"
)

LABELLED_JSON = (
    "code string, func string, has_vulnerability boolean, label string, file string, "
    "function_name string, cwe string, cwe_id string, project string"
)

GROUND_TRUTH = (
    "file string, function_name string, vulnerability_type string, has_vulnerability boolean"
)

CVE_CSV = (
    "cve_id string, cwe_id string, summary string, project string, lang string, score string, "
    "publish_date string"
)

CWE_LIST = (
    "id string, name string, description string, code_examples array<string>, language string, "
    "severity string, mitigation string"
)

EXPLOITED_ENTRY = (
    "cveID string, vendorProject string, product string, shortDescription string, "
    "cwes array<string>, dateAdded string, dueDate string, notes string"
)
EXPLOITED_CATALOGUE = f"vulnerabilities array<struct<{EXPLOITED_ENTRY.replace(' string', ':string').replace(' array<string>', ':array<string>')}>>"

_CVSS = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>"
CVE_ENTRY = (
    "struct<id:string,published:string,vulnStatus:string,"
    "descriptions:array<struct<lang:string,value:string>>,"
    "weaknesses:array<struct<description:array<struct<value:string>>>>,"
    f"metrics:struct<cvssMetricV31:{_CVSS},cvssMetricV30:{_CVSS}>>"
)
CVE_FEED = f"vulnerabilities array<struct<cve:{CVE_ENTRY}>>"

SARIF = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
    "region:struct<startLine:int,startColumn:int>>>>>>>>"
)
SEMGREP = (
    "results array<struct<path:string,check_id:string,start:struct<line:int>,"
    "extra:struct<message:string,severity:string>>>"
)
BANDIT = (
    "results array<struct<filename:string,line_number:int,test_id:string,issue_text:string,"
    "issue_severity:string,issue_confidence:string>>"
)

ADVISORY = (
    "id string, aliases array<string>, summary string, severity array<struct<type:string,score:string>>, "
    "database_specific struct<severity:string>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,"
    "versions:array<string>>>, "
    "references array<struct<url:string>>"
)

METRICS = "TP:int,FP:int,FN:int,TN:int,Precision:double,Recall:double,F1:double,FPR:double"
EVAL_REPORT = (
    "report_id string, timestamp string, dataset string, preset string, sample_count int, "
    f"metrics struct<{METRICS}>"
)

VERDICT_JSON = (
    "has_vulnerability string, vulnerability_type string, confidence string, description string, "
    "line_numbers array<string>, remediation string, verdict string, reasoning string, "
    "cwe_type string, severity string, cwe_id string, exploitability string, impact string, "
    "reasoning_chain string, cwe_reference string, suspicious string, reason string, "
    "confirmed string, adjusted_confidence string, adjusted_severity string, "
    "false_positive_reason string, refined_description string, no_findings string, "
    "initial_verdict string, window_suggestion string, blind_spot_risk string, winner string, "
    "final_verdict string, "
    "findings array<struct<vulnerability_type:string,severity:string,line:string,description:string,confidence:string>>"
)
