"""Request table: what is asked about which sample, with a stable identity."""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb

VERSION = "1"

# Default wording.  Users pass their own templates; {names} are columns.
TEMPLATES = {
    "screen": (
        "Check this {language} function for a {sink_category} problem.\nSink: {sink_type}\nSource: {source_var}\n"
        "Mitigations: {sanitizers}\nFlow: {dataflow_path}\n\n{code_window}\n\n"
        'Answer as JSON: {{"verdict": "suspicious" or "safe", "confidence": 0-1, "reasoning": ""}}'
    ),
    "single_pass": (
        "Audit this {language} function ({sink_category}, risk {risk_level}).\nSink: {sink_type}\n"
        "Source: {source_var}\nMitigations: {sanitizers}\nFlow: {dataflow_path}\n\n{code_window}\n\n"
        'Answer as JSON: {{"has_vulnerability": true/false, "confidence": 0-1, "cwe_type": "", "reasoning": ""}}'
    ),
    "verify": (
        "A first look called this {language} function suspicious: {focus}\nSink: {sink_type} ({sink_category})\n"
        "Source: {source_var}\nMitigations: {sanitizers}\nFlow: {dataflow_path}\n\n{code_window}\n\n"
        'Answer as JSON: {{"verdict": "vulnerable" or "safe", "confidence": 0-1, "reasoning": ""}}'
    ),
    "integrate": (
        "Tools looked at {language} function {function_name} ({code_chars} characters).\nSink: {sink_type} "
        "({sink_category}), risk {risk_level}\nMitigations: {sanitizers}\nFlow: {dataflow_path}\n"
        "Findings:\n{findings_summary}\nAgreement: {consensus_level}. {consensus_detail}\nRan: {tools_run}\n"
        "Missing: {tools_failed}\nNobody checked: {blind_spots}\n\n"
        'Answer as JSON: {{"initial_verdict": "", "confidence": 0-1, "window_suggestion": "", "blind_spot_risk": ""}}'
    ),
    "full_scan": (
        "Audit the whole {language} function.\nSink: {sink_type}\nSource: {source_var}\nMitigations: {sanitizers}\n"
        "Flow: {dataflow_path}\nKnown cases:\n{cases}\n\n{code}\n\n"
        'Answer as JSON: {{"verdict": "vulnerable" or "safe", "confidence": 0-1, "reasoning": ""}}'
    ),
    "blind_spot": (
        "Another reviewer called this {language} function {prior_verdict}, looking at: {focus}\n"
        "Known cases:\n{cases}\nLook elsewhere only.\n\n{code}\n\n"
        'Answer as JSON: {{"has_vulnerability": true/false, "no_findings": true/false, "confidence": 0-1, "cwe_type": ""}}'
    ),
    "arbiter": (
        "Two reviewers disagree.\nFirst: {r2_reads} ({r2_confidence}) {r2_reasoning}\n"
        "Second: {r3_reads} ({r3_confidence}) {r3_reasoning}\n\n"
        'Answer as JSON: {{"winner": "", "final_verdict": "vuln" or "safe", "confidence": 0-1, "reasoning": ""}}'
    ),
}

# --- fixed values: settings of the five slice-verification strategies --------
REVIEW_STRATEGIES = {
    "baseline": 0.3, "cot": 0.2, "cwe_specialized": 0.1, "adversarial": 0.3, "strict": 0.0,
}

_HOLE = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def render(template: str, values: Mapping[str, Column] | None = None) -> Column:
    """Template with ``{name}`` holes as one concat; filled text is never re-read for holes."""
    parts: list[Column] = []
    text = ""
    at = 0
    for m in _HOLE.finditer(template):
        text += template[at : m.start()]
        at = m.end()
        if m.group(1) is None:
            text += m.group(0)[0]
            continue
        if text:
            parts.append(F.lit(text))
            text = ""
        value = (values or {}).get(m.group(1), F.col(m.group(1)))
        parts.append(F.coalesce(value.cast("string"), F.lit("")))
    text += template[at:]
    if text:
        parts.append(F.lit(text))
    return F.concat(*parts)


def render_by(key: Column, templates: Mapping[str, str], values: Mapping[str, Column] | None = None, default: str | None = None) -> Column:
    """Template chosen per row by ``key`` (category, strategy or bias)."""
    out = None
    for name, template in templates.items():
        text = render(template, values)
        out = F.when(key == name, text) if out is None else out.when(key == name, text)
    return out.otherwise(render(templates[default], values)) if default else out


def slice_values() -> dict[str, Column]:
    """Context of a slice as template values."""
    return {
        "sanitizers": F.when(F.size("sanitizers") > 0, F.array_join("sanitizers", ", ")).otherwise("none"),
        "sink_type": F.coalesce("sink_type", F.lit("?")),
        "source_var": F.when(F.col("source_var") != "", F.col("source_var")).otherwise("unknown"),
        "dataflow_path": F.when(F.col("dataflow_path") != "", F.col("dataflow_path")).otherwise("?"),
    }


def context(detail: Column) -> Column:
    """Mitigation text back into a list."""
    return F.when(F.coalesce(detail, F.lit("")) != "", F.split(detail, "; ")).otherwise(
        F.array().cast("array<string>")
    )


def request_key(stage: Column, params: str, *, version: str = VERSION) -> Column:
    """Identity of a request: full code, sink, language, stage, parameters, version."""
    return F.sha2(
        F.to_json(
            F.struct(
                F.coalesce(F.col("code"), F.lit("")).alias("code"),
                F.coalesce(F.col("sink_type"), F.lit("")).alias("sink"),
                F.coalesce(F.col("language"), F.lit("c")).alias("language"),
                stage.alias("stage"),
                F.lit(params).alias("params"),
                F.lit(version).alias("version"),
            )
        ),
        256,
    )


def build(
    df: DataFrame, stage: str, prompt: Column, *, params: str = "", strategy: str = "", temperature: float | Column = 0.0,
    max_tokens: int = 1024, system: str = "Answer with raw JSON only.",
) -> DataFrame:
    """Requests of one stage."""
    temp = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return df.select(
        request_key(F.lit(stage), params).alias("request_id"),
        "sample_id",
        F.lit(stage).alias("stage"),
        F.lit(strategy).alias("strategy"),
        temp.alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
        prompt.alias("prompt"),
        F.lit(system).alias("system"),
    )


def per_temperature(requests: DataFrame, temperatures: list[float]) -> DataFrame:
    """One request per temperature, identities kept apart."""
    return requests.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures]))).withColumn(
        "request_id", F.sha2(F.concat_ws("|", "request_id", F.col("temperature").cast("string")), 256)
    )


def unanswered(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Requests without a stored response; copies of a function ask once."""
    return requests.dropDuplicates(["request_id"]).join(
        answered.select("request_id").distinct(), "request_id", "left_anti"
    )


def params_for(preset: str = "v1", overrides: dict | None = None) -> dict:
    """Preset parameters with overrides merged per section."""
    params = copy.deepcopy(rb.PRESETS.get(preset, rb.PRESETS["v1"]))
    for section, values in (overrides or {}).items():
        if isinstance(params.get(section), dict):
            params[section] = {**params[section], **values}
        else:
            params[section] = values
    return params


def preset_rows() -> list[tuple[str, str, str, str]]:
    """(config, section, key, value) of all presets."""
    return [
        (name, section, key, str(value))
        for name, preset in rb.PRESETS.items()
        for section, values in preset.items()
        for key, value in values.items()
    ]


def merge_overrides(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Table form of the merge: (config, section, key, value), override wins."""
    key = ["config", "section", "key"]
    o = overrides.select(*key, F.col("value").alias("_o"))
    return base.join(o, key, "full").select(*key, F.coalesce("_o", "value").alias("value"))


def preset_comparison(presets: DataFrame) -> DataFrame:
    """One row per preset, the chosen parameters as columns."""
    wanted = {
        "code_window_mode": ("code_window", "mode"),
        "strategy": ("llm", "mode"),
        "no_sink": ("static_decision", "no_sink"),
        "low_risk_sink": ("static_decision", "low_risk_sink"),
        "sanitizer_threshold": ("static_decision", "sanitizer_threshold"),
        "conflict_arbitration": ("post_process", "enable_conflict_arbitration"),
        "confidence_calibration": ("post_process", "enable_confidence_calibration"),
    }
    return presets.groupBy("config").agg(
        *[
            F.max(F.when((F.col("section") == s) & (F.col("key") == k), F.col("value"))).alias(name)
            for name, (s, k) in wanted.items()
        ]
    )
