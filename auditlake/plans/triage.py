"""From slices to final verdicts, stage by stage.

Inference happens outside: every stage writes requests and reads responses.
The functions here say which samples need which stage and what the answers of
all stages mean together.  Stage answers are struct columns (null when the
stage was not asked or its response could not be read) next to an ``asked``
flag where the difference matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators import requests as rq
from auditlake.operators import static_scan

OVERTURN_AT = 0.7


def route(slices: DataFrame, params: dict) -> DataFrame:
    """Adds ``static_decision`` and ``route`` (static or model).

    The tool-aware chain has no static shortcut: its first reviewer decides.
    """
    decision = static_scan.static_decision(slices, **{
        k: params.get("static_decision", {}).get(k, v)
        for k, v in {"no_sink": "safe", "low_risk_sink": "safe", "sanitizer_threshold": 0, "dataflow_required": True}.items()
    })
    always_model = params.get("llm", {}).get("mode") == "tool_aware_chain"
    return slices.withColumn("static_decision", decision).withColumn(
        "route",
        F.when(F.lit(always_model) | (F.col("static_decision") == "uncertain"), "model").otherwise("static"),
    )


def staged(df: DataFrame, decision: Column, *, screen: Column, verify: Column) -> DataFrame:
    """Predictions of the staged baselines: the decision, then what is uncertain by the screen (B) and by screen and verification (C)."""
    open_case = decision == "uncertain"
    return df.withColumns(
        {
            "by_screen": F.when(open_case, screen).otherwise(decision == "vuln"),
            "by_chain": F.when(open_case, screen & verify).otherwise(decision == "vuln"),
        }
    )


def static_results(routed: DataFrame) -> DataFrame:
    """Final rows of the samples rules alone could settle."""
    return routed.filter(F.col("route") == "static").select(
        "sample_id",
        F.col("static_decision").alias("final_verdict"),
        F.lit("static_deterministic").alias("final_method"),
        F.lit(0.9).alias("final_confidence"),
        F.lit(0).alias("llm_calls"),
    )


def _overturn(verdict: Column, method: Column, confidence: Column, third: Column) -> tuple[Column, Column, Column]:
    hit = third.isNotNull() & F.coalesce(third["has_vulnerability"], F.lit(False)) & (
        F.coalesce(third["confidence"], F.lit(0.5)) >= OVERTURN_AT
    )
    return (
        F.when(hit, "vuln").otherwise(verdict),
        F.when(hit, F.concat(method, F.lit("_a3_blind_spot"))).otherwise(method),
        F.when(hit, F.coalesce(third["confidence"], F.lit(0.5))).otherwise(confidence),
    )


def _field(df: DataFrame, answer: str, name: str) -> Column:
    """Text field of a stage answer, null when the answers do not carry it."""
    kept = df.schema[answer].dataType.fieldNames() if answer in df.columns else []
    return F.col(f"{answer}.{name}") if name in kept else F.lit(None).cast("string")


def _explain(df: DataFrame, resolved: DataFrame, base: Column) -> DataFrame:
    """Adds the reasoning behind the verdict and, after an overturn, the reported type."""
    overturned = F.col("final_method").endswith("_a3_blind_spot")
    note = F.concat(F.lit(" [A3 BLIND SPOT: "), F.coalesce(_field(df, "a3", "reasoning"), F.lit("")), F.lit("]"))
    text = F.coalesce(base, F.lit(""))
    return resolved.withColumns(
        {
            "reasoning": F.when(overturned, F.concat(text, note)).otherwise(text),
            "vulnerability_type": F.when(
                overturned, F.coalesce(_field(df, "a3", "cwe_type"), F.lit("CWE-UNKNOWN"))
            ),
        }
    )


def second_verdict(a2: Column) -> Column:
    """Reviewer 2 in its own vocabulary; an unreadable answer is uncertain."""
    return (
        F.when(a2.isNull(), "uncertain")
        .when(F.coalesce(a2["verdict"], F.lit("safe")) == "vulnerable", "confirmed_vuln")
        .otherwise("false_positive")
    )


def usable_third(a3: Column) -> Column:
    """Reviewer 3 only counts when it reports a finding."""
    return F.when(
        a3.isNotNull() & ~F.coalesce(a3["no_findings"], F.lit(False)) & F.coalesce(a3["has_vulnerability"], F.lit(False)),
        a3,
    )


def needs_tool_aware(df: DataFrame, *, third_enabled: bool = True) -> DataFrame:
    """Adds needs_verify, needs_full_scan, needs_third after reviewer 1 (and 2)."""
    a1, a2 = F.col("a1"), F.col("a2")
    suspicious = F.coalesce(F.col("a1.initial_verdict"), F.lit("")) == "suspicious"
    full = F.coalesce(F.col("a1.window_suggestion"), F.lit("full")) == "full"
    risk = F.coalesce(F.col("a1.blind_spot_risk"), F.lit(""))
    screened_check = a1.isNotNull() & ~suspicious & risk.isin("high", "medium")
    verify = a1.isNotNull() & suspicious & ~full
    second = second_verdict(a2)
    third = (screened_check & ~full) | (
        verify & (((second != "confirmed_vuln") & F.lit(third_enabled)) | ((second == "confirmed_vuln") & (risk == "high")))
    )
    return df.withColumns(
        {
            "needs_verify": verify,
            "needs_full_scan": (a1.isNotNull() & suspicious & full) | (screened_check & full),
            "needs_third": third,
        }
    )


def resolve_tool_aware(df: DataFrame, *, third_enabled: bool = True) -> DataFrame:
    """Final verdict of the tool-aware chain from a1, a2, fs (full scan), a3."""
    df = needs_tool_aware(df, third_enabled=third_enabled)
    a1, a2, fs = F.col("a1"), F.col("a2"), F.col("fs")
    suspicious = F.coalesce(F.col("a1.initial_verdict"), F.lit("")) == "suspicious"
    second = second_verdict(a2)
    scan = F.col("needs_full_scan")
    vulnerable_scan = F.coalesce(fs["verdict"], F.lit("")) == "vulnerable"
    verdict = (
        F.when(a1.isNull(), "vuln")
        .when(scan, F.when(fs.isNull() | vulnerable_scan, "vuln").otherwise("safe"))
        .when(~suspicious, "safe")
        .when(second == "false_positive", "safe")
        .otherwise("vuln")
    )
    method = (
        F.when(a1.isNull(), "tool_aware_a1_failed")
        .when(scan & fs.isNull(), "tool_aware_full_scan_parse_failed")
        .when(scan & vulnerable_scan, "tool_aware_full_scan_vuln")
        .when(scan, "tool_aware_full_scan_safe")
        .when(~suspicious, "tool_aware_a1_screened")
        .when(second == "false_positive", "tool_aware_a2_false_positive")
        .when(second == "uncertain", "tool_aware_a2_uncertain")
        .otherwise("tool_aware_full_pipeline")
    )
    confidence = (
        F.when(a1.isNull(), F.lit(0.3))
        .when(scan & fs.isNull(), F.lit(0.3))
        .when(scan & vulnerable_scan, F.coalesce(fs["confidence"], F.lit(0.7)))
        .when(scan, F.coalesce(fs["confidence"], F.lit(0.5)))
        .when(~suspicious, F.coalesce(a1["confidence"], F.lit(0.3)))
        .when(second == "uncertain", F.lit(0.5))
        .otherwise(F.coalesce(a2["confidence"], F.lit(0.5)))
    )
    third = F.when(F.col("needs_third"), usable_third(F.col("a3")))
    v, m, c = _overturn(verdict, method, confidence, third)
    calls = F.lit(1) + sum(
        (F.when(F.col(n), 1).otherwise(0) for n in ("needs_verify", "needs_full_scan", "needs_third")), F.lit(0)
    )
    out = df.withColumns({"final_verdict": v, "final_method": m, "final_confidence": c, "llm_calls": calls})
    base = F.when(F.col("needs_full_scan"), _field(df, "fs", "reasoning")).otherwise(_field(df, "a1", "reasoning"))
    return _explain(df, out, base)


def resolve_chain(df: DataFrame, *, second_enabled: bool = True, third_enabled: bool = False) -> DataFrame:
    """Final verdict of the screen/verify/third chain from a1, a2, a3."""
    a1, a2 = F.col("a1"), F.col("a2")
    suspicious = F.coalesce(F.col("a1.verdict"), F.lit("")) == "suspicious"
    second = second_verdict(a2)
    asked2 = a1.isNotNull() & suspicious & F.lit(second_enabled)
    asked3 = asked2 & (second != "confirmed_vuln") & F.lit(third_enabled)
    verdict = (
        F.when(a1.isNull(), "vuln").when(~suspicious, "safe")
        .when(asked2 & (second == "false_positive"), "safe").otherwise("vuln")
    )
    method = (
        F.when(a1.isNull(), "llm_parse_failure").when(~suspicious, "llm_agent1_screened")
        .when(~F.lit(second_enabled), "llm_agent1_only")
        .when(second == "false_positive", "llm_agent2_false_positive")
        .when(second == "uncertain", "llm_agent2_uncertain").otherwise("llm_full_pipeline")
    )
    confidence = (
        F.when(a1.isNull(), F.lit(0.3)).when(~suspicious, F.coalesce(a1["confidence"], F.lit(0.3)))
        .when(~F.lit(second_enabled), F.coalesce(a1["confidence"], F.lit(0.5)))
        .when(second == "uncertain", F.lit(0.5)).otherwise(F.coalesce(a2["confidence"], F.lit(0.5)))
    )
    v, m, c = _overturn(verdict, method, confidence, F.when(asked3, usable_third(F.col("a3"))))
    calls = F.lit(1) + F.when(asked2, 1).otherwise(0) + F.when(asked3, 1).otherwise(0)
    out = df.withColumns({"final_verdict": v, "final_method": m, "final_confidence": c, "llm_calls": calls})
    return _explain(df, out, _field(df, "a1", "reasoning"))


def resolve_single(df: DataFrame) -> DataFrame:
    """Final verdict of a single-pass answer ``a1``."""
    a1 = F.col("a1")
    return df.withColumns(
        {
            "final_verdict": F.when(a1.isNull() | F.coalesce(a1["has_vulnerability"], F.lit(False)), "vuln").otherwise("safe"),
            "final_method": F.when(a1.isNull(), "llm_parse_failure").otherwise("llm_single_pass"),
            "final_confidence": F.when(a1.isNull(), 0.3).otherwise(F.coalesce(a1["confidence"], F.lit(0.5))),
            "llm_calls": F.lit(1),
        }
    )


def review_slices(verdicts: DataFrame, strategy: str) -> DataFrame:
    """Slice verification: a "not vulnerable" answer sets the risk low and the status safe."""
    yes = F.col("v.has_vulnerability")
    return verdicts.filter(F.col("v").isNotNull()).withColumns(
        {
            "status": F.when(yes, f"VULN (LLM-{strategy})").otherwise(f"SAFE (LLM-{strategy})"),
            "risk_level": F.when(yes, F.col("risk_level")).otherwise("low"),
            "has_vulnerability": yes,
            "llm_confidence": F.col("v.confidence"),
        }
    )


def no_sink_findings(slices: DataFrame, verdicts: DataFrame, strategy: str) -> DataFrame:
    """Vulnerable answers on functions without a sink, tagged with method and function."""
    return (
        slices.filter(F.col("sink_type").isNull())
        .join(verdicts.filter(F.col("v.has_vulnerability")).select("sample_id", "v"), "sample_id")
        .select(
            "sample_id", "function_name", F.lit(f"llm_{strategy}").alias("detection_method"),
            F.col("v.vulnerability_type").alias("vulnerability_type"), F.col("v.confidence").alias("confidence"),
        )
    )


def screen_requests(routed: DataFrame, params: dict, templates: dict[str, str] | None = None) -> DataFrame:
    """First-stage requests of a preset; needs ``code_window`` (see windows.code_window)."""
    t = {**rq.TEMPLATES, **(templates or {})}
    model = params.get("llm", {})
    asked = routed.filter(F.col("route") == "model")
    stage, tokens, temp = {
        "single_pass": ("single_pass", "single_pass_max_tokens", "single_pass_temperature"),
        "tool_aware_chain": ("integrate", "agent1_max_tokens", "agent1_temperature"),
    }.get(model.get("mode", ""), ("screen", "agent1_max_tokens", "agent1_temperature"))
    values = {**rq.slice_values(), "code_chars": F.length("code")}
    return rq.build(
        asked, stage, rq.render(t[stage], values), params=str(sorted(model.items())), strategy=model.get("mode", ""),
        temperature=model.get(temp, 0.0), max_tokens=model.get(tokens, 1024),
    )


def later_requests(asked: DataFrame, params: dict, templates: dict[str, str] | None = None) -> DataFrame:
    """Requests of the stages behind the first: verify, full_scan and blind_spot, in one read.

    ``asked`` are samples with the first answer ``a1`` and the flags of
    ``needs_tool_aware``; columns named in a template, or null-safe defaults for
    ``focus``, ``prior_verdict`` and ``cases``, fill it.  A template called
    "verify:<bias>" is taken when the preset's ``agent2_bias`` is that bias.  What
    is asked depends on earlier answers, so the prompt is part of the identity.
    """
    model = params.get("llm", {})
    t = {**rq.TEMPLATES, **(templates or {})}
    biased = f"verify:{model.get('agent2_bias', '')}"
    chosen = {"verify": t.get(biased, t["verify"]), "full_scan": t["full_scan"], "blind_spot": t["blind_spot"]}
    stages = F.array_compact(F.array(*[F.when(F.col(flag), stage) for stage, flag in (("verify", "needs_verify"), ("full_scan", "needs_full_scan"), ("blind_spot", "needs_third"))]))
    values = {
        "focus": F.coalesce(F.col("a1.reasoning") if "reasoning" in asked.schema["a1"].dataType.names else F.lit(None).cast("string"), F.lit("")),
        "prior_verdict": F.coalesce(F.col("a1.initial_verdict"), F.lit("unclear")),
    }
    if "cases" not in asked.columns:
        values["cases"] = F.lit("none")
    if "sanitizers" in asked.columns:
        values = {**rq.slice_values(), **values}
    rows = asked.withColumn("stage", F.explode(stages))
    third = F.col("stage") == "blind_spot"
    return _with_identity(
        rows, rq.render_by(F.col("stage"), chosen, values), str(sorted(model.items())),
        temperature=F.when(third, F.lit(float(model.get("agent3_temperature", 0.1)))).otherwise(float(model.get("agent2_temperature", 0.1))),
        max_tokens=F.when(third, F.lit(int(model.get("agent3_max_tokens", 512)))).otherwise(int(model.get("agent2_max_tokens", 1024))),
    )


def arbiter_requests(disagreeing: DataFrame, params: dict, templates: dict[str, str] | None = None) -> DataFrame:
    """One request per sample whose reviewers disagree (see ``postprocess.conflicts``)."""
    template = {**rq.TEMPLATES, **(templates or {})}["arbiter"]
    values = {f"{r}_{f}": F.coalesce(F.col(f"{r}.{f}").cast("string"), F.lit("")) for r in ("r2", "r3") for f in ("confidence", "reasoning")}
    model = params.get("llm", {})
    return _with_identity(
        disagreeing.withColumn("stage", F.lit("arbiter")), rq.render(template, values), str(sorted(model.items())),
        temperature=F.lit(float(model.get("arbiter_temperature", 0.0))), max_tokens=F.lit(int(model.get("arbiter_max_tokens", 512))),
    )


def _with_identity(rows: DataFrame, prompt: Column, params: str, *, temperature: Column, max_tokens: Column) -> DataFrame:
    identity = F.sha2(F.concat_ws("|", "stage", prompt, F.lit(params), F.lit(rq.VERSION)), 256)
    return rows.select(
        identity.alias("request_id"), "sample_id", "stage", temperature.alias("temperature"), max_tokens.alias("max_tokens"), prompt.alias("prompt"),
        F.lit("Answer with raw JSON only.").alias("system"),
    )


def score_with(requests: DataFrame, score_fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Optional hook: answer requests inside Spark with a user's batch function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_id": batch["request_id"], "raw": score_fn(batch).astype("string")})

    return requests.select("request_id", "stage", "prompt", "system", "temperature", "max_tokens").mapInPandas(
        run, "request_id string, raw string"
    )
