"""Arbitration, calibration and quality checks over one row per sample.

Input of the chain: ``sample_id, final_verdict, final_confidence,
final_method, reasoning, pattern_count, r2, r3`` where r2/r3 are
struct<verdict, has_vulnerability, confidence, reasoning, cwe> of the second
and third reviewer (null when that reviewer did not answer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rulebook as rb
from auditlake.operators import static_scan


def reviewer(df_alias: str) -> list[Column]:
    return [F.col(f"{df_alias}.{n}") for n in ("verdict", "has_vulnerability", "confidence", "reasoning", "cwe")]


def by_stage(verdicts: DataFrame, stages: tuple[str, ...], key: str = "sample_id") -> DataFrame:
    """One struct column per stage; conditional max, so no pivot pass and no hot group.

    When a stage answered a sample several times, the largest struct wins
    (verdict, then the other fields in order), independent of row order.
    """
    fields = F.struct("verdict", "has_vulnerability", "confidence", "reasoning", "cwe")
    return verdicts.groupBy(key).agg(*[F.max(F.when(F.col("stage") == s, fields)).alias(s) for s in stages])


def as_bool(verdict: Column, has_vulnerability: Column) -> Column:
    """Tri-state reading of a verdict."""
    return (
        F.when(verdict.isin("vulnerable", "confirmed_vuln", "vuln"), F.lit(True))
        .when(verdict.isin("safe", "false_positive"), F.lit(False))
        .otherwise(has_vulnerability)
    )


def conflicts(df: DataFrame) -> DataFrame:
    """Rows whose second and third reviewer disagree (undecided counts as different)."""
    a = as_bool(F.col("r2.verdict"), F.col("r2.has_vulnerability"))
    b = as_bool(F.col("r3.verdict"), F.col("r3.has_vulnerability"))
    return df.filter(F.col("r2").isNotNull() & F.col("r3").isNotNull() & ~a.eqNullSafe(b)).withColumns(
        {
            "r2_reads": F.when(a, "vuln").otherwise("safe"),
            "r3_reads": F.when(b, "vuln").otherwise("safe"),
        }
    )


def apply_arbitration(df: DataFrame, answers: DataFrame, key: str = "sample_id") -> DataFrame:
    """Arbiter answers (key, arb_verdict, arb_confidence, arb_reasoning) over the results."""
    j = df.join(answers, key, "left")
    has = F.col("arb_verdict").isNotNull() | F.col("arb_confidence").isNotNull()
    return j.select(
        *[c for c in df.columns if c not in ("final_verdict", "final_confidence", "final_method", "reasoning")],
        F.coalesce("arb_verdict", "final_verdict").alias("final_verdict"),
        F.coalesce("arb_confidence", "final_confidence").alias("final_confidence"),
        F.when(has, F.concat(F.coalesce("final_method", F.lit("")), F.lit("_arbitrated")))
        .otherwise(F.col("final_method")).alias("final_method"),
        F.when(
            has,
            F.concat(
                F.coalesce("reasoning", F.lit("")), F.lit(" [ARBITRATOR: "),
                F.coalesce("arb_reasoning", F.lit("")), F.lit("]"),
            ),
        ).otherwise(F.col("reasoning")).alias("reasoning"),
    )


def different_finding(r2: Column, r3: Column) -> Column:
    """Third reviewer speaks about something else than the second."""
    a, b = F.lower(F.coalesce(r2["reasoning"], F.lit(""))), F.lower(F.coalesce(r3["reasoning"], F.lit("")))
    cwe_a, cwe_b = F.coalesce(r2["cwe"], F.lit("")), F.coalesce(r3["cwe"], F.lit(""))
    other_cwe = (cwe_a != "") & (cwe_b != "") & (cwe_a != cwe_b)
    other_area = b.rlike("|".join(rb.OTHER_AREA_WORDS)) & (b != F.substring(a, 1, 50))
    return other_cwe | other_area


def calibrate(df: DataFrame, *, compat: bool = False, independent_at: float = 0.7, overlap_at: float = 0.85) -> DataFrame:
    """Confidence by reviewer agreement, wording and tool support.

    Each adjustment is its own column, so the note lists all that applied.
    ``compat`` lets the tool bonus look at the verdict before calibration
    changed it.
    """
    fv, fc = F.col("final_verdict"), F.coalesce(F.col("final_confidence"), F.lit(0.5))
    third = F.col("r3").isNotNull()
    found = third & F.coalesce(F.col("r3.has_vulnerability"), F.lit(False))
    conf3 = F.coalesce(F.col("r3.confidence"), F.lit(0.5))
    independent = different_finding(F.col("r2"), F.col("r3"))
    case = (
        F.when(found & (fv == "vuln") & independent & (conf3 < independent_at), "A3_blind_spot_weak_reverted")
        .when(found & (fv == "vuln") & independent, "A3_blind_spot_independent")
        .when(found & (fv == "vuln") & (conf3 < overlap_at), "A3_overlap_weak_reverted")
        .when(found & (fv == "vuln"), "A3_overlap_strong_accepted")
        .when(found & (fv == "safe"), "A3_finding_weak_no_overturn")
        .when(~third & (fv == "vuln") & F.col("r2").isNotNull(), "A3_skipped_A2_confident")
    )
    out = df.withColumn("_verdict0", fv).withColumn("_case", case)
    c = F.col("_case")
    out = out.withColumn(
        "_fc1",
        F.when(c == "A3_blind_spot_weak_reverted", F.greatest(fc - 0.05, F.lit(0.3)))
        .when(c == "A3_blind_spot_independent", F.least(fc + 0.1, F.lit(0.98)))
        .when(c == "A3_overlap_weak_reverted", F.greatest(fc - 0.1, F.lit(0.25)))
        .when(c == "A3_overlap_strong_accepted", conf3)
        .when(c == "A3_finding_weak_no_overturn", F.greatest(fc - 0.05, F.lit(0.35)))
        .otherwise(fc),
    ).withColumn("final_verdict", F.when(c.endswith("_reverted"), "safe").otherwise(fv))
    text = F.coalesce(F.col("reasoning"), F.lit(""))
    low = F.lower(text)
    vague = (text != "") & low.rlike("|".join(rb.VAGUE_WORDS)) & ~low.contains("concrete")
    short = (text != "") & (F.length(text) < 20)
    out = out.withColumn("_vague", vague).withColumn("_short", short)
    out = out.withColumn("_fc2", F.when(F.col("_vague"), F.greatest(F.col("_fc1") - 0.1, F.lit(0.25))).otherwise(F.col("_fc1")))
    out = out.withColumn("_fc3", F.when(F.col("_short"), F.greatest(F.col("_fc2") - 0.15, F.lit(0.2))).otherwise(F.col("_fc2")))
    seen = F.col("_verdict0") if compat else F.col("final_verdict")
    bonus = (F.coalesce(F.col("pattern_count"), F.lit(0)) >= 2) & (seen == "vuln")
    out = out.withColumn("_bonus", bonus)
    out = out.withColumn(
        "final_confidence",
        F.round(F.when(F.col("_bonus"), F.least(F.col("_fc3") + 0.05, F.lit(0.95))).otherwise(F.col("_fc3")), 4),
    )
    notes = F.array_compact(
        F.array(
            c,
            F.when(F.col("_vague"), F.lit("vague")),
            F.when(F.col("_short"), F.lit("short")),
            F.when(F.col("_bonus"), F.lit("tool_consensus")),
        )
    )
    out = out.withColumn("calibration_notes", notes)
    return out.drop("_verdict0", "_case", "_fc1", "_fc2", "_fc3", "_vague", "_short", "_bonus")


def quality_check(df: DataFrame) -> DataFrame:
    """Warnings on thin evidence; two of them also cap the confidence."""
    text = F.coalesce(F.col("reasoning"), F.lit(""))
    fc = F.coalesce(F.col("final_confidence"), F.lit(0.5))
    bare = (F.col("final_verdict") == "vuln") & (F.length(text) < 10)
    capped = F.when(bare, F.least(fc, F.lit(0.4))).otherwise(fc)
    over = (capped > 0.95) & (F.length(text) < 50)
    despite = (
        (F.col("final_verdict") == "vuln")
        & F.coalesce(F.col("r2.verdict") == "false_positive", F.lit(False))
        & F.col("r3").isNull()
    )
    warnings = F.array_compact(
        F.array(
            F.when(bare, F.lit("vuln_verdict_without_reasoning")),
            F.when(over, F.lit("overconfident_short_reasoning")),
            F.when(despite, F.lit("vuln_despite_a2_safe_no_a3")),
        )
    )
    return df.withColumn("quality_warnings", warnings).withColumn(
        "final_confidence", F.when(over, F.lit(0.85)).otherwise(capped)
    )


def safe_pattern_override(df: DataFrame) -> DataFrame:
    """Optional: vuln becomes safe when the row's sink is only used safely."""
    hit = (
        (F.col("final_verdict") == "vuln") & (F.coalesce("sink_type", F.lit("")) != "")
        & static_scan.safe_usage(F.col("code"), F.col("sink_type"))
    )
    return df.withColumn("_hit", hit).withColumns(
        {
            "final_confidence": F.when(F.col("_hit"), F.greatest(F.col("final_confidence") - 0.2, F.lit(0.3)))
            .otherwise(F.col("final_confidence")),
            "final_method": F.when(F.col("_hit"), F.concat("final_method", F.lit("_safe_pattern_override")))
            .otherwise(F.col("final_method")),
            "final_verdict": F.when(F.col("_hit"), "safe").otherwise(F.col("final_verdict")),
        }
    ).drop("_hit")


def arithmetic_override(df: DataFrame) -> DataFrame:
    """Optional: safe becomes vuln when an arithmetic-overflow rule matches."""
    out = df.withColumn("_label", F.when(F.col("final_verdict") == "safe", static_scan.arithmetic_label(F.col("code"))))
    hit = F.col("_label").isNotNull()
    return out.withColumns(
        {
            "final_verdict": F.when(hit, "vuln").otherwise(F.col("final_verdict")),
            "final_method": F.when(hit, F.concat("final_method", F.lit("_numeric_vuln_override")))
            .otherwise(F.col("final_method")),
            "final_confidence": F.when(hit, 0.85).otherwise(F.col("final_confidence")),
            "vulnerability_type": F.when(hit, F.concat(F.lit("CWE-190-"), "_label")),
        }
    ).drop("_label")


def chain(df: DataFrame, params: dict, arbitration: DataFrame | None = None) -> DataFrame:
    """The switchable chain of a preset's ``post_process`` section."""
    if params.get("enable_conflict_arbitration") and arbitration is not None:
        df = apply_arbitration(df, arbitration)
    if params.get("enable_confidence_calibration", True):
        df = calibrate(df)
    if params.get("enable_quality_check", True):
        df = quality_check(df)
    return df
