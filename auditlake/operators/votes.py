"""Tallies over several verdicts of one sample.

All of them are plain aggregates with a map-side part, so a sample that owns a
large share of the votes costs one small row per task, not a collected group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, *, min_confidence: float = 0.75, needed: int = 2, reviewers: tuple[str, ...] = ("strict", "adversarial", "cot")) -> DataFrame:
    """Samples at least ``needed`` reviewers flag with enough confidence.

    ``votes``: sample_id, reviewer, has_vulnerability, confidence.  The best
    reviewer is the most confident one that flagged; earlier reviewers win ties.
    """
    order = F.coalesce(*[F.when(F.col("reviewer") == r, F.lit(i)) for i, r in enumerate(reviewers)], F.lit(len(reviewers)))
    flagged = F.col("has_vulnerability")
    best = F.max(
        F.when(flagged, F.struct(F.col("confidence"), (-order).alias("neg"), F.col("reviewer").alias("reviewer")))
    )
    out = votes.groupBy("sample_id").agg(
        F.count_if(flagged & (F.col("confidence") >= min_confidence)).alias("agent_votes"),
        best.alias("_best"),
        *[
            F.max(F.when(flagged & (F.col("reviewer") == r), F.col("confidence"))).alias(f"{r}_confidence")
            for r in reviewers
        ],
    )
    return out.filter(F.col("agent_votes") >= needed).select(
        "sample_id", "agent_votes",
        F.col("_best.reviewer").alias("best_reviewer"),
        F.col("_best.confidence").alias("confidence"),
        F.concat(F.lit("multi_agent_"), F.col("agent_votes").cast("string"), F.lit("v")).alias("detection_method"),
        *[f"{r}_confidence" for r in reviewers],
    )


def temperature_vote(votes: DataFrame, *, weights: dict[float, float] | None = None, consensus: int = 2, samples: DataFrame | None = None) -> DataFrame:
    """Weighted vote over temperatures.

    ``votes``: sample_id, temperature, verdict, screen_confidence.  With
    ``samples`` given, samples without a single readable vote are kept and
    answered conservatively.
    """
    weight: Column = F.lit(1.0)
    for t, w in (weights or {}).items():
        weight = F.when(F.col("temperature") == F.lit(t), F.lit(w)).otherwise(weight)
    vulnerable, safe = F.col("verdict") == "vulnerable", F.col("verdict") == "safe"
    tally = votes.filter(F.col("verdict").isNotNull()).groupBy("sample_id").agg(
        F.sum(F.when(vulnerable, weight).otherwise(0.0)).alias("vuln_score"),
        F.sum(F.when(safe, weight).otherwise(0.0)).alias("safe_score"),
        F.count_if(vulnerable).alias("vuln_count"),
        F.count_if(~vulnerable).alias("safe_count"),
        F.max("screen_confidence").alias("screen_confidence"),
    )
    if samples is not None:
        tally = samples.select("sample_id").join(tally, "sample_id", "left")
    v, s = F.coalesce("vuln_score", F.lit(0.0)), F.coalesce("safe_score", F.lit(0.0))
    confirmed = F.coalesce("screen_confidence", F.lit(0.5)) if weights else F.lit(0.7)
    case = (
        F.when(F.coalesce("vuln_count", F.lit(0)) + F.coalesce("safe_count", F.lit(0)) == 0, "no_votes")
        .when(F.col("vuln_count") >= consensus, "confirmed")
        .when((v >= 1.5) & (v > s), "weighted")
        .when((s >= 1.5) | (v < 0.5), "false_positive")
        .otherwise("uncertain")
    )
    return tally.withColumn("_case", case).select(
        "sample_id",
        F.coalesce("vuln_count", F.lit(0)).cast("bigint").alias("vuln_count"),
        F.coalesce("safe_count", F.lit(0)).cast("bigint").alias("safe_count"),
        v.alias("vuln_score"), s.alias("safe_score"),
        F.when(F.col("_case") == "false_positive", "safe").otherwise("vuln").alias("final_verdict"),
        F.concat(F.lit("llm_voting_"), "_case").alias("final_method"),
        F.when(F.col("_case") == "no_votes", 0.4).when(F.col("_case") == "confirmed", confirmed)
        .when(F.col("_case") == "weighted", 0.6).when(F.col("_case") == "false_positive", 0.3)
        .otherwise(0.5).alias("final_confidence"),
    )


def confidence_vote(votes: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Share of confidence behind "confirmed"; ``uncertain`` counts in the total only.

    ``votes``: sample_id, verdict, confidence (nulls mean 0.5).
    """
    conf = F.coalesce(F.col("confidence"), F.lit(0.5))
    tally = votes.groupBy("sample_id").agg(
        F.sum(F.when(F.col("verdict") == "confirmed_vuln", conf).otherwise(0.0)).alias("vuln_weight"),
        F.sum(conf).alias("total_weight"),
        F.max(F.coalesce(F.col("confidence"), F.lit(0.0))).alias("confidence"),
    )
    # Rounded, so the order in which the partial sums meet cannot flip a tie.
    share = F.round(F.col("vuln_weight") / F.col("total_weight"), 9)
    wins = (F.col("total_weight") > 0) & (share >= threshold)
    return tally.withColumn("verdict", F.when(wins, "confirmed_vuln").otherwise("false_positive"))


def any_vulnerable(predictions: DataFrame, key: str = "sample_id", flag: str = "pred") -> DataFrame:
    """A sample is vulnerable when any of its slices is."""
    return predictions.groupBy(key).agg(F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias(flag))
