"""Verdicts against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.columns import ratio
from auditlake.operators.extract import basename


def location_key(df: DataFrame) -> DataFrame:
    """Adds file basename and function as the matching key."""
    return df.withColumn("file_key", basename(F.col("file"))).withColumn(
        "function_key", F.coalesce("function_name", F.lit(""))
    )


def one_per_key(df: DataFrame, key: list[str], flag: str, order: str | None = None) -> DataFrame:
    """One flag per key: the last by ``order`` when given, else true if any is."""
    if order is not None:
        return df.groupBy(*key).agg(F.max_by(F.coalesce(flag, F.lit(False)), F.col(order)).alias(flag))
    return df.groupBy(*key).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias(flag))


def pair(truth: DataFrame, predictions: DataFrame, key: list[str], *, universe: str = "union", order: str | None = None) -> DataFrame:
    """(key, label, pred) over one of three universes.

    ``union``: every key of either side; ``truth``: keys of the truth only;
    ``answered``: keys of both.  What is missing counts as False.  Both sides
    are combined to one row per key before they meet, so the join has no
    repeated keys to run hot on.
    """
    how = {"union": "full", "truth": "left", "answered": "inner"}[universe]
    t = one_per_key(truth.select(*key, "label", *([order] if order else [])), key, "label", order)
    p = one_per_key(predictions.select(*key, "pred", *([order] if order else [])), key, "pred", order)
    return t.join(p, key, how).select(
        *key, F.coalesce("label", F.lit(False)).alias("label"), F.coalesce("pred", F.lit(False)).alias("pred")
    )


def counts() -> list[Column]:
    t, p = F.col("label"), F.col("pred")
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    ]


def scores(counted: DataFrame) -> DataFrame:
    """precision, recall, f1, fpr, accuracy, error_rate from tp/fp/fn/tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counted.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": ratio(fp, fp + tn),
            "accuracy": ratio(tp + tn, n),
            "error_rate": ratio(fp + fn, n),
        }
    )


def metrics(pairs: DataFrame, *by: str | Column) -> DataFrame:
    """Confusion counts and scores, optionally per group."""
    return scores(pairs.groupBy(*by).agg(*counts()) if by else pairs.agg(*counts()))


def metrics_with_total(pairs: DataFrame, *by: str) -> DataFrame:
    """Scores per subset plus the total row (rollup); nulls of the key mean total."""
    return scores(pairs.rollup(*by).agg(*counts()))


def length_bucket(chars: Column) -> Column:
    return (
        F.when(chars < 500, "<500").when(chars < 1000, "500-1000").when(chars < 2000, "1000-2000")
        .when(chars < 3000, "2000-3000").otherwise(">=3000")
    )


def by_length(pairs: DataFrame, chars: str = "n_chars") -> DataFrame:
    """Scores by code-length bucket, with share of sink rows and third-reviewer rows."""
    grouped = pairs.groupBy(length_bucket(F.col(chars)).alias("bucket")).agg(
        *counts(),
        F.count(F.lit(1)).alias("n"),
        F.round(F.count_if(F.col("has_sink")) / F.count(F.lit(1)), 4).alias("sink_share"),
        F.round(F.count_if(F.col("third_review")) / F.count(F.lit(1)), 4).alias("third_share"),
    )
    return scores(grouped)


def method_distribution(results: DataFrame, column: str = "final_method") -> DataFrame:
    return results.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def label_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label)).alias("vulnerable"), F.count_if(~F.col(label)).alias("safe"),
        F.count(F.lit(1)).alias("total"),
    )


def call_costs(results: DataFrame, *by: str) -> DataFrame:
    """Model calls and seconds: totals and per sample."""
    g = results.groupBy(*by) if by else results.groupBy()
    return g.agg(
        F.sum("llm_calls").alias("calls"),
        F.round(F.sum("llm_calls") / F.count(F.lit(1)), 4).alias("calls_per_sample"),
        F.round(F.sum("elapsed_ms") / F.count(F.lit(1)) / 1000, 4).alias("seconds_per_sample"),
    )


def ablation(pairs: DataFrame, baseline: str) -> DataFrame:
    """Scores per ``config`` in one pass and the F1 gain over the baseline config.

    The window runs over the aggregate, one row per config, so the pairs are
    read once and the single window partition stays tiny.
    """
    scored = scores(pairs.groupBy("config").agg(*counts(), F.sum("llm_calls").alias("calls")))
    all_configs = Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col("config") == baseline, F.col("f1"))).over(all_configs)
    return scored.withColumn("delta_f1", F.round(F.col("f1") - base, 4))


def long_metrics(scored: DataFrame, *keep: str) -> DataFrame:
    """One row per metric."""
    names = ["precision", "recall", "f1", "fpr"]
    return scored.unpivot(list(keep), names, "metric", "value")


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric by metric: value in A, in B, difference."""
    left = a.select("metric", F.col("value").alias("value_a"))
    right = b.select("metric", F.col("value").alias("value_b"))
    return left.join(right, "metric").withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), 4))


def agreement(a: DataFrame, b: DataFrame, key: str = "sample_id", verdict: str = "verdict") -> DataFrame:
    """Share of samples two configurations decide alike (joined by sample)."""
    j = a.select(key, F.col(verdict).alias("_a")).join(b.select(key, F.col(verdict).alias("_b")), key)
    same = F.count_if(F.col("_a").eqNullSafe(F.col("_b")))
    return j.agg(
        F.count(F.lit(1)).alias("samples"), same.alias("agree"),
        F.round(F.when(F.count(F.lit(1)) > 0, same / F.count(F.lit(1))).otherwise(0.0), 4).alias("agreement"),
    )


def outcome(kind: str) -> Column:
    """Row filter of a result table: all, correct, wrong, FN or FP."""
    t, p = F.col("label"), F.col("pred")
    return {
        "all": F.lit(True), "correct": t == p, "wrong": t != p, "FN": t & ~p, "FP": ~t & p,
    }[kind]


def without_skipped(results: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Rows that were answered at all (``skip`` rows do not count in metrics)."""
    return results.filter(~F.col(verdict).eqNullSafe(F.lit("skip")))
