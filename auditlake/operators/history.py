"""Saved evaluation reports: listing, search, comparison, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = {
    "newest": [F.desc, "timestamp"],
    "f1": [F.desc, "f1"],
    "samples": [F.desc, "sample_count"],
}


def search(reports: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring in timestamp, dataset or preset."""
    q = text.strip().lower()
    if not q:
        return reports
    return reports.filter(
        F.lower("timestamp").contains(q) | F.lower("dataset").contains(q) | F.lower("preset").contains(q)
    )


def listing(reports: DataFrame, order: str = "newest") -> DataFrame:
    direction, column = ORDERS[order]
    return reports.orderBy(direction(column), "report_id")


def overview(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("reports"),
        F.max("timestamp").alias("newest"),
        F.max("f1").alias("best_f1"),
        F.sum("size_bytes").alias("total_bytes"),
    )


def report_metrics(reports: DataFrame) -> DataFrame:
    """(report_id, metric, value) rows."""
    return reports.unpivot(["report_id"], ["precision", "recall", "f1", "fpr"], "metric", "value")


def activity(scans: DataFrame, reports: DataFrame, *, scans_kept: int = 10, reports_kept: int = 5, shown: int = 8) -> DataFrame:
    """Latest entries of two feeds (type, time, detail), newest first."""
    a = scans.orderBy(F.desc("time"), "detail").limit(scans_kept)
    b = reports.orderBy(F.desc("time"), "detail").limit(reports_kept)
    return a.unionByName(b).orderBy(F.desc("time"), "type", "detail").limit(shown)


def severity_counts(results: DataFrame) -> DataFrame:
    """Vulnerable rows by severity, and safe = total − vulnerable."""
    vulnerable = F.col("has_vulnerability")
    levels = ["HIGH", "MEDIUM", "LOW", "INFO"]
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(vulnerable).alias("vulnerable"),
        *[F.count_if(vulnerable & (F.upper("severity") == s)).alias(s.lower()) for s in levels],
    ).withColumn("safe", F.col("total") - F.col("vulnerable"))


def head(rows: DataFrame, condition: Column | str, *order: Column | str, n: int) -> DataFrame:
    """The first ``n`` rows of a filtered list in an order (TakeOrderedAndProject: n rows per task); the order should tell rows apart."""
    return rows.filter(condition).orderBy(*order).limit(n)


def top_vulnerable(results: DataFrame, n: int = 30, ties: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Most confident vulnerable rows."""
    return head(results, "has_vulnerability", F.desc("confidence"), *ties, n=n)
