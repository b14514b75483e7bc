"""Sinks: reports, evaluation tables, idempotent loads, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.commits import GrowingTable


def scan_report(results: DataFrame, path: str, *, generated_at: Column | None = None) -> DataFrame:
    """Writes the result rows and, beside them, a one-row summary; returns the summary."""
    results.write.mode("overwrite").json(f"{path}/results")
    written = results.sparkSession.read.schema(results.schema).json(f"{path}/results")  # what was written, not computed again
    summary = written.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("has_vulnerability")).alias("vulnerable")
    ).withColumn("generated_at", (generated_at if generated_at is not None else F.current_timestamp()).cast("string"))
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary


def results_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def public_columns(results: DataFrame) -> DataFrame:
    """Without the columns whose name starts with an underscore."""
    return results.select(*[c for c in results.columns if not c.startswith("_")])


def eval_report(results: DataFrame, path: str) -> None:
    """Evaluation rows as JSON, partitioned by dataset and preset."""
    public_columns(results).write.mode("append").partitionBy("dataset", "preset").json(path)


def comparison(baseline: DataFrame, variant: DataFrame, path: str) -> None:
    baseline.withColumn("run", F.lit("baseline")).unionByName(variant.withColumn("run", F.lit("rag"))).write.mode(
        "overwrite"
    ).json(path)


def load_new(docs: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Appends the rows whose id is not stored yet; running it again adds nothing, nor do loads at the same time.

    Rows without an id are skipped; of several with one id, the first in the
    order of their JSON counts.  Returns the rows that were new.
    """
    w = Window.partitionBy(key).orderBy(F.to_json(F.struct(*sorted(docs.columns))))
    usable = docs.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return GrowingTable(docs.sparkSession, path).append(lambda stored: usable if stored is None else usable.join(stored.select(key), key, "left_anti"))


def cacheable(results: DataFrame) -> DataFrame:
    """Results a model took part in (static decisions are cheap to repeat)."""
    return results.filter(
        F.col("final_method").startswith("llm") | F.col("final_method").startswith("tool_aware")
    )


def write_cache(results: DataFrame, path: str, *, now: Column | None = None, run: str | None = None) -> None:
    """Appends the cacheable results; a ``run`` that is repeated with its name adds nothing twice."""
    rows = cacheable(results)
    entries = rows.select(
        "key",
        (now if now is not None else F.current_timestamp()).alias("cached_at"),
        F.to_json(F.struct(*[c for c in rows.columns if c != "key"])).alias("payload"),
    )
    GrowingTable(results.sparkSession, path).append(lambda _: entries, token=run)
