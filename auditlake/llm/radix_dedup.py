"""Operator 2, exact dedup by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes of the UTF-8 text.  All rows start in one
group; each round splits every group by its rows' next digit.  A row alone in
its group is unique and leaves; a group whose texts ended within the digit holds
equal texts and leaves too.  Only the others go on, with the bytes they have
left, so equality is decided by the bytes themselves and no digest is needed.
Digits widen from round to round: most rows leave after the first 64 bytes, and
the few long equal texts need few rounds.

A round is one counting aggregate (combined before it moves, so a group that
holds a third of all rows costs one row per task) and one join back against the
groups of two or more, both sides plain shuffles that adaptive execution splits
where a group is large.  The groups grow with the data, so they are merged and
never broadcast.

Nulls count as empty texts, and all empty texts are equal.  Of equal texts the
row with the largest id stays; a null id is the smallest; of repeated rows with
the same id, one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, numbered, texts

FIRST_DIGIT, WIDER, WIDEST = 64, 8, 1 << 20


def equal_groups(rows: DataFrame, over: HandOver) -> DataFrame:
    """Members of groups of two or more among ``rows`` (row_id, doc_id, text): row_id, keep_id, group_size, kept."""
    active = rows.select("row_id", "doc_id", F.lit(0).cast("long").alias("grp"), F.col("text").cast("binary").alias("rest"))
    ended, width, turn = [], FIRST_DIGIT, 0
    while True:
        split = active.withColumn("digit", F.substring("rest", 1, width))
        classes = split.groupBy("grp", "digit").agg(
            F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.min("row_id").alias("next_grp")
        )
        classes = over.settle(classes.filter("group_size > 1"), f"classes{turn}")
        over_now = F.length("digit") < width
        turned = split.join(classes.hint("merge"), ["grp", "digit"]).select(
            "row_id", "doc_id", F.col("next_grp").alias("grp"), "group_size", "keep_id", over_now.alias("ended"),
            F.when(~over_now, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        )
        turned = over.settle(turned, f"turn{turn}")
        over.drop(f"classes{turn}")
        ended.append(turned.filter("ended").drop("rest", "ended"))
        active = turned.filter("NOT ended").select("row_id", "doc_id", "grp", "rest")
        if active.isEmpty():
            break
        width, turn = min(width * WIDER, WIDEST), turn + 1
    members = reduce(DataFrame.unionByName, ended)
    stays = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("grp").agg(F.max("row_id").alias("row_id"))
    return members.join(stays.select("row_id", F.lit(True).alias("stays")), "row_id", "left").select(
        "row_id", "keep_id", "group_size", F.coalesce("stays", F.lit(False)).alias("kept")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept; with ``digest`` also the text's SHA-256."""
    over = HandOver(docs.sparkSession)
    rows = over.settle(numbered(texts(docs, id_col, text_col)), "rows")
    members = equal_groups(rows, over)
    extra = [F.sha2("text", 256).alias("text_sha256")] if digest else []
    return rows.select("row_id", "doc_id", *extra).join(members, "row_id", "left").select(
        "doc_id", F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"), *["text_sha256"] * digest,
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay."""
    over = HandOver(docs.sparkSession)
    rows = over.settle(numbered(docs, "__row"), "rows")
    keyed = texts(rows, id_col, text_col, F.col("__row").alias("row_id"))
    gone = equal_groups(keyed, over).filter("NOT kept").select(F.col("row_id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
