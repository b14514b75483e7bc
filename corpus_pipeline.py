"""The corpus pipeline: documents through five operators, each result written and read as the next one's input.

A null text is an empty one to every stage and stays null in the rows; all null and empty texts are copies of each
other.  A row without an id is kept like others, but goes before rows with one where copies go.  Repeated
rows are copies.  An empty table stays empty.  Columns beside the id and the text, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import best_fit, containment, edit_near_dedup, radix_dedup, toxic_segments
from auditlake.llm.common import HandOver
from auditlake.llm.queries import table, toxicity_model, word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows whose toxicity score is 0.3 or more go."""
    return toxic_segments.without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), reject_at=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts the row with the largest id stays."""
    return radix_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each near-duplicate class the row with the smallest id stays."""
    return edit_near_dedup.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows that hold a benchmark item go."""
    return containment.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: what is left, packed into sequences of 2,048 ids."""
    return best_fit.pack(docs, word_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the scores nor the edit distances nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, over = table(spark, sf_dir, "documents"), HandOver(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = over.settle(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            over.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
