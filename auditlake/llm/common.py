"""What the operators share: input columns, hand-over tables, and workers' small helpers."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import checkpoint_folder


def known_to_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it; where it's installed on the executors, that copy serves."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only (doc_id, text) and ``more``; a null text is an empty one, columns with clashing names stay outside."""
    known_to_workers(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


class HandOver:
    """Tables written once into the cluster's shared folder and read again.

    A written table cuts the lineage and pins values that a repeated task could
    make differently (row numbers); lost executors don't lose it.  ``drop``
    removes a table as soon as the next one is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, row_col: str = "row_id") -> DataFrame:
    """Adds a number for each row; write the result before using it twice."""
    return docs.withColumn(row_col, F.monotonically_increasing_id())
