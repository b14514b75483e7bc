"""Streaming forms: scan of arriving functions; see ``suppression`` for repeated requests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditlake.operators import extract, static_scan
from auditlake.session import checkpoint_folder


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """File stream with an explicit schema."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def scan_functions(stream: DataFrame) -> DataFrame:
    """The static scan is stateless, so the stream form is the batch form."""
    return static_scan.scan(stream)


def scan_files(stream: DataFrame) -> DataFrame:
    """Arriving source files (file, language, content) into slices."""
    return static_scan.scan(extract.split_functions(stream))


def run_available(stream: DataFrame, table_path: str, state_path: str) -> DataFrame:
    """Processes what arrived since the last call, exactly once, and returns the whole table.

    Both paths are the caller's and belong together: a second call with them
    handles new files only and adds to the table.
    """
    query = (
        stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", state_path)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table_path)


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """New table and state paths in the session's shared folder, for a stream that starts anew."""
    base = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/state"
