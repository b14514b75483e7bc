"""Session defaults and the few size checks operators rely on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "auditlake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench.  On a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AUDITLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    without that setting gets a fresh temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="auditlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives lost executors)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when the frame has no more than ``rows`` rows; stops reading beyond."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Small inputs over all cores, for row work that costs far more than its bytes.

    Inputs that already have as many partitions as cores are left alone, unless ``rows`` says how many
    rows of that work a task should have: partitions of files may be empty or hold whole row
    groups, so their rows are counted (from the footers), and dealt out evenly if one has more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most > min(rows, -(-total // cores)):
            return df.repartition(max(cores, -(-total // rows)))
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def known_to_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it; where it's installed on the executors, that copy serves."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))
