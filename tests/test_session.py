"""Inputs dealt out to tasks."""

from pyspark.sql import functions as F

from auditlake.session import spread


def most_rows(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_row_groups_are_dealt_out_by_rows(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(20_000).selectExpr("id", "sha2(string(id), 256) AS text").coalesce(1).write.parquet(f"{tmp_path}/one")  # one row group
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        df = spark.read.parquet(f"{tmp_path}/one")
        assert df.rdd.getNumPartitions() >= cores and most_rows(df) == 20_000
        dealt = spread(df, rows=500)
        assert most_rows(dealt) <= 600 and dealt.agg(F.sum("id")).first()[0] == 20_000 * 19_999 // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    even = spark.range(0, 800, 1, 2 * cores)
    assert spread(even, rows=500).rdd.getNumPartitions() == 2 * cores
    assert spread(even.filter("false"), rows=500).count() == 0
