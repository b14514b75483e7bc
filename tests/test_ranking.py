"""Order inside hot groups, and sessions in batch and stream."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from auditlake.operators import findings, ranking, traffic
from auditlake.streaming import incremental, sessions


def hot_rows(n=900):
    random.seed(31)
    keys = ["hot"] * (n // 2) + [None] * 20 + [f"k{i % 90}" for i in range(n // 2)]
    return [(k, random.randint(0, 40), i) for i, k in enumerate(keys)]


def test_ranks_equal_a_sort_and_hot_groups_spread(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, at int, id int").repartition(7)
    groups = {}
    for k, at, i in rows:
        groups.setdefault(k, []).append((at, i))
    want = {(k, i): n for k, v in groups.items() for n, (_, i) in enumerate(sorted(v), 1)}
    assert {(r.k, r.id): r.rank for r in ranking.rank_within(df, ["k"], ["at", "id"]).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranking.in_parts(df, ["k"], ["at", "id"])
        assert parts.filter("k = 'hot'").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranking.rank_within(df.filter("false"), ["k"], ["at", "id"]).count() == 0


def test_blocks_of_a_hot_sample(spark):
    lines = [("hot", "tool", "T", i, f"m{i}") for i in range(1200)] + [("cold", "tool", "T", None, None)] * 3
    df = spark.createDataFrame(lines, "sample_id string, tool string, type string, line int, message string").repartition(5)
    blocks = sorted((r.block, r.findings_summary) for r in findings.findings_blocks(df, lines=100).collect() if r.sample_id == "hot")
    assert [b for b, _ in blocks] == list(range(12)) and all(t.count("\n") == 99 for _, t in blocks)
    whole = {r.sample_id: r.findings_summary for r in findings.findings_text(df, most_lines=2000).collect()}
    assert "\n".join(t for _, t in blocks) == whole["hot"] and whole["cold"] == "  [tool] T @ line ?:  (x3)"


def test_stream_and_batch_sessions_agree(spark, tmp_path):
    random.seed(32)
    start, rows = datetime(2024, 1, 1), []
    for user in [0] * 200 + list(range(1, 41)) * 10:
        rows.append((user, start + timedelta(minutes=random.randint(0, 6000), microseconds=random.randint(0, 3))))
    rows += [(77, start), (77, start + timedelta(minutes=30)), (77, start + timedelta(minutes=60, microseconds=1))]
    df = spark.createDataFrame([(u, t, i) for i, (u, t) in enumerate(rows)], "user_id int, ts timestamp, event_id int")
    batch = traffic.sessions(df, gap_minutes=30).groupBy("user_id", "session_no").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    want = sorted((r.user_id, r.a, r.b, r.n) for r in batch.collect())
    assert [w[1:] for w in want if w[0] == 77] == [(start, start + timedelta(minutes=30), 2), (start + timedelta(minutes=60, microseconds=1),) * 2 + (1,)]
    for day in range(6):  # deliveries up to a day out of order, then one that closes everything
        df.filter(F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(start)) + F.col("event_id") % 24 * 3600) / 86400) == day).write.parquet(str(tmp_path / "in" / str(day)))
    spark.createDataFrame([(99, start + timedelta(days=60), 0)], df.schema).write.parquet(str(tmp_path / "in" / "9"))
    stream = incremental.arriving(spark, str(tmp_path / "in"), df.schema, recursiveFileLookup=True, maxFilesPerTrigger=3)
    got = incremental.run_available(sessions.sessions(stream, late="3 days", gap_minutes=30), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.user_id, r.first_ts, r.last_ts, r.requests) for r in got.collect()) == want
