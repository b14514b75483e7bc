"""API-traffic checks over the events, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog import derived, sqltext as sq
from auditlake.catalog.registry import query, table
from auditlake.operators import traffic as tr
from auditlake.streaming import incremental as inc, sessions as stream_form, suppression

# One event is one request: the endpoint by type, the object id from the value.
REQUESTS = """
SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS object_id,
       concat('/api/', event_type, '/', CAST(floor(value) AS BIGINT)) AS path,
       concat(event_type, '/', CAST(floor(value * 100) AS BIGINT)) AS resource, value
FROM {events}
"""
_REQ = f"req AS (SELECT *, regexp_replace(path, '/[0-9]+$', '/{{id}}') AS endpoint FROM {derived.cte(REQUESTS)} r)"
_SESS = f"""{_REQ},
g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lag(object_id) OVER (PARTITION BY user_id, endpoint ORDER BY ts, event_id) AS o FROM req),
s AS (SELECT *, CASE WHEN object_id - o = 1 THEN 1 ELSE 0 END AS step,
             CAST(sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 180 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM g)"""


def _requests(spark, sf):
    r = derived.derive(spark, sf, REQUESTS)
    return r.withColumn("endpoint", tr.path_template(F.col("path")))


@query("path_templates", f"WITH {_REQ} SELECT endpoint, count(*) AS requests, count(DISTINCT path) AS paths FROM req GROUP BY endpoint")
def path_templates(spark, sf):
    per = _requests(spark, sf).groupBy("endpoint", "path").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("endpoint").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("paths"))


@query("traffic_sessions", f"WITH {_SESS} SELECT event_id, user_id, session_no FROM s")
def traffic_sessions(spark, sf):
    return tr.sessions(_requests(spark, sf), gap_minutes=180).select("event_id", "user_id", "session_no")


@query(
    "suspicious_sessions",
    f"""WITH {_SESS}, a AS (SELECT user_id, session_no, count(*) AS requests, count(DISTINCT endpoint) AS endpoints, CAST(sum(step) AS BIGINT) AS id_steps FROM s GROUP BY ALL)
SELECT *, round(requests / endpoints, 4) AS same_ratio FROM a WHERE endpoints >= 5 OR requests >= 15 OR id_steps >= 1 OR requests / endpoints >= 4""",
)
def suspicious_sessions(spark, sf):
    rows = tr.sessions(tr.sequential_ids(_requests(spark, sf)), gap_minutes=180)
    return tr.suspicious_sessions(rows, endpoints=5)


@query(
    "sequential_id_scan",
    f"""WITH {_SESS}, a AS (SELECT user_id, endpoint, count(*) AS requests, CAST(sum(step) AS BIGINT) AS steps FROM s GROUP BY ALL)
SELECT *, round(steps / requests, 4) AS ratio FROM a WHERE round(steps / requests, 4) > 0.01 AND requests >= 3""",
)
def sequential_id_scan(spark, sf):
    return tr.scan_ratio(tr.sequential_ids(_requests(spark, sf)), threshold=0.01)


@query(
    "shared_resources",
    f"""WITH {_REQ}, t AS (SELECT DISTINCT resource, user_id FROM req), f AS (SELECT resource FROM t GROUP BY resource HAVING count(*) BETWEEN 2 AND 5)
SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS resources FROM t a JOIN t b ON a.resource = b.resource AND a.user_id < b.user_id
WHERE a.resource IN (SELECT resource FROM f) GROUP BY ALL""",
)
def shared_resources(spark, sf):
    return tr.shared_resources(_requests(spark, sf))


@query(
    "alert_dedupe",
    f"""WITH {_REQ}, a AS (SELECT path AS endpoint, CASE event_id % 3 WHEN 0 THEN 'scan' ELSE 'burst' END AS anomaly_type, value AS confidence, event_id AS alert_id FROM req)
SELECT endpoint, anomaly_type, confidence, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, anomaly_type ORDER BY confidence DESC, alert_id) AS rn FROM a) x WHERE rn = 1""",
)
def alert_dedupe(spark, sf):
    r = _requests(spark, sf)
    return tr.dedupe_alerts(
        r.select(
            F.col("path").alias("endpoint"), F.when(F.col("event_id") % 3 == 0, "scan").otherwise("burst").alias("anomaly_type"),
            F.col("value").alias("confidence"), F.col("event_id").alias("alert_id"),
        )
    )


# --- streaming forms ------------------------------------------------------------


def _event_stream(spark, sf):
    return inc.arriving(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema)


@query(
    "stream_scan",
    sq.SCAN + " SELECT sample_id, sink_type, sink_category, risk_level, dataflow_path, ast_confidence FROM slices",
)
def stream_scan(spark, sf):
    """Functions arriving as files, scanned as they come."""
    arriving = spark.sql(derived.CODE, events=_event_stream(spark, sf))
    out = inc.scan_functions(arriving).select("sample_id", "sink_type", "sink_category", "risk_level", "dataflow_path", "ast_confidence")
    return inc.run_available(out, *inc.fresh_paths(spark, "scan"))


@query(
    "stream_sessions",
    f"""WITH {_SESS}, a AS (SELECT user_id, session_no, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS requests FROM s GROUP BY ALL)
SELECT user_id, first_us, last_us, requests FROM a WHERE last_us + 10800000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM req)""",
)
def stream_sessions(spark, sf):
    """Sessions that have ended, from the stream; those whose gap isn't over yet are still open."""
    found = stream_form.sessions(_event_stream(spark, sf), late="0 seconds", gap_minutes=180)
    out = inc.run_available(found, *inc.fresh_paths(spark, "sessions"))
    return out.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "requests")


# Requests arrive in three deliveries, up to seven hours out of order.
_DELIVERY = "least(2, cast(floor((unix_timestamp(ts) - unix_timestamp(timestamp'2024-01-01 00:00:00') + event_id % 8 * 3600) / 864000) as int))"


@query(
    "stream_request_suppression",
    """WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS request_id, epoch_us(ts) AS us FROM events),
d AS (SELECT * FROM e WHERE us <= (SELECT max(us) // 1000 * 1000 - 8 * 3600000000 FROM e)),
a AS (SELECT request_id, min(us) AS us FROM d GROUP BY request_id
      UNION ALL SELECT a.request_id, (SELECT min(d.us) FROM d WHERE d.request_id = a.request_id AND d.us >= a.us + 86400000000) FROM a WHERE a.us IS NOT NULL)
SELECT request_id, us AS asked_us, CAST(0 AS BIGINT) AS late_rows FROM a WHERE us IS NOT NULL""",
)
def stream_request_suppression(spark, sf):
    """A request is asked once in 24 hours from the time it was asked; those of the last 8 hours are still undecided."""
    base, arrivals = inc.fresh_paths(spark, "suppress")
    events = table(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    asked = late = None
    for delivery in range(3):
        events.filter(F.expr(_DELIVERY) == delivery).write.parquet(f"{arrivals}/{delivery}")
        stream = inc.arriving(spark, arrivals, events.schema, recursiveFileLookup=True)
        asked, late = suppression.run(stream, base, late="8 hours")
    return asked.select("request_id", F.unix_micros("asked_at").alias("asked_us")).join(F.broadcast(late.agg(F.count(F.lit(1)).alias("late_rows"))))
