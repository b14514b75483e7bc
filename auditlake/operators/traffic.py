"""API-traffic checks: templated paths, sessions, id scans, shared resources.

A busy user can own a large part of the traffic, so nothing here orders all
rows of a user in one task: rows are ordered inside range parts of about equal
row counts (see ``ranking``), and parts are stitched with one summary row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.ranking import in_parts

_PART = "__part"


def path_template(path: Column) -> Column:
    """/users/123 -> /users/{id}"""
    return F.regexp_replace(path, r"/\d+(?=/|$)", "/{id}")


def previous(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str = "prev") -> DataFrame:
    """``value`` of the preceding row in (keys, order); ``bucket`` must rise with the order.

    Inside a bucket this is a plain lag; the first row of a bucket takes the
    last value of the key's previous bucket.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.withColumn("_lag", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = df.groupBy(*keys, bucket).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    before = last.withColumn("_before", F.lag("_last").over(across)).drop("_last")
    joined = rows.join(before, [*keys, bucket], "left")
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))).drop(
        "_lag", "_first", "_before"
    )


def sessions(requests: DataFrame, *, gap_minutes: int = 30) -> DataFrame:
    """Adds ``session_no`` per user; ``requests``: user_id, ts and event_id."""
    order, bucket = ["ts", "event_id"], _PART
    rows = previous(in_parts(requests, ["user_id"], order, _PART), ["user_id"], bucket, order, "ts", "_prev_ts")
    fresh = F.col("_prev_ts").isNull() | (F.col("ts") - F.col("_prev_ts") > F.expr(f"interval {gap_minutes} minutes"))
    rows = rows.withColumn("_new", fresh.cast("int")).drop("_prev_ts")
    inside = Window.partitionBy("user_id", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("_new").over(inside))
    opened = rows.groupBy("user_id", bucket).agg(F.sum("_new").alias("_opened"))
    before = Window.partitionBy("user_id").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.withColumn("_offset", F.coalesce(F.sum("_opened").over(before), F.lit(0))).drop("_opened")
    return rows.join(offsets, ["user_id", bucket]).withColumn("session_no", F.col("_offset") + F.col("_local")).drop(
        "_new", "_local", "_offset", _PART
    )


def suspicious_sessions(with_session: DataFrame, *, endpoints: int = 6, requests: int = 15, same_ratio: float = 4.0, scans: int = 1) -> DataFrame:
    """Sessions with many endpoints, many requests, consecutive ids or one endpoint hit often."""
    per_endpoint = with_session.groupBy("user_id", "session_no", "endpoint").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("is_next_id", F.lit(0))).alias("steps")
    )
    s = per_endpoint.groupBy("user_id", "session_no").agg(
        F.sum("n").alias("requests"), F.count(F.lit(1)).alias("endpoints"), F.sum("steps").alias("id_steps"),
    )
    s = s.withColumn("same_ratio", F.round(F.col("requests") / F.col("endpoints"), 4))
    return s.filter(
        (F.col("endpoints") >= endpoints) | (F.col("requests") >= requests) | (F.col("id_steps") >= scans)
        | (F.col("same_ratio") >= same_ratio)
    )


def sequential_ids(requests: DataFrame) -> DataFrame:
    """Adds ``is_next_id``: the numeric parameter is one more than the user's previous on the endpoint."""
    keys, order = ["user_id", "endpoint"], ["ts", "event_id"]
    rows = previous(in_parts(requests, keys, order, _PART), keys, _PART, order, "object_id", "_prev_id")
    return rows.withColumn("is_next_id", F.coalesce((F.col("object_id") - F.col("_prev_id") == 1).cast("int"), F.lit(0))).drop("_prev_id", _PART)


def scan_ratio(stepped: DataFrame, *, threshold: float = 0.3, at_least: int = 3) -> DataFrame:
    """(user, endpoint) pairs whose share of consecutive ids exceeds the threshold."""
    g = stepped.groupBy("user_id", "endpoint").agg(F.count(F.lit(1)).alias("requests"), F.sum("is_next_id").alias("steps"))
    g = g.withColumn("ratio", F.round(F.col("steps") / F.col("requests"), 4))
    return g.filter((F.col("ratio") > threshold) & (F.col("requests") >= at_least))


def shared_resources(requests: DataFrame, *, max_users: int = 5) -> DataFrame:
    """User pairs that touch the same resources, over resources with at most ``max_users`` users.

    A resource many users share says nothing about access control and is left
    out by its user count, before any pairs exist; what remains has at most
    ten pairs per resource.
    """
    touched = requests.select("resource", "user_id").distinct()
    few = touched.groupBy("resource").agg(F.count(F.lit(1)).alias("users")).filter(F.col("users").between(2, max_users))
    groups = touched.join(few.select("resource"), "resource", "left_semi").groupBy("resource").agg(
        F.array_sort(F.collect_list("user_id")).alias("u")
    )
    pairs = F.flatten(
        F.transform("u", lambda a: F.transform(F.filter("u", lambda b: b > a), lambda b: F.struct(a.alias("user_a"), b.alias("user_b"))))
    )
    return groups.select("resource", F.explode(pairs).alias("p")).groupBy("p.user_a", "p.user_b").agg(
        F.count(F.lit(1)).alias("resources")
    )


def dedupe_alerts(alerts: DataFrame) -> DataFrame:
    """Most confident alert per (endpoint, anomaly_type); ties by alert id."""
    best = F.max(F.struct("confidence", (-F.col("alert_id")).alias("neg"))).alias("_b")
    return alerts.groupBy("endpoint", "anomaly_type").agg(best).select(
        "endpoint", "anomaly_type", F.col("_b.confidence").alias("confidence"), (-F.col("_b.neg")).alias("alert_id")
    )
