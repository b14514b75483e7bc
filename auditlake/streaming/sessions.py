"""Sessions of arriving requests, by session windows and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sessions of a busy user are merged in each task before they move.
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def sessions(requests: DataFrame, *, late: str, gap_minutes: int = 30, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """user, first_ts, last_ts, requests of every session that has ended, as ``traffic.sessions`` cuts them.

    A session goes on while requests are at most ``gap_minutes`` apart.  It ends, and is
    given out, when the watermark (newest time less ``late``) is past that gap; requests that come
    later than ``late`` are dropped, and a session still open is kept as state, one row each.
    """
    requests.sparkSession.conf.set(MERGE_FIRST, "true")
    window = F.session_window("at", f"{gap_minutes} minutes")
    timed = requests.filter(F.col(user).isNotNull()).select(user, F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    found = timed.groupBy(user, window.alias("w")).agg(F.max(F.unix_micros("at")).alias("last_us"), F.count(F.lit(1)).alias("requests"))
    return found.select(user, F.col("w.start").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "requests")
