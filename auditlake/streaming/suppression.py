"""Suppression of repeated requests: one request per key and life time, counted from the request that was asked.

A request is asked if none of its key was asked in the ``hours`` before it; otherwise it is a
repeat.  That depends on the order of the requests in time, not of arrival, so a
request is decided once no earlier one can come any more: when the stream's watermark,
the newest time seen less ``late``, has passed it.  Keyed state holds the undecided times and the
times last asked.  It is kept for a bucket of keys (by hash) and not for a key, as packed tables: undecided rows are appended
as they come, and a timer per bucket puts them in order, decides those that can be decided, keeps the others and forgets keys whose
last request has expired.  So a bucket costs a few calls of the state a batch, however many keys and rows it has, and a row
costs a step of a loop.  How the rows are split into batches can't change what is asked, as
long as no row comes more than ``late`` behind the newest one before its batch; the
rows that do are written to a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditlake.session import known_to_workers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_HOUR = 3_600_000_000
#: Buckets of keys (a state folder is bound to that number), and rows of one packed table at most.
BUCKETS = 1_024
PACKED_ROWS = 50_000
_ROW = pa.schema([("key", pa.string()), ("at", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _ROW) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def _table(keys: list[str], times: list[int]) -> pa.Table:
    return pa.table([pa.array(keys, pa.string()), pa.array(times, pa.int64())], schema=_ROW)


class AskOnce(StatefulProcessor):
    """Rows are (key, at) of the keys of one group, or (at) where the group is a key.

    Times are microseconds; timers are milliseconds, rounded up so that they never ring early.
    """

    def __init__(self, hours: int):
        self.life = hours * _HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "bell bigint, first bigint")  # first undecided time
        self.asked = handle.getValueState("asked", "rows binary")  # time last asked of each key
        self.open = handle.getListState("open", "rows binary")  # undecided rows

    def _set(self, bell: int | None, first: int | None, end: int | None) -> None:
        """With the bell set to the first undecided time, else to the end of all requests' lives."""
        at = first if first is not None else end
        ms = None if at is None else -(-at // 1000)
        if bell is not None and bell != ms:
            self.handle.deleteTimer(bell)
        if ms is None:
            self.status.clear()
            return
        if bell != ms:
            self.handle.registerTimer(ms)
        self.status.update((ms, first))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bell, first = self.status.get() or (None, None)
        held: list[pa.Table] = []

        def keep() -> None:
            found = pa.concat_tables(held).group_by(["key", "at"], use_threads=False).aggregate([]).combine_chunks()
            self.open.appendList([(_packed(found),)])
            held.clear()

        for frame in rows:
            frame = frame[frame["at"].notna()]
            if len(frame):
                times = frame["at"].astype("int64").tolist()
                held.append(_table(frame["key"].tolist() if "key" in frame else [key[0]] * len(times), times))
                first = min(times) if first is None else min(first, min(times))
            if sum(map(len, held)) >= PACKED_ROWS:
                keep()
        if held:
            keep()
        if first is not None:
            self._set(bell, first, None)
        return iter([])

    def _decided(self, rows: pa.Table, asked: dict[str, int], now: int) -> tuple[tuple[list, list], tuple[list, list]]:
        """(keys, times) to ask by ``now``, and those still undecided; ``asked`` is brought up to date."""
        ask, later, life = ([], []), ([], []), self.life
        of = before = last = None
        for part in rows.sort_by([("key", "ascending"), ("at", "ascending")]).to_batches(max_chunksize=10_000):
            for key, at in zip(*(column.to_pylist() for column in part.columns)):
                if key != of:
                    of, last = key, asked.get(key)
                elif at == before:
                    continue
                before = at
                if last is not None and last <= at < last + life:
                    continue
                if at <= now:
                    asked[key] = last = at
                keys, times = ask if at <= now else later
                keys.append(key)
                times.append(at)
        return ask, later

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, first = self.status.get() or (None, None)
        now, known = timerValues.getCurrentWatermarkInMs() * 1000, self.asked.get()
        asked = dict(zip(*(column.to_pylist() for column in _unpacked(known[0]).columns))) if known else {}
        rows = pa.concat_tables([_ROW.empty_table(), *(_unpacked(value) for (value,) in self.open.get())]) if first is not None else _ROW.empty_table()
        (keys, times), later = self._decided(rows, asked, now)
        open_yet = _table(*later)
        if len(open_yet):
            self.open.put([(_packed(open_yet.slice(n, PACKED_ROWS)),) for n in range(0, len(open_yet), PACKED_ROWS)])
        elif first is not None:
            self.open.clear()
        asked = {k: at for k, at in asked.items() if at + self.life > now}
        if asked:
            self.asked.update((_packed(_table([*asked], [*asked.values()])),))
        elif known:
            self.asked.clear()
        self._set(None, min(later[1], default=None), max(asked.values()) + self.life if asked else None)  # this bell has rung
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "at": pd.Series(times, dtype="int64")})

    def close(self) -> None:
        pass


def suppress_repeats(requests: DataFrame, *, late: str, key: str = "request_id", ts: str = "ts", hours: int = 24) -> DataFrame:
    """(key, asked_at) of the requests to ask, once the watermark has passed them; rows later than ``late`` are dropped here.

    ``run`` keeps those rows.  Null keys and null times are no requests.  The state
    needs the RocksDB store; ``run`` sets it, other callers set it for their session.
    """
    known_to_workers(requests.sparkSession)
    timed = requests.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("asked_at"))
    timed = timed.withWatermark("asked_at", late).withColumn("at", F.unix_micros("asked_at"))
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    asked = timed.groupBy("bucket").transformWithStateInPandas(AskOnce(hours), "key string, at bigint", "Append", "EventTime")
    return asked.select(F.col("key").alias(key), F.timestamp_micros("at").alias("asked_at"))


def split_by_lateness(requests: DataFrame, base: str, *, late: str, ts: str) -> None:
    """Writes what arrived to ``base``/on_time or ``base``/late, by the newest time of earlier batches.

    Each batch has its own folders, so a repeated batch replaces what it wrote before.
    """
    spark, at = requests.sparkSession, F.col(ts).cast("timestamp")
    marks = "newest timestamp, batch bigint"

    def split(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(marks).option("recursiveFileLookup", True).parquet(f"{base}/marks").filter(F.col("batch") < number)
        newest = earlier.agg(F.max("newest")).first()[0]
        too_late = F.lit(False) if newest is None else F.coalesce(at <= F.lit(newest) - F.expr(f"interval {late}"), F.lit(False))
        seen = Observation()
        batch.observe(seen, F.max(at).alias("newest")).filter(~too_late).write.mode("overwrite").parquet(f"{base}/on_time/{number}")
        batch.filter(too_late).write.mode("overwrite").parquet(f"{base}/late/{number}")
        spark.createDataFrame([(seen.get["newest"], number)], marks).coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/{number}")

    for name, schema in (("on_time", requests.schema), ("late", requests.schema), ("marks", marks)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}/start")
    requests.writeStream.foreachBatch(split).option("checkpointLocation", f"{base}/split-state").trigger(availableNow=True).start().awaitTermination()


def run(requests: DataFrame, base: str, *, late: str, key: str = "request_id", ts: str = "ts", hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Handles what arrived since the last call with this ``base`` folder, exactly once.

    Returns all requests asked so far (key, asked_at) and all rows that came too late (the input's columns).
    """
    spark = requests.sparkSession
    split_by_lateness(requests, base, late=late, ts=ts)
    on_time = spark.readStream.schema(requests.schema).option("recursiveFileLookup", True).parquet(f"{base}/on_time")
    asked = suppress_repeats(on_time, late=late, key=key, ts=ts, hours=hours)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        query = asked.writeStream.format("parquet").option("path", f"{base}/asked").option("checkpointLocation", f"{base}/asked-state")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    late_rows = spark.read.schema(requests.schema).option("recursiveFileLookup", True).parquet(f"{base}/late")
    return spark.read.schema(asked.schema).parquet(f"{base}/asked"), late_rows
