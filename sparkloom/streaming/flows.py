"""Structured Streaming forms; those without state of their own work on a batch table too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators import metering
from ..sources.scratch import scratch

#: Rows of a key that are Python's at a time.
ROWS = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream; its time has no zone, which a watermark does not take."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 days", slide: str | None = None) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width, slide or width)).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def latest(events: DataFrame) -> DataFrame:
    """The last stage of each key, and when it was reached; of two stages of one time the later event's."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"))


def alive(states: DataFrame, hours: float = 24) -> DataFrame:
    """States that are not older than so long before the last of all."""
    last = states.agg(F.max("ts").alias("last"))
    return states.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.make_interval(hours=F.lit(hours))).drop("last")  # one row


def rate_windows(requests: DataFrame, limit: int = 60, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests by tenant and window, and how many go over the limit."""
    counted = requests.withWatermark("ts", late).groupBy("tenant", F.window("ts", width)).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("tenant", F.col("window.start").alias("start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def daily_ledger(usage: DataFrame, late: str = "2 days") -> DataFrame:
    """Tokens by tenant and UTC day; a day's state goes two days later."""
    summed = usage.withWatermark("ts", late).groupBy("tenant", F.window("ts", "1 day")).agg(F.sum("tokens").alias("tokens"))
    return summed.select("tenant", F.to_date("window.start").alias("day"), "tokens")


class Fold(StatefulProcessor):
    """A step of ``metering`` over a key's rows, in order within a batch, with the state in the store from batch to batch.

    ``until`` tells when a state no longer matters, in microseconds of event
    time: a timer then removes it, once the watermark is there. A state equal
    to the first one is not kept at all. Without ``until`` states stay.
    """

    def __init__(self, columns: tuple[str, ...], order: tuple[str, ...], first: tuple, kind: str, step: Callable[[tuple, tuple], tuple[tuple, tuple]], until: Callable[[tuple], int] | None, names: list[str]) -> None:
        self.columns, self.order, self.first, self.kind, self.step, self.until, self.names = columns, order, first, kind, step, until, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state = tuple(tuple(x) if isinstance(x, list) else x for x in self.held.get()) if self.held.exists() else self.first
        before = state
        for row in self._in_order(rows):
            state, out = self.step(state, row)
            yield Row(**dict(zip(self.names, (*key, *out))))
        if state != before:
            self._keep(state)

    def _in_order(self, rows: Iterator[Row]) -> Iterator[tuple]:
        """A batch's rows of a key, sorted: they wait as Arrow columns, and are Python's ``ROWS`` at a time."""
        held, some = [], []

        def put() -> None:
            held.append(pa.table({c: pa.array(x) for c, x in zip(self.columns, zip(*some))}))
            some.clear()

        for row in rows:
            some.append(tuple(row[c] for c in self.columns))
            if len(some) == ROWS:
                put()
        if some:
            put()
        if held:
            whole = pa.concat_tables(held, promote_options="default").sort_by([(c, "ascending") for c in self.order])
            held.clear()
            for at in range(0, len(whole), ROWS):
                yield from zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns))

    def _keep(self, state: tuple) -> None:
        if self.until is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if state == self.first:
            self.held.clear()
            return
        self.held.update(tuple(list(x) if isinstance(x, tuple) else x for x in state))
        if self.until is not None:
            self.handle.registerTimer(-(-self.until(state) // 1_000))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())


def folded(rows: DataFrame, key: str, columns: tuple[str, ...], order: tuple[str, ...], first: tuple, state: str, step: Callable[[tuple, tuple], tuple[tuple, tuple]], schema: str, until: Callable[[tuple], int] | None = None, late: str = "1 hour") -> DataFrame:
    """``metering.folded`` over a stream, whose rows come in order from batch to batch.

    With ``until`` the rows need ``ts``: their watermark, ``late`` behind the
    latest, is the clock by which states go. Rows later than that are dropped.
    """
    whole = f"`{key}` {rows.schema[key].dataType.simpleString()}, {schema}"
    timed = rows.withWatermark("ts", late) if until else rows
    names = StructType.fromDDL(whole).names
    return timed.groupBy(key).transformWithState(Fold(columns, order, first, state, step, until, names), whole, "append", "eventTime" if until else "none")


def circuit_breaker(calls: DataFrame, threshold: int = 5, open_s: float = 30.0) -> DataFrame:
    """As ``metering.circuit_breaker``, with the state kept from batch to batch; a closed breaker without failures keeps none."""
    rows = calls.select("key", "seq", metering.micros(), "ok")
    return folded(rows, "key", metering.CALL, ("seq",), metering.CLOSED, "name string, failures long, opened double", lambda s, r: metering.breaker_step(s, r, threshold, open_s), metering.BREAKER)


def approvals(actions: DataFrame, ttl_s: float = 600.0, late: str = "1 hour") -> DataFrame:
    """As ``metering.approvals``; what is held goes when it is consumed, or when its time is over by the watermark."""
    rows = actions.select("approval_id", "seq", "ts", metering.micros(), "action", "tenant", "user")
    return folded(
        rows, "approval_id", metering.ACTION, ("seq",), metering.NOBODY, "name string, tenant string, user string, until long",
        lambda s, r: metering.approval_step(s, r, ttl_s), metering.APPROVAL, lambda s: s[3], late,
    )


def admitted(requests: DataFrame, budget: float, limit: int, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """As ``metering.admitted``: permits and ledgers of a tenant in the store, gone when its permits are free and its ledgers past.

    All requests of no tenant share a key, which holds no state.
    """
    return folded(
        metering.admission_rows(requests), "tenant", metering.REQUEST, ("us", "event_id"), metering.IDLE, "days array<bigint>, used array<bigint>, permits array<bigint>",
        lambda s, r: metering.admission_step(s, r, budget, limit, seconds), metering.ADMISSION, lambda s: metering.admission_until(s, seconds), late,
    )


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB for the queries that are started inside; a session's own choice of store is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_to_table(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """All that is there now, run to the end, as a table below the shared folder (or ``path``).

    In mode ``append`` the table grows; in ``complete`` each batch's table
    takes the place of the one before, in a folder of its own.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    with rocksdb(spark):
        return _run(stream, writer, mode, path)


def _run(stream: DataFrame, writer, mode: str, path: str) -> DataFrame:
    spark = stream.sparkSession
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    last: list[str] = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{batch}")
        last[:] = [f"{path}/{batch}"]

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
