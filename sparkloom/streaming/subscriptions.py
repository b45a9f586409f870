"""Events to those who are subscribed to their topic at the time of the event, while subscriptions come and go.

``events(topic, id, ts, body)`` and ``actions(topic, subscriber, seq, ts,
action)``, where an action is SUBSCRIBE or UNSUBSCRIBE. At one time actions
come before events, and of the actions of one subscriber that of the larger
``seq`` is the last. Both forms give (topic, id, subscriber, body).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.window import Window

from ..operators.metering import micros

ACTION, EVENT = 0, 1
#: Events of a topic that meet its subscriptions together.
BLOCK = 64
#: Rows of a desk that wait in one entry of the store, and that are taken and told at a time.
ROWS = 10_000
WAITING = pa.schema([("us", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("given", pa.bool_()), ("who", pa.string()), ("action", pa.string()), ("body", pa.string())])


def delivered(events: DataFrame, actions: DataFrame) -> DataFrame:
    """The batch form: a subscription is a span of places among its topic's events, and meets them by blocks of ``BLOCK`` places.

    A block that lies in a span gives a row for each of its events, so that
    the rows that meet grow with the actions and the rows that come out.
    """
    none = lambda kind: F.lit(None).cast(kind)
    told = events.select("topic", "ts", F.lit(EVENT).alias("kind"), F.lit(None).cast(actions.schema["seq"].dataType).alias("seq"), "id", "body", none(actions.schema["subscriber"].dataType).alias("subscriber"), none("string").alias("action"))
    asked = actions.select("topic", "ts", F.lit(ACTION).alias("kind"), "seq", none(events.schema["id"].dataType).alias("id"), none(events.schema["body"].dataType).alias("body"), "subscriber", "action")
    both = told.unionByName(asked).where("topic is not null and ts is not null").withColumn("hour", F.date_trunc("hour", "ts"))
    # events before a row: those of the hours before, then those of its own
    hours = both.groupBy("topic", "hour").agg(F.count_if(F.col("kind") == EVENT).alias("n"))
    before = Window.partitionBy("topic").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("topic", "hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("topic", "hour").orderBy("ts", "kind", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("place", F.coalesce(F.count_if(F.col("kind") == EVENT).over(within), F.lit(0)))
    placed = placed.join(hours, ["topic", "hour"]).withColumn("place", F.col("place") + F.col("earlier"))
    block = lambda c: F.floor(c / BLOCK)
    known = events.groupBy("topic").agg(F.count("ts").alias("all"))
    order = Window.partitionBy("topic", "subscriber").orderBy("ts", "seq")
    spans = placed.where(F.col("kind") == ACTION).withColumn("until", F.lead("place").over(order)).where("action = 'SUBSCRIBE'")
    spans = spans.join(known, "topic").select("topic", "subscriber", F.col("place").alias("since"), F.coalesce("until", "all").alias("until")).where("since < until")
    spans = spans.select("*", F.explode(F.sequence(block(F.col("since")), block(F.col("until") - 1))).alias("block"))
    met = placed.where(F.col("kind") == EVENT).select("topic", "id", "body", "place", block(F.col("place")).alias("block")).join(spans, ["topic", "block"])
    return met.where("place >= since and place < until").select("topic", "id", "subscriber", "body")


class _Desk(StatefulProcessor):
    """One topic (or a share of it): what has come waits until the watermark has passed it, then is taken in the order of time.

    What waits is kept as Arrow batches, one entry of the store for many rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.readers = handle.getMapState("readers", "who string", "since long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                came = pa.Table.from_pandas(pdf[WAITING.names], WAITING, preserve_index=False)
                self.waiting.appendList(_packed(came))
                first = min(x for x in (first, int(pdf["us"].min())) if x is not None)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, us: int) -> None:
        """One timer, for the first that waits: when it goes off, all that the watermark has passed is taken."""
        at = -(-us // 1_000)
        for other in list(self.handle.listTimers()):
            if other <= at:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1_000
        held = pa.concat_tables([WAITING.empty_table(), *(pa.ipc.open_stream(bytes(x[0])).read_all() for x in self.waiting.get())])
        passed = pc.less_equal(held["us"], now)
        later = held.filter(pc.invert(passed))
        self.waiting.clear()
        if len(later):
            self.waiting.appendList(_packed(later))
        ready = held.filter(passed).sort_by([(c, "ascending") for c in ("us", "kind", "seq", "who")])
        before = {k[0]: v[0] for k, v in self.readers.iterator()}
        readers, out = dict(before), []
        for at in range(0, len(ready), ROWS):
            for us, kind, seq, given, who, action, body in zip(*(c.to_pylist() for c in ready.slice(at, ROWS).columns)):
                if kind == EVENT:
                    out.extend((key[0], seq if given else None, reader, body) for reader in readers)
                    if len(out) >= ROWS:
                        yield _told(out)
                        out = []
                elif action == "SUBSCRIBE":
                    readers[who] = us
                else:
                    readers.pop(who, None)
        if out:
            yield _told(out)
        for who in before.keys() - readers.keys():
            self.readers.removeKey((who,))
        for who, since in readers.items():
            if before.get(who) != since:
                self.readers.updateValue((who,), (since,))
        if len(later):
            self._wake(pc.min(later["us"]).as_py())


def _packed(rows: pa.Table) -> list[tuple[bytes]]:
    """Rows as entries of the store, ``ROWS`` of them each."""
    out = []
    for at in range(0, len(rows), ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, WAITING) as writer:
            writer.write_table(rows.slice(at, ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _told(rows: list[tuple]) -> pd.DataFrame:
    topic, ids, readers, bodies = zip(*rows)
    return pd.DataFrame({"topic": topic, "id": pd.array(ids, "Int64"), "subscriber": readers, "body": bodies})


def stream(events: DataFrame, actions: DataFrame, late: str = "10 minutes", shares: int = 4) -> DataFrame:
    """The same of two streams, ``late`` after what happened.

    A topic's events are dealt out to ``shares`` desks and its actions sent to
    all of them, so that a topic of very many events is not one task's work.
    Null topics and subscribers take no part.
    """
    told = events.where("topic is not null").select("topic", (F.pmod(F.xxhash64("id"), F.lit(shares))).cast("int").alias("share"), "ts", micros(), F.lit(EVENT).alias("kind"), F.coalesce("id", F.lit(0)).alias("seq"), F.col("id").isNotNull().alias("given"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("string").alias("action"), "body")
    asked = actions.where("topic is not null and subscriber is not null").select("topic", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "ts", micros(), F.lit(ACTION).alias("kind"), F.coalesce("seq", F.lit((1 << 63) - 1)).alias("seq"), F.lit(True).alias("given"), F.col("subscriber").alias("who"), "action", F.lit(None).cast("string").alias("body"))
    both = told.unionByName(asked).withWatermark("ts", late)
    return both.groupBy("topic", "share").transformWithStateInPandas(_Desk(), "topic string, id long, subscriber string, body string", "append", "eventTime")
