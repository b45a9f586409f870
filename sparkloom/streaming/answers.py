"""Answers that come in parts: put in order, guarded as a whole, and sent on as frames.

``parts(conv_id, part, kind, text, ts)`` may come in any order, twice, and over
any number of batches. Kinds: TOKEN (a piece of the answer, numbered from 0),
END and END_TOOL (its number is how many pieces there are, its text the trace
or the calls of tools), ERROR (its text says what happened; it may come at any
number). An answer is let go when its end and all pieces are there: piece by
piece, or as one safe message if the whole text holds a forbidden term, even
one that is split over pieces. An error, or silence for too long, gives one
error frame and nothing of the answer. What comes after is not looked at.

Frames: conv_id, seq (from 0), event, data; messages, then TRACE or TOOL_CALL,
then ``[DONE]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.text import has_any
from ..operators.metering import micros

SAFE, SILENT = "This answer was withheld.", "The answer did not end in time."
MESSAGE, ERROR, TRACE, TOOL_CALL, DONE = "message", "ERROR", "TRACE", "TOOL_CALL", "[DONE]"
FRAMES = "seq int, event string, data string"


def frames_of(pieces: list[str], tool: bool, payload: str, terms: tuple[str, ...], safe: str = SAFE) -> list[tuple[str, str]]:
    """(event, data) of an answer that is complete; empty pieces give no frame."""
    whole = "".join(pieces)
    out = [(MESSAGE, safe)] if any(t in whole for t in terms) else [(MESSAGE, p) for p in pieces if p]
    if not tool or payload:
        out.append((TOOL_CALL if tool else TRACE, payload))
    return [*out, (MESSAGE, DONE)]


class _Buffer(StatefulProcessor):
    """The pieces of one conversation's answer, each an entry of the store, until it is let go; then a mark, until nothing of it can come any more."""

    def __init__(self, terms: tuple[str, ...], wait_s: float, safe: str) -> None:
        self.terms, self.wait, self.safe = terms, round(wait_s * 1_000), safe

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "part long", "text string")
        self.about = handle.getValueState("about", "end long, tool boolean, payload string, held long, done boolean, last long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        end, tool, payload, held, done, last = tuple(self.about.get()) if self.about.exists() else (-1, False, "", 0, False, 0)
        failed = None
        for row in rows:
            last = max(last, row["us"] // 1_000)
            if done:
                continue
            if row["kind"] == "ERROR":
                failed = min(failed or row["text"] or "", row["text"] or "")
            elif row["kind"] in ("END", "END_TOOL"):
                end, tool, payload = row["part"], row["kind"] == "END_TOOL", row["text"] or ""
            elif not self.pieces.containsKey((row["part"],)):
                self.pieces.updateValue((row["part"],), (row["text"] or "",))
                held += 1
        out: list[tuple[str, str]] = []
        if not done and failed is not None:
            out, done = [(ERROR, failed)], True
        elif not done and end >= 0 and held >= end:
            pieces = {k[0]: v[0] for k, v in self.pieces.iterator() if k[0] < end}
            if len(pieces) == end:
                out, done = frames_of([pieces[i] for i in range(end)], tool, payload, self.terms, self.safe), True
        if out:
            self.pieces.clear()
            held = 0
        self.about.update((end, tool, payload, held, done, last))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last + self.wait)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        done = self.about.get()[4] if self.about.exists() else True
        self.pieces.clear()
        self.about.clear()
        yield from self._told(key, [] if done else [(ERROR, SILENT)])

    @staticmethod
    def _told(key: Any, frames: list[tuple[str, str]]) -> Iterator[Row]:
        for seq, (event, data) in enumerate(frames):
            yield Row(conv_id=key[0], seq=seq, event=event, data=data)


def frames(parts: DataFrame, terms: tuple[str, ...] = (), wait_s: float = 60.0, late: str = "10 minutes", safe: str = SAFE) -> DataFrame:
    """The stream of frames; ``wait_s`` of event time without a part ends an answer, by a watermark ``late`` behind the latest."""
    rows = parts.select("conv_id", "part", "kind", "text", "ts", micros()).withWatermark("ts", late)
    kind = parts.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").transformWithState(_Buffer(tuple(terms), wait_s, safe), f"conv_id {kind}, {FRAMES}", "append", "eventTime")


def frames_of_all(parts: DataFrame, terms: tuple[str, ...] = (), safe: str = SAFE) -> DataFrame:
    """The same frames of a table of parts to which nothing is added any more: what has no end is silent."""
    once = parts.groupBy("conv_id", "kind", F.when(F.col("kind") == "TOKEN", F.col("part")).alias("no")).agg(F.min("text").alias("text"), F.max("part").alias("part"))
    token, ends = F.col("kind") == "TOKEN", F.col("kind").isin("END", "END_TOOL")
    per = once.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(token, F.struct("part", F.coalesce("text", F.lit("")).alias("text"))))).alias("all"),
        F.max(F.when(ends, F.col("part"))).alias("end"), F.max(F.when(ends, F.col("kind") == "END_TOOL")).alias("tool"), F.max(F.when(ends, F.coalesce("text", F.lit("")))).alias("payload"),
        F.min(F.when(F.col("kind") == "ERROR", F.coalesce("text", F.lit("")))).alias("failed"),
    )
    pieces = F.transform(F.filter("all", lambda x: x["part"] < F.col("end")), lambda x: x["text"])
    frame = lambda event, data: F.struct(F.lit(event).alias("event"), data.alias("data"))
    hit = has_any(F.array_join("pieces", ""), list(terms), False)
    told = F.when(hit, F.array(frame(MESSAGE, F.lit(safe)))).otherwise(F.transform(F.filter("pieces", lambda p: p != ""), lambda p: frame(MESSAGE, p)))
    last = F.when(~F.col("tool"), F.array(frame(TRACE, F.col("payload")))).when(F.col("payload") != "", F.array(frame(TOOL_CALL, F.col("payload")))).otherwise(F.array().cast("array<struct<event:string,data:string>>"))
    whole = F.concat(told, last, F.array(frame(MESSAGE, F.lit(DONE))))
    out = F.when(F.col("failed").isNotNull(), F.array(frame(ERROR, F.col("failed")))).when(F.col("end").isNotNull() & (F.size("pieces") == F.col("end")), whole).otherwise(F.array(frame(ERROR, F.lit(SILENT))))
    return per.withColumn("pieces", pieces).select("conv_id", F.posexplode(out).alias("seq", "f")).select("conv_id", "seq", "f.event", "f.data")


def answered(frames: DataFrame) -> DataFrame:
    """Frames of whole answers to a row each for the audit: conv_id, status, answer, error, n_frames."""
    text = F.col("event") == MESSAGE
    said = F.array_sort(F.collect_list(F.when(text & (F.col("data") != DONE), F.struct("seq", "data"))))
    failed = F.max(F.when(F.col("event") == ERROR, F.col("data")))
    return frames.groupBy("conv_id").agg(
        F.when(failed.isNull(), F.lit("SUCCESS")).otherwise(F.lit("ERROR")).alias("status"),
        F.when(failed.isNull(), F.array_join(F.transform(said, lambda x: x["data"]), "")).alias("answer"), failed.alias("error"), F.count(F.lit(1)).alias("n_frames"),
    )
