"""Conversation structure repair by a retained-subsequence DP.

A repaired conversation reads ``(s?(ua)+)?`` by its roles' initials: perhaps a
system turn, then user and assistant in turn. The DP chooses which turns are
retained, each as it is or with another role, and prices what lies between two
retained turns: the deletions by prefix sums, the insertions by the pair of
roles. A running minimum for each role over the turns already seen (from the
end) gives the cheapest continuation, so a conversation costs time in
proportion to its turns. Of equally cheap edits the ASCII-least audit wins:
as ``D < I < K < R``, that is the longest run of deletions first, then an
insertion, then a kept turn.

A conversation's turns are ordered and its repaired text has one digest, so
one task walks through it; it holds a few bytes and a digest per turn, never
the texts: those pass by once more, in order, when the audit is known.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits; an undeleted truncated turn costs TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a turn; of those that apply the first counts.
SOUND, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Insertions between the last retained role (a row; none, s, u, a) and the next (a column; ends, s, u, a); -1: not allowed.
BETWEEN = ((0, 0, 0, 1), (2, -1, 0, 1), (1, -1, 1, 0), (0, -1, 0, 1))

MEASURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with faults by crc32(``conv_id:turn``) % 20, nulls read as one space there and in role and text.

    0 drops the turn, 1 empties it, 2 takes its ``.!?``, 3 gives it twice, 4
    makes it the user's. Dropped turns stay as rows with ``copies`` 0, so that
    no conversation goes missing. Other columns are not looked at.
    """
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind, text = F.col("kind"), F.coalesce(F.col("text").cast("string"), one)
    return conversations.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("kind")).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), one)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame, *by: str) -> DataFrame:
    """Conversations whole in a partition, their turns in order: null turns first, ties by role and the text's digest."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *by, F.col("turn").asc_nulls_first(), "role", "digest")


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def edits(initials: bytes, faults: bytes) -> tuple[int, str]:
    """The least cost of a repair and the ASCII-least audit at that cost.

    ``initials`` holds NONE, SYSTEM, USER or ASSISTANT for each turn,
    ``faults`` SOUND to IS_TRUNCATED; blank and duplicate turns must go.
    """
    n = len(initials)
    # prefix deletion sums are DELETE * i, as every deletion costs the same
    cheapest, place = [None] * 4, [n] * 4  # by role: DELETE * j + the cost from turn j on, and j
    follow, roles = array("q", [n]) * (4 * (n + 1)), bytearray(4 * (n + 1))

    def onward(i: int, last: int) -> int:
        """The cost of all after turn i, if it is retained as ``last``; its follower goes into the tables."""
        best, far, role = DELETE * (n - i - 1) + INSERT * BETWEEN[last][0], n, NONE
        first = 0
        for r in (SYSTEM, USER, ASSISTANT):
            gap = BETWEEN[last][r]
            if cheapest[r] is None or gap < 0:
                continue
            cost, j = cheapest[r] - DELETE * (i + 1) + INSERT * gap, place[r]
            letter = -1 if gap else 0 if initials[j] == r else 1
            if cost < best or cost == best and far < n and (-j, letter) < (-far, first):
                best, far, role, first = cost, j, r, letter
        follow[4 * (i + 1) + last], roles[4 * (i + 1) + last] = far, role
        return best

    for i in range(n - 1, -1, -1):
        if faults[i] in (IS_BLANK, IS_DUPLICATE):
            continue
        own = DELETE * i + (TRUNCATED if faults[i] == IS_TRUNCATED else 0)
        found = [(r, own + (0 if initials[i] == r else REROLE) + onward(i, r)) for r in (SYSTEM, USER, ASSISTANT) if initials[i] == r or r != SYSTEM]
        for r, cost in found:
            if cheapest[r] is None or cost < cheapest[r]:
                cheapest[r], place[r] = cost, i
    cost, audit, i, last = onward(-1, NONE), [], -1, NONE
    while i < n:
        j, role = follow[4 * (i + 1) + last], roles[4 * (i + 1) + last]
        audit.append("D" * (j - i - 1) + "I" * BETWEEN[last][role])
        if j < n:
            audit.append("K" if initials[j] == role else "R")
        i, last = j, role
    return cost, "".join(audit)


def _next_role(last: int) -> int:
    """The role that must come after ``last``, if it is inserted or given."""
    return ASSISTANT if last == USER else USER


class _Repaired:
    """The digest of a repaired conversation, whose damaged turns are given one after another."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last, self.sha, self.any = audit, 0, NONE, hashlib.sha256(), False

    def _put(self, role: str, text: str, kind: int) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.last = True, kind

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            kind = _next_role(self.last)
            self._put(NAMES[kind], "", kind)
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text, NONE + 1 + "sua".index(role[0]))
        elif edit == "R":
            kind = _next_role(self.last)
            self._put(NAMES[kind], text, kind)

    def hex(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


class _Facts:
    """What is kept of a conversation while its turns go by, in order."""

    def __init__(self) -> None:
        self.initials, self.faults, self.seen = bytearray(), bytearray(), set()
        self.low = self.high = self.distinct = None
        self.illegal = 0

    def turn(self, turn: int | None, initial: str, blank: bool, open_end: bool, digest: str) -> None:
        code, key = "sua".find(initial) + 1 if initial else NONE, bytes.fromhex(digest)
        if turn is not None:
            if self.low is None:
                self.low, self.distinct = turn, 1
            elif turn != self.high:
                self.distinct += 1
            self.high = turn
        if self.initials and (self.initials[-1], code) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.initials.append(code)
        self.faults.append(IS_BLANK if blank else IS_DUPLICATE if key in self.seen else IS_TRUNCATED if open_end else SOUND)
        self.seen.add(key)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        self.seen = set()
        cost, audit = edits(bytes(self.initials), bytes(self.faults))
        return (gaps, *(self.faults.count(x) for x in (IS_BLANK, IS_DUPLICATE, IS_TRUNCATED)), self.illegal, cost, audit)


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its rows) as they come, over the borders of batches."""
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(kinds: str, conv: str) -> tuple[str, list[tuple[str, pa.DataType]]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = f"conv_id {conv}, {kinds}"
    return text, to_arrow_schema(_parse_datatype_string(text))


def measure(damaged: DataFrame) -> DataFrame:
    """``damaged(conv_id, turn, role, text, copies)`` to one row per conversation: its faults, the least cost and the audit.

    The texts stay where they are: a turn is sent as its role's initial, two
    flags and a digest. A conversation of which nothing is left has zeros and
    an empty audit.
    """
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    slim = damaged.select(
        "conv_id", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open_end"), "copies",
    )
    schema, shape = _arrow(MEASURES, damaged.schema["conv_id"].dataType.simpleString())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            facts, now = None, None
            for conv, turn, _, digest, initial, blank, open_end, copies in _runs(parts):
                if facts is None or conv != now:
                    if facts is not None:
                        yield (now, *facts.row())
                    facts, now = _Facts(), conv
                for _ in range(copies):
                    facts.turn(turn, initial, blank, open_end, digest)
            if facts is not None:
                yield (now, *facts.row())

        yield from _batches(rows(), shape)

    return _ordered(slim).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the damaged ``conversations``: its faults, least cost, audit and the repaired conversation's digest.

    A null conv_id is a conversation of its own; a null turn comes first and
    counts in no gap; a null role or text is one space, so such a turn is blank
    or of no role. Rows of the same turn stand by role, then by digest of role
    and text; repeated rows are duplicates. Very long texts are hashed as they
    pass. An empty table gives no rows. Other columns are not looked at.
    """
    small_batches(conversations.sparkSession)
    hurt = damage(conversations)
    told = measure(hurt)
    names = [c for c in told.columns if c != "conv_id"]
    digest = _digest(F.col("role"), F.col("text")).alias("digest")
    nothing = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("copies")]
    heads = told.select("conv_id", F.lit(0).alias("part"), *nothing, F.struct(*names).alias("told"))
    empty = F.lit(None).cast(heads.schema["told"].dataType).alias("told")
    turns = hurt.where("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "role", digest, "text", "copies", empty)
    schema, shape = _arrow(f"{MEASURES}, repaired_sha256 string", hurt.schema["conv_id"].dataType.simpleString())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            head, made = None, None
            for conv, part, _, role, _, text, copies, measures in _runs(parts):
                if part == 0:
                    if head is not None:
                        yield (*head, made.hex())
                    head, made = (conv, *(measures[x] for x in names)), _Repaired(measures["audit"])
                for _ in range(copies):
                    made.turn(role, text)
            if head is not None:
                yield (*head, made.hex())

        yield from _batches(rows(), shape)

    return _ordered(heads.unionByName(turns), "part").mapInArrow(run, schema)
