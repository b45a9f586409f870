"""Best-fit packing of token sequences by exact-complement hashing.

How full a sequence gets depends on lengths only, and there are no more
lengths than a sequence has places. So the plan is made from the histogram of
lengths, a table of at most ``capacity`` counts whatever the corpus: from the
longest length down, what exactly fills its gap is looked up among single
lengths, sums of two and sums of three, and consumed as often as the counts
allow; what no exact complement takes is packed best-fit decreasing. The plan
is a list of patterns with multiplicities; each pattern uses up a length or a
kind of gap, so their number does not grow with the corpus either.

A piece finds its place by its rank among the pieces of its length. A length
may hold a third of all pieces, so ranks come from counts of hash ranges and
no window spans a length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored

CAPACITY, END = 1024, 2
#: Hash ranges of the pieces of one length.
SALTS = 4_096

Pattern = tuple[tuple[int, ...], int]


def byte_bpe(vocabulary: str | None = None, model: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE of 50,257 ids.

    The ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` and
    ``add_special_tokens=False``, special tokens' strings read as plain text;
    ``tiktoken`` makes the same ids of the same vocabulary four times as fast.
    Where its pattern gives up on a text, ``tokenizers`` itself takes over.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_ordinary(text), "<u4")
        except ValueError:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(model or public_tokenizers.path("byte_bpe_50k.json"))
            slow.encode_special_tokens = True
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces: all full but the first, which takes what is left over."""
    whole, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * whole


def pieces(docs: DataFrame, capacity: int = CAPACITY, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe, end: int = END) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, piece, start, length, ids_crc32; a null text is empty. Only numbers leave the task, no ids."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(), np.array([end], "<u4")
        for part in parts:
            at, cols = [], ([], [], [], [])
            for row, text in enumerate(part.column(1)):
                ids = np.concatenate((encode(text.as_py() or ""), last)).astype("<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                    at.append(row)
                    for col, value in zip(cols, (piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        col.append(value)
                    start += length
            numbers = [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *numbers], names=names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _complements(counts: np.ndarray, gap: int, size: int) -> Iterator[tuple[int, ...]]:
    """``size`` (one to three) available lengths, longest first, that sum to ``gap``; ``counts`` may fall meanwhile."""
    if size == 1 and counts[gap]:
        yield (gap,)
    if size == 2:
        for a in range(gap - 1, (gap - 1) // 2, -1):
            if counts[a] and counts[gap - a]:
                yield a, gap - a
    if size == 3:
        for a in range(gap - 2, (gap - 1) // 3, -1):
            left = gap - a
            top, low = min(a, left - 1), (left + 1) // 2  # of b: from the shorter of a and left - 1 down to half of what is left
            if counts[a] and top >= low:
                bs = np.arange(top, low - 1, -1)
                for b in bs[(counts[bs] > 0) & (counts[left - bs] > 0)].tolist():
                    yield a, b, left - b


def _uses(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    return [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """The number of pieces by length to patterns of lengths, each with the number of sequences that it makes.

    Sums of two and three can use up short lengths that best fit needs for
    what has no exact complement. So the plan is made with sums of up to one,
    two and three lengths (the smaller sums for all lengths first, or all
    sums for each length), and the one of fewest sequences is taken.
    """
    def sizes(most: int) -> list[tuple[int, ...]]:
        return [(k,) for k in range(1, most + 1)]

    rounds = [sizes(3), sizes(2), sizes(1), [(1, 2, 3)], [(1, 2)], []]
    made = [_plan(counts, capacity, r) for r in rounds]
    return min(made, key=lambda patterns: sum(times for _, times in patterns))


def _plan(counts: dict[int, int], capacity: int, rounds: list[tuple[int, ...]]) -> list[Pattern]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[Pattern] = []

    def take(pattern: tuple[int, ...]) -> None:
        times = min(int(left[x]) // k for x, k in _uses(pattern))
        if times > 0:
            for x, k in _uses(pattern):
                left[x] -= k * times
            done.append((pattern, times))

    take((capacity,))
    for sizes in rounds:
        for longest in range(capacity - 1, 0, -1):
            for size in sizes:
                if left[longest]:
                    for rest in _complements(left, capacity - longest, size):
                        take((longest, *rest))
                        if not left[longest]:
                            break
    return done + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: a length goes to the smallest gap that takes it, as often as the gap does, before a new sequence is begun."""
    gaps: list[int] = []  # sorted, of sequences that are begun
    begun: dict[int, list[Pattern]] = {}

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in begun:
            insort(gaps, gap)
            begun[gap] = []
        begun[gap].append((pattern, times))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                if n >= per:
                    put((length,) * per, n // per)
                if n % per:
                    put((length,) * (n % per), 1)
                break
            gap = gaps[at]
            pattern, times = begun[gap].pop()
            if not begun[gap]:
                del begun[gap], gaps[at]
            per = gap // length
            full = min(times, n // per)
            if full:
                put(pattern + (length,) * per, full)
                n -= full * per
            if times > full and 0 < n < per:
                put(pattern + (length,) * n, 1)
                n, full = 0, full + 1
            if times > full:
                put(pattern, times - full)
    return [p for gap in gaps for p in begun[gap]]


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the first rank of each of its runs of pieces, the run's first sequence, and the offset there."""
    used: dict[int, int] = {}
    runs: dict[int, tuple[list, list, list]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            for col, value in zip(runs.setdefault(length, ([], [], [])), (used.get(length, 0), sequence, offset)):
                col.append(value)
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in cols) for length, cols in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, encoder: Callable[[], Callable[[str], np.ndarray]] = byte_bpe, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end``; a longer one than ``capacity`` is
    cut from its end. Null and empty texts are one id. Null ids and repeated
    rows are documents of their own, an empty table gives no rows, other
    columns are not looked at. The same rows give the same sequences.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    cut = stored(pieces(docs, capacity, encoder, end).withColumn("salt", salt))
    cells = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    found = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = found.value
        for part in parts:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length).tolist():
                here = length == one
                first, sequences, offsets = runs[one]
                at = np.searchsorted(first, rank[here], "right") - 1
                sequence[here], offset[here] = sequences[at] + rank[here] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
