"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when a string of ``SPAN`` bytes that covers it starts anywhere else
too. Suffixes are not all sorted against all: every string of that length holds
an anchor, the place whose ``GRAM`` bytes have the smallest hash of all places
in the string, and equal strings hold equal anchors at equal places. So only
what stands around equal anchors is compared, in these steps:

1. All anchors are found; those that stand once are done.
2. Anchors whose whole surroundings (all strings that can hold them) are equal
   to others' are repeated throughout.
3. The rest of an anchor's surroundings, with one of each of the equal ones, are
   suffix-sorted twice, by what follows the anchor and (backwards) by what stands
   before it: a merge sort that compares two suffixes by the length of their
   common extension, found by binary search over prefix polynomial hashes. The
   finished order is verified on the bytes of all neighbours, which also gives
   their exact extensions; after a collision the bytes are sorted instead.
4. Two surroundings that have L bytes before and R bytes after the anchor in
   common share the strings that start 400 - R to L bytes before it. Surroundings
   are joined from the longest L on; of those joined so far, a suffix's
   neighbours in the other order have its largest R.

An anchor with more than ``GROUP`` different surroundings is not sorted in one
task: Spark counts digests of ever narrower ranges of its strings, see
``_by_halving``, with the same result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

SPAN, GRAM, GROUP, BATCH = 400, 64, 65_536, 4_096
REACH = SPAN - GRAM  # the furthest that a string holding an anchor starts before it
WIDTH = REACH + SPAN
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 19
BROADCAST_ROWS = 200_000
ALL = (1 << 64) - 1
#: Prefix hashes are kept for each so many bytes.
EVERY = 8
#: Into how many parts a range of starts is cut in each round.
PARTS = 8


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE, CHUNK + SPAN + GRAM), _powers(INVERSE, CHUNK + SPAN + GRAM)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes at each place, from prefix polynomial hashes modulo 2 ** 64."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=prefix[1:])
    h = (prefix[GRAM:] - prefix[:-GRAM]) * _DOWN[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _sliding(f: np.ufunc, x: np.ndarray, w: int, pad: int) -> np.ndarray:
    """``f`` over each ``w`` elements in a row."""
    n = len(x)
    rows = np.concatenate([x, np.full(-n % w, pad, x.dtype)]).reshape(-1, w)
    to, after = f.accumulate(rows, axis=1).ravel(), f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[: n - w + 1], to[w - 1 : n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors, in order."""
    places, hashes, w = [], [], REACH + 1
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - SPAN + 1, CHUNK):
        h = gram_hashes(raw[at : at + CHUNK + SPAN - 1])
        low = _sliding(np.minimum, h, w, ALL)
        # of the windows that hold a place, the largest minimum: its own hash if it is the least of one of them
        edge = np.zeros(w - 1, np.uint64)
        high = _sliding(np.maximum, np.concatenate([edge, low, edge]), w, 0)
        here = np.flatnonzero(high == h)
        places.append(here + at)
        hashes.append(h[here])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first].view(np.int64)


class Surroundings:
    """The bytes around anchors, a row for each, with the anchor at place ``REACH``; absent bytes are zero, others one more than their value."""

    def __init__(self, data: list[bytes], before: list[int]):
        self.left = np.array(before, np.int64)
        self.right = np.array([len(d) for d in data], np.int64) - self.left
        self.bytes = np.zeros((len(data), WIDTH), np.uint16)
        for row, d, b in zip(self.bytes, data, before):
            row[REACH - b : REACH - b + len(d)] = np.frombuffer(d, np.uint8)
            row[REACH - b : REACH - b + len(d)] += 1
        #: Prefix hashes that count from the anchor: equal bytes between it and a place have equal hashes there.
        self.prefix = np.zeros((len(data), WIDTH // EVERY + 1), np.uint64)
        for at in range(0, len(data), BATCH):
            sums = np.cumsum(self.bytes[at : at + BATCH] * _UP[:WIDTH], axis=1)
            self.prefix[at : at + BATCH, 1:] = sums[:, EVERY - 1 :: EVERY]
        self.prefix -= self.prefix[:, REACH // EVERY : REACH // EVERY + 1].copy()

    def extension(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many bytes from the anchor on (``way`` 1), or before it (-1), rows ``a`` and ``b`` have in common.

        Binary search over the prefix hashes finds the block of ``EVERY`` bytes
        in which they part, and its bytes the place.
        """
        wide, limit = self.prefix.shape[1], (SPAN if way > 0 else REACH) // EVERY
        flat, p, q = self.prefix.ravel(), a * wide + REACH // EVERY, b * wide + REACH // EVERY
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit + 1)
        for _ in range(limit.bit_length()):
            mid = low + high >> 1
            same = flat[p + way * mid] == flat[q + way * mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid)
        at = np.minimum(low, limit - 1) * EVERY
        block = np.arange(EVERY)
        where = (REACH + at[:, None] + block) if way > 0 else (REACH - 1 - at[:, None] - block)
        unlike = self.bytes[a[:, None], where] != self.bytes[b[:, None], where]
        return np.where(low == limit, limit * EVERY, at + np.where(unlike.any(1), unlike.argmax(1), EVERY))

    def compare(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """The order of two suffixes (-1, 0, 1): that of the bytes after their common extension."""
        n, limit = self.extension(a, b, way), SPAN if way > 0 else REACH
        at = np.minimum(n, limit - 1)
        at = REACH + at if way > 0 else REACH - 1 - at
        return np.where(n == limit, 0, np.sign(self.bytes[a, at].astype(np.int32) - self.bytes[b, at]))

    def sort(self, first: np.ndarray, last: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each group in order, and the common extension of each with the next, verified on the bytes.

        ``first`` and ``last`` are where a row's group begins and ends.
        """
        order = self._merge_sorted(first, last, way)
        shared, sorted_ = self._verified(order, first, way)
        if not sorted_:  # a collision misled the sort
            side = self.bytes[:, REACH:] if way > 0 else self.bytes[:, REACH - 1 :: -1]
            order = np.array(sorted(range(len(first)), key=lambda i: (first[i], side[i].astype(">u2").tobytes())), np.int64)
            shared, _ = self._verified(order, first, way)
        return order, shared

    def _merge_sorted(self, first: np.ndarray, last: np.ndarray, way: int) -> np.ndarray:
        """A bottom-up merge sort of all groups at once; each row finds its place in the run beside its own by binary search."""
        order, slots, width = np.arange(len(first)), np.arange(len(first)), 1
        most = int((last - first).max(initial=0))
        while width < most:
            place = slots - first
            run = place // width
            begin = np.minimum(first + (run ^ 1) * width, last)
            low, high, later = begin.copy(), np.minimum(begin + width, last), run & 1 == 1
            while len(open_ := np.flatnonzero(low < high)):
                mid = low[open_] + high[open_] >> 1
                sign = self.compare(order[mid], order[open_], way)
                ahead = (sign < 0) | (sign == 0) & later[open_]
                low[open_], high[open_] = np.where(ahead, mid + 1, low[open_]), np.where(ahead, high[open_], mid)
            merged = np.empty_like(order)
            merged[first + (run & ~1) * width + place % width + low - begin] = order
            order, width = merged, 2 * width
        return order

    def _verified(self, order: np.ndarray, first: np.ndarray, way: int) -> tuple[np.ndarray, bool]:
        """The true extensions of neighbours, and whether all stand in order."""
        side = self.bytes[:, REACH:] if way > 0 else self.bytes[:, REACH - 1 :: -1]
        shared, right = np.zeros(max(0, len(order) - 1), np.int64), True
        for at in range(0, len(shared), BATCH):
            a, b = side[order[at : at + BATCH][: len(shared) - at]], side[order[at + 1 : at + 1 + BATCH]]
            unlike = a != b
            n = np.where(unlike.any(1), unlike.argmax(1), side.shape[1])
            here = np.arange(len(n))
            stop = np.minimum(n, side.shape[1] - 1)
            grouped = first[at : at + len(n)] == first[at + 1 : at + 1 + len(n)]
            right &= bool((~grouped | (a[here, stop] <= b[here, stop])).all())
            shared[at : at + BATCH] = np.where(grouped, n, -1)
        return shared, right


def _meetings(before: list[int], rank: list[int], base: int) -> list[tuple[int, int, int]]:
    """(rank, rank, L): suffixes that stand beside each other among those that have L or more bytes before the anchor in common.

    ``before`` has the common bytes of neighbours in the backward order, and
    ``rank`` the places in the other order of the suffixes of that order.
    """
    out: list[tuple[int, int, int]] = []
    begin, sets = list(range(len(rank))), {i: [r] for i, r in enumerate(rank)}  # a set's first place, kept at its last; its ranks, at its first
    end = list(range(len(rank)))
    for k in sorted(range(len(before)), key=before.__getitem__, reverse=True):
        a, b, shared = begin[k], k + 1, before[k]
        large, small = sets[a], sets.pop(b)
        if len(large) < len(small):
            large, small = small, large
        for r in small:
            at = bisect_left(large, r)
            if at:
                out.append((base + r, base + large[at - 1], shared))
            if at < len(large):
                out.append((base + r, base + large[at], shared))
            large.insert(at, r)
        sets[a] = large
        begin[end[b]], end[a] = a, end[b]
    return out


def repeated(data: list[bytes], before: list[int], sizes: list[int]) -> list[tuple[int, int, int]]:
    """Of surroundings in groups of ``sizes``: (row, least, most), ranges of starts before the anchor at which a string begins that another of the group has too."""
    x = Surroundings(data, before)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    first, last = np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)
    after, follows = x.sort(first, last, 1)
    ahead, precedes = x.sort(first, last, -1)
    rank = np.empty(len(after), np.int64)
    rank[after] = np.arange(len(after))
    ranks, shared = rank[ahead].tolist(), precedes.tolist()
    pairs: list[tuple[int, int, int]] = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a == 2:
            pairs.append((a, a + 1, shared[a]))
        elif b - a > 2:
            pairs += _meetings(shared[a : b - 1], [r - a for r in ranks[a:b]], a)
    if not pairs:
        return []
    one, two, both = np.array(pairs, np.int64).T
    low, high = np.minimum(one, two), np.maximum(one, two)
    # the least of the neighbours' extensions between the two
    tables = [follows]
    while 1 << len(tables) <= len(follows):
        half = 1 << len(tables) - 1
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    level = np.frexp((high - low).astype(float))[1] - 1
    ahead_of = np.empty(len(low), np.int64)
    for k in np.unique(level).tolist():
        here = level == k
        ahead_of[here] = np.minimum(tables[k][low[here]], tables[k][high[here] - (1 << k)])
    rows = after[np.concatenate([low, high])]
    least = np.maximum(0, SPAN - np.minimum(np.tile(ahead_of, 2), x.right[rows]))
    most = np.minimum(np.tile(both, 2), x.left[rows])
    keep = least <= most
    rows, least, most = rows[keep], least[keep], most[keep]
    turn = np.lexsort((least, rows))
    out: list[list[int]] = []
    for row, a, b in zip(rows[turn].tolist(), least[turn].tolist(), most[turn].tolist()):
        if out and out[-1][0] == row and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([row, a, b])
    return [tuple(r) for r in out]


def _found(key: str) -> str:
    return f"{key}, ah long, cd binary, at int, size int"


def _anchor_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per anchor: document, hash, digest of its surroundings, place, bytes of the document."""
    for pdf in parts:
        ids, tks, ahs, cds, ats, sizes = [], [], [], [], [], []

        def batch() -> pd.DataFrame:
            return pd.DataFrame({"doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype if len(ids) else None), "tk": tks, "ah": ahs, "cd": cds, "at": ats, "size": sizes})

        for doc_id, tk, data in zip(pdf["doc_id"], pdf["tk"], pdf["data"]):
            data = data or b""
            places, hashes = anchors(data)
            n = len(places)
            ids += [doc_id] * n
            tks += [tk] * n
            ahs += hashes.tolist()
            ats += places.tolist()
            sizes += [len(data)] * n
            for p in places.tolist():
                before = min(p, REACH)
                cds.append(hashlib.blake2b(data[p - before : p + SPAN], digest_size=16, key=str(before).encode()).digest())
            if len(ids) > 50_000:
                yield batch()
                for x in (ids, tks, ahs, cds, ats, sizes):
                    x.clear()
        if ids:
            yield batch()


def _cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The surroundings of the asked places of each document."""
    columns = ["ah", "n", "m", "doc_id", "tk", "at", "around", "before"]
    for pdf in parts:
        out: list[tuple] = []
        for doc_id, tk, data, asked in zip(pdf["doc_id"], pdf["tk"], pdf["data"], pdf["asked"]):
            for x in asked:
                at = x["at"]
                out.append((x["ah"], x["n"], x["m"], doc_id, tk, at, data[max(0, at - REACH) : at + SPAN], min(at, REACH)))
                if len(out) >= 8_192:
                    yield pd.DataFrame(out, columns=columns).astype({"doc_id": pdf["doc_id"].dtype})
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": pdf["doc_id"].dtype})


def _sorted_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of ``ah`` to the repeated ranges of those that stand once; some groups at a time."""
    sizes: list[int] = []
    rows: list[tuple] = []
    group = dtype = None

    def solved() -> pd.DataFrame:
        out = []
        for i, a, b in repeated([r[5] for r in rows], [r[6] for r in rows], sizes):
            _, n, doc_id, tk, at, _, _ = rows[i]
            if n == 1:
                out.append((doc_id, tk, at - b, at - a + SPAN))
        return pd.DataFrame(out, columns=["doc_id", "tk", "start", "stop"]).astype({"doc_id": dtype})

    for pdf in parts:
        dtype = pdf["doc_id"].dtype
        for row in zip(pdf["ah"], pdf["n"], pdf["doc_id"], pdf["tk"], pdf["at"], pdf["around"], pdf["before"]):
            if row[0] != group:
                if len(rows) >= BATCH:
                    yield solved()
                    rows, sizes = [], []
                group = row[0]
                sizes.append(0)
            rows.append(row)
            sizes[-1] += 1
    if rows:
        yield solved()


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range of starts of a surrounding's strings the digest of the bytes that all of them hold, and of those that any holds (none if it lacks some)."""
    columns = ["ah", "member", "n", "least", "most", "core", "whole"]
    for pdf in parts:
        out: list[tuple] = []
        for row in pdf.itertuples(index=False):
            data, before = row.around, row.before

            def digest(start: int, stop: int) -> bytes | None:
                inside = 0 <= before + start and before + stop <= len(data)
                return hashlib.blake2b(data[before + start : before + stop], digest_size=16).digest() if inside else None

            for x in row.ranges:
                a, b = x["least"], x["most"]
                if core := digest(-a, SPAN - b):
                    out.append((row.ah, row.member, x["n"], a, b, core, digest(-b, SPAN - a)))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)


def _by_halving(around: DataFrame) -> DataFrame:
    """``(member, least, most)``, the repeated ranges of groups of any size, by counts that are summed before they are shuffled.

    A range of starts is settled for surroundings that have all bytes of its
    strings in common (one of them goes on, as a partner of others), and dropped
    where nobody else has the bytes that each of its strings holds. What is left
    is cut into ``PARTS`` ranges, down to single starts. At a passage that very
    many surroundings share only the ranges at its two ends go on.
    """
    width, by = REACH + 1, ["ah", "least", "most"]
    asked = around.withColumn("ranges", F.array(F.struct("n", F.lit(0).alias("least"), F.lit(REACH).alias("most"))))
    found = None
    while True:
        rows = stored(asked.select("ah", "member", "around", "before", "ranges").mapInPandas(_digests, "ah long, member long, n long, least int, most int, core binary, whole binary"))
        whole = stored(
            rows.where("whole is not null").groupBy(*by, "whole").agg(F.sum("n").alias("all"), F.min("member").alias("one")).where(F.col("all") > 1).drop("all")
        )
        settled = rows.join(whole, [*by, "whole"], "left").select("ah", "member", "n", "least", "most", "core", "one")
        here = settled.where("one is not null and n = 1").select("member", "least", "most")
        found = here if found is None else found.unionByName(here)
        if width == 1:
            return found
        core = stored(rows.groupBy(*by, "core").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select(*by, "core"))
        left = settled.where("one is null or one = member").join(core, [*by, "core"], "left_semi")
        width = -(-width // PARTS)
        weight = F.when(F.col("one").isNull(), F.col("n")).otherwise(F.lit(2).cast("long"))
        cut = left.select("member", weight.alias("n"), "most", F.explode(F.sequence("least", "most", F.lit(width))).alias("least"))
        cut = cut.select("member", F.struct("n", "least", F.least(F.col("least") + width - 1, F.col("most")).alias("most")).alias("x"))
        asked = around.join(cut.groupBy("member").agg(F.collect_list("x").alias("ranges")), "member")


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``(doc_id, tk, start, stop)``: ranges of bytes of ``docs(doc_id, tk, data)`` that are repeated."""
    small_batches(docs.sparkSession)
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long"
    rows = stored(docs.mapInPandas(_anchor_rows, _found(key)))
    kinds = rows.groupBy("ah", "cd").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tk", "at")).alias("one"))
    kinds = stored(kinds)
    groups = kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most")).where("m > 1 or most > 1")
    groups = stored(groups.where("m > 1 and least = 1").select("ah", "m"))  # a table, so that the join below can split an anchor of very many surroundings
    whole = rows.join(kinds.where("n > 1").select("ah", "cd"), ["ah", "cd"]).select(
        "doc_id", "tk", F.greatest(F.col("at") - REACH, F.lit(0)).alias("start"), F.least(F.col("at") + SPAN, F.col("size")).alias("stop")
    )
    asked = (
        kinds.join(groups, "ah")
        .select("one.doc_id", "one.tk", F.struct("ah", "n", "m", F.col("one.at").alias("at")).alias("x"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_list("x").alias("asked"))
    )
    asked = stored(asked)
    if asked.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    with_asked = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))).select("doc_id", "tk", "data", "asked")
    around = with_asked.mapInPandas(_cut_out, f"ah long, n long, m long, {key}, at int, around binary, before int").dropDuplicates(["ah", "doc_id", "tk", "at"])
    around = stored(around.withColumn("member", F.monotonically_increasing_id()))
    span = f"{key}, start int, stop int"
    found = around.where(F.col("m") <= group).drop("member", "m").repartition("ah").sortWithinPartitions("ah").mapInPandas(_sorted_groups, span)
    if groups.where(F.col("m") > group).limit(1).count():
        many = around.where(F.col("m") > group)
        found = found.unionByName(many.join(_by_halving(many), "member").select("doc_id", "tk", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + SPAN).alias("stop")))
    return whole.unionByName(found).where(F.col("stop") - F.col("start") >= SPAN)


def _merge(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def _kept(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for doc_id, data, ranges in zip(pdf["doc_id"], pdf["data"], pdf["ranges"]):
            data, spans = data or b"", _merge(ranges if ranges is not None else [])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc_id, len(data), len(data) - len(kept), spans, kept))
        made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
        made["doc_id"] = made["doc_id"].astype(pdf["doc_id"].dtype)
        yield made


def dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (merged ranges removed), kept (the bytes left).

    A null text is empty. Repeated rows are documents of their own, so each of
    two equal rows of at least ``SPAN`` bytes is removed whole; null ids are
    kept; an empty table gives none; other columns are not looked at. What is
    left may end inside of a character.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    found = repeats(keyed, group).groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left").select("doc_id", "data", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInPandas(_kept, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary")
