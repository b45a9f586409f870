"""Quality by importance resampling.

Two bag-of-hashed-n-gram models are made: one of target text (documents that
are marked good) and one of raw text (all documents). A document's importance
is the log ratio of the two over its n-grams, and Gumbel top-k over it draws
documents without replacement in proportion to importance.

All documents are counted and scored, whole. ``k`` is what the labels say: the
good share of the labelled documents, of all documents, plus ``SLACK``. The
k-th largest key is found exactly by counting the keys' bit groups, so nothing
is sorted in one task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, unused

BUCKETS = 10_007
#: Words, and runs of other signs.
PIECES = re.compile(r"\w+|[^\w\s]+")
SLACK = 0.01


def buckets(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's one- and two-piece n-grams, repeats included."""
    pieces = PIECES.findall(text or "")
    h = np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in pieces), np.uint64, len(pieces))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return np.concatenate([h % np.uint64(BUCKETS), pair % np.uint64(BUCKETS)]).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of ``docs(text, good)`` by bucket: row 0 of all texts, row 1 of the good ones. Each task sends its sums."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), np.int64)
        for pdf in parts:
            for text, good in zip(pdf["text"], pdf["good"]):
                c = np.bincount(buckets(text), minlength=BUCKETS)
                total[0] += c
                if good:
                    total[1] += c
        for i in (0, 1):
            at = np.flatnonzero(total[i])
            yield pd.DataFrame({"which": np.full(len(at), i), "bucket": at, "n": total[i][at]})

    rows = docs.mapInPandas(count, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows.collect():  # two rows of each bucket at most
        out[r["which"], r["bucket"]] = r["n"]
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket, smoothed; all zero without target text."""
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw, target = (np.log((c + 1.0) / (c.sum() + BUCKETS)) for c in counts)
    return target - raw


def importance(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``log_weight``. The ratios are a fixed 80 KB and are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = sent.value
        for s in parts:
            yield pd.Series([float(local[buckets(t)].sum()) for t in s], dtype="float64")

    return docs.withColumn("log_weight", weigh(text_col))


def gumbel(seed: int, *cols: str) -> Column:
    """Gumbel noise from a digest of the row's values, the same in every run."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a bigint column, by four counts over 16 bits each; nothing if there are fewer."""
    if k <= 0:
        return None
    prefix, left = 0, k
    shifted = df.select(F.col(col).bitwiseXOR(F.lit(-(1 << 63))).alias("v"))  # unsigned order
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        same = shifted if shift == 48 else shifted.where(F.shiftrightunsigned("v", shift + 16) == F.lit(prefix).cast("long"))
        for r in sorted(same.groupBy(part.alias("p")).count().collect(), key=lambda r: -r["p"]):  # 65,536 rows at most
            if r["count"] >= left:
                prefix = prefix << 16 | r["p"]
                break
            left -= r["count"]
        else:
            return None
    return (prefix ^ 1 << 63) - (1 << 64 if (prefix ^ 1 << 63) >= 1 << 63 else 0)


def _ordered(key: Column) -> Column:
    """A double as a bigint of the same order, in steps of 2 ** -32."""
    return F.floor(F.least(F.greatest(key, F.lit(-2.0e9)), F.lit(2.0e9)) * F.lit(float(1 << 32))).cast("long")


def select(docs: DataFrame, labels: DataFrame, seed: int = 5, share: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk (its text's digest), log_weight, kept.

    ``share`` of the documents is drawn (rows of the last key's value too); by
    default the good share of the labelled documents and ``SLACK``. Null texts
    and empty ones have importance 0. Null ids and repeated rows are each
    judged (equal rows alike); null and repeated labels (the good one counts)
    do no harm; without good labels all is kept. Other columns are not looked
    at.
    """
    small_batches(docs.sparkSession)
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    good = marks.where("q = 1").select("doc_id", F.lit(True).alias("good"))
    # One way at every size: labels grow with the documents, so they are never broadcast.
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = log_ratio(bucket_counts(marked))
    weighed = importance(docs.select("doc_id", F.xxhash64("text").alias("tk"), "text"), ratio).drop("text")
    weighed = cut(weighed.withColumn("key", _ordered(F.col("log_weight") + gumbel(seed, "doc_id", "tk"))))
    if share is None:
        share = marks.agg(F.avg(F.col("q").cast("double"))).first()[0] if ratio.any() else 1.0
        share = min(1.0, share + SLACK)
    least = kth_largest(weighed, "key", math.ceil(share * weighed.count()))
    kept = F.lit(False) if least is None else F.col("key") >= F.lit(least)
    return weighed.select("doc_id", "tk", "log_weight", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 5, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn (see ``select``), with all their columns."""
    i, tk = unused(docs, "_id", "_tk")
    gone = select(docs, labels, seed, share).where("not kept").select(F.col("doc_id").alias(i), F.col("tk").alias(tk)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text").eqNullSafe(F.col(tk))), "left_anti")
