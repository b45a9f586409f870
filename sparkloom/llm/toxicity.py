"""Toxicity by non-negative positive-unlabelled learning (numpy).

A linear classifier over words and word beginnings is trained from
confirmed toxic documents and unlabelled ones. With class prior p the risk is
p * R+(1) + max(0, Ru(0) - p * R+(0)): the share of the unlabelled risk that
the positives account for is taken off, and a step that would make the rest
negative goes the other way instead. The prior is the toxic share of the
labelled training rows, which are used for nothing else: negative labels are
never learned from. Weights start at zero, for the features that are surely
commoner in positives than in what the unlabelled leave for negatives, and the
threshold is where the same estimate of the share of wrong answers is least.

The fit takes about ``MOST_POSITIVE`` toxic and ``MOST_UNLABELLED`` unlabelled
documents, those of the smallest digests, whole. Features are counted on the
executors; the driver gets the counts of features that three or more of the
sampled toxic documents have, and the sampled documents' chosen features. Every
text is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
STARTS = (4, 5, 6)
WORDS = re.compile(r"\w+")


def features(text: str | None) -> set[int]:
    """The features of a text, as CRC-32 values: its words and their first letters."""
    seen = set()
    for word in set(WORDS.findall((text or "").lower())):
        seen.add(zlib.crc32(word.encode("utf-8", "surrogatepass")))
        for n in STARTS:
            if len(word) >= n:
                seen.add(zlib.crc32(word[:n].encode("utf-8", "surrogatepass") + b"*"))
    return seen


class Model:
    """A weight for each chosen feature, and an offset."""

    def __init__(self, weights: dict[int, float], offset: float):
        self.weights, self.offset = weights, offset

    def margin(self, x: set[int]) -> float:
        w = self.weights
        return math.fsum(w[f] for f in x if f in w) + self.offset

    def score(self, x: set[int]) -> float:
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, self.margin(x)))))


def choose(c_p: np.ndarray, c_u: np.ndarray, p: int, u: int, prior: float) -> np.ndarray:
    """Which features the positives surely have more often, by bounds of both counts (a long text has many chance ones).

    The negatives' rate is what the unlabelled have with the positives' share taken off.
    """
    low_p = (c_p - np.sqrt(c_p)) / p
    high_n = np.maximum(0.0, (c_u + 2 * np.sqrt(c_u) + 1) / u - prior * c_p / p) / (1 - prior)
    return (c_p >= 3) & (low_p > 3 * high_n)


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The estimate of the risk's negative part, and the slopes of the whole by each positive's and each unlabelled margin.

    When the negative part is below zero its own slope is gone up instead.
    """
    s_p, s_u = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) for z in (z_p, z_u))
    n_p, n_u = max(1, len(z_p)), max(1, len(z_u))
    negative = np.logaddexp(0, z_u).sum() / n_u - prior * np.logaddexp(0, z_p).sum() / n_p
    down_p, down_u = -prior * s_p / n_p, s_u / n_u
    if negative < 0:
        return negative, -down_p, -down_u
    return negative, prior * (s_p - 1) / n_p + down_p, down_u


def threshold(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> float:
    """The margin from which on a document is marked: where missed positives and the unlabelled marked beyond the positives' share are fewest."""
    z_p, z_u = np.sort(z_p), np.sort(z_u)
    at = np.unique(np.concatenate([z_p, z_u]))
    found = 1 - np.searchsorted(z_p, at) / len(z_p)
    marked = 1 - np.searchsorted(z_u, at) / len(z_u)
    best = int(np.argmin(prior * (1 - found) + np.maximum(0.0, marked - prior * found)))
    return float((at[best] + (at[best - 1] if best else at[best] - 1)) / 2)


def fit(ids: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 320, rate: float = 0.1, decay: float = 1e-3, seed: int = 11) -> Model:
    """The classifier over the features ``ids`` after about ``steps`` steps, whole rounds; documents are arrays of places in ``ids``."""
    p, sets = len(positive), positive + unlabelled
    flat = np.concatenate(sets).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    n = len(ids)
    weights, offset, rng = np.zeros(n), -3.0, np.random.default_rng(seed)
    squares, offset_square = np.full(n, 1e-6), 1e-6
    batches = max(1, len(sets) // 512)
    for _ in range(-(-steps // batches)):
        for batch in np.array_split(rng.permutation(len(sets)), batches):
            batch = np.sort(batch)  # positives first
            spans = [flat[starts[i] : starts[i + 1]] for i in batch]
            row = np.repeat(np.arange(len(batch)), [len(x) for x in spans])
            cols = np.concatenate(spans)
            z = np.bincount(row, weights[cols], minlength=len(batch)) + offset
            first = int((batch < p).sum())
            _, by_p, by_u = risk(z[:first], z[first:], prior)
            slope = np.concatenate([by_p, by_u])
            g = np.bincount(cols, slope[row], minlength=n) + decay * weights
            squares += g * g
            weights -= rate * g / np.sqrt(squares)
            offset_square += slope.sum() ** 2
            offset -= rate * slope.sum() / np.sqrt(offset_square)
    z = np.array([weights[x].sum() for x in sets]) + offset
    offset -= threshold(z[:p], z[p:], prior)
    return Model(dict(zip(ids.tolist(), weights.tolist())), float(offset))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label must not be learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, those of the smallest digests of their ids."""
    share = min(1.0, most / max(1, df.count()))
    return df if share >= 1 else df.where(F.xxhash64("doc_id", F.lit("fit")).cast("double") < F.lit((share * 2 - 1) * 2.0**63))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``docs`` and ``labels`` that are not held out; without toxic ones everything scores low."""
    nothing = Model({}, -10.0)
    open_docs = docs.select("doc_id", "text").where(~held_out())
    marks = labels.where("toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = open_docs.join(marks, "doc_id")
    prior = float(marks.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0)
    if not 0 < prior < 1:
        return nothing
    parts = {"p": (known.where("y = 1").select("doc_id", "text"), MOST_POSITIVE), "u": (open_docs, MOST_UNLABELLED)}
    rows = reduce(DataFrame.unionByName, [_sample(df, most).select(F.lit(k).alias("part"), "text") for k, (df, most) in parts.items()])
    rows = cut(rows.withColumn("tk", F.xxhash64("text")).dropDuplicates(["part", "tk"]))  # copies would count as evidence
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    p, u = sizes.get("p", 0), sizes.get("u", 0)
    if not p or not u:
        return nothing
    context = docs.sparkSession.sparkContext

    def listed(only: frozenset | None):
        sent = context.broadcast(only)

        @F.pandas_udf("array<long>")
        def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            wanted = sent.value
            for s in parts:
                yield pd.Series([sorted(features(t) if wanted is None else features(t) & wanted) for t in s])

        return of("text")

    def counted(part: str, only: frozenset | None, least: int) -> dict[int, int]:
        each = rows.where(F.col("part") == part).select(F.explode(listed(only)).alias("f"))
        return {r["f"]: r["count"] for r in each.groupBy("f").count().where(F.col("count") >= least).collect()}

    in_p = counted("p", None, 3)
    in_u = counted("u", frozenset(in_p), 1)
    ids = np.array(sorted(in_p), np.int64)
    ids = ids[choose(np.array([in_p[i] for i in ids.tolist()], float), np.array([in_u.get(i, 0) for i in ids.tolist()], float), p, u, prior)]
    if not len(ids):
        return nothing
    made: dict[str, list] = {"p": [], "u": []}
    for r in rows.select("part", listed(frozenset(ids.tolist())).alias("x")).collect():
        made[r["part"]].append(np.searchsorted(ids, np.array(r["x"], np.int64)))
    return fit(ids, made["p"], made["u"], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1). The model's weights, which the sample bounds, are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.offset))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = Model(*sent.value)
        for s in parts:
            yield pd.Series([local.score(features(t)) for t in s], dtype="float64")

    return docs.withColumn("score", scored(text_col))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text is empty, and an empty text scores what a text without any
    known feature does. Null ids and repeated rows are each scored; labels
    without a document, null labels and repeated labels (the toxic one counts)
    do no harm; without toxic labels every score is near 0; other columns are
    not looked at.
    """
    small_batches(docs.sparkSession)
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
