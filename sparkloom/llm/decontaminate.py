"""Benchmark decontamination by winnowing, on DataFrame functions only.

Texts become words; every run of ``k`` words is hashed, and of each ``w``
consecutive hashes the smallest (the first of equals) is kept as a
fingerprint. A shared span of ``w + k - 1`` words holds the same ``w`` hashes
in both texts, so both keep the same one: with k = 5 and w = 6 every shared
span of ten words is met. Documents' and items' fingerprints are joined on the
hash; each meeting is extended word by word to both sides, and counts when the
equal run holds a whole window. Items shorter than a window are met by all
runs of their own length instead.

The benchmark's fingerprints are broadcast only when their counted number is
under ``BROADCAST_ROWS``; else both sides are shuffled on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, unused

ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000
#: Low bits of a kept hash that hold its position.
AT_BITS = 31


def word_list(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(ANY_WORD), F.lit(0))


def _low(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _upto(last: Column) -> Column:
    """0 .. last, or nothing when last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    """The hash of each word in small letters."""
    return F.transform(words, lambda w: F.xxhash64(_low(w)))


def _winnowed(df: DataFrame, k: int, w: int, every: bool = False) -> DataFrame:
    """One row per fingerprint: ``f`` (hash) and ``at`` (position of its first word); with ``every`` also a row without them for each row of ``df``."""
    mask = (1 << AT_BITS) - 1

    def grams(h: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        return F.transform(_upto(F.size(h) - k), lambda i: gram(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

    def least(g: Column) -> Column:
        return F.array_distinct(F.transform(_upto(F.size(g) - w), lambda i: F.array_min(F.slice(g, i + 1, w))))

    kept = let(_hashes(F.col("words")), lambda h: let(grams(h), least))
    if every:
        kept = F.concat(kept, F.array(F.lit(None).cast("long")))
    return (
        df.select("*", F.explode(kept).alias("e"))
        .withColumn("f", F.shiftright("e", AT_BITS))
        .withColumn("at", F.col("e").bitwiseAND(F.lit(mask)).cast("int"))
        .drop("e")
    )


def _runs(df: DataFrame, n: int) -> DataFrame:
    """One row per run of ``n`` words."""
    runs = let(_hashes(F.col("words")), lambda h: F.transform(_upto(F.size(h) - n), lambda i: F.xxhash64(F.slice(h, i + 1, n))))
    return df.select("*", F.posexplode(runs).alias("at", "f"))


def _context(df: DataFrame, prefix: str, core: int, around: int) -> DataFrame:
    """The words around a fingerprint, in small letters, and how many stand before it."""
    first = F.greatest(F.col("at") - around, F.lit(0))
    near = F.transform(F.slice("words", first + 1, F.col("at") - first + core + around), _low)
    return df.withColumn(f"{prefix}w", near).withColumn(f"{prefix}o", F.col("at") - first).drop("words")


def _meet(docs: DataFrame, items: DataFrame, core: int, around: int, window: int) -> DataFrame:
    """Verified runs: document, first word, word after the last, items; and a row with ``n_words`` for each one without fingerprint."""
    items = _context(items, "b", core, around).groupBy("f", "bw", "bo").agg(F.collect_set("item").alias("items"))
    items = cut(items)
    wanted = F.col("f").isNull() | F.col("items").isNotNull()
    if items.count() <= BROADCAST_ROWS:
        met = docs.join(F.broadcast(items), "f", "left").where(wanted)
        met = _context(met.withColumn("n_words", F.when(F.col("f").isNull(), F.size("words"))), "d", core, around)
    else:
        met = _context(docs.withColumn("n_words", F.when(F.col("f").isNull(), F.size("words"))), "d", core, around)
        met = met.join(items, "f", "left").where(wanted)

    def equal(x: Column, shift: Column) -> Column:
        i, j = x["do"] + shift, x["bo"] + shift
        return F.when((i >= 0) & (j >= 0), F.coalesce(F.get(x["dw"], i) == F.get(x["bw"], j), F.lit(False))).otherwise(F.lit(False))

    def length(x: Column, shifts: range) -> Column:
        """How many of ``shifts`` in turn have equal words."""
        if not shifts:
            return F.lit(0)
        same = F.transform(F.array(*[F.lit(s) for s in shifts]), lambda s: equal(x, s))
        unlike = F.array_position(same, F.lit(False)).cast("int")
        return F.when(unlike > 0, unlike - 1).otherwise(F.lit(len(shifts)))

    # one array element per meeting: what it needs is made once, and no filter is pushed through it
    pair = F.array(F.struct("at", "dw", "do", "bw", "bo"))
    sides = F.transform(pair, lambda x: F.struct(x["at"].alias("at"), length(x, range(-1, -1 - around, -1)).alias("l"), length(x, range(core + around)).alias("r")))
    held = F.filter(sides, lambda y: (y["r"] >= core) & (y["l"] + y["r"] >= window))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("l"), F.lit(0).alias("r")))
    return met.select("doc_id", "tk", "items", "n_words", F.explode(F.when(F.col("f").isNull(), none).otherwise(held)).alias("y")).select(
        "doc_id", "tk", "n_words", (F.col("y.at") - F.col("y.l")).alias("start"), (F.col("y.at") + F.col("y.r")).alias("end"), "items"
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, every: bool = False) -> DataFrame:
    """``(doc_id, tk, n_words, start, end, items)``: runs of document words that hold a benchmark window.

    ``tk`` tells rows of one id with other texts apart. Repeated rows give
    repeated runs, which the summary takes once. With ``every`` there is also a
    row with ``n_words`` and without items for each row of ``docs``, so that
    the texts are read and cut into words once.
    """
    w = window - k + 1
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    worded = keyed.select("doc_id", "tk", F.coalesce(word_list("text"), F.array().cast("array<string>")).alias("words"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_list("text").alias("words"))
    found = _meet(_winnowed(worded, k, w, every), _winnowed(items.where(F.size("words") >= window), k, w), k, window - k, window)
    short = [r[0] for r in items.select(F.size("words").alias("n")).where(f"n between 1 and {window - 1}").distinct().collect()]
    for n in sorted(short):  # fewer than ``window`` lengths
        found = found.unionByName(_meet(_runs(worded, n), _runs(items.where(F.size("words") == n), n), n, 0, n))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated.

    A null or empty text has no words and no hits; null ids are kept, and rows
    of one id but other texts are judged apart; repeated rows are each
    returned; an item without words is never met, a null item id is the empty
    string, and items of one id count once. An empty benchmark hits nothing.
    Other columns of either table are not looked at.
    """
    every = cut(matches(docs, benchmark, window, k, every=True))
    found = every.where("items is not null").drop("n_words").distinct()
    key = ["doc_id", "tk"]
    hit = (
        found.select(*key, F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
        .groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    )
    met = (
        found.select(*key, F.explode("items").alias("item")).distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    summed = hit.join(met, (hit.doc_id.eqNullSafe(met.doc_id)) & (hit.tk == met.tk)).select(hit.doc_id.alias("_id"), hit.tk.alias("_tk"), "n_hit", "items")
    all_docs = every.where("items is null").select("doc_id", "tk", F.col("n_words").cast("long").alias("n_words"))
    return all_docs.join(summed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with all their columns.

    Null and empty texts hold none and stay, as all rows do with an empty
    benchmark; of rows with one id each is judged by its own text.
    """
    i, tk = unused(docs, "_id", "_tk")
    bad = matches(docs, benchmark, window, k).select(F.col("doc_id").alias(i), F.col("tk").alias(tk)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(tk)), "left_anti")
