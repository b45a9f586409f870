"""Which texts hold which other texts, without comparing all with all.

A text that holds a needle holds the needle's inner words whole: only its
first and last word may be parts of longer ones. So a needle of three words
or more is met through the postings of its rarest inner words in the text
index, and the few candidates are verified on the texts. Shorter needles, and
tables of terms, go through an automaton that reads each text once, however
many terms there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.arrow import batches, schema_of
from ..sources.scratch import stored
from .inverted import TextIndex, bucket_of
from .rank import small

#: Inner words that a candidate must hold, the rarest ones.
WORDS = 3
#: Characters of terms in one automaton; more terms are read for in several passes.
AUTOMATON = 8_000_000


def _automata(terms: DataFrame) -> list[list[tuple]]:
    """(key, term) in lists of at most ``AUTOMATON`` characters, each for one pass over the texts."""
    parts, room = [], 0
    for key, term in terms.toLocalIterator():
        if not parts or room < len(term):
            parts.append([])
            room = AUTOMATON
        parts[-1].append((key, term))
        room -= len(term) + 1
    return parts


def terms_found(texts: DataFrame, terms: DataFrame, ignore_case: bool = False, key: str = "id", term_key: str = "term_id") -> DataFrame:
    """``texts(key, text)`` and ``terms(term_key, term)`` to ``(key, term_key)``, once for each term that a text holds anywhere.

    Null texts and terms hold and are held by nothing; the empty term is in
    every text. Rows of ``texts`` of the same key are told apart by nothing.
    """
    spark = texts.sparkSession
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    known = terms.where("term is not null").select(term_key, fold(F.col("term")).alias("term"))
    rows = texts.where("text is not null").select(key, fold(F.col("text")).alias("text"))
    kinds = f"`{key}` {texts.schema[key].dataType.simpleString()}, `{term_key}` {terms.schema[term_key].dataType.simpleString()}"
    out = spark.range(0, 0, 1, 1).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(None).cast(known.schema[term_key].dataType).alias(term_key))
    for part in _automata(known):
        out = out.unionByName(_pass(rows, spark.sparkContext.broadcast(part), kinds))
    return out


def _pass(rows: DataFrame, sent, kinds: str) -> DataFrame:
    shape = schema_of(kinds)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held: dict[str, list] = {}
        for key, term in sent.value:
            held.setdefault(term, []).append(key)
        everywhere, finder = held.pop("", []), ahocorasick.Automaton()
        for term, keys in held.items():
            finder.add_word(term, keys)
        if held:
            finder.make_automaton()

        def found() -> Iterator[tuple]:
            for part in parts:
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    seen = {id(keys): keys for _, keys in finder.iter(text.as_py())} if held else {}
                    for keys in (everywhere, *seen.values()):
                        for term in keys:
                            yield key, term

        yield from batches(found(), shape)

    return rows.mapInArrow(run, kinds)


def _candidates(index: TextIndex, needles: DataFrame) -> DataFrame:
    """``(query_id, chunk_id)`` of the chunks that hold the rarest inner words of each needle."""
    inner = F.array_distinct(F.slice("ts", F.lit(2), F.size("ts") - 2))
    words = needles.select("query_id", F.explode(inner).alias("term")).select("*", bucket_of(F.col("term"), index.buckets))
    words = stored(words)
    known = words.select("term", "bucket").distinct()
    df = index.part("dfs").join(small(known), ["term", "bucket"], "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    counted = words.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    rare = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= WORDS)
    # a word that no chunk holds rules its needle out: fewer words will be met than are asked for
    asked = stored(rare.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("query_id"))))
    post = index.part("postings").join(small(asked.select("term", "bucket").distinct()), ["term", "bucket"], "left_semi")
    met = post.select("term", "segment", F.explode("ids").alias("chunk_id")).join(small(asked.select("query_id", "term", "wanted")), "term")
    both = met.groupBy("query_id", "chunk_id", "segment", "wanted").agg(F.count(F.lit(1)).alias("n")).where("n = wanted")
    gone = index.part("dead").select("chunk_id", F.col("of").alias("segment"))
    return both.join(small(gone), ["chunk_id", "segment"], "left_anti").select("query_id", "chunk_id").distinct()


def containing(chunks: DataFrame, needles: DataFrame, index: TextIndex) -> DataFrame:
    """``(query_id, chunk_id)``: the ``chunks(chunk_id, text)`` that hold the text of ``needles(query_id, text)`` word for word.

    ``index`` is the text index of the same chunks. A null holds and is held
    by nothing, an empty needle is in every text.
    """
    split: Column = tokens(F.col("text"))
    asked = needles.where("text is not null").select("query_id", "text", split.alias("ts"))
    pairs = stored(_candidates(index, asked.where(F.size("ts") > 2)))
    texts = chunks.select("chunk_id", F.col("text").alias("whole"))
    met = texts.join(small(pairs), "chunk_id").join(small(asked.select("query_id", "text")), "query_id")
    long = met.where(F.contains("whole", F.col("text"))).select("query_id", "chunk_id")
    short = asked.where(F.size("ts") <= 2).select("query_id", F.col("text").alias("term"))
    brief = terms_found(chunks.select("chunk_id", "text"), short, key="chunk_id", term_key="query_id")
    return long.unionByName(brief.select("query_id", "chunk_id"))
