"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes what a stage returns to the shared folder as Parquet
and reads it again for the next, so a lost executor never costs more than one
stage. Extra columns of ``docs`` are not looked at, whatever their names, and
very long texts are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, line_dedup, mixing, near_copies, quality
from sparkloom.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go.

    A null or empty text has importance 0. Null ids and repeated rows are each
    judged, equal rows alike; without good labels, or of an empty table, all
    that there is stays.
    """
    return quality.resample(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; a document of which nothing but blanks is left by that goes too.

    Null texts and blank ones that were so before stay. Repeated rows and equal
    texts are one text to the counts and lose the same lines; of ties the
    smallest id's first line stays, null ids last.
    """
    out = line_dedup.dedup(docs.select(*COLUMNS))
    gone = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~gone | F.col("text").isNull()).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more) stays, that of the smallest id.

    Null texts and texts without words are copies of each other; a shorter text
    is one shingle. Of rows with one id one stays, whatever its texts; rows
    without id all stay.
    """
    return near_copies.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and empty texts hold none; rows of one id are judged each by its own
    text; an empty benchmark removes nothing.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    Texts without words (null and empty ones too) come as often as others of
    their source but add no words; null sources are one source, the last;
    repeated rows are documents of their own.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]
#: XXH64 and hashed n-gram models can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs
