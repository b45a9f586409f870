"""Sources and sinks: tables, raw files, golden sets, and writers that replace one document's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as bytes: (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text, Markdown or HTML files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON arrays; files whose name holds ``example`` are left out."""
    schema = "id string, category string, question string, expectedKeywords string, expectedAnswer string, expectedChunkIds array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.withColumn("file", F.input_file_name()).where(~F.contains(F.lower(F.element_at(F.split("file", "/"), -1)), F.lit("example")))


def write_chunks(chunks: DataFrame, path: str, by: str = "tenant_id") -> None:
    chunks.write.mode("append").partitionBy(by).parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A report of a few lines as one text file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def without_documents(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a cascade delete leaves of a table."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
