"""From raw documents to pages and chunks with their metadata, and the tables that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import parsers
from ..sources.scratch import stored
from . import chunking

#: Parsers by name: a function of files ``(doc_id, content)`` to pages ``(doc_id, page_number, text)``.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "NATIVE": lambda files: files.select("doc_id", F.lit(1).alias("page_number"), F.col("content").cast("string").alias("text")),
    **{kind: lambda files, kind=kind: parsers.parsed(files, kind).where("error is null").drop("error") for kind in ("HTML", "DOCX")},
}
#: Text of fewer characters a page than this, over the first ``PROBED`` pages, is taken for a scan.
DENSITY, PROBED = 50, 3


def accepted(files: DataFrame) -> DataFrame:
    """``files(mime, length)`` with their ``kind`` and ``error_code`` (null: accepted)."""
    kind = T.mime_kind(F.col("mime"))
    code = F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, F.lit("FILE_EMPTY")).when(kind == "UNKNOWN", F.lit("FILE_TYPE_UNSUPPORTED"))
    return files.select("*", kind.alias("kind"), code.alias("error_code"))


def forced_route(raw: Column) -> Column:
    """A route that was asked for, in any case and with blanks around it; anything else is null."""
    name = F.upper(T.stripped(raw))
    return F.when(name.isin("NATIVE", "DEEP", "OCR"), name)


def routed(files: DataFrame) -> DataFrame:
    """``files(name, pages, chars, forced, deep, ok)`` with ``route``, and the ``outcome`` if that route works or not (``ok``).

    ``pages`` and ``chars`` are what a probe of the first pages found; null
    where it failed, which says nothing of a scan. A forced route that fails
    is an error; another falls back to NATIVE.
    """
    forced = forced_route(F.col("forced"))
    density = F.when(F.col("pages") > 0, F.col("chars") / F.least(F.col("pages"), F.lit(PROBED))).when(F.col("pages") <= 0, F.lit(0.0))
    route = F.coalesce(
        forced, F.when(~T.is_pdf(F.col("name")), F.lit("NATIVE")).when(F.col("deep"), F.lit("DEEP")).when(density < DENSITY, F.lit("OCR")).otherwise(F.lit("NATIVE"))
    )
    outcome = F.when(F.col("ok"), route).when(forced.isNotNull(), F.lit("ERROR")).otherwise(F.lit("NATIVE"))
    return files.select("*", route.alias("route"), outcome.alias("outcome"))


def layout_content(kind: Column) -> Column:
    """A layout block's text: of a table the model's (out of its code fence), then the other fields in turn; empty without any."""
    fields = ["html", "markdownContent", "markdown", "text"]
    table = T.first_non_blank(T.strip_fence(F.col("llmResult")), *[F.col(c) for c in fields])
    return F.when(F.contains(kind, F.lit("table")), table).otherwise(T.first_non_blank(*[F.col(c) for c in fields[1:]]))


def layout_pages(layouts: DataFrame) -> DataFrame:
    """``layouts(doc_id, seq, pageNum, type, llmResult, html, markdownContent, markdown, text)`` to pages: page_number, content, and of the document page_count, tables, images.

    Blocks without a page stand on the one before them (the first on page 0),
    images and figures give no text, pages count from one, and blank pages go.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    kind = F.coalesce("type", F.lit(""))
    image = F.contains(kind, F.lit("image")) | F.contains(kind, F.lit("figure"))
    blocks = layouts.select(
        "doc_id", "seq", "pageNum", F.coalesce(F.last("pageNum", True).over(order), F.lit(0)).alias("page"), image.alias("image"),
        (~image & F.contains(kind, F.lit("table"))).alias("table"), F.when(~image, layout_content(kind)).alias("content"),
    )
    whole = blocks.groupBy("doc_id").agg((F.coalesce(F.max("pageNum"), F.lit(-1)) + 1).alias("page_count"), F.count_if("table").alias("tables"), F.count_if("image").alias("images"))
    pages = blocks.where(T.has_text(F.col("content"))).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("content"))
    kept = pages.select("doc_id", (F.col("page") + 1).alias("page_number"), T.trimmed(F.col("content")).alias("content"))
    kept = kept.where(T.has_text(F.col("content")))
    return kept.join(whole, "doc_id")


def merged_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(doc_id, page_number, text)`` that were read one by one to a document each: text, pages, and tables found in it."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(text.alias("text"), F.count(F.lit(1)).alias("pages"), F.sum(T.markdown_tables(F.col("text"))).alias("tables"))


def page_count(stated: Column, parts: Column) -> Column:
    """What a parser states, if it is over zero; else the number of parts."""
    return F.coalesce(F.when(stated > 0, stated), parts)


def chunked(pages: DataFrame, tokens: int = chunking.TOKENS) -> DataFrame:
    """``pages(doc_id, page_number, text, ...)`` to chunks with all other columns of their page.

    Chunks are numbered through the document; ids are digests of document and
    number, so that another run gives the same ones.
    """
    kept = [c for c in pages.columns if c not in ("doc_id", "page_number", "text")]
    keyed = pages.withColumn("page_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page_number").cast("string")))
    made = chunking.split_documents(keyed, "page_key", "text", tokens).select(F.col("doc_id").alias("page_key"), F.col("chunk_index").alias("place"), "content", "chunk_type", "original_content", "token_count")
    joined = made.join(keyed.drop("text"), "page_key")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "place")) - 1
    out = joined.withColumn("chunk_index", at)
    chunk_id = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    return out.select("doc_id", "page_number", "chunk_index", chunk_id.alias("chunk_id"), "content", "chunk_type", "original_content", "token_count", *kept)


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """What stands beside a chunk's vector; absent values have defaults."""
    return chunks.select(
        "chunk_id", "doc_id", "tenant_id", chunk_kind(F.col("chunk_type")).alias("chunk_type"), F.coalesce("name", F.lit("unknown")).alias("file_name"),
        F.coalesce("page_num", F.lit(0)).alias("page_num"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
    )


def index_documents(chunks: DataFrame) -> DataFrame:
    """What the text index holds of a chunk; new ones are not deleted."""
    return chunks.select("chunk_id", "doc_id", "tenant_id", "content", F.coalesce("chunk_type", F.lit("TEXT")).alias("chunk_type"), F.col("original_name").alias("file_name"), "page_num", F.lit(False).alias("is_deleted"))


def chunk_kind(raw: Column) -> Column:
    return F.when(raw.isin("TEXT", "TABLE", "IMAGE"), raw).otherwise(F.lit("TEXT"))


def batches(rows: DataFrame, key: str, n: int = 10, by: str | None = None) -> DataFrame:
    """Rows with their ``batch`` of ``n`` in the order of ``key``, within each ``by`` (a document), which is one window's work."""
    order = Window.partitionBy(by).orderBy(key) if by else Window.orderBy(key)
    return rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / n))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; write it beside the old table and swap."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks, each key once (its smallest row)."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.`{c}`").alias(c) for c in new.columns])


def bulk_failures(items: DataFrame, by: str, examples: int = 5) -> DataFrame:
    """``items(by, id, error)`` of a bulk write: how many, how many failed, and the smallest failed ids.

    Ids are cut to the smallest ones of each of 64 hash ranges before they
    meet, so a source that fails as a whole brings no long list to any task.
    """
    failed = F.col("error").isNotNull()
    ids = items.where(failed & F.col("id").isNotNull()).select(by, "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).distinct()
    for keys in ([by, "part"], [by]):
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("place") <= examples).drop("place")
    shown = ids.groupBy(F.col(by).alias("of")).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.count_if(failed).alias("failed"))
    none = F.array().cast(shown.schema["examples"].dataType)
    return counts.join(shown, F.col(by).eqNullSafe(F.col("of")), "left").select(by, "items", "failed", F.coalesce("examples", none).alias("examples"))


def with_most(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows with ``most``, the highest ``value`` of their ``by`` (nulls are one): aggregated first, so that a hot one is no task of its own."""
    top = rows.groupBy(F.col(by).alias("_by")).agg(F.max(value).alias("most"))
    return rows.join(top, rows[by].eqNullSafe(top["_by"]), "left").drop("_by")


def ingested(files: DataFrame, parser: str = "NATIVE", tokens: int = chunking.TOKENS) -> tuple[DataFrame, DataFrame]:
    """Files ``(doc_id, content, ...)`` to their chunks, with all other columns, and one row per document with its counts and status.

    Documents that give no chunk (texts of ten characters or fewer) end as FAILED.
    """
    pages = PARSERS[parser](files).join(files.drop("content"), "doc_id")
    chunks = chunked(pages, tokens)
    return chunks, _summary(files, chunks)


def _summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("tokens"), F.count_if(F.col("chunk_type") == "TABLE").alias("tables"))
    done = F.when(F.col("chunk_count").isNull(), F.lit("FAILED")).otherwise(F.lit("SUCCESS"))
    return files.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("tables", F.lit(0)).alias("tables"), done.alias("status"))


def ingested_files(files: DataFrame, tokens: int = chunking.TOKENS) -> tuple[DataFrame, DataFrame]:
    """Files ``(doc_id, content, kind, ...)``, each by its kind's parser, to chunks and a summary as ``ingested`` has them, with the ``error`` of files that could not be read.

    Ids are unique. Pages are written to the shared folder once, as both results read them.
    """
    read = stored(parsers.parsed(files))
    chunks = chunked(read.where("error is null").drop("error").join(files.drop("content"), "doc_id"), tokens)
    errors = read.where("error is not null").select("doc_id", "error")
    return chunks, _summary(files, chunks).join(errors, "doc_id", "left")
