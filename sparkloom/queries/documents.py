"""Ingestion: acceptance, routing, layouts, chunk metadata and the tables they go to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents
from ..sources import parsers
from ..sources.tables import table
from .registry import query, sql_has_text, sql_stripped

# fixed values: kinds of files by their media types are in functions.text
EXTENSIONS = ["md", "pdf", "PDF", "txt", "html"]
MIMES = ["application/pdf", "text/markdown", "text/plain", "text/html", "image/png"]
FORCED = [None, "deep", " OCR ", "bogus", ""]


def _pick(values, n):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), n)


def _sql_list(values):
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def files(spark, sf_dir):
    """Documents as if they were files: what their number and length say stands for what a file would."""
    d, i = table(spark, sf_dir, "documents"), (F.col("doc_id") % 5).cast("int")
    return d.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), _pick(EXTENSIONS, i)).alias("name"), F.when(F.col("doc_id") % 13 > 0, F.col("doc_id") % 4).alias("pages"), F.length("text").cast("long").alias("chars"),
        _pick(FORCED, (F.floor(F.col("doc_id") / 5) % 5).cast("int")).alias("forced"), (F.col("doc_id") % 3 == 0).alias("deep"), (F.col("doc_id") % 7 != 0).alias("ok"),
        _pick(MIMES, i).alias("mime"), F.when(F.col("doc_id") % 11 != 0, F.length("text")).alias("length"),
    )


FI = f"""fi as (select doc_id, doc_id || '.' || {_sql_list(EXTENSIONS)}[doc_id % 5 + 1] as name, case when doc_id % 13 > 0 then doc_id % 4 end as pages, length(text) as chars, upper(trim({_sql_list(FORCED)}[doc_id // 5 % 5 + 1])) as f,
  doc_id % 3 = 0 as deep, doc_id % 7 <> 0 as ok, {_sql_list(MIMES)}[doc_id % 5 + 1] as mime, case when doc_id % 11 <> 0 then length(text) else 0 end as length from documents),
ro as (select *, case when f in ('NATIVE', 'DEEP', 'OCR') then f when lower(name) not like '%.pdf' then 'NATIVE' when deep then 'DEEP' when (case when pages > 0 then chars / least(pages, 3)::double when pages <= 0 then 0 end) < 50 then 'OCR' else 'NATIVE' end as route from fi)"""


@query("routed_files", f"with {FI} select doc_id, route, case when ok then route when f in ('NATIVE', 'DEEP', 'OCR') then 'ERROR' else 'NATIVE' end as outcome, regexp_extract(name, '[.]([^.]*)$', 1) as ext from ro")
def routed_files(spark, sf_dir):
    return documents.routed(files(spark, sf_dir)).select("doc_id", "route", "outcome", T.extension(F.col("name")).alias("ext"))


@query("accepted_files", f"with {FI} select doc_id, case mime when 'application/pdf' then 'PDF' when 'text/markdown' then 'MD' when 'text/plain' then 'TXT' when 'text/html' then 'HTML' else 'UNKNOWN' end as kind, case when length = 0 then 'FILE_EMPTY' when mime = 'image/png' then 'FILE_TYPE_UNSUPPORTED' end as error_code from fi")
def accepted_files(spark, sf_dir):
    return documents.accepted(files(spark, sf_dir)).select("doc_id", "kind", "error_code")


def layouts(spark, sf_dir):
    """Lines of documents as layout blocks, their fields filled by turns."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    n, turn = F.length("line"), F.col("seq") % 5
    kind = F.when(n % 7 == 0, F.lit("table")).when(n % 11 == 0, F.lit("figure_image")).otherwise(F.lit("text"))
    return lines.select(
        "doc_id", "seq", F.when(F.col("seq") % 3 == 2, (F.col("seq") / 3).cast("int")).alias("pageNum"), kind.alias("type"),
        F.when(turn == 0, F.concat(F.lit("```html\n"), "line", F.lit("\n```"))).alias("llmResult"), F.when(turn == 1, F.col("line")).alias("html"),
        F.when(turn == 2, F.col("line")).when(turn == 1, F.lit(" \t\n")).alias("markdownContent"), F.when(turn == 3, F.col("line")).alias("markdown"), F.when(turn != 4, F.concat(F.lit("t:"), "line")).alias("text"),
    )


LAY = f"""
li as (select doc_id, unnest(range(len(ls))) as seq, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)),
bl as (select doc_id, seq, line, length(line) as n, seq % 5 as turn, case when seq % 3 = 2 then seq // 3 end as page_num from li),
ki as (select *, case when n % 7 = 0 then 'table' when n % 11 = 0 then 'figure_image' else 'text' end as kind from bl),
pa as (select *, coalesce(last_value(page_num ignore nulls) over (partition by doc_id order by seq rows between unbounded preceding and current row), 0) as page from ki),
co as (select *, case when kind = 'figure_image' then null
  when kind = 'table' then coalesce(case when turn = 0 then nullif({sql_stripped('line')}, '') end, case when turn in (1, 2, 3) and {sql_has_text('line')} then line end, case when turn <> 4 then 't:' || line end)
  else coalesce(case when turn in (2, 3) and {sql_has_text('line')} then line end, case when turn <> 4 then 't:' || line end) end as content from pa),
wh as (select doc_id, coalesce(max(page_num), -1) + 1 as page_count, count(*) filter (kind = 'table') as tables, count(*) filter (kind = 'figure_image') as images from pa group by 1),
pg as (select doc_id, page + 1 as page_number, regexp_replace(string_agg(content, chr(10) order by seq), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') as content from co where {sql_has_text('content')} group by 1, 2)"""


@query("layout_blocks", f"with {LAY} select doc_id, page_number, sha256(content) as content, page_count, tables, images from pg join wh using (doc_id) where content <> ''")
def layout_blocks(spark, sf_dir):
    out = documents.layout_pages(layouts(spark, sf_dir))
    return out.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.sha2("content", 256).alias("content"), F.col("page_count").cast("long").alias("page_count"), "tables", "images")


@query("layout_pages", f"with {LAY}, n as (select doc_id, count(*) as pages, sum(length(content))::bigint as chars from pg where content <> '' group by 1) select doc_id, pages, chars, page_count, tables, images from n join wh using (doc_id)")
def layout_pages(spark, sf_dir):
    """What the layouts of a document come to: its pages that hold text, and the blocks of each kind."""
    pages = documents.layout_pages(layouts(spark, sf_dir))
    sums = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("content")).alias("chars"), *[F.max(c).cast("long").alias(c) for c in ("page_count", "tables", "images")])
    return sums


@query("route_decision", f"with {FI}, o as (select *, case when ok then route when f in ('NATIVE', 'DEEP', 'OCR') then 'ERROR' else 'NATIVE' end as outcome from ro) select route, outcome, pages is null as probe_failed, count(*) as files from o group by all")
def route_decision(spark, sf_dir):
    """Files by the route that was chosen and what became of it, failed probes apart."""
    out = documents.routed(files(spark, sf_dir))
    return out.groupBy("route", "outcome", F.col("pages").isNull().alias("probe_failed")).agg(F.count(F.lit(1)).alias("files"))


@query("mime_type_map", f"with {FI} select mime, case mime when 'application/pdf' then 'PDF' when 'text/markdown' then 'MD' when 'text/plain' then 'TXT' when 'text/html' then 'HTML' else 'UNKNOWN' end as kind, count(*) as files from fi group by all")
def mime_type_map(spark, sf_dir):
    out = files(spark, sf_dir)
    return out.groupBy("mime", T.mime_kind(F.col("mime")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query("merged_pages", r"""with pa as (select conv_id as doc_id, turn, case when turn % 2 = 0 then '| a | b |' || chr(10) || '|---|---|' || chr(10) else '' end || text as text from conversations)
select doc_id, sha256(string_agg(text, chr(10) || chr(10) order by turn, text)) as text, count(*) as pages, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) like '|%' and contains(x, '---'))))::bigint as tables from pa group by 1""")
def merged_pages(spark, sf_dir):
    """Turns of conversations as pages that were read one by one, every second one with a table."""
    rule = F.when(F.col("turn") % 2 == 0, F.lit("| a | b |\n|---|---|\n")).otherwise(F.lit(""))
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.concat(rule, "text").alias("text"))
    return documents.merged_pages(pages).select("doc_id", F.sha2("text", 256).alias("text"), "pages", "tables")


def chunk_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("doc_id"), F.col("source").alias("tenant_id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("name"), F.col("lang").alias("original_name"),
        F.col("text").alias("content"), _pick(["TEXT", "TABLE", "other", None], (F.col("doc_id") % 4).cast("int")).alias("chunk_type"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9).alias("page_num"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5 == 1).alias("is_deleted"),
    )


@query("vector_metadata", "select doc_id as chunk_id, doc_id // 10 as doc_id, source as tenant_id, case when doc_id % 4 = 1 then 'TABLE' else 'TEXT' end as chunk_type, case when doc_id % 3 > 0 then lang else 'unknown' end as file_name, case when doc_id % 2 = 0 then doc_id % 9 else 0 end as page_num, doc_id % 5 = 1 as is_deleted from documents")
def vector_metadata(spark, sf_dir):
    return documents.vector_metadata(chunk_rows(spark, sf_dir))


@query("index_documents", "select doc_id as chunk_id, doc_id // 10 as doc_id, source as tenant_id, sha256(text) as content, coalesce(['TEXT', 'TABLE', 'other', null][doc_id % 4 + 1], 'TEXT') as chunk_type, lang as file_name, case when doc_id % 2 = 0 then doc_id % 9 end as page_num, false as is_deleted from documents")
def index_documents(spark, sf_dir):
    return documents.index_documents(chunk_rows(spark, sf_dir)).withColumn("content", F.sha2("content", 256))


@query("index_upsert", "select doc_id, source, case when doc_id % 7 = 0 then upper(lang) else lang end as lang from documents union all select doc_id + 1000000000, source, 'new' from documents where doc_id % 50 = 0")
def index_upsert(spark, sf_dir):
    """Documents with those of a later delivery in place of theirs, and its new ones."""
    old = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    again = old.where("doc_id % 7 = 0").withColumn("lang", F.upper("lang"))
    new = old.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "source", F.lit("new").alias("lang"))
    return documents.upserted(old, again.unionByName(new), "doc_id")


@query("sessions_inserted", "select conv_id, min(text) as title from conversations where conv_id not in (select conv_id from conversations where turn = 5) group by 1")
def sessions_inserted(spark, sf_dir):
    """Sessions that are not there yet, one row each however many requests begin one."""
    c = table(spark, sf_dir, "conversations")
    return documents.inserted(c.where("turn = 5").select("conv_id"), c.select("conv_id", F.col("text").alias("title")), "conv_id")


@query("bulk_failures", "select source, count(*) as items, count(*) filter (n_chars % 3 = 0) as failed, coalesce(array_to_string(list_sort(list_distinct(list(doc_id) filter (n_chars % 3 = 0)))[1:5], ','), '') as examples from documents group by 1")
def bulk_failures(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 3 == 0, F.lit("rejected")).alias("error"))
    return documents.bulk_failures(items, "source").withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query("page_counts", "select conv_id, case when any_value(n) > 0 then any_value(n) else count(*) end as pages from (select conv_id, conv_id % 4 - 1 as n from conversations) group by 1")
def page_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"))
    return c.select("conv_id", documents.page_count(F.col("conv_id") % 4 - 1, F.col("parts")).alias("pages"))


@query("ingested_documents", "select source, count(*) as documents, count(*) filter (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10) as succeeded from documents group by 1")
def ingested_documents(spark, sf_dir):
    """Documents through the parser and the splitter; how many end with chunks."""
    d = table(spark, sf_dir, "documents")
    _, summary = documents.ingested(d.select("doc_id", F.col("text").cast("binary").alias("content"), "source"))
    return summary.join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"))


@query("parsed_pages", r"""with body as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\s+', ' ', 'g') as h from pages),
  plain as (select page_id, regexp_replace(regexp_replace(h, '</?(html|body|nav|ul|li|div|article|h1|p|footer|br)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from body),
  lines as (select page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as l from plain)
  select page_id, len(l) as lines, md5(array_to_string(l, chr(10))) as text_md5 from lines where len(l) > 0""")
def parsed_pages(spark, sf_dir):
    """HTML files to the lines of their bodies."""
    p = parsers.parsed(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content")), "HTML")
    return p.select(F.col("doc_id").alias("page_id"), F.size(F.split("text", "\n")).cast("long").alias("lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("ingested_kinds", """with f as (select text, case doc_id % 5 when 0 then 'TXT' when 1 then 'MD' when 2 then 'HTML' when 3 then 'DOCX' else 'PDF' end as kind from documents)
  select kind, count(*) as files, count(*) filter (kind in ('TXT', 'MD', 'HTML') and length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10) as succeeded,
  count(*) filter (kind = 'DOCX') as broken, count(*) filter (kind = 'PDF') as without_parser from f group by 1""")
def ingested_kinds(spark, sf_dir):
    """Documents as files of a kind each, chunked whatever becomes of the others: those called DOCX hold no archive, and PDF has no parser."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    kind = _pick(["TXT", "MD", "HTML", "DOCX", "PDF"], n.cast("int"))
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    content = F.when(n == 2, F.concat(F.lit("<html><body><p>"), escaped, F.lit("</p></body></html>"))).otherwise(F.col("text"))
    files = d.select("doc_id", content.cast("binary").alias("content"), kind.alias("kind"))
    _, summary = documents.ingested_files(files)
    return summary.join(files.select("doc_id", "kind"), "doc_id").groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("error") == "BadZipFile").alias("broken"), F.count_if(F.col("error") == "no parser").alias("without_parser"),
    )


@query("injection_defaults", "select conv_id, turn, contains(lower(text), 'x') or turn % 3 = 0 as rejected from conversations")
def injection_defaults(spark, sf_dir):
    """Every third turn tries one of the default terms, in capitals; and one more term is configured."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.upper(_pick(T.INJECTION, (F.col("conv_id") % len(T.INJECTION)).cast("int")))))
    return c.select("conv_id", "turn", T.has_any(F.coalesce(said, "text"), [*T.INJECTION, "x"], True).alias("rejected"))


@query("display_fields", """select event_id, strftime(ts, '%Y-%m-%d %H:%M') as time, case when abs(value) >= 10 then printf('%.2f', value) else printf('%.4f', value) end as score,
  case when event_id = 0 then '—' when event_id * 977 < 1024 then (event_id * 977) || ' B' when event_id * 977 < 1048576 then printf('%.1f', round(event_id * 977 / 1024.0::double, 1)) || ' KB' else printf('%.1f', round(event_id * 977 / 1048576.0::double, 1)) || ' MB' end as size,
  round(greatest(abs(value) / greatest(max(abs(value)) over (partition by event_type), 1e-9) * 100, 2), 6) as bar,
  case event_id % 8 when 0 then 5 when 1 then 15 when 2 then 30 when 3 then 50 when 4 then 85 when 5 then 100 when 6 then 0 end as percent, try_cast(case when event_id % 4 = 0 then 'p' || event_id else ' ' || event_id end as int) as page from events""")
def display_fields(spark, sf_dir):
    """How numbers and times are shown."""
    stages = ["READING", "TRANSFORMING", "PERSISTING", "EMBEDDING", "INDEXING", "COMPLETED", "FAILED", "UNKNOWN"]
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    most = F.col("most")
    return documents.with_most(e.select("*", F.abs("value").alias("size_of")), "event_type", "size_of").select(
        "event_id", T.time_shown(F.col("ts")).alias("time"), T.score_shown(F.col("value")).alias("score"), T.size_shown(n * 977).alias("size"), F.round(T.bar_width(F.col("value"), most), 6).alias("bar"),
        T.stage_percent(_pick(stages, (n % 8).cast("int"))).alias("percent"), T.page_number(F.concat(F.when(n % 4 == 0, F.lit("p")).otherwise(F.lit(" ")), n.cast("string"))).alias("page"),
    )


@query("chunk_bars", "select doc_id, round(greatest(n_chars / greatest(max(n_chars) over (partition by source), 1)::double * 64, 6), 6) as height from documents")
def chunk_bars(spark, sf_dir):
    """How high each one's bar stands beside its source's longest."""
    d = documents.with_most(table(spark, sf_dir, "documents"), "source", "n_chars")
    return d.select("doc_id", F.round(T.bar_height(F.col("n_chars"), F.col("most")), 6).alias("height"))
