"""Guards, text functions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, contain, documents
from ..sources.tables import table
from .registry import query, sql_has_text, sql_stripped

AT = r"[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}"


@query("pii_mask", rf"select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^0-9])1[3-9][0-9]{{9}}($|[^0-9])', '\1' || '1***-****-****' || '\2', 'g'), '(^|[^0-9])[0-9]{{17}}[0-9Xx]($|[^0-9Xx])', '\1' || repeat('*', 18) || '\2', 'g'), '[0-9A-Za-z_.-]+@[0-9A-Za-z_.-]+\.[a-zA-Z]{{2,}}', '***@***.***', 'g')) as masked from documents")
def pii_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.sanitize(F.col("text")), 256).alias("masked"))


@query("injection_detect", "select conv_id, turn, contains(lower(text), 'the') or contains(lower(text), 'ignore all') as rejected from conversations")
def injection_detect(spark, sf_dir):
    words = T.terms(" THE, ignore all ,,")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.has_any(F.col("text"), words, True).alias("rejected"))


@query("output_blacklist", "select doc_id, contains(text, 'The') or contains(text, 'Und') as blocked from documents")
def output_blacklist(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_any(F.col("text"), T.terms("The,Und", lower=False), False).alias("blocked"))


@query("stream_guard_replace", "with s as (select conv_id, string_agg(text, '' order by turn) as answer from conversations where role = 'assistant' group by conv_id) select conv_id, contains(answer, 'hathe') as blocked, sha256(case when contains(answer, 'hathe') then 'This answer was withheld.' else answer end) as shown from s")
def stream_guard_replace(spark, sf_dir):
    """Parts of an answer are joined first, so that a term split over two of them is seen."""
    parts = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    whole = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("answer"))
    hit = T.has_any(F.col("answer"), ["hathe"], False)
    return whole.select("conv_id", hit.alias("blocked"), F.sha2(F.when(hit, F.lit("This answer was withheld.")).otherwise(F.col("answer")), 256).alias("shown"))


@query("token_estimate", "select doc_id, trunc(length(text) / 2.5::double)::bigint as tokens from documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("chunk_stats", "select source, count(*) as chunks, round(avg(trunc(length(text) / 2.5::double)), 6) as avg_tokens, max(trunc(length(text) / 2.5::double))::bigint as max_tokens, count(*) filter (contains(text, ' | ')) as tables from documents group by source")
def chunk_stats(spark, sf_dir):
    t = T.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(t), 6).alias("avg_tokens"), F.max(t).cast("long").alias("max_tokens"), F.count_if(F.contains("text", F.lit(" | "))).alias("tables"))


FIRST = """first as (select conv_id, case conv_id % 5 when 0 then chr(9) || chr(10) || ' ' when 1 then null when 2 then chr(9) || text || chr(10) when 3 then substr(text, 1, 20) || chr(8195) else text end as text
  from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n = 1)"""


@query("session_titles", f"with {FIRST}, t as (select *, regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') as s from first) select conv_id, case when not {sql_has_text('text')} then 'untitled' when length(s) > 50 then substr(s, 1, 50) || '…' else s end as title from t")
def session_titles(spark, sf_dir):
    """Titles of first questions, some of white space only, some with it at their ends."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    kind, text = F.col("conv_id") % 5, F.col("text")
    asked = F.when(kind == 0, F.lit("\t\n ")).when(kind == 2, F.concat(F.lit("\t"), text, F.lit("\n"))).when(kind == 3, F.concat(F.substring(text, 1, 20), F.lit("\u2003"))).when(kind == 4, text)
    return c.select("conv_id", T.title(asked).alias("title"))


@query("escape_and_truncate", "select doc_id, replace(replace(replace(case when length(text) > 800 then substr(text, 1, 800) || '…' else text end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as shown from documents")
def escape_and_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_html(T.truncate(F.col("text"), 800)).alias("shown"))


FENCES = """raw as (select doc_id, case doc_id % 8 when 0 then chr(10) || '```html' || chr(10) || text || chr(10) || '```' || chr(9) when 1 then chr(9) || text || chr(10) when 2 then '```md' || chr(10) || text
  when 3 then null when 4 then '```' || chr(10) || '```' when 5 then '```' || replace(text, chr(10), ' ') || '```' when 6 then '``````' else '```' || chr(10) || chr(9) || text || '```' end as raw from documents)"""
STRIPPED = f"""s as (select *, {sql_stripped('raw')} as t from raw),
  c as (select doc_id, case when starts_with(t, '```') and ends_with(t, '```') and length(t) > 6 and contains(t, chr(10)) then {sql_stripped("substr(t, strpos(t, chr(10)) + 1, greatest(length(t) - 3 - strpos(t, chr(10)), 0))")} else coalesce(raw, '') end as content from s)"""


@query("strip_code_fence", f"with {FENCES}, {STRIPPED} select doc_id, length(content) as n, sha256(content) as content from c")
def strip_code_fence(spark, sf_dir):
    """Texts with all kinds of fences: closed, open, empty, on one line, with white space around."""
    kind, text = F.col("doc_id") % 8, F.col("text")
    made = [F.concat(F.lit("\n```html\n"), text, F.lit("\n```\t")), F.concat(F.lit("\t"), text, F.lit("\n")), F.concat(F.lit("```md\n"), text), F.lit(None), F.lit("```\n```"), F.concat(F.lit("```"), F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("```")), F.lit("``````")]
    raw = F.concat(F.lit("```\n\t"), text, F.lit("```"))
    for i, m in enumerate(made):
        raw = F.when(kind == i, m).otherwise(raw)
    content = T.strip_fence(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(content).cast("long").alias("n"), F.sha2(content, 256).alias("content"))


TERMS = "te as (select distinct unnest(regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]{4,}')) as term from benchmark)"


@query("term_table_guard", f"with {TERMS} select doc_id, count(*) as terms, sha256(string_agg(term, ',' order by term)) as found from documents join te on contains(lower(text), term) group by doc_id")
def term_table_guard(spark, sf_dir):
    """Texts against a table of terms (all words of four letters or more of the benchmark), as parts of words too."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{4,}"), F.lit(0))
    terms = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).distinct().select(F.col("term").alias("term_id"), "term")
    met = contain.terms_found(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), terms, ignore_case=True)
    listed = F.array_join(F.array_sort(F.collect_list("term_id")), ",")
    return met.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("terms"), F.sha2(listed, 256).alias("found"))


@query("split_fixed")
def split_fixed(spark, sf_dir):
    return chunking.split_documents(table(spark, sf_dir, "documents"))


@query("html_protect_split")
def html_protect_split(spark, sf_dir):
    return chunking.split_documents(table(spark, sf_dir, "pages"), "page_id", "html")


@query("embed_batches", "select source, b as batch, count(*) as n, min(doc_id) as first_id from (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 10 as b from documents) group by 1, 2")
def embed_batches(spark, sf_dir):
    """Batches of ten, numbered through each source, so that no window spans the table."""
    made = documents.batches(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 10, by="source")
    return made.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
