"""Search, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import snippet
from ..operators import chain, contain, evaluate, fusion, inverted, retrieve, vector_index
from ..sources.scratch import stored
from ..sources.tables import table
from .registry import query

BM = r"""
tok as (select doc_id as chunk_id, source, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') as ts from documents),
qt as (select distinct item_id as query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) as term from benchmark),
st as (select count(*) as n, avg(len(ts)) as avgdl from tok),
po as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, len(ts) as dl, unnest(ts) as term from tok) group by all),
df as (select term, count(*) as df from po group by term),
bs as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as score
  from po join df using (term) join qt using (term) cross join st group by query_id, chunk_id),
bm as (select * from (select *, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from bs) where rank <= 10)"""
VE = """
vq as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id in (select item_id from benchmark)),
vs as (select query_id, vec_id as chunk_id, list_inner_product(q, embedding::double[]) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(embedding::double[], embedding::double[]))) as score from embeddings, vq),
ve as (select * from (select *, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from vs) where rank <= 10)"""
FU = """
un as (select query_id, chunk_id, rank, score, 'v' as p from ve union all select query_id, chunk_id, rank, score, 'b' from bm),
f0 as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as fusion_score, max(case when p = 'v' then rank end) as vector_rank, max(case when p = 'b' then rank end) as bm25_rank,
  max(case when p = 'v' then score end) as vector_score, max(case when p = 'b' then score end) as bm25_score from un group by query_id, chunk_id),
fu as (select * from (select *, row_number() over (partition by query_id order by round(fusion_score, 12) desc, vector_rank nulls last, bm25_rank nulls last) as fused_rank from f0) where fused_rank <= 10)"""


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def question_vectors(spark, sf_dir):
    """The vector of the same number stands for a question."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return e.join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def index(spark, sf_dir):
    """The index of all documents, made by the first query that needs it."""
    return retrieve.kept_index(chunks(spark, sf_dir))


def bm25_hits(spark, sf_dir):
    return stored(retrieve.bm25_topk(index(spark, sf_dir), questions(spark, sf_dir)))


def vector_hits(spark, sf_dir, measure="cosine", threshold=None):
    return stored(retrieve.vector_topk(question_vectors(spark, sf_dir), vectors(spark, sf_dir), 10, measure, threshold))


def fused_hits(spark, sf_dir):
    return fusion.fuse(vector_hits(spark, sf_dir), bm25_hits(spark, sf_dir))


def _hits(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_topk", f"with {BM} select query_id, chunk_id, round(score, 6) as score, rank from bm")
def bm25_topk(spark, sf_dir):
    return _hits(bm25_hits(spark, sf_dir))


LATER = r"""documents as (select doc_id, case when doc_id % 7 = 0 then 'renewed words of the ' || text else text end as text, source from memory_documents where doc_id % 5 <> 0
  union all select doc_id + 1000000000, 'a new text about ' || text, source from memory_documents where doc_id % 50 = 1)"""


@query("index_refresh", f"with memory_documents as (select * from documents), {LATER.replace('documents as (', 'docs as (', 1)}, {BM.replace('from documents)', 'from docs)')} select query_id, chunk_id, round(score, 6) as score, rank from bm")
def index_refresh(spark, sf_dir):
    """Hits of an index after an upsert of known and new chunks and a delete: those of an index built anew."""
    c = chunks(spark, sf_dir)
    changed = c.where("chunk_id % 7 = 0").withColumn("text", F.concat(F.lit("renewed words of the "), "text"))
    new = c.where("chunk_id % 50 = 1").select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), F.concat(F.lit("a new text about "), "text").alias("text"), "source")
    grown = inverted.upsert(retrieve.index_chunks(c), changed.unionByName(new))
    return _hits(retrieve.bm25_topk(inverted.delete(grown, c.where("chunk_id % 5 = 0").select("chunk_id")), questions(spark, sf_dir)))


@query("bm25_tenant_filtered", f"with {BM}, fl as (select bs.* from bs join documents d on d.doc_id = bs.chunk_id where d.source = 'src3') select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from fl) where rank <= 10")
def bm25_tenant_filtered(spark, sf_dir):
    return _hits(retrieve.bm25_topk(index(spark, sf_dir), questions(spark, sf_dir), live=F.col("source") == "src3"))


@query("vector_topk_cosine", f"with {VE} select query_id, chunk_id, round(score, 6) as score, rank from ve")
def vector_topk_cosine(spark, sf_dir):
    return _hits(vector_hits(spark, sf_dir))


@query("vector_topk_ip", f"with {VE}, ip as (select query_id, vec_id as chunk_id, list_inner_product(q, embedding::double[]) as score from embeddings, vq) select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from ip) where rank <= 10")
def vector_topk_ip(spark, sf_dir):
    return _hits(vector_hits(spark, sf_dir, "ip"))


@query("vector_topk_l2", f"with {VE}, l2 as (select query_id, vec_id as chunk_id, -list_distance(q, embedding::double[]) as score from embeddings, vq where vec_id <> query_id) select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from l2) where rank <= 10")
def vector_topk_l2(spark, sf_dir):
    hits = retrieve.vector_topk(question_vectors(spark, sf_dir), vectors(spark, sf_dir), 11, "l2").where("query_id <> chunk_id").drop("rank")
    return _hits(retrieve.ranked(hits, 10))


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """As ``vector_topk_cosine``, by the cells of the index; which hits an index finds SQL can't say."""
    index = vector_index.kept_index(vectors(spark, sf_dir))
    return _hits(vector_index.topk(index, question_vectors(spark, sf_dir)))


@query("vector_index_recall", f"with {VE} select count(*) as nearest, true as recall_is_enough from ve")
def vector_index_recall(spark, sf_dir):
    """How many true nearest ones there are, and whether the index finds nine tenths of them."""
    found, true = stored(vector_index_topk(spark, sf_dir)), vector_hits(spark, sf_dir)
    both = true.join(found.select("query_id", "chunk_id", F.lit(1).alias("met")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("nearest"), (F.count("met") >= 0.9 * F.count(F.lit(1))).alias("recall_is_enough"))


@query("vector_index_cells", "select count(*) as vectors, true as all_indexed from embeddings")
def vector_index_cells(spark, sf_dir):
    """Every vector lies in one cell."""
    index = vector_index.kept_index(vectors(spark, sf_dir))
    held = index.vectors().select("chunk_id", "cell").alias("i").join(vectors(spark, sf_dir).select("chunk_id"), "chunk_id", "right")
    return held.agg(F.count(F.lit(1)).alias("vectors"), (F.count("cell") == F.count(F.lit(1))).alias("all_indexed"))


@query("vector_threshold", f"with {VE} select query_id, chunk_id, round(score, 6) as score, rank from ve where score >= 0.1")
def vector_threshold(spark, sf_dir):
    return _hits(vector_hits(spark, sf_dir, threshold=0.1))


@query("vector_pairs_over_half", f"with {VE} select query_id, chunk_id, round(score, 6) as score from vs where score >= 0.5")
def vector_pairs_over_half(spark, sf_dir):
    out = retrieve.similarity(question_vectors(spark, sf_dir), vectors(spark, sf_dir), "cosine", 0.5)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("rrf_fusion", f"with {BM}, {VE}, {FU} select query_id, chunk_id, round(fusion_score, 9) as fusion_score, vector_rank, bm25_rank, fused_rank from fu")
def rrf_fusion(spark, sf_dir):
    return fused_hits(spark, sf_dir).select("query_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), *[F.col(c).cast("long").alias(c) for c in ("vector_rank", "bm25_rank", "fused_rank")])


@query("rrf_single_path", f"with {BM} select query_id, chunk_id, round(1.0::double / (60 + rank), 9) as fusion_score, rank as fused_rank from bm")
def rrf_single_path(spark, sf_dir):
    b = bm25_hits(spark, sf_dir)
    return fusion.fuse(b.where("false"), b).select("query_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), F.col("fused_rank").cast("long").alias("fused_rank"))


@query("hybrid_topk", f"with {BM}, {VE}, {FU} select query_id, chunk_id, round(fusion_score, 9) as fusion_score, fused_rank as final_rank from fu where fused_rank <= 5")
def hybrid_topk(spark, sf_dir):
    return fusion.rerank_degraded(fused_hits(spark, sf_dir)).select("query_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), F.col("final_rank").cast("long").alias("final_rank"))


@query("rerank_index_join", f"with {BM}, {VE}, {FU} select query_id, chunk_id, round(((fused_rank - 1) * 7 % 10) / 10.0::double, 6) as relevance, row_number() over (partition by query_id order by ((fused_rank - 1) * 7 % 10) desc, fused_rank) as final_rank from fu qualify final_rank <= 5")
def rerank_index_join(spark, sf_dir):
    made = spark.range(12).select(F.col("id").cast("int").alias("index"), (F.pmod(F.col("id") * 7, F.lit(10)) / 10.0).alias("relevance"))
    hits = fused_hits(spark, sf_dir)
    results = questions(spark, sf_dir).select("query_id").crossJoin(F.broadcast(made))  # twelve answers to each question
    return fusion.apply_rerank(hits, results).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), F.col("final_rank").cast("long").alias("final_rank"))


@query("debug_candidates", f"""with {BM}, {VE}, {FU}, al as (select query_id, chunk_id from bm union select query_id, chunk_id from ve),
fi as (select * from fu where fused_rank <= 5)
select al.query_id, al.chunk_id, bm.rank as bm25_rank, ve.rank as vector_rank, fi.fused_rank as final_rank, round(fi.fusion_score, 9) as fusion_score,
  row_number() over (partition by al.query_id order by fi.fused_rank nulls last, bm.rank nulls last, ve.rank nulls last) as position
from al left join bm using (query_id, chunk_id) left join ve using (query_id, chunk_id) left join fi using (query_id, chunk_id)""")
def debug_candidates(spark, sf_dir):
    v, b = vector_hits(spark, sf_dir), bm25_hits(spark, sf_dir)
    out = fusion.debug_candidates(v, b, fusion.rerank_degraded(fusion.fuse(v, b)))
    return out.select("query_id", "chunk_id", *[F.col(c).cast("long").alias(c) for c in ("bm25_rank", "vector_rank", "final_rank")], F.round("fusion_score", 9).alias("fusion_score"), F.col("position").cast("long").alias("position"))


@query("trace_projection", rf"""with {BM} select b.query_id, b.chunk_id, d.source as file_name, b.rank,
  case when length(regexp_replace(d.text, '\s+', ' ', 'g')) > 120 then substr(regexp_replace(d.text, '\s+', ' ', 'g'), 1, 120) || '…' else regexp_replace(d.text, '\s+', ' ', 'g') end as snippet
from bm b join documents d on d.doc_id = b.chunk_id""")
def trace_projection(spark, sf_dir):
    hits = bm25_hits(spark, sf_dir)
    return chunks(spark, sf_dir).join(retrieve.small(hits), "chunk_id").select("query_id", "chunk_id", F.col("source").alias("file_name"), F.col("rank").cast("long").alias("rank"), snippet(F.col("text")).alias("snippet"))


@query("trace_metrics", f"with {BM}, {VE}, {FU} select query_id, count(*) as n_final, round(max(fusion_score), 9) as top_fusion_score, count(*) filter (vector_rank is not null and bm25_rank is not null) as n_both, count(*) filter (vector_rank is null) = count(*) as vector_degraded from fu group by query_id")
def trace_metrics(spark, sf_dir):
    return fused_hits(spark, sf_dir).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_final"), F.round(F.max("fusion_score"), 9).alias("top_fusion_score"),
        F.count_if(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull()).alias("n_both"), F.bool_and(F.col("vector_rank").isNull()).alias("vector_degraded"),
    )


@query("fail_closed", f"with {BM} select query_id, least(count(*), 10) as n from bs where query_id % 2 = 0 and chunk_id % 3 > 0 group by query_id")
def fail_closed(spark, sf_dir):
    """Questions of no tenant or one of white space (the odd ones) find nothing, not even chunks of no tenant."""
    q = questions(spark, sf_dir).withColumn("tenant", F.when(F.col("query_id") % 2 == 0, F.lit("t")).when(F.col("query_id") % 4 == 1, F.lit("\t\n ")))
    owner = F.when(F.col("chunk_id") % 3 > 0, F.lit("t")).when(F.col("chunk_id") % 9 > 0, F.lit("\t\n "))
    held = retrieve.index_chunks(chunks(spark, sf_dir).withColumn("tenant", owner))
    return retrieve.bm25_topk(held, q, tenant="tenant").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


# what holds a benchmark text word for word is what its question should find
RE = """
ex as (select b.item_id as query_id, b.item_id % 5 = 4 as negative, list(d.doc_id order by d.doc_id) filter (d.doc_id is not null) as expected from benchmark b left join documents d on contains(d.text, b.text) group by b.item_id),
hi as (select ex.query_id, bm.rank, case when list_contains(expected, bm.chunk_id) then 1 else 0 end as rel from ex join bm using (query_id)),
ru as (select *, sum(rel) over (partition by query_id order by rank) as seen from hi),
pe as (select query_id, sum(rel) as found, min(case when rel = 1 then rank end) as first, sum(case when rel = 1 then seen / rank::double end) as prec from ru group by query_id),
me as (select ex.query_id, negative, case when len(expected) > 0 then coalesce(found, 0) / len(expected)::double end as recall,
  case when len(expected) > 0 then coalesce(1.0::double / first, 0) end as reciprocal_rank, case when len(expected) > 0 then coalesce(prec, 0) / len(expected)::double end as context_precision
  from ex left join pe using (query_id))"""


def cases(spark, sf_dir):
    q = questions(spark, sf_dir)
    held = contain.containing(chunks(spark, sf_dir), q, index(spark, sf_dir))
    want = held.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("expected"))
    none = F.array().cast("array<long>")
    return q.select("query_id").join(want, "query_id", "left").select("query_id", (F.col("query_id") % 5 == 4).alias("negative"), F.coalesce("expected", none).alias("expected"))


def case_metrics(spark, sf_dir):
    c = stored(cases(spark, sf_dir))
    return c.select("query_id", "negative").join(evaluate.metrics(c, bm25_hits(spark, sf_dir)), "query_id")


@query("retrieval_metrics", f"with {BM}, {RE} select query_id, round(recall, 6) as recall, round(reciprocal_rank, 6) as reciprocal_rank, round(context_precision, 6) as context_precision from me")
def retrieval_metrics(spark, sf_dir):
    return case_metrics(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "context_precision")])


REPORT = f"with {BM}, {RE}, rp as (select count(*) as n_cases, count(recall) as n_retrieval, count(*) filter (not negative and query_id % 6 <> 1) as n_generation, count(*) filter (negative and query_id % 7 <> 2) as n_negative, round(avg(recall), 6) as recall, round(avg(reciprocal_rank), 6) as mrr, round(avg(context_precision), 6) as context_precision, round(avg(case when not negative and query_id % 6 <> 1 then 1 + query_id % 5 end)::double, 6) as faithfulness, round(avg(case when not negative and query_id % 6 <> 1 then 1 + query_id % 3 end)::double, 6) as relevancy, round(avg(case when negative and query_id % 7 <> 2 then case when query_id % 3 = 0 then 1.0::double else 0.0::double end end), 6) as rejection from me)"


def report(spark, sf_dir):
    """Judge scores are an input; here they follow from the question's number, and some are missing."""
    m, n = case_metrics(spark, sf_dir), F.col("query_id")
    verdict = F.when(n % 7 != 2, F.when(n % 3 == 0, F.lit("rejected")).otherwise(F.lit("PARTIAL")))
    judged = questions(spark, sf_dir).select("query_id", (n % 5 == 4).alias("negative"), F.when(n % 6 != 1, 1 + n % 5).alias("faithfulness"), (1 + n % 3).alias("relevancy"), verdict.alias("verdict"))
    return evaluate.report(m.drop("negative"), judged)


@query("eval_report", f"{REPORT} select * from rp")
def eval_report(spark, sf_dir):
    return report(spark, sf_dir)


@query("eval_gate", f"""{REPORT} select * from (select 'recall' as metric, recall as value, 0.85::double as threshold, recall >= 0.85 as passed from rp union all select 'mrr', mrr, 0.7, mrr >= 0.7 from rp
union all select 'faithfulness', faithfulness, 4.0, faithfulness >= 4 from rp union all select 'rejection', rejection, 0.85, rejection >= 0.85 from rp) where value is not null""")
def eval_gate(spark, sf_dir):
    return evaluate.gate(report(spark, sf_dir))


@query("citation_join", f"with {BM}, {VE}, {FU}, ci as (select query_id, unnest([1, 3, 9]) as n from (select item_id as query_id from benchmark)) select ci.query_id, n::bigint as n, chunk_id from ci join fu on fu.query_id = ci.query_id and fu.fused_rank = ci.n and fu.fused_rank <= 5")
def citation_join(spark, sf_dir):
    answers = questions(spark, sf_dir).select("query_id", F.lit("as [ref-1] and [ref-3] say, not [ref-9]").alias("answer"))
    cited = answers.select("query_id", F.explode(F.regexp_extract_all("answer", F.lit(r"\[ref-(\d+)\]"), F.lit(1)).cast("array<int>")).alias("n"))
    final = fusion.rerank_degraded(fused_hits(spark, sf_dir)).select("query_id", "chunk_id", F.col("final_rank").alias("n"))
    return cited.join(final, ["query_id", "n"]).select("query_id", F.col("n").cast("long").alias("n"), "chunk_id")


@query("prompt_assembly", f"with {BM}, c as (select query_id, string_agg('[' || chunk_id || '] ' || d.source, chr(10) || chr(10) order by rank) as context from bm join documents d on d.doc_id = bm.chunk_id where rank <= 5 group by query_id) select b.item_id as query_id, case when c.context is null then 'No evidence was found.' else 'Question: ' || b.text || chr(10) || c.context end as prompt from benchmark b left join c on c.query_id = b.item_id")
def prompt_assembly(spark, sf_dir):
    hits = retrieve.small(bm25_hits(spark, sf_dir).where("rank <= 5"))
    lines = chunks(spark, sf_dir).select("chunk_id", "source").join(hits, "chunk_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.col("source")).alias("line")))).alias("l"))
    context = lines.select("query_id", F.array_join("l.line", "\n\n").alias("context"))
    return questions(spark, sf_dir).join(context, "query_id", "left").select("query_id", F.when(F.col("context").isNull(), F.lit("No evidence was found.")).otherwise(F.concat(F.lit("Question: "), "text", F.lit("\n"), "context")).alias("prompt"))


def _metadata(spark, sf_dir, hits, side):
    """Hits with the metadata that their own path has."""
    d = chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    if side == "v":
        more = d.select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("v-"), "source")).alias("file_name"), F.col("lang").alias("chunk_type"))
    else:
        more = d.select("chunk_id", F.concat(F.lit("b-"), "source").alias("file_name"), (F.col("chunk_id") % 10).alias("page_num"))
    return hits.join(more, "chunk_id", "left")


@query("rrf_metadata", f"""with {BM}, {VE}, {FU},
me as (select un.query_id, un.chunk_id, max(case when p = 'v' and doc_id % 2 = 0 then 'v-' || source end) as vf, max(case when p = 'b' then 'b-' || source end) as bf,
  max(case when p = 'v' then lang end) as chunk_type, max(case when p = 'b' then doc_id % 10 end) as page_num from un left join documents d on d.doc_id = un.chunk_id group by 1, 2)
select fu.query_id, fu.chunk_id, coalesce(vf, bf) as file_name, chunk_type, page_num, round(fusion_score, 9) as fusion_score, fused_rank from fu join me using (query_id, chunk_id)""")
def rrf_metadata(spark, sf_dir):
    v, b = (_metadata(spark, sf_dir, h(spark, sf_dir), s).select("query_id", "chunk_id", "rank", "score", "file_name", c) for h, s, c in ((vector_hits, "v", "chunk_type"), (bm25_hits, "b", "page_num")))
    return fusion.fuse(v, b).select("query_id", "chunk_id", "file_name", "chunk_type", "page_num", F.round("fusion_score", 9).alias("fusion_score"), F.col("fused_rank").cast("long").alias("fused_rank"))


TENANT = "'src' || (query_id % 4)"
TEN = f"""
ow as (select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)),
bt as (select * from (select bs.*, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from bs join ow on ow.doc_id = bs.chunk_id where ow.source = {TENANT}) where rank <= 10),
vt as (select * from (select vs.*, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from vs join ow on ow.doc_id = vs.chunk_id where ow.source = {TENANT}) where rank <= 10),
ut as (select query_id, chunk_id, rank, 'v' as p from vt union all select query_id, chunk_id, rank, 'b' from bt),
ft as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as fusion_score, max(case when p = 'v' then rank end) as vector_rank, max(case when p = 'b' then rank end) as bm25_rank from ut group by 1, 2),
rt as (select *, row_number() over (partition by query_id order by round(fusion_score, 12) desc, vector_rank nulls last, bm25_rank nulls last) as fused_rank from ft)"""


def _owned(spark, sf_dir):
    """Chunks with their tenant, and whether they are deleted (documents marked toxic)."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")).distinct().withColumn("is_deleted", F.lit(True))
    return chunks(spark, sf_dir).withColumnRenamed("source", "tenant").join(gone, "chunk_id", "left").withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))


@query("hybrid_tenant", f"with {BM}, {VE}, {TEN} select query_id, chunk_id, round(fusion_score, 9) as fusion_score, vector_rank, bm25_rank, fused_rank from rt where fused_rank <= 10 and query_id % 7 <> 3")
def hybrid_tenant(spark, sf_dir):
    """Both paths see only what a question's own tenant holds and has not deleted; questions of nobody are not searched for."""
    tenant = F.when(F.col("query_id") % 14 == 3, F.lit("\t")).when(F.col("query_id") % 7 != 3, F.concat(F.lit("src"), (F.col("query_id") % 4).cast("string")))
    asked = lambda q: q.withColumn("tenant", tenant)
    owned = _owned(spark, sf_dir)
    b = retrieve.bm25_topk(retrieve.index_chunks(owned), asked(questions(spark, sf_dir)), tenant="tenant", live=~F.col("is_deleted"))
    held = vectors(spark, sf_dir).join(owned.drop("text"), "chunk_id")
    v = retrieve.vector_topk(asked(question_vectors(spark, sf_dir)), held, tenant="tenant", live=~F.col("is_deleted"))
    return fusion.fuse(v, b).select("query_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), *[F.col(c).cast("long").alias(c) for c in ("vector_rank", "bm25_rank", "fused_rank")])


HALVES = "(select item_id * 10 as item_id, text from benchmark union all select item_id * 10 + 1, substr(text, 1, length(text) // 2) from benchmark union all select item_id * 10 + 2, substr(text, length(text) // 2 + 1) from benchmark)"


@query("multi_query_union", f"""with {BM.replace("from benchmark)", f"from {HALVES})")}, un as (select query_id // 10 as query_id, chunk_id, max(score) as score from bm group by 1, 2)
select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, chunk_id) as rank from un) where rank <= 10""")
def multi_query_union(spark, sf_dir):
    """A question and its two halves, each searched for; a chunk counts with its best score."""
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    variants = chain.expanded(questions(spark, sf_dir), lambda t: [t, F.substr(t, F.lit(1), half(t)), F.substr(t, half(t) + 1)])
    hits = retrieve.bm25_topk(index(spark, sf_dir), variants.select((F.col("query_id") * 10 + F.col("variant")).alias("query_id"), "text"))
    return _hits(fusion.best_of_variants(hits.withColumn("query_id", F.floor(F.col("query_id") / 10)), 10))


@query("rerank_response", f"""with {BM}, {VE}, {FU}, an as (select *, query_id % 3 as shape, round(length(d.text) % 97 / 97.0::double, 6) as relevance from fu left join documents d on d.doc_id = fu.chunk_id),
ok as (select query_id, chunk_id, relevance, row_number() over (partition by query_id order by relevance desc, fused_rank) as final_rank from an where shape < 2 and relevance is not null)
select query_id, chunk_id, relevance, final_rank from ok where final_rank <= 5 union all select query_id, chunk_id, null, fused_rank from an where shape = 2 and fused_rank <= 5""")
def rerank_response(spark, sf_dir):
    """A scorer's answers as a service gives them: in either shape, or broken, where the fused order stays."""
    hits = stored(fused_hits(spark, sf_dir))
    scored = chunks(spark, sf_dir).join(F.broadcast(hits), "chunk_id").select("query_id", F.struct((F.col("fused_rank") - 1).alias("index"), F.round(F.length("text") % 97 / 97.0, 6).alias("relevance_score")).alias("r"))
    body = scored.groupBy("query_id").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("plain"))
    shaped = F.when(F.col("query_id") % 3 == 0, F.col("plain")).when(F.col("query_id") % 3 == 1, F.concat(F.lit('{"output":'), "plain", F.lit("}"))).otherwise(F.lit("{oops"))
    out = fusion.rerank(hits, stored(fusion.rerank_results(body.select("query_id", shaped.alias("body")))))
    return out.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), F.col("final_rank").cast("long").alias("final_rank"))


def probes(spark, sf_dir):
    """Ways of searching by name, each with its place in the order of choice."""
    return {"vector": (2, lambda: vector_hits(spark, sf_dir)), "bm25": (1, lambda: bm25_hits(spark, sf_dir)), "hybrid": (0, lambda: fused_hits(spark, sf_dir).withColumn("rank", F.col("fused_rank")))}


AB = """
pr as (select 'vector' as probe, 2 as place, query_id, chunk_id, rank from ve union all select 'bm25', 1, query_id, chunk_id, rank from bm union all select 'hybrid', 0, query_id, chunk_id, fused_rank from fu),
hm as (select probe, place, ex.query_id, pr.rank, case when list_contains(expected, pr.chunk_id) then 1 else 0 end as rel from ex join pr using (query_id)),
rm as (select *, sum(rel) over (partition by probe, query_id order by rank) as seen from hm),
pm as (select probe, query_id, sum(rel) as found, min(case when rel = 1 then rank end) as first, sum(case when rel = 1 then seen / rank::double end) as prec from rm group by 1, 2),
al as (select * from (select distinct probe, place from pr), ex)"""


@query("eval_ab_compare", f"""with {BM}, {VE}, {FU}, {RE}, {AB}
select al.probe, max(al.place) = 0 as chosen, count(*) as n_cases, round(avg(case when len(expected) > 0 then coalesce(found, 0) / len(expected)::double end), 6) as recall,
  round(avg(case when len(expected) > 0 then coalesce(1.0::double / first, 0) end), 6) as mrr, round(avg(case when len(expected) > 0 then coalesce(prec, 0) / len(expected)::double end), 6) as context_precision
from al left join pm on pm.probe = al.probe and pm.query_id = al.query_id group by al.probe""")
def eval_ab_compare(spark, sf_dir):
    """The same cases through each probe; the one that comes first is chosen."""
    return evaluate.compared(stored(cases(spark, sf_dir)), probes(spark, sf_dir))


@query("eval_annotation", f"with {BM} select query_id, rank, chunk_id, substr(regexp_replace(d.text, '\\s+', ' ', 'g'), 1, 120) as snippet from bm join documents d on d.doc_id = bm.chunk_id")
def eval_annotation(spark, sf_dir):
    """What a person who marks expected chunks is shown: ten hits a question with the begin of their text."""
    text = F.substring(F.regexp_replace("text", r"\s+", " "), 1, 120)
    return chunks(spark, sf_dir).join(F.broadcast(bm25_hits(spark, sf_dir)), "chunk_id").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", text.alias("snippet"))


@query("judge_prompts", f"""with {BM}, li as (select query_id, string_agg('[' || chunk_id || '] ' || case when length(d.text) > 800 then substr(d.text, 1, 800) || '…' else d.text end, chr(10) || chr(10) order by rank) as context from bm join documents d on d.doc_id = bm.chunk_id where rank <= 5 and d.source <> 'src2' group by query_id)
select item_id as query_id, sha256(case when context is null then 'No evidence was found for this question. Say so and nothing else.' else 'Answer from the evidence only and cite it as [ref-N].' || chr(10) || chr(10) || 'Evidence:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || text end) as prompt from benchmark left join li on query_id = item_id""")
def judge_prompts(spark, sf_dir):
    finals = chunks(spark, sf_dir).where("source <> 'src2'").join(F.broadcast(bm25_hits(spark, sf_dir).where("rank <= 5")), "chunk_id").select("query_id", "chunk_id", F.col("rank").alias("final_rank"), F.col("text").alias("content"))
    return chain.prompts(questions(spark, sf_dir), finals, most=800).select("query_id", F.sha2("prompt", 256).alias("prompt"))


@query("audit_log", f"""with {BM}, {VE}, {FU}, se as (select item_id as query_id, text, contains(lower(text), 'new instructions') or contains(lower(text), 'the ') as bad, length(text) as n from benchmark),
ra as (select query_id, to_json(list({{'chunk_id': chunk_id::varchar, 'file_name': d.source}} order by p, rank)) as j from un join documents d on d.doc_id = un.chunk_id where query_id not in (select query_id from se where bad) group by 1),
fi as (select query_id, to_json(list({{'chunk_id': chunk_id::varchar, 'file_name': d.source, 'score': round(fusion_score, 6)}} order by fused_rank)) as j from fu join documents d on d.doc_id = fu.chunk_id where fused_rank <= 5 and query_id not in (select query_id from se where bad) group by 1)
select se.query_id, text as query_text, text as rewritten_query, case when ra.j is not null then 'hybrid' end as retrieval_type, ra.j::varchar as retrieved_chunks, fi.j::varchar as reranked_chunks,
  least(n * 100000000, 2147483647)::bigint as latency_ms, case when n % 5 <> 0 then '{{"prompt_tokens":' || n || ',"completion_tokens":7,"total_tokens":' || (n + 7) || '}}' end as token_usage,
  case when bad then 'REJECTED' when n % 4 = 0 then 'ERROR' else 'SUCCESS' end as status, case when bad then 'PROMPT_INJECTION' when n % 4 = 0 then 'TimeoutError' end as error_code
from se left join ra using (query_id) left join fi using (query_id)""")
def audit_log(spark, sf_dir):
    """Questions through the guard, what is let through searched for, and a row about each."""
    n = F.length("text")
    bad = text.has_any(F.col("text"), [*text.INJECTION, "the "], True)
    error = F.when(bad, F.lit("BusinessError")).when(n % 4 == 0, F.lit("TimeoutError"))
    asked = chain.rewritten(questions(spark, sf_dir)).select(
        "*", error.alias("error_class"), F.when(bad, F.lit("PROMPT_INJECTION")).alias("error_code"), n.alias("prompt_tokens"), F.lit(7).alias("completion_tokens"),
        F.when(n % 5 != 0, n + 7).alias("total_tokens"), (n.cast("long") * 100_000_000).alias("latency_ms"))
    v, b = vector_hits(spark, sf_dir), bm25_hits(spark, sf_dir)
    passed = asked.where("error_code is null").select("query_id")
    raw = v.withColumn("path", F.lit("v")).unionByName(b.withColumn("path", F.lit("b"))).withColumn("fusion_score", F.lit(None).cast("double"))
    final = fusion.rerank_degraded(fusion.fuse(v, b)).withColumn("rerank_score", F.col("fusion_score"))
    named = lambda hits: chunks(spark, sf_dir).select("chunk_id", F.col("source").alias("file_name")).join(F.broadcast(hits.join(passed, "query_id", "left_semi")), "chunk_id")
    return chain.audited(asked, named(raw), named(final))
