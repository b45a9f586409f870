"""Routing, layouts, chunks with metadata, tables and files."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import catalog, chunking, documents
from sparkloom.sources import tables

ROUTES = [
    ("a.md", 1, 500, None, False, True, "NATIVE", "NATIVE"), ("b.pdf", 2, 0, None, False, True, "OCR", "OCR"), ("c.pdf", 3, 900, None, True, True, "DEEP", "DEEP"),
    ("d.txt", 1, 10, None, True, True, "NATIVE", "NATIVE"), ("e.md", 1, 10, "deep", False, True, "DEEP", "DEEP"), ("f.PDF", 3, 900, None, True, False, "DEEP", "NATIVE"),
    ("g.pdf", 3, 900, " bogus ", False, True, "NATIVE", "NATIVE"), ("h.pdf", 0, 0, "ocr", False, False, "OCR", "ERROR"),
]


def test_routes(spark):
    df = spark.createDataFrame([r[:6] for r in ROUTES], "name string, pages int, chars int, forced string, deep boolean, ok boolean")
    assert {(r.name, r.route, r.outcome) for r in documents.routed(df).collect()} == {(r[0], *r[6:]) for r in ROUTES}


def test_layouts(spark):
    rows = [
        (1, 1, 2, "text", None, None, "two", None, "t"), (1, 2, None, "table", "```html\n<table>x</table>\n```", "<b>", "m", None, None), (1, 3, 0, "text", "no", "no", None, "zero", None),
        (1, 4, 1, "text", None, None, "  ", None, None), (1, 5, 0, "figure", None, None, "no", None, None), (2, 1, None, None, None, None, None, None, "first"), (2, 2, None, "table", "```\n```", " ", "md", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, seq int, pageNum int, type string, llmResult string, html string, markdownContent string, markdown string, text string")
    out = {(r.doc_id, r.page_number): (r.content, r.page_count, r.tables, r.images) for r in documents.layout_pages(df).collect()}
    assert out == {(1, 1): ("zero", 3, 1, 1), (1, 3): ("two\n<table>x</table>", 3, 1, 1), (2, 1): ("first\nmd", 0, 1, 0)}


def test_chunks_keep_the_columns_of_their_page(spark):
    long = "A sentence of some words. " * 200
    pages = spark.createDataFrame([(1, 2, long, "t", "b.pdf"), (1, 1, "The first page is short.", "t", "b.pdf"), (2, 1, "  ", "u", None)], "doc_id long, page_number int, text string, tenant_id string, name string")
    out = documents.chunked(pages).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == list(range(len(out))) and len(out) > 2 and out[0].content == "The first page is short."
    assert {(r.doc_id, r.tenant_id, r.name) for r in out} == {(1, "t", "b.pdf")} and [r.page_number for r in out] == [1] + [2] * (len(out) - 1)
    assert [r.chunk_id for r in out] == [r.chunk_id for r in documents.chunked(pages.repartition(3)).orderBy("chunk_index").collect()]
    files = spark.createDataFrame([(1, bytearray(long.encode()), "t"), (2, bytearray(b""), "u")], "doc_id long, content binary, tenant_id string")
    chunks, summary = documents.ingested(files)
    assert {r.doc_id: (r.status, r.chunk_count > 0) for r in summary.collect()} == {1: ("SUCCESS", True), 2: ("FAILED", False)}
    assert {r.tenant_id for r in chunks.collect()} == {"t"}


def test_upserts_and_failures(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "z"), (3, "y"), (3, "x")], "id long, v string")
    assert sorted(map(tuple, documents.upserted(old, new, "id").collect())) == [(1, "a"), (2, "z"), (3, "x"), (3, "y")]
    assert [tuple(r) for r in documents.inserted(old, new, "id").collect()] == [(3, "x")]
    items = spark.createDataFrame([("d", i, "e" if i < 8 else None) for i in range(10)], "doc string, id long, error string")
    assert documents.bulk_failures(items, "doc").first()[1:] == (10, 8, [0, 1, 2, 3, 4])
    numbered = documents.batches(spark.range(23), "id", 10).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in numbered] == [10, 10, 3]


def test_schemas(spark, tmp_path):
    for name in catalog.TABLES:
        catalog.schema(name)
    path = str(tmp_path / "chunk")
    assert catalog.ensured(spark, "chunk", path).count() == 0
    row = {"id": "1", "doc_id": "d", "chunk_type": "VIDEO"}
    spark.createDataFrame([row], catalog.schema("chunk")).write.mode("append").parquet(path)
    there = catalog.ensured(spark, "chunk", path)
    assert there.count() == 1 and catalog.misfits(there, "chunk").first().misfit == "chunk_type"
    assert catalog.orphans(there, "doc_id", spark.createDataFrame([("x",)], "id string")).count() == 1
    assert catalog.orphans(there, "doc_id", spark.createDataFrame([("d",)], "id string")).count() == 0


def test_lookups_and_frames(spark):
    people = spark.createDataFrame([("E1", "Ann"), ("E2", "Bob"), ("E3", "Bob"), ("Ann", "Zoe")], "id string, name string")
    asked = spark.createDataFrame([("E2",), ("Bob",), ("Ann",), ("nobody",)], "keyword string")
    assert {r.keyword: r.id for r in catalog.looked_up(asked, people).collect()} == {"E2": "E2", "Bob": "E2", "Ann": "Ann", "nobody": None}
    lines = [(1, i, x) for i, x in enumerate(["event: token", "data: a", "data: b", "", "data: c", "", "event:TRACE", "data:[1]"])]
    out = catalog.parsed_frames(spark.createDataFrame(lines, "conv_id long, seq long, line string")).orderBy("seq").collect()
    assert [(r.event, r.data) for r in out] == [("token", "a"), ("token", "b"), ("message", "c"), ("TRACE", "[1]")]


def test_small_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    text = lambda x: F.lit(x).cast("string")
    fences = [("```html\n<b>x</b>\n```", "<b>x</b>"), ("plain", "plain"), ("```md\nopen", "```md\nopen"), (None, ""), ("```\n```", ""), ("  ```json\n{}\n```  ", "{}"), ("``````", "``````")]
    assert [one(T.strip_fence(text(a))) for a, _ in fences] == [b for _, b in fences]
    assert [one(T.page_number(text(x))) for x in ("7", " 12 ", "x", "", None, "1.5")] == [7, 12, None, None, None, None]
    assert [one(T.size_shown(F.lit(n).cast("long"))) for n in (None, 0, 5, 2048, 3 << 20)] == ["—", "—", "5 B", "2.0 KB", "3.0 MB"]
    assert [one(T.score_shown(F.lit(v).cast("double"))) for v in (None, 12.345, -0.5)] == ["—", "12.35", "-0.5000"]
    assert one(T.mime_kind(text("image/png"))) == "UNKNOWN" and one(T.markdown_tables(text("| a |\n|---|\n| --- x"))) == 2


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# one\ntwo")
    assert tables.texts(spark, str(tmp_path / "in")).first().text == "# one\ntwo" and tables.files(spark, str(tmp_path / "in")).first().length == 9
    (tmp_path / "golden").mkdir()
    for name, ids in (("a.json", ["1", "2"]), ("b-example.json", ["9"])):
        (tmp_path / "golden" / name).write_text(json.dumps([{"id": i, "category": "TABLE", "question": "q", "expectedChunkIds": ["c"]} for i in ids]))
    assert sorted(r.id for r in tables.golden(spark, str(tmp_path / "golden")).collect()) == ["1", "2"]
    chunks = spark.createDataFrame([("c", "t"), ("d", "u")], "chunk_id string, tenant_id string")
    tables.write_chunks(chunks, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("tenant_id = 'u'").first().chunk_id == "d"
    tables.write_report(spark.createDataFrame([("recall 1.0",)], "line string"), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["recall 1.0"]
    with pytest.raises(KeyError):
        documents.PARSERS["NONE"]


def test_bars_and_versions(spark):
    rows = spark.createDataFrame([("a", 10), ("a", 5), ("a", None), (None, 4), (None, 0), ("z", 0)], "k string, n int")
    out = documents.with_most(rows, "k", "n").select("k", "n", "most", T.bar_height(F.col("n"), F.col("most")).alias("h")).collect()
    assert {(r.k, r.n): (r.most, r.h) for r in out} == {("a", 10): (10, 64.0), ("a", 5): (10, 32.0), ("a", None): (10, 6.0), (None, 4): (4, 64.0), (None, 0): (4, 6.0), ("z", 0): (0, 6.0)}
    templates = spark.createDataFrame([(2, "p", "v1", "late"), (1, "p", "v1", "first"), (3, "p", "v2", "two"), (4, None, "v1", "no")], "id int, name string, version string, content string")
    asked = spark.createDataFrame([("p", "v1"), ("p", "v2"), ("p", "v9"), (None, "v1"), ("q", None)], "name string, version string")
    assert {(r.name, r.version): r.content for r in catalog.of_version(asked, templates).collect()} == {("p", "v1"): "first", ("p", "v2"): "two", ("p", "v9"): None, (None, "v1"): None, ("q", None): None}


def test_the_splitter_hands_out_few_chunks_at_a_time(spark):
    """A task's memory does not grow with the number of texts in a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.range(3_000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("A sentence of a text. "), 200).alias("text"))
        made = chunking.split_documents(docs)
        assert int(spark.conf.get(name)) <= 1_000
        sizes = made.select("doc_id", "content").mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [len(p)]}) for p in parts), "n long")
        assert sizes.agg(F.sum("n")).first()[0] == made.count() >= 3_000
        assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
