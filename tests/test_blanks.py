"""What counts as blank: tabs, newlines and wide spaces do, a no-break space does not."""

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import documents

NOTHING = [None, "", " ", "\t\n", " 　", "\x1c\x1f", " "]


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_has_text(spark):
    assert not any(one(spark, T.has_text(F.col("x")), *NOTHING))
    assert all(one(spark, T.has_text(F.col("x")), "a", " \n.", "\xa0", " "))


def test_first_non_blank_is_the_text_as_it_is_or_empty(spark):
    df = spark.createDataFrame([("\t\n", " a ", "b"), (None, "　", None)], "x string, y string, z string")
    assert [r[0] for r in df.select(T.first_non_blank(F.col("x"), F.col("y"), F.col("z"))).collect()] == [" a ", ""]


def test_fences(spark):
    cases = {
        "```html\n<b>x</b>\n```": "<b>x</b>", "\n\t```md\n\n a \n```\n": "a", " plain\n": " plain\n", "```md\nopen": "```md\nopen", "```\n```": "", "``````": "``````",
        "```no newline```": "```no newline```", "text ```\na\n```": "text ```\na\n```", None: "", "```a\nb```c\n```": "b```c",
    }
    assert one(spark, T.strip_fence(F.col("x")), *cases) == list(cases.values())


def test_titles(spark):
    assert one(spark, T.title(F.col("x")), *NOTHING, "\t a\n", "b" * 51, "\xa0c") == ["untitled"] * len(NOTHING) + ["a", "b" * 50 + "…", "\xa0c"]


def test_extensions_keep_their_case(spark):
    assert one(spark, T.extension(F.col("x")), "a.PDF", "b", "c.tar.gz", "d.", None) == ["PDF", "", "gz", "", ""]


def test_a_probe_that_failed_is_no_scan(spark):
    files = spark.createDataFrame(
        [("a.pdf", None, None, None, False, True), ("a.pdf", 3, None, None, False, True), ("b.pdf", 0, 0, None, False, True), ("c.pdf", 2, 10, None, False, False), ("d.pdf", None, 5, "\tocr\n", False, False)],
        "name string, pages int, chars int, forced string, deep boolean, ok boolean",
    )
    assert [(r.route, r.outcome) for r in documents.routed(files).collect()] == [("NATIVE", "NATIVE")] * 2 + [("OCR", "OCR"), ("OCR", "NATIVE"), ("OCR", "ERROR")]


def test_blocks_of_white_space_make_no_page(spark):
    rows = [(1, 0, 0, "text", None, None, "\t\n", None, "kept"), (1, 1, 1, "text", None, None, None, None, "\n\t"), (1, 2, 2, "table", "```html\n \n```", "\t", None, None, " cell ")]
    df = spark.createDataFrame(rows, "doc_id long, seq int, pageNum int, type string, llmResult string, html string, markdownContent string, markdown string, text string")
    out = [(r.page_number, r.content, r.page_count, r.tables) for r in documents.layout_pages(df).orderBy("page_number").collect()]
    assert out == [(1, "kept", 3, 1), (3, "cell", 3, 1)]
