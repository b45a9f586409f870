"""The paged reader gives the same pages however its source is paged, and tries again what fails in passing."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import documents
from sparkloom.queries.documents import layouts
from sparkloom.sources import paged

CLIENT = "sparkloom.sources.paged:FileService"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("service")
    rows = layouts(spark, "/root/testdata/sf0.001").where("doc_id < 60").orderBy("doc_id", "seq").collect()
    jobs = {}
    for r in rows:
        jobs.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict().items() if k not in ("doc_id", "seq") and v is not None})
    for job, found in jobs.items():
        (path / f"{job}.json").write_text(json.dumps(found, ensure_ascii=False), encoding="utf-8")
    (path / "1000.json").write_text("null")
    (path / "1001.json").write_text("[]")
    return str(path)


def pages(df):
    return sorted(map(tuple, documents.layout_pages(df).select(F.col("doc_id").cast("long"), "page_number", "content", "page_count", "tables", "images").collect()))


@pytest.mark.parametrize("how", [{"step": 1, "partitions": 3}, {"step": 7}, {"step": 100_000}, {"step": 5, "fails": 3, "wait": 0.001}])
def test_pages_do_not_depend_on_the_paging(spark, folder, how):
    want = pages(layouts(spark, "/root/testdata/sf0.001").where("doc_id < 60"))
    assert pages(paged.layouts(spark, CLIENT, folder=folder, **how)) == want and want


def test_an_end_is_completed_and_short():
    class Slow:
        """Says nothing of its end until it has been asked for more."""

        def fetch(self, job, offset, step):
            return [{"layouts": [{"text": "a"}] * 2, "completed": False}, {"layouts": [{"text": "b"}], "completed": False}, {"layouts": [{"text": "c"}, {"text": "d"}], "completed": True}, {"layouts": [], "completed": True}][[0, 2, 3, 5].index(offset)]

    assert [b["text"] for b in paged.blocks(Slow(), "j", 2)] == ["a", "a", "b", "c", "d"]


def test_what_keeps_failing_is_an_error():
    class Down:
        calls = 0

        def fetch(self, job, offset, step):
            self.calls += 1
            raise paged.Passing("down")

    down = Down()
    with pytest.raises(paged.Passing):
        list(paged.blocks(down, "j", 2, tries=3, wait_s=0.0))
    assert down.calls == 3


def test_rows_of_odd_blocks():
    assert paged.row_of("j", 0, {"pageNum": "2", "type": None, "html": {"a": 1}, "text": "x"}) == ("j", 0, None, None, None, '{"a": 1}', None, None, "x")
    assert paged.row_of("j", 1, {"pageNum": 2.0})[2] == 2 and paged.row_of("j", 1, {"pageNum": True})[2] is None
