"""Results of a parsing service that are fetched page by page, as a Spark data source.

A job's blocks come in steps: from an offset up to ``step`` of them. Reading
ends at an empty answer, or when the service says that the job is completed
and the step was short; a full step may always have one after it. Failures
that may pass are tried again, each time after a longer wait; one that stays
fails the task, which Spark runs again. Jobs are dealt out to partitions, and
a partition holds one step at a time.

``client`` names a function ``module:function`` that takes the options and
gives a service with ``jobs()`` and ``fetch(job, offset, step)``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "paged_layouts"
SCHEMA = "doc_id string, seq int, pageNum int, type string, llmResult string, html string, markdownContent string, markdown string, text string"
TEXTS = ("type", "llmResult", "html", "markdownContent", "markdown", "text")


class Passing(Exception):
    """A failure that may pass: a time-out, a full queue."""


class Service(Protocol):
    def jobs(self) -> list[str]: ...

    def fetch(self, job: str, offset: int, step: int) -> dict[str, Any] | None:
        """``{"layouts": [...], "completed": bool}``; None if there is nothing."""


def blocks(service: Service, job: str, step: int, tries: int = 4, wait_s: float = 0.5) -> Iterator[dict[str, Any]]:
    """All blocks of a job, in order, however they are paged."""
    offset = 0
    while True:
        answer = _tried(service, job, offset, step, tries, wait_s)
        found = (answer or {}).get("layouts") or []
        yield from found
        offset += len(found)
        if not found or answer.get("completed") is True and len(found) < step:
            return


def _tried(service: Service, job: str, offset: int, step: int, tries: int, wait_s: float) -> dict[str, Any] | None:
    for left in range(tries - 1, -1, -1):
        try:
            return service.fetch(job, offset, step)
        except Passing:
            if not left:
                raise
            time.sleep(wait_s)
            wait_s *= 2
    return None


def row_of(job: str, seq: int, block: dict[str, Any]) -> tuple:
    """A block as a row of ``SCHEMA``; a page that is no number is none, other values are their text."""
    page = block.get("pageNum")
    number = int(page) if isinstance(page, (int, float)) and not isinstance(page, bool) else None
    told = [None if block.get(c) is None else block[c] if isinstance(block[c], str) else json.dumps(block[c], ensure_ascii=False) for c in TEXTS]
    return (job, seq, number, *told)


class Jobs(InputPartition):
    def __init__(self, jobs: list[str]) -> None:
        super().__init__(jobs)
        self.jobs = jobs


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.step, self.tries = int(options.get("step", "100")), int(options.get("tries", "4"))
        self.wait, self.parts = float(options.get("wait", "0.5")), int(options.get("partitions", "8"))

    def _service(self) -> Service:
        module, function = self.options["client"].split(":")
        return getattr(importlib.import_module(module), function)(self.options)

    def partitions(self) -> list[Jobs]:
        jobs = sorted(self._service().jobs())
        return [Jobs(jobs[i :: self.parts]) for i in range(min(self.parts, len(jobs)))] or [Jobs([])]

    def read(self, partition: Jobs) -> Iterator[tuple]:
        service = self._service()
        for job in partition.jobs:
            for seq, block in enumerate(blocks(service, job, self.step, self.tries, self.wait)):
                yield row_of(job, seq, block)


class PagedLayouts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def layouts(spark: SparkSession, client: str, **options: Any) -> DataFrame:
    """All blocks of all jobs, as ``documents.layout_pages`` takes them."""
    spark.dataSource.register(PagedLayouts)
    return spark.read.format(NAME).options(client=client, **{k: str(v) for k, v in options.items()}).load()


class FileService:
    """The service's double over a folder: a file of JSON for each job, a list of blocks. Every ``fails``-th call fails in passing."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.fails, self.calls = options["folder"], int(options.get("fails", "0")), 0

    def jobs(self) -> list[str]:
        import os

        return [f.removesuffix(".json") for f in os.listdir(self.folder) if f.endswith(".json")]

    def fetch(self, job: str, offset: int, step: int) -> dict[str, Any] | None:
        self.calls += 1
        if self.fails and self.calls % self.fails == 0:
            raise Passing(job)
        with open(f"{self.folder}/{job}.json", encoding="utf-8") as f:
            found = json.load(f)
        if found is None:
            return None
        return {"layouts": found[offset : offset + step], "completed": offset + step >= len(found)}
