"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrow import small_batches  # noqa: F401
from ..sources.scratch import scratch, shared_dir, shuffles_dropped, stored  # noqa: F401
from ..sources.tables import table  # noqa: F401

#: Rows of a few numbers that a partition takes.
PACK = 100_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when executors go."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows in no more partitions than they need, so that a small table is not shuffled out of as many files as a large one."""
    return df.coalesce(max(1, -(-rows // PACK)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator works with: ``names``, with underscores before those that ``df`` has (case does not tell them apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def blank_split(text: Column) -> Column:
    """The runs of characters other than white space (20, 09-0D): a plain split at spaces, which needs no regular expression."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, made once: a column that a lambda's body names may be put in there by the optimizer and made for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
