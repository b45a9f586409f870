"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import BLANK

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


#: White space as Java has it, in DuckDB's patterns; see ``functions.text.BLANK``.
SQL_BLANK = BLANK


def sql_has_text(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{SQL_BLANK}]'), false)"


def sql_stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{SQL_BLANK}]+|[{SQL_BLANK}]+$', '', 'g')"


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import answers, catalog, documents, events, retrieval, text  # noqa: E402,F401
