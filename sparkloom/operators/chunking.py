"""Splitting pages into chunks that keep tables and images whole."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.arrow import batches, schema_of, small_batches

TOKENS, LEAST_CHARS, LEAST_KEPT, MOST_CHUNKS, SMALL_TABLE = 800, 200, 10, 10_000, 30
CHARS_PER_TOKEN = 2.5
#: Chunks that a task holds at a time.
CHUNK_ROWS = 256
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}

#: What start tags end: an open paragraph, and elements of the same kind (up to the elements that hold them apart).
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "dd", "dt"}
TABLE_PARTS = {"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}
TABLE_SCOPE = {"table", "td", "th", "caption"}
SCOPE = TABLE_SCOPE | {"button", "object", "template"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"} | SCOPE), "dt": ({"dt", "dd"}, {"dl"} | SCOPE), "dd": ({"dt", "dd"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}


def split_tokens(text: str, tokens: int = TOKENS) -> list[str]:
    """Pieces of about ``tokens`` estimated tokens, each cut after the last sentence end beyond ``LEAST_CHARS``; short rests go."""
    size, out, rest = int(tokens * CHARS_PER_TOKEN), [], text
    while rest.strip() and len(out) < MOST_CHUNKS:
        piece = rest[:size]
        if len(rest) > size:
            at = max(piece.rfind(c) for c in ".?!\n。？！")
            if at > LEAST_CHARS:
                piece = piece[: at + 1]
        rest = rest[len(piece) :]
        if len(piece.strip()) > LEAST_KEPT:
            out.append(piece.strip())
    if rest.strip():
        out.append(rest.strip())
    return out


class _TopLevel(HTMLParser):
    """The body's own children as (tag or "", text, html).

    End tags that HTML lets out are implied, end tags that match nothing open
    are ignored, and what is open at the end is closed there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, str, str]] = []
        self.open, self.text, self.html = [], [], []

    def shut(self, to: int) -> None:
        """Closes open elements until ``to`` are left."""
        while len(self.open) > to:
            tag = self.open.pop()
            self.html.append(f"</{tag}>")
            if not self.open:
                self.nodes.append((tag, " ".join("".join(self.text).split()), "".join(self.html)))

    def last(self, tags: set[str], within: set[str]) -> int | None:
        """The place of the innermost open one of ``tags`` that no element of ``within`` holds apart."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in tags:
                return i
            if self.open[i] in within:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            return
        if tag in ENDS_P and (at := self.last({"p"}, SCOPE)) is not None:
            self.shut(at)
        ends, within = IMPLIED.get(tag, (set(), set()))
        while (at := self.last(ends, within)) is not None:
            self.shut(at)
        raw = self.get_starttag_text() or ""
        if not self.open:
            self.text, self.html = [], []
        self.html.append(raw)
        if tag in VOID:
            if not self.open:
                self.nodes.append((tag, "", raw))
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends no element of HTML

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            self.shut(0)
            return
        within = set() if tag == "table" else {"table"} if tag in TABLE_PARTS else TABLE_SCOPE
        if (at := self.last({tag}, within)) is not None:
            self.shut(at)

    def handle_data(self, data):
        if self.open:
            self.text.append(data)
            self.html.append(data)
        elif data.strip():
            self.nodes.append(("", " ".join(data.split()), data))

    def close(self):
        super().close()
        self.shut(0)


def split_page(text: str, tokens: int = TOKENS) -> list[tuple[str, str | None, str | None]]:
    """(content, kind, original html): top-level tables of some length and images are chunks of their own."""
    if not text or not text.strip():
        return []
    if "<table" not in text.lower() and "<img" not in text.lower():
        return [(c, None, None) for c in split_tokens(text, tokens)]
    parser, out, buffer = _TopLevel(), [], []
    parser.feed(text)
    parser.close()

    def flush():
        out.extend((c, "TEXT", None) for c in split_tokens("\n".join(buffer), tokens))
        buffer.clear()

    for tag, words, html in parser.nodes:
        if tag == "table" and len(words) >= SMALL_TABLE:
            flush()
            out.append((words, "TABLE", html))
        elif tag == "img":
            flush()
            out.append((html, "IMAGE", html))
        elif words:
            buffer.append(words)
    flush()
    return out


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS) -> DataFrame:
    """``(doc_id, chunk_index, content, chunk_type, original_content, token_count, chunk_id)``; the id is a digest, so a new run gives the same ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    ddl = f"doc_id {kind}, chunk_index int, content string, chunk_type string, original_content string"
    shape = schema_of(ddl)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one text at a time, however many a batch has
        texts = ((d.as_py(), t.as_py()) for part in parts for d, t in zip(*part.columns))
        yield from batches(((d, i, *chunk) for d, t in texts for i, chunk in enumerate(split_page(t, tokens))), shape, CHUNK_ROWS)

    small_batches(docs.sparkSession)
    made = docs.select(id_col, text_col).mapInArrow(run, ddl)
    return made.select(
        "*", (F.length("content") / F.lit(CHARS_PER_TOKEN)).cast("int").alias("token_count"),
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
    )
