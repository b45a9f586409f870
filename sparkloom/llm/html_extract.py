"""Main text of HTML pages by union-free regular-expression inference.

The different pages of each host's template (the set of a page's element paths
to depth ``DEPTH``, what is in a marked article aside) are aligned, one after the other, into a wrapper: a sequence
of tags, fixed texts, text slots, optional groups and repeated groups. Where two
texts differ a slot is made; where tags differ, a block that repeats the one
before it becomes a repeated group, and otherwise what the other side lacks
becomes optional. All different pages take part: each of ``SHARES`` hash ranges
of a template is folded in its own group, and the wrappers of the ranges are
then aligned with each other, so that a host with a third of all pages is no
single task's work and no page is held longer than it is aligned.

Every page takes part, whether it marks its article or not, and every text comes
through the wrapper of its page's template. The wrapper tells the article's
elements: those that its pages mark by element or role, or, where they mark
none, the one that holds most slot text. It tells the template's fixed texts,
which no unmarked article holds (texts that at least ``LEAST_PAGES`` pages and
``FIXED_SHARE`` of all have at their place in it); a marked article stays whole.
And it tells which elements in an article belong to the template.

From an article go the elements that by name or role are menus, headers,
footers, sidebars, notices, adverts, forms or reader comments. Elements whose
class or id is, as a whole, a listed word go if ``LEAST_PAGES`` pages of the
template have them, or if it has not so many pages: what fewer of its pages have
is text of theirs (a dinner's menu). Elements around a marked article count by
name and role, and by class only if they hold comments, adverts or related
pages: a page's outermost elements are often named after what stands in them.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

DEPTH, LEAST_PAGES, FIXED_SHARE = 3, 3, 0.8
#: Hash ranges of a template's pages in the rounds of alignment.
SHARES = (4_096, 64, 1)
#: Wrappers of up to so many bytes in all are broadcast.
BROADCAST_BYTES = 16 << 20
#: Wrappers leave a task in batches of about so many characters.
HELD_CHARS = 1 << 20
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
# fixed values: element names
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "td", "th"}
BESIDE = {"nav", "footer", "aside", "form", "head", "select", "option", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# fixed values: words of class and id attributes
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "sponsors", "promo", "promotion", "sidebar", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "toolbar", "pagination", "pager", "masthead"}
# fixed values: of these, the ones that also count around a marked article
APART = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "related", "recommended"}
#: Start tags that end an open paragraph, and what an item of the same kind ends.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKED = {"article", "main"}
# fixed values: element names of MathML that stand in a line
MATHS = {"mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mspace", "mstyle", "mpadded", "mphantom", "merror", "menclose", "semantics"}
INLINE |= MATHS
#: Elements that stand in an article rather than hold one.
INNER = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "thead", "tfoot", "tr", "caption", "address", "hr"}


def lex(page: str) -> Iterator[tuple]:
    """("open", name, attributes), ("close", name) and ("text", string); comments, declarations and raw elements go."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := TAG.match(page, lt):
            name, at = m[2].lower(), m.end()
            if m[1]:
                yield "close", name
            else:
                yield "open", name, m[3]
                if name in RAW:
                    end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
                    at = end.end() if end else n
                    yield "close", name
        elif page.startswith("</", lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        else:
            yield "text", "<"
            at = lt + 1


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in ATTRIBUTE.finditer(raw):
        if m[5]:
            out["hidden"] = ""
        elif m[1].lower() in ("class", "id", "role", "aria-hidden"):
            out[m[1].lower()] = m[2] or m[3] or m[4] or ""
    return out


def _beside(name: str, attributes: dict[str, str], in_article: bool) -> int:
    """2 if an element is not part of an article, 1 if only its class says so and it may hold a marked one."""
    if name in RAW or name in BESIDE or name == "header" and not in_article:
        return 2
    if name in MARKED or name in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ROLES:
        return 2
    if in_article:
        return 0
    words = _words(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    return 2 if words & APART else int(bool(words & MARKS))


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))


def _listed(attributes: dict[str, str]) -> bool:
    """Whether a class or the id is made of listed words alone."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return any((words := _words(name)) and words <= MARKS for name in names)


def blocks(page: str) -> list[tuple]:
    """(path, mark, in a link, parts, root) of each block outside of what stands beside articles.

    The mark is 2 in a marked article, 1 in one that stands in an element named
    like something else; ``root`` is the path of the article's element. A part is
    its text and the element of a listed class that it stands in, if any.
    """
    stack: list[list] = []  # name, signature, beside, marked, root, listed
    out: list[tuple] = []
    parts: list[tuple[str, str]] = []
    linked = total = 0

    def end_block() -> None:
        nonlocal linked, total
        if parts:
            if entities.unescape("".join(x[0] for x in parts)).strip():
                mark = (2 - stack[-1][2]) * stack[-1][3] if stack else 0
                out.append((tuple(x[1] for x in stack if x[0] not in INLINE), mark, linked * 2 > total, tuple(parts), stack[-1][4] if stack else ""))
            parts.clear()
            linked = total = 0

    for token in lex(page):
        if token[0] == "text":
            if not stack or stack[-1][2] < (2 if stack[-1][3] else 1):
                parts.append((token[1], stack[-1][5] if stack else ""))
                size = len(token[1].strip())
                total += size
                linked += size * any(x[0] == "a" for x in stack)
            continue
        name = token[1]
        if name in ("td", "th"):
            parts.append((" ", ""))
        elif name not in INLINE:
            end_block()
        if token[0] == "open":
            if name in ENDS_P and any(x[0] == "p" for x in stack):
                while stack and stack.pop()[0] != "p":
                    pass
            if name in ENDS_LIKE and stack and stack[-1][0] in ENDS_LIKE[name]:
                stack.pop()
            if name in VOID:
                continue
            attributes = _attributes(token[2]) if token[2].strip(" /\t\r\n") else {}
            above = stack[-1] if stack else [None, None, 0, False, "", ""]
            marked = above[3] or name in MARKED or attributes.get("role", "").lower() == "main"
            beside = max(above[2], _beside(name, attributes, above[3]))
            signature = f"{name}.{attributes['class']}" if attributes.get("class") else name
            root, listed = above[4], above[5]
            if marked and not above[3]:
                root = "/".join([*(x[1] for x in stack if x[0] not in INLINE), signature])
            if above[3] and not listed and name not in MARKED and _listed(attributes):
                listed = re.sub(r"[0-9]+", "0", f"{signature}#{attributes.get('id', '')}")
            stack.append([name, signature, beside, marked and beside < 2, root, listed])
        elif any(x[0] == name for x in stack):
            while stack.pop()[0] != name:
                pass
    end_block()
    return out


# A wrapper's nodes: ["t", path], ["c", path, text, size, pages], ["s", path, size], ["o", nodes], ["r", nodes].


def _text(block: tuple, gone: Callable[[str], bool] = bool) -> str:
    """A block's text, without the parts in elements that are gone (all of a listed class, if nothing is said)."""
    return " ".join(entities.unescape("".join(t for t, listed in block[3] if not (listed and gone(listed)))).split())


def stream(found: list[tuple]) -> list[list]:
    """A page's blocks as wrapper nodes: each as its element and its text, by digest. Text in links has no size.

    Blocks of a marked article that repeat the element before them are one
    repeated group from the start: no text in it is told to be fixed.
    """
    out: list[list] = []
    before = None
    for block in found:
        if text := _text(block):
            path, size = "/".join(block[0]), 0 if block[2] else len(text)
            if not block[1] or path != before:
                out.append(["t", path])
                out.append(["c", path, _block_digest(path, text), size, 1])
            elif out[-1][0] == "r":
                out[-1][1][1][2] += size
            else:
                out[-2:] = [["r", [["t", path], ["s", path, out[-1][3] + size]]]]
            before = path if block[1] else None
    return out


def _sample(found: list[tuple]) -> dict:
    """A page as a wrapper of its own: nodes, marks of article elements by path, pages that have an element of a listed class."""
    roots: dict[str, int] = {}
    for block in found:
        if block[1]:
            roots[block[4]] = max(block[1], roots.get(block[4], 0))
    return {"nodes": stream(found), "roots": roots, "seen": dict.fromkeys(sorted({x[1] for b in found for x in b[3] if x[1]}), 1)}


def _joined(a: dict, b: dict) -> dict:
    """One wrapper for the pages of two."""
    return {
        "nodes": align(a["nodes"], b["nodes"]),
        "roots": {r: max(a["roots"].get(r, 0), b["roots"].get(r, 0)) for r in sorted({*a["roots"], *b["roots"]})},
        "seen": dict(Counter(a["seen"]) + Counter(b["seen"])),
    }


def _plain(nodes: list[list]) -> bool:
    return all(n[0] not in "or" for n in nodes)


def _optional(nodes: list[list]) -> list[list]:
    """Nodes that may be absent: runs of them as a group each, beside the groups that they hold, so that none nests in another."""
    out: list[list] = []
    run: list[list] = []
    for node in nodes:
        if node[0] in "or":
            if run:
                out.append(["o", run])
                run = []
            out.append(node)
        else:
            run.append(node)
    return [*out, ["o", run]] if run else out


def _same(a: list, b: list) -> list | None:
    """Two nodes that match, as one; or nothing."""
    if a[0] == "t":
        return a if b[0] == "t" and a[1] == b[1] else None
    if a[0] in "cs" and b[0] in "cs" and a[1] == b[1]:
        size = a[3 if a[0] == "c" else 2] + b[3 if b[0] == "c" else 2]
        if a[0] == b[0] == "c" and a[2] == b[2]:
            return ["c", a[1], a[2], size, a[4] + b[4]]
        return ["s", a[1], size]
    return None


def _take(body: list[list], s: list[list], j: int) -> tuple[list[list], int] | None:
    """``body`` matched with ``s`` from ``j``: the joined nodes and the place after; or nothing."""
    out = []
    for node in body:
        if node[0] in "or":
            got = _take(node[1], s, j)
            while got and got[1] > j:
                node, j = [node[0], got[0]], got[1]
                got = _take(node[1], s, j) if node[0] == "r" else None
            out.append(node)
            continue
        if j >= len(s) or (one := _same(node, s[j])) is None:
            return None
        out.append(one)
        j += 1
    return out, j


def _places(nodes: list[list]) -> dict[tuple, list[int]]:
    """Where nodes stand that could match each other."""
    out: dict[tuple, list[int]] = {}
    for i, node in enumerate(nodes):
        if node[0] not in "or":
            out.setdefault((node[0] == "t", node[1]), []).append(i)
    return out


def align(w: list[list], s: list[list]) -> list[list]:
    """The wrapper ``w`` generalised so that it accepts ``s``, a page or another wrapper, too."""
    out: list[list] = []
    in_w, in_s = _places(w), _places(s)

    def ahead(places: dict[tuple, list[int]], node: list, at: int) -> int | None:
        where = places.get((node[0] == "t", node[1]), ())
        k = bisect_left(where, at)
        return where[k] if k < len(where) else None

    i = j = 0
    while i < len(w) and j < len(s):
        a, b = w[i], s[j]
        if a[0] in "or" and b[0] in "or":
            body = align(a[1], b[1]) if _same(a[1][0], b[1][0]) else []
            if body and "r" not in a[0] + b[0]:
                out += _optional(body)
                j += 1
            elif body and _plain(body):
                out.append(["r", body])
                j += 1
            else:
                out.append(a)
            i += 1
            continue
        if a[0] in "or":
            got, j = _take([a], s, j)
            out += got
            i += 1
            continue
        if b[0] in "or":
            got, i = _take([b], w, i)
            out += got
            j += 1
            continue
        if (one := _same(a, b)) is not None:
            out.append(one)
            i, j = i + 1, j + 1
            continue
        if len(out) >= 2 and out[-2][0] == "t" and out[-1][0] in "cs" and (got := _take(out[-2:], s, j)):  # the sample repeats the block before
            out[-2:] = [["r", got[0]]]
            j = got[1]
            while got := _take(out[-1][1], s, j):
                out[-1], j = ["r", got[0]], got[1]
            continue
        if len(out) >= 2 and out[-2][0] == "t" and out[-1][0] in "cs" and (got := _take(out[-2:], w, i)):  # the wrapper does
            out[-2:] = [["r", got[0]]]
            i = got[1]
            while got := _take(out[-1][1], w, i):
                out[-1], i = ["r", got[0]], got[1]
            continue
        if out and out[-1][0] == "r" and (got := _take(out[-1][1], s, j)) and got[1] > j:
            out[-1], j = ["r", got[0]], got[1]
            continue
        if out and out[-1][0] == "r" and (got := _take(out[-1][1], w, i)) and got[1] > i:
            out[-1], i = ["r", got[0]], got[1]
            continue
        next_s, next_w = ahead(in_s, a, j), ahead(in_w, b, i)
        if next_s is not None and (next_w is None or next_s - j <= next_w - i):
            out += _optional(s[j:next_s])
            j = next_s
        elif next_w is not None:
            out += _optional(w[i:next_w])
            i = next_w
        else:
            out += [["o", [a]], ["o", [b]]]
            i, j = i + 1, j + 1
    return [*out, *_optional(w[i:]), *_optional(s[j:])]


def conclude(wrapper: dict, pages: int) -> dict:
    """What a wrapper of so many pages tells.

    ``roots``, the paths of marked articles, of the best ``mark`` that there is;
    without any, the ``main`` path (empty if unknown) and ``fixed`` (digests of
    texts at their paths). ``own``: elements of a listed class that are not the
    template's but text of a few of its pages.
    """
    mass: Counter = Counter()
    fixed: set[int] = set()

    def weigh(nodes: list[list], repeated: bool) -> None:
        for node in nodes:
            if node[0] in "or":
                weigh(node[1], repeated or node[0] == "r")
                continue
            if node[0] == "c" and not repeated and node[4] >= LEAST_PAGES and node[4] >= FIXED_SHARE * pages:
                fixed.add(node[2])
            elif node[0] in "cs":
                path = node[1].split("/")
                for k in range(1, len(path) + 1):
                    mass["/".join(path[:k])] += node[3 if node[0] == "c" else 2]

    weigh(wrapper["nodes"], False)
    most = max(mass.values(), default=0)
    main = max((p for p, v in mass.items() if v >= 0.7 * most), key=lambda p: (p.count("/"), p), default="")
    mark = max(wrapper["roots"].values(), default=0)
    roots = sorted(r for r, v in wrapper["roots"].items() if v == mark)
    own = sorted(k for k, n in wrapper["seen"].items() if n < LEAST_PAGES <= pages)
    return {"fixed": sorted(fixed), "main": main, "mark": mark, "roots": roots, "own": own}


NOTHING = {"fixed": [], "main": "", "mark": 0, "roots": [], "own": []}


def infer(pages: list[str]) -> dict:
    """What some pages of one template have in common, aligned in the order of their text."""
    samples = [_sample(found) for found in map(blocks, sorted(set(pages))) if found]
    return conclude(reduce(_joined, samples), len(samples)) if samples else NOTHING


def extract(page: str | None, wrapper: dict) -> str:
    """The article's blocks, joined by newlines."""
    return _extract(blocks(page or ""), wrapper)


def _extract(found: list[tuple], wrapper: dict) -> str:
    own = set(wrapper.get("own", ()))
    texts = [(b, text) for b in found if (text := _text(b, lambda listed: listed not in own))]
    roots = set(wrapper.get("roots", ()))
    marked = [text for b, text in texts if b[1] and b[1] == wrapper.get("mark") and b[4] in roots]
    if not marked and (most := max((b[1] for b, _ in texts), default=0)):  # a page that marks its article unlike the others
        marked = [text for b, text in texts if b[1] == most]
    if marked:
        return "\n".join(marked)
    if wrapper["main"]:
        inside = _holder(wrapper["main"].split("/"))
        within = [(b, text) for b, text in texts if list(b[0][: len(inside)]) == inside and not (b[2] and inside[-1:] in ([], ["html"], ["body"]))]
        texts = within or [(b, text) for b, text in texts if not b[2]] or texts
    fixed = set(wrapper["fixed"])
    return "\n".join(text for b, text in texts if not fixed or _block_digest("/".join(b[0]), text) not in fixed)


def _holder(path: list[str]) -> list[str]:
    """The element that holds a path's paragraphs, lists and tables."""
    while path and path[-1].partition(".")[0] in INNER:
        path = path[:-1]
    return path


def _block_digest(path: str, text: str) -> int:
    """Of a block's path and text, as a bigint."""
    at = xxhash.xxh64_intdigest("\0".join((path, text)).encode("utf-8", "surrogatepass"))
    return at - (1 << 64) if at >> 63 else at


def template(found: list[tuple]) -> str:
    """What pages of one template have in common: the element paths of their blocks, cut at a depth and at a marked article."""
    return "\n".join(sorted({b[4] if b[1] else "/".join(b[0][:DEPTH]) for b in found}))


def host(url: str = "url") -> Column:
    """The host of a URL; a null URL, or one without a host, has the empty one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _aligned(last: bool):
    """Rows in the order of their group to one wrapper for each; ``last`` gives what it tells instead."""

    columns = ["host", "template", "page", "pages", "wrapper"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = wrapper = page = None
        pages = held = 0
        out: list[tuple] = []

        def told() -> None:
            nonlocal held
            out.append((*now[:2], page, pages, json.dumps(conclude(wrapper, pages) if last else wrapper)))
            held += len(out[-1][-1])

        for pdf in parts:
            for h, name, share, at, n, nodes in zip(pdf["host"], pdf["template"], pdf["share"], pdf["page"], pdf["pages"], pdf["wrapper"]):
                if (h, name, share) != now:
                    if now is not None:
                        told()
                    if held > HELD_CHARS:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
                    now, wrapper, page, pages = (h, name, share), json.loads(nodes), at, n
                else:
                    wrapper, pages = _joined(wrapper, json.loads(nodes)), pages + n
        if now is not None:
            told()
            yield pd.DataFrame(out, columns=columns)

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``: for each host a JSON object of its templates' conclusions, from all different pages."""
    rows = pages.select(host().alias("host"), "html").where("html is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for h, page in zip(pdf["host"], pdf["html"]):
                found = blocks(page)
                if not found:
                    continue
                whole = hashlib.md5(page.encode("utf-8", "surrogatepass")).hexdigest()
                name = hashlib.md5(template(found).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((h, name, whole, 1, json.dumps(_sample(found))))
            yield pd.DataFrame(out, columns=["host", "template", "page", "pages", "wrapper"])

    schema = "host string, template string, page string, pages int, wrapper string"
    made = rows.mapInPandas(run, schema).dropDuplicates(["host", "template", "page"])
    for shares in SHARES:
        by = ["host", "template", "share"]
        dealt = made.withColumn("share", F.pmod(F.xxhash64("page"), F.lit(shares))).repartition(*by).sortWithinPartitions(*by, "page")
        made = stored(dealt.mapInPandas(_aligned(shares == 1), schema))
    return made.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("template", "wrapper")))).alias("wrapper"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text.

    A null or empty page has the empty text. Pages without a host are one
    host; null ids and repeated rows are each extracted; an empty table gives
    none; other columns are not looked at.
    """
    small_batches(pages.sparkSession)
    made = stored(wrappers(pages))
    if made.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        made = F.broadcast(made)
    joined = pages.select("page_id", "url", "html", host().alias("host")).join(made, "host", "left")

    @F.pandas_udf("string")
    def text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict = {None: {}}
        for html, wrapper in parts:
            out = []
            for h, w in zip(html, wrapper):
                if w not in known:
                    if len(known) > 1_000:
                        known = {None: known[None]}
                    known[w] = {k: json.loads(v) for k, v in json.loads(w).items()}
                found = blocks(h or "")
                name = hashlib.md5(template(found).encode("utf-8", "surrogatepass")).hexdigest() if known[w] else ""
                out.append(_extract(found, known[w].get(name, NOTHING)))
            yield pd.Series(out, dtype="object")

    return joined.select("page_id", "url", text("html", "wrapper").alias("text"))
