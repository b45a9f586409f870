"""Wrappers from all pages of a host."""

from sparkloom.llm import html_extract

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def page(kind, i):
    body = f"<p>{f'{kind} text {i} ' * 20}</p><p>{f'{kind} more {i} ' * (9 + i)}</p>"
    return f"<body><div class={kind}top><p>Line of {kind}</p></div><div class={kind}body><p>Read on</p>{body}</div></body>"


def test_each_template_has_its_wrapper(spark):
    pages = [page(kind, i) for kind in ("a", "b", "c") for i in range(12)]
    out = texts(spark, pages)
    assert all("Line of" not in t and "Read on" not in t and t.count("\n") == 1 for t in out.values())


def test_copies_of_a_page_are_one(spark):
    pages = [page("a", i) for i in range(4)]
    first = texts(spark, pages)
    for i in range(4):
        assert texts(spark, [*pages, *[pages[i]] * 30]) == first | dict.fromkeys(range(4, 34), first[i])
    assert "Line of" not in first[0] and "a text 0" in first[0]


def test_marked_articles_stay_whole(spark):
    out = texts(spark, [f"<body><article><h2>Summary</h2><p>page {i}</p></article></body>" for i in range(12)])
    assert all(out[i] == f"Summary\npage {i}" for i in range(12))


def test_elements_around_a_marked_article():
    none = html_extract.NOTHING
    assert html_extract.extract('<div class="has-sidebar"><article><p>kept</p></article><div class=sidebar>gone</div></div>', none) == "kept"
    assert html_extract.extract('<div id="content-widget"><main><p>kept</p></main></div>', none) == "kept"
    assert html_extract.extract('<div class=post><p>kept</p></div><div id=comments><article>Nice!</article></div>', none) == "kept"
    assert html_extract.extract('<article><p>kept</p></article><div class=widget><article>teaser</article></div>', none) == "kept"
    assert html_extract.extract('<nav><article>no</article></nav><aside><main>no</main></aside>', none) == ""


def test_optional_and_repeated_groups():
    a = [["t", "x"], ["c", "x", "Menu", 4, 1], ["t", "y"], ["c", "y", "one", 3, 1], ["t", "z"], ["c", "z", "End", 3, 1]]
    b = [["t", "x"], ["c", "x", "Menu", 4, 1], ["t", "y"], ["c", "y", "two", 3, 1], ["t", "y"], ["c", "y", "three", 5, 1], ["t", "v"], ["c", "v", "new", 3, 1], ["t", "z"], ["c", "z", "End", 3, 1]]
    w = html_extract.align(a, b)
    assert w == html_extract.align(b, a)
    assert w == [["t", "x"], ["c", "x", "Menu", 8, 2], ["r", [["t", "y"], ["s", "y", 11]]], ["o", [["t", "v"], ["c", "v", "new", 3, 1]]], ["t", "z"], ["c", "z", "End", 6, 2]]
    assert html_extract.align(w, a)[-1] == ["c", "z", "End", 9, 3] and html_extract.align(a, w)[-1] == ["c", "z", "End", 9, 3]
    again = html_extract.align(w, w)
    assert [n[0] for n in again] == [n[0] for n in w] and again[1] == ["c", "x", "Menu", 16, 4]


def test_unmarked_pages_against_how_they_were_made(spark):
    """Pages without an article element: only the wrapper tells the text from what stands around it."""
    import random

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    pages, want = [], []
    for h in range(3):
        about, promise = f"About host {h} and its many readers", f"We at host {h} tell you all"
        for _ in range(15):
            text = [" ".join(word() for _ in range(rng.randrange(12, 40))) for _ in range(rng.randrange(1, 7))]
            extra = f"<p class=x>{promise}</p>" if rng.random() < 0.95 else ""
            body = "".join(f"<p>{t}</p>" for t in text)
            pages.append((len(pages), f"http://host{h}.example/p", f"<html><body><div class=top><p>{about}</p>{extra}</div><div class=story>{body}</div><div class=end><p>Host {h} since 1999</p></div></body></html>"))
            want.append("\n".join(text))
    out = html_extract.main_text(spark.createDataFrame(pages, SCHEMA)).collect()
    assert {r.page_id: r.text for r in out} == dict(enumerate(want))
    without = [html_extract.extract(p[2], html_extract.NOTHING) for p in pages]
    assert all(a != b for a, b in zip(without, want))


def test_html_long_pages_and_other_columns(spark):
    body = "".join(f"<p>para {i}</p>" for i in range(20_000))
    rows = [(1, "http://h/1", f"<article>{body}</article>", "a", "b", 3), (None, None, f"<div>{body}</div>", "a", "b", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string, share int")
    out = html_extract.main_text(df).collect()
    assert len(out) == 2 and {r.text for r in out} == {"\n".join(f"para {i}" for i in range(20_000))}


def depth(nodes):
    return max((1 + depth(n[1]) for n in nodes if n[0] in "or"), default=0)


def test_groups_do_not_nest():
    """Each page lacks one more of the tail than the one before it: no recursion, whatever the number of pages."""
    path = [f"<p class=c{i}>text {i}</p>" for i in range(1_800)]
    pages = ["<div>" + "".join(path[:n]) + "</div>" for n in range(1_800, 0, -3)]
    samples = [html_extract._sample(html_extract.blocks(p)) for p in pages]
    whole = samples[0]
    for s in samples[1:]:
        whole = html_extract._joined(whole, s)
    assert depth(whole["nodes"]) == 1
    assert [n[0] for n in html_extract.align(whole["nodes"], samples[5]["nodes"])] == [n[0] for n in whole["nodes"]]
    mixed = html_extract.infer([f"<div>{'<p>a</p>' * (i % 7)}{f'<ul><li>x{i}</ul>' * (i % 3)}{'<h2>h</h2><p>b</p>' * (i % 5)}</div>" for i in range(400)])
    assert mixed["mark"] == 0


def test_five_thousand_pages_of_one_template(spark):
    pages = [f"<body><div class=top><p>Site line</p></div><div class=story><h1>Head {i}</h1><p>{f'text {i} ' * 30}</p>{''.join(f'<p class=t{k}>tail {i} {k} words</p>' for k in range(i % 40))}</div></body>" for i in range(5_000)]
    out = texts(spark, pages)
    assert len(out) == 5_000 and all("Site line" not in t for t in out.values())
    assert out[39].count("\n") == 40 and out[39].startswith("Head 39\n")


def test_text_of_an_article_with_words_in_its_names(spark):
    inside = [
        '<p class="market-share">Shares fell</p>', '<section id="ad-hoc-networks"><p>Networks form</p></section>', '<p class="notice-period">Three months</p>',
        '<div id="dinner-menu"><p>Soup</p></div>', '<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>', '<p>Press <button>Start</button> now</p>',
    ]
    want = ["Shares fell", "Networks form", "Three months", "Soup", "Let x=2 be", "Press Start now"]
    one = "<body><article><h1>T</h1>" + "".join(inside) + "</article></body>"
    assert html_extract.extract(one, html_extract.NOTHING) == "\n".join(["T", *want])
    out = texts(spark, [one.replace("T<", f"T{i}<") for i in range(5)])
    assert all(out[i] == "\n".join([f"T{i}", *want]) for i in range(5))


def test_the_wrapper_tells_listed_classes_of_the_template_from_text(spark):
    """An element named ``ad`` that the template's pages have goes, one named ``menu`` that one page has is its text."""
    pages = [f"<body><article><h1>T{i}</h1><p>Body {i} of it <span class=promo>Buy {i}</span> goes on</p><div class=ad>Offer {i}</div>{'<div class=menu><p>Soup of the day</p></div>' if i == 3 else ''}</article></body>" for i in range(8)]
    out = texts(spark, pages)
    assert all(out[i] == f"T{i}\nBody {i} of it goes on" + ("\nSoup of the day" if i == 3 else "") for i in range(8))
    assert html_extract.extract(pages[3], html_extract.NOTHING) == "T3\nBody 3 of it goes on"


def test_marked_pages_come_through_their_wrapper():
    pages = [f"<body><div class=cards><main><p>Page {i}</p></main></div></body>" for i in range(4)]
    wrapper = html_extract.infer(pages)
    assert wrapper["roots"] == ["body/div.cards/main"] and wrapper["mark"] == 2
    other = "<body><main><p>Elsewhere</p></main></body>"
    assert html_extract.extract(other, wrapper) == "Elsewhere"


def test_headings_and_lists_of_unmarked_articles(spark):
    pages = [f"<body><div class=top><p>Site line</p></div><div class=story><h1>Head {i}</h1><p>{f'text {i} ' * 30}</p><ul><li>item {i}</li></ul></div></body>" for i in range(6)]
    out = texts(spark, pages)
    assert all(out[i].split("\n")[0] == f"Head {i}" and out[i].endswith(f"item {i}") for i in range(6))
