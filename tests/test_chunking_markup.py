"""Pages whose markup leaves end tags out."""

import pytest

from sparkloom.operators.chunking import split_page

CELLS = "cell words " * 6
TABLE = f"<table><tr><td>{CELLS}</td></tr></table>"


@pytest.mark.parametrize("page", [
    f"<p>Some text before{TABLE}<p>and more text after", f"<ul><li>Some text before<li>more</ul></div>{TABLE}<div>and more text after", f"<html><body><p>Some text before<p>more{TABLE}</span>and more text after</body></html>",
    f"<p>Some text before<table><tr><td>{CELLS}<tr><td>last</table>and more text after",
])
def test_unclosed_markup(page):
    out = split_page(page)
    assert [k for _, k, _ in out] == ["TEXT", "TABLE", "TEXT"]
    assert "Some text before" in out[0][0] and "and more text after" in out[2][0] and "cell words" in out[1][0] and out[1][2].startswith("<table>") and out[1][2].endswith("</table>")


def test_open_at_the_end_and_nested_tables():
    assert [k for _, k, _ in split_page(f"<p>Some text before<table><tr><td>{CELLS}")] == ["TEXT", "TABLE"]
    nested = split_page(f"<table><tr><td>{TABLE}<td>{CELLS}</table><img src=a.png><p>Tail of the page")
    assert [k for _, k, _ in nested] == ["TABLE", "IMAGE", "TEXT"] and nested[0][2].count("</table>") == 2
    assert split_page("<div>one two three <b>four<br/>five<img src=x>six")[0][0] == "one two three fourfivesix"
