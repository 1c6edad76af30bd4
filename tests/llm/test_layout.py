"""Layout of pages: implied tags, visibility, lists and tables."""

import pytest

from matchloom.llm.html_layout import visible_text

CASES = [
    ("", ""),
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b", "a\nb"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
    ("<p>a <span hidden>no</span>b", "a b"),
    ("<style>.x{display:none}</style><div class='x y'>no</div><div>yes</div>", "yes"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b></div>", "yes"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<script>x</p></script>a &amp; b", "a & b"),
    ("<h1>T</h1><div>a</div><div>b</div>", "T\n\na\nb"),
    ("<details><summary>s</summary>no</details>", "s"),
    ("<a><b>x</a>y</b>", "xy"),
    ("1 < 2 <b>x", "1 < 2 x"),
    ("<p>a</div></p>b", "a\n\nb"),
    ("<table><tr><td>x ||<td><tr><td>|<tr><td>a<td>| b |</table>", "x ||\n|\na    | | b |"),
    ("<style>@media print{.x{display:none}} @media screen{.y{display:none}} p.z#q{display:none}</style><p class=x>x<p class=y>y<p class=z id=q>z<p class=z>w", "x\n\nw"),
    ("<svg><title>no</title><text>yes</text></svg> <math><mi>m</mi></math> <object>o</object>", "yes m o"),
    ("<a href='x>y\">t</a> <b>u", 'y">t u'),
    ("<table><td colspan=2>wide one<td>c<tr><td>a<td>b<td>d</table>", "wide one | c\na | b | d"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert visible_text(page) == text


def test_deep_pages_end():
    assert visible_text("<div>" * 30000 + "x") == "x"
    assert "x" in visible_text("<table><tr><td>" * 200 + "x")


def timed(page):
    import time

    began = time.time()
    text = visible_text(page)
    assert time.time() - began < 4
    return text


def test_open_tags_take_linear_time():
    assert timed("<a " * 200_000).startswith("<a <a")
    for piece in ('<a b="', "<a b='>\" ", '<a b=">"', "<a b='", '<a "\' >', "<!x", "</script"):
        timed(piece * 60_000)
        timed(piece * 60_000 + ">")
    timed("<script>" + "</script" * 100_000)


def test_wide_cells_are_not_padded_to():
    page = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 3000 + "</table>"
    lines = timed(page).split("\n")
    assert lines[0] == "x" * 20_000 + " | y" and lines[1:] == ["a | b"] * 3000


def test_many_rules():
    sheet = "".join(f".c{i}{{display:none}}" for i in range(3000))
    page = f"<style>{sheet}</style>" + "".join(f"<p class=c{i}>no</p><p class=d{i}>yes</p>" for i in range(3000))
    assert timed(page).split() == ["yes"] * 3000


def test_no_word_is_lost_in_deep_tables():
    page = "<table><tr><td>w<td>" * 60 + "end"
    for deep in (3, 40):
        assert [w for w in visible_text(page, deep=deep).split() if w != "|"] == ["w"] * 60 + ["end"]
