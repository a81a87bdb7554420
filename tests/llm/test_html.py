"""Layout-aware text: hostile pages, tables, visibility, and all text against the standard library's parser."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from circlet.llm import html_text
from circlet.llm.html_text import visible_text


TABLE_TAGS = "table caption colgroup col thead tbody tfoot tr td th".split()


@pytest.mark.parametrize(
    "name, page",
    [
        ("open tags", "<a " * 1_000_000),
        ("open quotes", "<a b=\"" * 500_001),
        ("depth", "<div>" * 600_000),
        ("end tags below a cell", "<b><table><tr><td>" + "<div>" * 150_000 + "</b>" * 150_000),
        ("lists", "<ul><li>x" * 100_000),
        ("tables", "<table><tr><td>x" * 60_000),
        ("rowspans", "<table><tr>" + "".join(f"<td rowspan={9999 - i % 2}>" for i in range(50_000)) + "<tr><td>y" * 40_000),
        ("wide cells", "<table>" + "<tr><td colspan=1000>x<td>y" * 30_000),
        ("blanks", ("<a" + " " * 3000) * 1000),
        ("references", "&#" + "9" * 1_000_000 + ";" + "&#" * 500_000),
        ("lone signs", "<" * 3_000_000),
        ("comments", "<!--" * 700_000),
        ("groups of rows", "<table>" + "<thead><colgroup>" * 100_000),
        ("groups in captions", "<table>" + "<caption><tbody>" * 100_000),
        ("groups that never end", "<table>" + "<div><tbody>" * 100_000),
        *[(f"{a} {b}", "<table>" + f"<{a}><{b}>x" * 5_000) for a in TABLE_TAGS for b in TABLE_TAGS],
    ],
)
def test_hostile_pages_take_linear_time(name, page):
    began = time.process_time()
    visible_text(page)
    assert time.process_time() - began < 15  # seconds of a loaded machine; what is quadratic takes hours


@pytest.mark.parametrize(
    "source, text",
    [
        # a cell that reaches down keeps its column; rowspan 0 is to the end of the group, which ends all spans
        ("<table><tr><td rowspan=2>aa<td>b<tr><td>c</table>", "aa  b\n    c"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<tbody><tr><td>e</table>", "a  b\n   c\n   d\ne"),
        ("<table><tr><td colspan=2>aa<td>b<tr><td>c<td>d<td>e</table>", "aa     b\nc   d  e"),
        ("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f</table>", "a  b  c\n   d\n   e  f"),
        ("<table><tr><td colspan=99999999999999999999>a<td>b<tr><td colspan=x>c</table>", "a  b\nc"),
        # a group of rows ends all that it can't be in, however these are nested
        ("<table><thead><colgroup><thead><tr><td>a<tbody><tr><td>b</table>", "a\nb"),
        ("<table><thead><colgroup><col><tbody><tr><td rowspan=2>a<tfoot><tr><td>b</table>", "a\nb"),
        # visibility is inherited and can be taken back; display can't
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", "yes"),
        ("<div style='display:none'>no<b style='display:block;visibility:visible'>no</b></div>yes", "yes"),
        ("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>yes</table>", "  yes"),
        ("<details><summary>S</summary>no<p>no</details><details open>yes</details>", "S\nyes"),
        ("<style>.x, p.y{display:none} #a{visibility:hidden} @media print{b{display:none}} i{display:none}</style><u class='z x'>no</u><u id=a>no</u><i style='display:inline'>1</i><b>2</b>", "12"),
        # the page may end anywhere
        ("x <b", "x <b"), ("x <b a=\"", "x <b a=\""), ("x <!-- y", "x"), ("x <b a='>y", "x y"), ("x </", "x </"), ("<script>x", ""),
        ("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;", "�A"),
        ("<!-->a<!--->b<!--c-->d", "abd"),
        ("<blockquote>q<p>r</blockquote>z", "  q\n\n  r\n\nz"),
        ("<ul><li><p>a<p>b</ul><ol start=-1><li>c<li>d</ol>", "- a\n\n  b\n\n-1. c\n0. d"),
    ],
)
def test_layout_and_visibility(source, text):
    assert visible_text(source) == text


class _Plain(HTMLParser):
    """All text outside hidden elements, of a page whose tags are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "")
        up = self.open[-1] if self.open else (False, False)
        gone = up[0] or "hidden" in a or "display:none" in style or tag in ("script", "style", "template")
        veiled = True if "visibility:hidden" in style else False if "visibility:visible" in style else up[1]
        if tag not in ("br", "img", "hr"):
            self.open.append((gone, veiled))
        elif tag == "img" and not gone and not veiled:
            self.found.append(a.get("alt") or "")

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if not any(self.open[-1] if self.open else (False, False)):
            self.found.append(data)


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        pick = rng.random()
        if pick < 0.35 or depth > 7:
            out.append(rng.choice(["word", "two words", " &amp; ", "é<br>", "<img alt='pic' src=x>", "1 &lt; 2", "<!-- no > -->", "日本"]))
            continue
        tag = rng.choice(["div", "span", "b", "section", "em", "blockquote", "ul", "table", "template", "script"])
        attr = rng.choice(["", "", "", " hidden", " style='display: none'", " style=\"visibility:hidden\"", " style='visibility:visible'", " class=\"a b\" title='x > y'", " data-x"])
        if tag == "ul":
            body = "".join(f"<li>{random_page(rng, depth + 1)}</li>" for _ in range(rng.randrange(3)))
        elif tag == "table":
            body = "".join("<tr>" + "".join(f"<td rowspan={rng.randrange(1, 4)} colspan={rng.randrange(1, 3)}>{random_page(rng, depth + 2)}</td>" for _ in range(rng.randrange(1, 4))) + "</tr>" for _ in range(rng.randrange(3)))
        elif tag == "script":
            body = "var a = '</b>' < 1;"
        else:
            body = random_page(rng, depth + 1)
        out.append(f"<{tag}{attr}>{body}</{tag}>")
    return "".join(out)


def letters(text):
    return sorted(c for c in text if not c.isspace() and c != "-")


def test_all_visible_text_by_another_parser():
    rng = random.Random(5)
    for _ in range(1500):
        page = random_page(rng)
        plain = _Plain()
        plain.feed(page)
        plain.close()
        assert letters(visible_text(page)) == letters("".join(plain.found)), page


def test_query_equals_each_page_alone(spark):
    """Nulls, repeated rows, a very long page, columns that clash: a row of the result for each row."""
    rng = random.Random(6)
    pages = [(i, random_page(rng)) for i in range(60)] + [(None, "x"), (3, None), (3, ""), (7, "<p>word " * 200_000), (7, "<p>a<p>b"), (7, "<p>a<p>b")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumns({"n_lines": F.lit("x"), "Text": F.lit(1)})
    got = sorted(((r.page_id, r.text, r.n_lines) for r in html_text.extract(df).collect()), key=repr)
    want = [(i, visible_text(h)) for i, h in pages]
    assert got == sorted(((i, t, len(t.split("\n")) if t else 0) for i, t in want), key=repr)
