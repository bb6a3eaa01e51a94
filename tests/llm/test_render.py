import pytest

from lintlake.llm.render import render, tree

CASES = {
    "inline": ("a <b>b</b>c\n d<i> e</i>", "a bc d e"),
    "implied paragraph ends": ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    "implied item ends": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    "ordered": ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    "several blocks in an item": ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
    "definitions": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n    b\nc\n    d"),
    "headings": ("<h1>a</h1>b<h2>c</h2>", "a\n\nb\n\nc"),
    "breaks": ("a<br>b<br/>c</br>d", "a\nb\nc\nd"),
    "preformatted": ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    "table": ("<table><tr><th>ab<th>c<tr><td>d<td>efg</table>", "ab  c\nd   efg"),
    "table without rows": ("<table><td>a<td>b</table>", "a  b"),
    "spanning": ("<table><tr><td colspan=2>ab<td>x<tr><td>c<td>d<td>y</table>", "ab    x\nc  d  y"),
    "wide characters": ("<table><tr><td>日本<td>a<tr><td>b<td>c</table>", "日本  a\nb     c"),
    "lines in cells": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "table in table": ("<table><tr><td>a<td><table><tr><td>b<td>c</table><tr><td>d</table>", "a  b  c\nd"),
    "caption": ("<table><caption>x</caption><tr><td>a</table>", "x\na"),
    "stray text": ("<table>x<tr><td>a</table>", "x\na"),
    "scripts": ("a<script>if (a<b) '</p>'</script>b<style>p{}</style>", "ab"),
    "hidden": ("a<p hidden>b</p><p style='DISPLAY : none'>c</p><p style='visibility:hidden'>d</p>e", "ae"),
    "hidden by sheet": ("<style>.x, #y {display:none} q{color:red}</style><p class='z x'>a</p><p id=y>b</p><q>c</q>", "c"),
    "hidden table row": ("<table><tr hidden><td>a<tr><td>b</table>", "b"),
    "comments": ("a<!-- <p>b</p> -->c<!doctype x><?x?>d", "acd"),
    "entities": ("&lt;b&gt; &amp;amp; &eacute;&#x41;&nbsp;&unknown;", "<b> &amp; éA &unknown;"),
    "quoted attributes": ("<a title='x>y' href=\"z>\">b</a>", "b"),
    "head": ("<html><head><title>t</title><meta x><body>a", "a"),
    "implied head end": ("<head><title>t</title><p>a", "a"),
    "unclosed": ("<div><b>a<p>b", "a\n\nb"),
    "stray ends": ("</div>a</b></li>b</p>c", "ab\n\nc"),
    "textarea": ("<textarea><b>a</b></textarea>", "<b>a</b>"),
    "not tags": ("1 < 2 <3 a<b", "1 < 2 <3 a"),
    "images": ("<img alt='a'> <img src=x>b", "a b"),
    "quote": ("a<blockquote>b<p>c</blockquote>d", "a\n\n  b\n\n  c\n\nd"),
    "empty": ("", ""),
    "nothing shown": ("<script>x</script><p> </p>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_render(name):
    source, expected = CASES[name]
    assert render(source) == expected


def test_null_stays_null():
    assert render(None) is None


@pytest.mark.parametrize("source", ["<div>" * 30_000 + "x", "<table><td>" * 500 + "x", "<b" * 50_000, "<a " + "x " * 100_000, "<ul><li>" * 5000 + "x"])
def test_odd_pages_end(source):
    render(source)


def test_tree_of_table_parts():
    root, _ = tree("<table><thead><tr><th>a<tbody><tr><td>b<tfoot><tr><td>c</table>d")
    parts = root.children[0]
    assert [n.tag for n in parts.children] == ["thead", "tbody", "tfoot"]
    assert root.children[1] == "d"


def test_whole_query_keeps_every_visible_word(spark):
    import html
    import re

    from lintlake.llm.render import op6_html_text

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").toPandas().set_index("page_id").html
    rows = op6_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(pages)
    for row in rows:
        source = re.sub(r"<!--.*?-->|<(script|style|title)\b.*?</\1>", "", pages[row["page_id"]], flags=re.S)
        expected = html.unescape(re.sub(r"<(?:/?(?:b|a|i|span)\b[^>]*)>", "", source).replace("<", " <"))
        expected = re.sub(r"<[^>]*>", " ", expected).split()
        assert [w for w in row["text"].split() if w != "-"] == [w for w in expected if w != "-"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<a href=/o'brien>O'Brien</a> x", "O'Brien x"), ("<p class=a'>b</p>c", "b\n\nc"), ('<p title = "a>b" x\'y>c', "c"),
        ("a</>words<b>c</b>", "awordsc"), ("a<!-->b<!-- x --!>c", "abc"), ("<a title=\"b>c", ""),
        ("<style>@media print{.x{display:none}}</style><p class=x>a", "a"),
        ("<style>@media print{.y{color:red}} .x{display:none}</style><p class=x>a</p>b", "b"),
        ("<style>@import 'z';@media screen, print{.x{color:red;display:none}}</style><p class=x>a</p>b", "b"),
        ("<style>@media (max-width: 600px){.x{display:none}}</style><p class=x>a", "a"),
        ("a<xmp><b>&amp;</xmp>c", "a<b>&amp;c"), ("<head>a<title>t</title></head>b", "ab"),
        ("a <select><option>b<option>c</select>", "a\nb\nc"), ("a <object data=x>b</object>", "a b"),
    ],
)
def test_what_a_screen_shows(source, expected):
    assert render(source) == expected
