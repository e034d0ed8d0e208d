"""Layout of visible text."""

import re
from html.parser import HTMLParser

import pytest

from cardloom.llm import html

CASES = [
    (None, None),
    ("", ""),
    ("  \n ", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>a<p>b", "a\n\nb"),
    ("<p>a<div>b</div>c", "a\n\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>a</b><i> b</i>c &amp; &lt;d&gt; &#233;", "a bc & <d> é"),
    ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z", "- a\n- b\n  3. x\n  4. y\n- c\n\nz"),
    ("<ul><li><p>a</p><p>b</p></li><li>c</ul>", "- a\n\n  b\n\n- c"),
    ("<dl><dt>t<dd>one<dd>two<dt>u</dl>", "t\n  one\n  two\nu"),
    ("<table><caption>C</caption><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>22</table>", "C\nName   N\napple  1\nfig    22"),
    ("<table><tr><td>a<br>b<td>x</table>after", "a  x\nb\n\nafter"),
    ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"),
    ("<table><tr><td>o<td><table><tr><td>i<td>j</table></table>", "o  i  j"),
    ("<table><tr><td>日本<td>x<tr><td>a<td>y</table>", "日本  x\na     y"),
    ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
    ("<head><title>no</title></head><style>p{}</style><script>'</p>'</script>yes<!-- no --><noscript>no</noscript>", "yes"),
    ("<div hidden>no</div><p style='color:red;DISPLAY : none'>no</p><p style='visibility:hidden'>no</p>yes<template>no</template>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("a < b && c<", "a < b && c<"),
    ("</p></div>x</table>", "x"),
    ("<p>a</p", "a"),
    ("<img alt='pic of x'><img>", "pic of x"),
    ("<a title='>'>x</a>", "x"),
    ("<select><option>no</select><textarea>no</textarea>yes", "yes"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_layout(page, want):
    assert html.visible_text(page) == want


def test_deep_long_and_wide_pages():
    assert html.visible_text("<div>" * 20_000 + "x") == "x"
    assert html.visible_text("<table><tr><td>" * 300 + "x") == "x"
    assert html.visible_text("<p>" + "word " * 300_000).count("word") == 300_000
    rows = "".join(f"<tr><td>{'w' * 5000 if i == 0 else i}<td>x" for i in range(2000))
    assert len(html.visible_text(f"<table>{rows}</table>")) < 500_000


class _Naive(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "style", "script") and 1

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "style", "script") and 1

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_all_words_of_the_given_pages(spark):
    """The same words in the same order as a plain walk over the tokens; the query covers the whole table."""
    from cardloom.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in QUERIES["op5_html"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        naive = _Naive()
        naive.feed(r.html)
        naive.close()
        plain = re.sub(r"^\s*- ", "", got[r.page_id], flags=re.M)
        assert re.sub(r"\s+", "", plain) == re.sub(r"\s+", "", "".join(naive.words))


def test_rows(spark):
    frame = spark.createDataFrame(
        [(1, "<p>a", "u", "t"), (1, "<p>a", "u", "t"), (None, None, None, None), (2, "", "u", "t")], "page_id bigint, html string, url string, text string"
    )
    assert sorted(map(tuple, html.extract(frame).collect()), key=str) == sorted([(1, "a"), (1, "a"), (None, None), (2, "")], key=str)
    assert html.extract(frame.limit(0)).collect() == []
