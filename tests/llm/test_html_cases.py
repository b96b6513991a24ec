"""Pages whose visible text is known, and an independent plain reading of the given pages."""

import re
import time
from html.parser import HTMLParser

import pytest

from tapeloom.llm.htmltext import RAW, UNSEEN, html_to_text

CASES = [
    ('<p style="backface-visibility: hidden">yes</p>', "yes"),
    ('<p style="color: red; visibility: hidden">no</p>yes', "yes"),
    ('<p style="DISPLAY:none !important">no</p>yes', "yes"),
    ("<head><title>T</title>Hello <b>world</b>", "Hello world"),
    ("<head><title>T</title><span>x</span> y", "x y"),
    ("<head><title>T</title><noscript>no</noscript>\n<meta a=b></head><body>x", "x"),
    ("<div>" * 205 + "<div hidden>SECRET</div>ok" + "</div>" * 205 + "tail", "ok\ntail"),
    ("<div hidden>" + "<div>" * 300 + "no" + "</div>" * 300 + "no</div>yes", "yes"),
    ("<div>" * 250 + "<span hidden><b>no</b></span><i>a</i>b", "ab"),
    ("<body hidden>x", ""),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<details>no<summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
    ("<table><tr><td colspan=2>ab<td>z<tr><td>long<td>longer<td>c</table>", "ab            z\nlong  longer  c"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>x<td>3</table>", "r  1\n   2\nx  3"),
    ('<table><tr><td colspan="0" rowspan="-1">a<td colspan=x>b<td colspan=999999999>c</table>', "a  b  c"),
    ("text <a href='x", "text"),
    ("a < b and c > d", "a < b and c > d"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_visible_text(page, text):
    assert html_to_text(page) == text


@pytest.mark.parametrize("piece", ["<a", '<a"', "<div>", " x='", "<p>", "<li><span>", "<td colspan=9>", '<a "', "</b>", "<!-", "&amp"])
def test_long_hostile_pages_are_read_in_linear_time(piece):
    begun = time.perf_counter()
    html_to_text("<b " + piece * 20_000)
    html_to_text(piece * 20_000)
    assert time.perf_counter() - begun < 20


class _Plain(HTMLParser):
    """Words outside elements that are never shown, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.unseen = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        hides = tag in UNSEEN or "hidden" in given or re.search(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)", given.get("style") or "")
        if (hides or self.unseen) and tag not in ("meta", "link", "br", "img", "input", "hr", "source"):
            self.unseen.append(tag)
        if tag == "img" and not self.unseen and not hides:
            self.words += (given.get("alt") or "").split()

    def handle_endtag(self, tag):
        if tag in self.unseen:
            while self.unseen.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.unseen:
            self.words += data.split()


def test_given_pages_have_the_words_of_a_plain_reading(spark, sf):
    assert "script" in RAW
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        plain = _Plain()
        plain.feed(r.html or "")
        plain.close()
        squeezed = lambda words: re.sub(r"[\s•\-\d.]+", "", "".join(words))  # noqa: E731  list marks are added by the layout
        assert squeezed(html_to_text(r.html or "").split()) == squeezed(plain.words), r.page_id
