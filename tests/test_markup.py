"""Anchors against the parser of the standard library, and cases it shares with browsers."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from procura.functions import markup


class Reference(HTMLParser):
    """The same rules on top of the standard library's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.inside, self.hidden, self.count = [], False, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            self.inside = bool(href)
            if href:
                self.found.append([self.count, href, ""])
            self.count += 1
        self.hidden = tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.hidden = False

    def handle_endtag(self, tag):
        self.hidden = False
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.found[-1][2] += data


def reference(text):
    parser = Reference()
    parser.feed(text)
    parser.close()
    return [tuple(x) for x in parser.found]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<a title="a>b" href="/x.pdf">x</a>', [(0, "/x.pdf", "x")]),
        ('<a title="go href=/bad" href="/good.pdf">g</a>', [(0, "/good.pdf", "g")]),
        ("<a href='/a&#x27;&#38;&nbsp;&eacute;'>&#x27;&#38;&nbsp;&eacute;</a>", [(0, "/a'&\xa0é", "'&\xa0é")]),
        ('<a href="?a=1&copy=2&amp;b&lt;&notit;&copy">x</a>', [(0, "?a=1&copy=2&b<&notit;©", "x")]),
        ("<a href=/x>1 < 2 and 3 > 1</a>", [(0, "/x", "1 < 2 and 3 > 1")]),
        ("<textarea><a href=/no>n</a></textarea><a href=/x>y</a>", [(0, "/x", "y")]),
        ("<a href=/x>a<textarea><b>&amp;</textarea>c</a>", [(0, "/x", "a<b>&c")]),
        ("<script>'<a href=/no>'</script><a href=/x>y<style><a></style>z</a>", [(0, "/x", "yz")]),
        ("<!-- <a href=/no> --><a href=/x>y<!--n-->z</a>", [(0, "/x", "yz")]),
        ("<!--><a href=/x>y</a>", [(0, "/x", "y")]),
        ("<!-- a --!><a href=/x>y</a>", [(0, "/x", "y")]),
        ("<!-- never closed <a href=/no>", []),
        ("<a href=/x>open<p>more<a href=/y>z", [(0, "/x", "openmore"), (1, "/y", "z")]),
        ("<a name=n>n</a><a>m</a><a href=''>e</a><A HREF=/x>y</A >t", [(3, "/x", "y")]),
        ("<a href=/x href=/no>y</a>", [(0, "/x", "y")]),
        ("<a\nhref\n=\n'/x'/>y", [(0, "/x", "y")]),
        ("<abbr href=/no>y</abbr><a href=/x", []),
        ("<a href=\"/never closed>y</a>", []),
        ("<a href=/x>a</>b</ c>d<?e>f<!g>h<", [(0, "/x", "abdfh<")]),
        ("", []),
    ],
)
def test_cases(page, want):
    assert markup.anchors(page) == want


def test_equal_to_the_reference_parser():
    """Generated pages of well-formed parts, in any order and nesting."""
    rng = random.Random(11)
    parts = [
        '<a href="/x">', "<a href='/y?a=1&amp;b=2'>", "<a href=/z class=c>", "<a name=n>", "</a>", "</A>", "text", " &amp; ", "&eacute;", "&#38;",
        "<b>", "</b>", "<br/>", "<!-- c <a href=/no> -->", "<script>var a='<a href=/no>';</script>", "<style>p{}</style>", '<p title="a > b">',
        "</p>", "1 < 2", "<!DOCTYPE html>", '<a title="x>y" href="/q">', "\n", "é", "<A HREF='/u'>", '<a href="?a=1&copy;=2&lt;">',
    ]
    for _ in range(3000):
        page = "".join(rng.choices(parts, k=rng.randint(0, 25))) + "."
        assert markup.anchors(page) == reference(page), page


def test_any_text_ends():
    rng = random.Random(12)
    for _ in range(5000):
        markup.anchors("".join(rng.choices(["<", ">", "/", "!", "--", "a", " href=", "'", '"', "&", "#", "x", "script", "=", "?", " "], k=rng.randint(0, 30))))


@pytest.mark.parametrize("part", ["<!--", "<a href='", "<script>", "<", "<a", "&", "<a href=/x>", "</", "<textarea>", "<a x=\"", "<!-", "</a "])
def test_linear(part):
    started = time.perf_counter()
    markup.anchors(part * 100_000)
    assert time.perf_counter() - started < 5
