"""Main text of pages: hand-made pages by rule, and whole tables against the element that holds the article."""

import html
import re

import pytest

from plumbline.llm import pages
from plumbline.llm.common import prepare
from plumbline.llm.queries import QUERIES

LONG = "The house at the end of the road was sold to the people who had been there for more than a year, and they are in it now. "
MORE = "Das Haus am Ende der Straße wurde an die Leute verkauft, die seit mehr als einem Jahr dort waren, und nun sind sie mit dem Hund in ihm. "
MENU = "<ul><li><a href='/'>Home</a><li><a href='/a'>About us and what we do</a></ul>"


def text(page):
    return pages.main_text(page)[0]


def doc(*paragraphs):
    return "\n\n".join(" ".join(p.split()) for p in paragraphs)


FURNITURE = [
    f"<nav>{MENU}</nav>", f"<header><p>{LONG}</p></header>", f"<footer>&copy; {LONG}</footer>", f"<aside><h2>More</h2><p>{LONG}</p></aside>",
    f"<form action='/s'><label>{LONG}</label><input name=q><button>Go and find it</button></form>", f"<script>var a = '<p>{LONG}</p>';</script>",
    f"<style>p > a {{ content: '{LONG}' }}</style>", f"<!-- <p>{LONG}</p> -->", f'<div class="cookie-notice"><p>{LONG}</p></div>',
    f'<div id="adSlot1">{LONG}</div>', f"<section class='post-comments'><article><p>{LONG}</p></article></section>",
    f'<div class="sidebar left"><p>{LONG}</p><p>{MORE}</p></div>', f"<noscript><p>{LONG}</p></noscript>", f"<div hidden><p>{LONG}</p></div>",
    f'<div style="display: none">{LONG}</div>', f"<div role='navigation'>{MENU}</div>", f"<svg><text>{LONG}</text></svg>",
    "<select><option>The one<option>and the other</select>", f"<template><p>{LONG}</p></template>", f"<textarea>{LONG}</textarea>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", '<div class="entry-content">{}</div>'])
def test_furniture_goes_and_text_stays(wrap):
    body = f"<h1>Sold</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}<br>{LONG}</p>"
    want = doc("Sold", LONG, "Yes.", f"{MORE} {LONG}")
    for piece in FURNITURE:
        for page in (piece + wrap.format(body), wrap.format(body) + piece, piece + wrap.format(body) + piece):
            assert text(f"<!DOCTYPE html><html><head><title>{LONG}</title></head><body>{page}</body></html>") == want, page


@pytest.mark.parametrize("piece", [p for p in FURNITURE if not p.startswith("<header")])
def test_furniture_within_an_article(piece):
    page = f"<article><h1>Sold</h1><p>{LONG}</p>{piece}<p>Yes.</p><p>{MORE}</p></article>"
    assert text(page) == doc("Sold", LONG, "Yes.", MORE)


def test_blocks_of_an_article_are_whole():
    junk = "getesch | einerü | schieein | erstchte. | Cherung"
    page = f"<nav>{MENU}</nav><div class=ad>Buy it now, and for less.</div><article><h1>A b</h1><p><b>{LONG}<br><p>{junk}<p>No.</article><footer>&copy; x</footer>"
    assert text(page) == doc("A b", LONG, junk, "No.")
    assert text("<article><h1>Zzz</h1><p>Qqq www.</p></article><p>" + LONG) == doc("Zzz", "Qqq www.")  # nothing could be decided


def test_open_blocks_follow_the_nearest():
    page = f"<div>{MENU}</div><p>Short one</p><h2>Head</h2><p>{LONG * 2}</p><p>Inner.</p><p>{MORE * 2}</p><p>Last.</p><div>{MENU}</div><p>After.</p><div>{MENU}</div>"
    got = text(page).split("\n\n")
    assert got == [" ".join(t.split()) for t in ("Head", LONG * 2, "Inner.", MORE * 2)]
    labels = [pages.OPEN, pages.TEXT, pages.OPEN, pages.OPEN, pages.OPEN, pages.NO_TEXT, pages.OPEN]
    found = [pages.Block("x", 0, pages.OUTSIDE, 0, False, False)] * 7
    assert pages.second_pass(found, labels) == [1, 1, 1, 0, 0, 0, 0]
    head = [b._replace(heading=True) for b in found]
    assert pages.second_pass(head, [2, 0, 2, 2, 1, 2, 2]) == [0, 0, 1, 1, 1, 1, 1]


def test_references_space_and_markup():
    page = f"<article><p>a&amp;b &lt;i&gt; &#228;&#x20ac; &notit; &nbsp; x&nbsp;y\n\t z &amp &copy 2 < 3 <i title='a>b'>c</i><p>{LONG}</article>"
    assert text(page).split("\n\n")[0] == "a&b <i> ä€ ¬it; x y z & © 2 < 3 c"
    for broken in ("<article><p>" + LONG, f"<article><p>{LONG}<", f"<article><p>{LONG}<a href='x", f"<article><p>{LONG}<!-- x", f"<article><p>{LONG}<script>x", f"<article><button><p>{LONG}"):
        assert text(broken) == doc(LONG) + (" <" if broken.endswith("<") else ""), broken
    for nothing in (None, "", " \n", "<", "<!--", "<article>", "<p></p>", "</div></article>", "\x00"):
        assert text(nothing) in ("", "\x00") and "<" not in text(nothing) or nothing == "<"


def test_very_long_pages():
    many = "<p>" + LONG
    page = "<nav>" + MENU * 2000 + "</nav><article>" + many * 20_000 + "<p>" + "x" * 3_000_000 + "</article>" + "<div" * 100_000
    got = text(page)
    assert got.count("\n\n") == 20_000 and got.endswith("x" * 3_000_000)
    assert len(text("<div>" * 50_000 + LONG * 3 + "</div>" * 50_000)) > 300
    assert text('<p a="' * 20_000) == ""


def test_query_keeps_the_articles(spark, sf_dir):
    """All pages of the table mark their article: its blocks, cut out by other means, are the text."""
    table = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op12_main_text"](spark, sf_dir).collect()
    assert len(rows) == len(table)
    for r in rows:
        source = table[r["page_id"]]
        inner = re.search(r"(?s)<article>(.*?)</article>", source["html"])[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", part)) for part in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(" ".join(p.split()) for p in parts if p.split())
        assert r["n_chars"] == len(r["text"]) and r["url"] == source["url"]


def test_odd_rows(spark):
    prepare(spark)
    page = f"<article><p>{LONG}</article>"
    rows = [(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, page, None, None), (2, "u", None, "t", 1), (3, "u", "", "t", 1)]
    table = spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in pages.extract(table).collect()), key=str)
    want = doc(LONG)
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(None, None, want, len(want)), (2, "u", "", 0), (3, "u", "", 0)], key=str)
    assert pages.extract(table.limit(0)).collect() == []
