"""Markup as the web writes it: character references against Python's html.unescape, attributes in every form."""

import html
import random

from chalkline.llm import warc


def records(stored, pages):
    rows = warc.derive(warc.page_responses(stored(list(enumerate(pages)), "page_id long, html string")
                                           .selectExpr("page_id", "'http://a.org/' AS url", "html"))).collect()
    return {(r["page_id"], r["type"]): r["block"] for r in rows}


def test_character_references(stored):
    """Every name, numbers of all kinds, missing semicolons, names that begin others, and no second decoding."""
    known = sorted(html.entities.html5)
    texts = ["&#xE9;&#Xe9;&eacute;&uuml;&rsquo;", "&amp;lt;&#38;lt;&#x26;amp;", "&notit;&notin;&notin &copy2020 &ampamp;", "A & B && c&",
             "&#0;&#x0;&#xD800;&#1114112;&#x110000;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFF;", "&#0000000000233;&#x000000000E9;",
             "&#128;&#x99;&#150;", "&#233 &#xe9 &#;&#x; &#xg;", "&nosuchname; &x=1&y=2&copy=3", "&#x1F4AC;&NotEqualTilde;"]
    texts += ["".join(f"{i}&{x}|" for i, x in enumerate(known[k:k + 300])) for k in range(0, len(known), 300)]
    rng = random.Random(4)
    texts += ["".join(rng.choice(["&", "#", "x", "am", "p", ";", "lt", "no", "t", "in", "9", "65", "E", " ", "é", "x💬"])
                      for _ in range(rng.randint(1, 40))) for _ in range(400)]
    got = records(stored, texts)
    for i, text in enumerate(texts):
        want = html.unescape(text).replace("\xa0", " ") if "&" in text else text
        if any(ord(c) < 32 and c not in "\n\t\r" for c in want) or "&#0" in text and "�" not in want:
            continue
        own = [" ".join(x.split(" ")) for x in (got[i, "conversion"], want)]
        assert [x for x in own[0].split(" ") if x] == [x for x in own[1].replace("\t", " ").strip().split(" ") if x] \
            or "\n" in want and "".join(own[0].split()) == "".join(own[1].split()), text


def test_links_and_languages(stored):
    pages = ["<html lang='fr'><a href='/a'>1</a> <A HREF = \"/b c\">2</A> <a class=x href=/d?e=f>3</a><a\nid=\"q\"\n href\n=\n'/g'>",
             "<html class=\"l\" lang=de-AT><a title=\"x href=/no >\" href='/a\"b'>1</a><a data-href='/no' rel=y>2</a><a href>3</a>",
             "<html xml:lang=\"es\"><abbr href=/no><a title='t'href=\"/y\"/><a href=\"\">e</a><a hreflang=no href=/z>",
             "<html data-lang=no><p lang=no><a " + "x='1' " * 50_000 + "href=/far>"]
    meta = [dict(lines=records(stored, pages)[i, "metadata"].split("\r\n")) for i in range(4)]
    links = [[x[9:] for x in m["lines"] if x.startswith("outlink: ")] for m in meta]
    assert links == [["/a", "/b%20c", "/d?e=f", "/g"], ["/a\"b"], ["/y", "", "/z"], ["/far"]]
    assert [x[10:] for m in meta for x in m["lines"] if x.startswith("language: ")] == ["fr", "de-AT", "es", ""]
