"""Main text of pages: the parser, classes and regions, and whole sites built from known articles."""

import html
import random
import re

import numpy as np

from pinprice.llm import html_template as T
from pinprice.llm.html_parse import host_of, parse
from pinprice.llm.queries import op12_html_template
from conftest import SF001

DDL = "page_id long, url string, html string, text int, host string, region string, key string"


def run(spark, rows, **options):
    got = T.extract(spark.createDataFrame(rows, DDL), **options)
    assert got.columns == ["page_id", "url", "text", "n_chars", "region"]
    out = got.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    return out


def test_parser_ends_what_is_left_open():
    p = parse("<ul><li>a<li>b <b>c</ul><p>x<p>y<div>z</div>w")
    assert list(zip(p.blocks, p.paths, strict=True)) == [("a", "ul>li"), ("b c", "ul>li"), ("x", "p"), ("y", "p"),
                                                         ("z", "div"), ("w", "")]
    starts = sum(b > a for a, b in zip([0, *p.depths], p.depths, strict=False))
    assert starts * 2 + len(p.blocks) == len(p.roles) and p.depths[-1] == 0
    p = parse("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table>e")
    assert [(b, q.count(">")) for b, q in zip(p.blocks, p.paths, strict=True)] == [("a", 2), ("b", 2), ("c", 5), ("d", 2),
                                                                                 ("e", 0)]


def test_parser_odd_markup():
    texts = lambda s: parse(s).blocks
    assert texts("a<!-- <p>b --><i>c</i><!-->d<!--->e") == ["acde"]
    assert texts("a<!-- never ends <p>b") == ["a"]
    assert texts("1 < 2 &amp;&lt; &eacute; &#233;&#xe9; &am <3") == ["1 < 2 &< é éé &am <3"]
    assert texts("a<script>var x = '<p>b</p>' </scripty> </script >c<style>p{}</style>d") == ["a", "c", "d"]
    assert texts("<p title='a > b' data-x=\"</p>\">x</p><p title=\"open>y</p>") == ["x", "y"]
    assert texts("x<br>y<br/>z\n\t w") == ["x", "y", "z w"]
    assert texts("x<p class='cut") == ["x"] and texts("x</p></div></3>y<?php 1 ?>") == ["x", "y"]
    assert texts("<textarea><p>a</textarea>b<title>c &amp; d</title>") == ["b", "c & d"]
    assert texts("") == [] and texts("   \n ") == []
    assert parse("<div class='ad'>" * 3000 + "x").junk == [True]


def test_hosts():
    assert [host_of(u) for u in ("http://A.b:80/x", "https://u:p@c.d?x", "ftp://e", "//f/g", "", None, "mailto:h")] == [
        "a.b", "c.d", "e", "", "", "", ""]


def test_classes_of_a_page():
    tokens = np.array([1, 2, 3, 4, 5, 6])
    classes = np.array([10, 10, 20, 20, 30, 30])
    got = T.page_classes(np.array([1, 3, 4, 9, 3, 4, 2]), tokens, classes, 10)
    assert {c: x[1:] for c, x in got.items()} == {10: (True, 1), 20: (True, 2)}
    got = T.page_classes(np.array([1, 3, 4, 4, 3, 2, 5, 6]), tokens, classes, 10)
    assert not got[20][1] and got[30][1]
    got = T.page_classes(np.array([5, 1, 6, 2]), tokens, classes, 10)  # spans two gaps of the root
    assert not got[30][1] and got[10][1]


def test_region_is_the_element_with_the_bulk():
    assert T.region_of({"html>body>div.a>p": 90, "html>body>div.b": 10}) == "html>body>div.a"
    assert T.region_of({"html>body>div.a": 60, "html>body>div.b": 40}) == "html>body"
    assert T.region_of({"html>body>article>div.x>p": 100}) == "html>body>article"
    assert T.region_of({"": 5}) == "" and T.region_of({}) == ""


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij<&é", k=rng.randint(1, 8))) for _ in range(n))


def site(rng, style, i, host):
    """(html, text) of one page of a site: menus, notices, adverts, comments and footers around an article."""
    blocks = [words(rng, rng.randint(1, 40)).strip() or "x" for _ in range(rng.randint(3, 9))]
    e = html.escape
    menu = "".join(f"<li><a href='/{x}'>{e(x)}</a>" for x in ("Home", "News", words(rng, 2)))
    body = f"<h1>{e(blocks[0])}</h1>" + "".join(
        rng.choice([f"<p>{e(b)}</p>", f"<p>{e(b)}", f"<p><b>{e(b)}</b><br>", f"<ul><li>{e(b)}</ul>",
                    f"<blockquote>{e(b)}</blockquote>"]) for b in blocks[1:])
    advert = f"<div class='ad-box'>{e(words(rng, 5))}</div>" if rng.random() < 0.6 else ""
    said = "".join(f"<div class=c><p>{e(words(rng, 6))}</div>" for _ in range(rng.randint(0, 4)))
    head = f"<!DOCTYPE html><html><head><title>{e(blocks[0])}</title><script>if (a<b) x('</p>')</script></head>"
    if style == "article":
        page = (f"{head}<body><nav><ul>{menu}</ul></nav>{advert}<article>{body}</article><section id=comments>{said}"
                f"</section><footer>{host} {e(words(rng, 3))}</footer>")
    else:  # no telling names but for the advert's
        page = (f"{head}<body><div class=x1><form><input>Search</form><ul class=nav>{menu}</ul></div><div class=q7>"
                f"We use biscuits on this site</div><div class=k9 id=post-{i}>{advert}{body}</div>"
                f"<div class=z2>Read more at {host}</div></body></html>")
    return page, "\n".join(" ".join(b.split()) for b in blocks)


def test_sites_against_their_articles(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for host, style, n in (("a.example", "article", 25), ("b.example", "plain", 25), ("c.example", "plain", 4),
                           ("d.example", "article", 1), ("e.example", "article", 2)):
        for _ in range(n):
            i = len(rows)
            page, text = site(rng, style, i, host)
            rows.append((i, f"https://{host}/{i}", page, 0, "", "", None))
            want[i] = text
    got = {r["page_id"]: r["text"] for r in run(spark, rows)}
    assert got == want


def test_odd_rows_and_copies(spark):
    page = "<html><body><nav>m</nav><article><h1>T</h1><p>same text</article><footer>f</footer>"
    rows = [(i, "http://h/1", page, 0, "", "", "") for i in (1, 1, 2, 3, 4, None)]            # copies are whole articles
    rows += [(5, "http://h/5", "<html><body><article></article><p>p", 0, "", "", ""),          # an empty article
             (6, None, page, 0, "", "", ""), (7, "", None, 0, "", "", ""), (8, "http://h/8", "", 0, "", "", ""),
             (9, "http://h/9", "<html><body><main>other <i>shape</i></main>", 0, "", "", ""),
             (10, "http://long/", "<html><body><article>" + "<p>w &amp; x" * 40_000, 0, "", "", "")]
    got = {r["page_id"]: r["text"] for r in run(spark, rows)}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 6, None), "T\nsame text"), 5: "", 7: "", 8: "", 9: "other shape",
                   10: "\n".join(["w & x"] * 40_000)}
    assert run(spark, []) == []


def test_shuffled_templates_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"http://s{i % 3}/", site(rng, "plain", i, "s")[0], 0, "", "", "") for i in range(24)]
    want = sorted(run(spark, rows))
    monkeypatch.setattr(T, "MAX_BROADCAST", 0)
    assert sorted(run(spark, rows)) == want


def test_query_against_the_article_elements(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    for r in op12_html_template(spark, SF001).collect():
        inner = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", inner)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])
