"""Literal cases of functions and operators."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.operators import fuzzy
from quern.operators import relational as R
from quern.operators import stateful as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_exclusive_percentile(spark):
    df = spark.range(20).agg(F.sort_array(F.collect_list(F.col("id").cast("double"))).alias("s"))
    assert abs(df.select(X.exclusive_p95(F.col("s"))).first()[0] - 18.95) < 1e-9


def test_short_history_takes_the_mean(spark):
    assert one(spark, X.exclusive_p95(F.array(F.lit(2.0), F.lit(4.0))), a=1) == 4.5


def test_urls(spark):
    assert one(spark, X.normalize_url(F.col("u")), u="http://www.a.org/b/?q=1#f") == "https://a.org/b?q=1#f"
    assert one(spark, X.comparable_url(F.col("u")), u=" HTTP://A.org/b/ ") == "https://a.org/b"
    assert one(spark, X.url_pattern(F.col("p")), p="/a/123/x45/deadbeef99") == "/a/num/xn/IDn"


def test_url_join(spark):
    from urllib.parse import urljoin

    from quern.functions import urls as U

    refs = ["", "x", "/x/y", "x/../y", "../x", "../../x", "./", "..", "/a/./b/../c", "//h.org/p", "https://h.org/q", "mailto:a@b.c", "?q=1", "#f", "x?y=1#z", "/x?u=../v"]
    rows = [(b, r) for b in ("https://a.org", "https://a.org/", "http://a.org/b/c/d?k=1#f", "http://a.org/b/c/") for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", U.url_join(F.col("b"), F.col("r")).alias("x")).collect()
    # The reference library leaves a bare host without its slash where only dots follow.
    assert [(b, r, x.rstrip("/")) for b, r, x in got] == [(b, r, urljoin(b, r).rstrip("/")) for b, r in rows]


def test_names(spark):
    assert one(spark, X.normalize_with(F.col("n"), X.NAME_RULES), n="St. Mary") == one(spark, X.normalize_with(F.col("n"), X.NAME_RULES), n="Saint Mary") == "saint mary"


def test_similarity(spark):
    assert one(spark, fuzzy.similarity("a", "b"), a="saint mary", b="saint mary") == 1.0
    assert one(spark, fuzzy.similarity("a", "b"), a="our lady of fatima", b="our lady of lourdes") >= 0.4
    assert one(spark, fuzzy.similarity("a", "b"), a="", b="x") == 0.0


def test_has_data(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,), (X.NOT_FOUND,)], ["v"])
    assert [r["v"] for r in rows.where(X.has_data(F.col("v"))).collect()] == ["a"]


def test_phone(spark):
    assert one(spark, X.format_phone(F.col("p")), p="404.555.0199") == "(404) 555-0199"
    assert one(spark, X.phones_match(F.col("a"), F.col("b")), a="404-555-0199", b="(404) 555 0199")


def test_null_order_of_pages(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, v int")
    assert [r["id"] for r in R.page(df, R.sort_key(df, "v", {"v": "v"}, "id"), 1, 3).collect()] == [1, 3, 2]
    assert [r["id"] for r in R.page(df, R.sort_key(df, "v", {"v": "v"}, "id", True), 1, 3).collect()] == [2, 3, 1]
    assert [r["id"] for r in R.page(df, R.sort_key(df, "nope", {"v": "v"}, "id"), 2, 2).collect()] == [3]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], ["t"]).collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    part = spark.createDataFrame([(1, None), (2, "z")], "k int, v string")
    assert sorted(map(tuple, R.partial_upsert(old, part, ["k"], ["v"]).collect())) == [(1, "a", 1), (2, "z", 1)]


def test_breaker(spark):
    calls = [(1, at, at, ok) for at, ok in ((0, False), (1, False), (2, False), (3, True), (20, True), (21, True), (22, True))]
    df = spark.createDataFrame(calls, "name long, at long, call_id long, ok boolean")
    got = {r["call_id"]: r["state"] for r in S.breaker_fold(df, timeout_us=10).collect()}
    assert got == {0: "CLOSED", 1: "CLOSED", 2: "OPEN", 3: "OPEN", 20: "HALF_OPEN", 21: "CLOSED", 22: "CLOSED"}


def test_streams_give_the_batch_result(spark):
    import os

    from quern.streaming import events

    if os.path.isdir("/root/testdata/sf0.001"):
        n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
        assert events.stream_daily(spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0] == n


def test_stream_daily_counts_late_files(spark, tmp_path):
    import datetime
    import os
    import shutil

    from quern.streaming import events

    schema = "event_id long, ts timestamp_ntz, event_type string, user_id long, value double"
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(10):
        at = datetime.datetime(2024, 12, 1) - datetime.timedelta(days=30 * k)
        spark.createDataFrame([(k, at, "view", 1, 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (part,) = (tmp_path / f"part{k}").glob("*.parquet")
        shutil.copy(part, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    got = events.stream_daily(spark, str(tmp_path)).collect()
    assert len(got) == 10 and all(r["n"] == 1 for r in got)


def test_duplicates_of_other_rows_than_the_first(spark):
    from quern.plans import models

    tail = "the quick brown fox jumps over a lazy dog while rain falls"
    texts = [
        "parish of saint mary and many other quite unrelated words", "parish of the holy ghost at riverbank hill top", "parish of the holy ghost at riverbank hill tops",
        "Alpha " + tail, "Omega " + tail, "x" * 130 + " one two three four five six seven", "x" * 130 + "".join(f" {k}q" for k in range(80)),
    ]
    df = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    real, models.table = models.table, lambda *_: df
    try:
        for rows in (256, 1):
            kept, fuzzy.BLOCK_ROWS = fuzzy.BLOCK_ROWS, rows
            got = {(r["doc_id"], r["seed"]) for r in models.fuzzy_dedup(spark, "").collect()}
            fuzzy.BLOCK_ROWS = kept
            assert got == {(2, 1), (4, 3)}
    finally:
        models.table = real


def test_relevant_prefix(spark):
    from quern.plans.contents import relevant_prefix

    def cut(text, most=20):
        return one(spark, relevant_prefix(F.col("t"), most), t=text)

    assert cut(" short one ") == "short one"
    assert cut("aa bb cc dd ee mass ff gg hh") == "aa bb cc dd ee mass"
    # Words go on past 70 % only while each has a term.
    assert cut("aa bb cc dd ee ff mass mass mass") == "aa bb cc dd ee"
    assert cut("mass " * 9) == "mass mass mass mass"
    assert cut("x" * 30 + " mass") == "x" * 20 + "..."
    null = spark.createDataFrame([(None,)], "t string").select(relevant_prefix(F.col("t"), 5).alias("x"))
    assert null.first()["x"] is None


def _over(spark, query, rows, schema):
    from quern.plans import contents

    df = spark.createDataFrame(rows, schema)
    real, contents.table = contents.table, lambda *_: df
    try:
        return query(spark, "").collect()
    finally:
        contents.table = real


def test_name_split(spark):
    from quern.plans.contents import name_split

    line = "St. Mary Parish 12 Elm Road Springfield St. John the Baptist 4 Oak Lane Rivertown St. Anne Chapel, Hill Road, Lakeview"
    got = _over(spark, name_split, [(1, f"short\n{line}"), (2, ""), (3, None), (4, "x" * 200)], "doc_id long, text string")
    assert [(r["doc_id"], r["row"], r["pos"], r["name"][:8]) for r in sorted(got, key=lambda r: r["pos"])] == [(1, 1, 0, "St. Mary"), (1, 1, 1, "St. John"), (1, 1, 2, "St. Anne")]


def test_element_rows(spark):
    from quern.plans.contents import element_rows

    html = '<ul><li>Saint Mary\nopen daily\n12 Elm Street</li><li data-name="Holy Ghost" data-address="4 Oak Ave">x</li><li>Zoom in</li><li>short</li><li><h3>A long enough heading</h3>b</li></ul>'
    got = _over(spark, element_rows, [(1, html), (2, ""), (3, None)], "page_id long, html string")
    assert sorted((r["pos"], r["name"], r["address"]) for r in got) == [(0, "Saint Mary", "12 Elm Street"), (1, "Holy Ghost", "4 Oak Ave"), (4, "A long enough heading", None)]


def test_page_analysis(spark):
    from quern.plans.contents import page_analysis

    got = {r["page_id"]: r for r in _over(spark, page_analysis, [(1, '<iframe src="a"></iframe> parish-finder ajax leaflet'), (2, ""), (3, '<a href="list.pdf">x</a>')], "page_id long, html string")}
    assert got[1]["complexity"] == "high" and got[1]["skipped"] == "PDFDirectoryExtractor"
    assert got[1]["sequence"].startswith("IframeExtractor:12,ParishFinderExtractor:18,ImprovedInteractiveMapExtractor:22")
    assert got[2]["skipped"] == "ImprovedInteractiveMapExtractor,PDFDirectoryExtractor,IframeExtractor"
    assert got[3]["suitable"].startswith("PDFDirectoryExtractor,") and "PDFDirectoryExtractor:3" in got[3]["sequence"]


def test_time_snippet(spark):
    from quern.plans.contents import time_snippet

    page = "<p>Adoration here</p><p>Twelve, 12 Hours per Week</p>"
    got = {r["page_id"]: r["snippet"] for r in _over(spark, lambda s, d: time_snippet(s, d, "adoration"), [(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string")}
    assert got == {1: "12 hours per week", 2: X.NOT_FOUND, 3: X.NOT_FOUND}


def test_smoothed_is_the_fold(spark):
    import random

    r = random.Random(2)
    rows = [(r.choice("aaab"), r.randint(0, 50), i, r.choice([0.0, 1.5, 2.0, 7.0])) for i in range(300)] + [("z", 1, 1, 0.0), ("z", 2, 2, 0.0), (None, 1, 1, 1.0), ("a", None, 1, 1.0), ("a", 1, 1000, None)]
    want = {}
    for k, at, _, v in sorted((x for x in rows if None not in x), key=lambda x: (x[1], x[2])):
        n, avg = want.get(k, (0, 0.0))
        want[k] = (n + 1, v if avg == 0 else 0.1 * v + 0.9 * avg)
    df = spark.createDataFrame(rows, "k string, at long, i long, v double")
    for width in (1, 7, 1000):
        got = {x["k"]: (x["n"], x["smoothed"]) for x in R.smoothed(df, "k", "at", "i", "v", width=width).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_frames_leave_services_out(spark):
    from quern.plans.rules import embedded_frames

    page = "<IFRAME src='https://www.google.com/maps/x'></iframe><iframe src=https://youtube.com/parish></iframe><iframe></iframe><div><iframe title=x src='/Find-Church'></iframe></div><img src='map.leaflet'>"
    got = embedded_frames(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r["pos"], r["src"], r["kind"]) for r in got] == [(0, "https://www.google.com/maps/x", "mapping"), (3, "/Find-Church", "listing")]


def test_links_take_published_terms_unless_told(spark):
    from quern.plans import links

    page = '<nav><a href="/information">Information</a><a href="/mass">Mass times</a></nav><a href="/directory">x</a><a href="/department">Department</a>'
    df = spark.createDataFrame([(1, "http://a.org/b", page)], "page_id long, url string, html string")
    assert {r["href"] for r in links.directory_links(df).collect()} == {"http://a.org/directory"}
    assert [r["href"] for r in links.menu_links(df).collect()] == ["http://a.org/mass"]


def test_page_text_leaves_scripts_out(spark):
    assert one(spark, X.html_text(F.col("h")), h="<p>a</p><SCRIPT>var t='</p>'</script><style>p{}</style> b") == "a b"


def test_costs_are_exact_sums(spark, tmp_path):
    from quern.plans import series

    # 0.0000225 in all, which a sum of doubles misses.
    rows = [(k, 0, "user", "x" * n) for k, n in enumerate((41, 25, 43))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in series.cost_rollup(spark, str(tmp_path)).collect()] == [("low", 0.000023, 0.000023, 3, 0.000008)]


def test_extracted_rows_read_references_as_their_sql(spark, tmp_path):
    from quern.plans import pages

    page = "<html><body><article><h1>The hand&amp;&amp &lt;i&gt; &eacute; &amp;lt;</h1><p>x</p></article></body></html>"
    spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(pages.SQL["extracted_rows"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in pages.extracted_rows(spark, str(tmp_path)).collect()] == want and want[0][3] == "The hand&&amp <i> &eacute; &lt;"


def test_extracted_rows_name_pages_by_the_whole_heading_as_their_sql(spark, tmp_path):
    """Headings too short for a name, and headings that read like addresses or distances."""
    from quern.plans import pages

    heads = ["de", "a,", "the,", "Of 8233 theast 4036451696482", "The 12 Elm Street, York, NY 10001", "The and (2.5 Miles) of", "  the \t of , "]
    rows = [(k, f"http://a.b/{k}", f"<html><body><article><h1>{h}</h1><p><b>{h} of<br><p>the 555-555-1234</p></article></body></html>") for k, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(pages.SQL["extracted_rows"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in pages.extracted_rows(spark, str(tmp_path)).collect()) == sorted(want) and sorted(r[0] for r in want) == [2, 3, 4, 5, 6]
