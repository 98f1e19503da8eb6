"""Page analysis over a stack of elements, and crawls of saved pages."""

import duckdb
from pyspark.sql import functions as F

from findgrid.functions import html
from findgrid.operators import recon
from findgrid.plans import queries_pages


def names(page):
    return [[i["name"] for i in f["inputs"]] for f in html.analyse(page)["forms"]]


def test_sign_in_page():
    page = """<!doctype html><html><head><title>Sign in</title></head><body>
    <form action="/login" method="post"><input type="hidden" name="csrf" value="tok123"><input name="username" type="text"><input name="password" type="password"></form>
    <a href="/admin">Admin</a><a href="/logout">Logout</a><script src="/app.js"></script></body></html>"""
    a = html.analyse(page)
    assert (a["title"], a["links"], a["scripts"]) == ("Sign in", ["/admin", "/logout"], ["/app.js"])
    assert a["forms"] == [{"action": "/login", "method": "post", "inputs": [{"name": "csrf", "input_type": "hidden", "value": "tok123"}, {"name": "username", "input_type": "text", "value": ""}, {"name": "password", "input_type": "password", "value": ""}]}]


def test_comments_and_raw_text_are_no_tags():
    page = "<!-- <form><input name=a></form> <a href=/x> --><script>'<form><a href=/y>'</script><style><a href=/z></style><textarea><input name=b></textarea><a href=/real><!-- open"
    a = html.analyse(page)
    assert (a["forms"], a["links"], a["title"]) == ([], ["/real"], None)


def test_nesting_and_unclosed_tags():
    assert names("<form><input name=a><form><input name=b></form><input name=c>") == [["a", "b"]]  # the inner form is ignored, its end tag ends the outer one
    assert names("<div><form><input name=a></div><input name=b>") == [["a"]]  # the form ends with the element that it is in
    assert names("<form><div></form><input name=a></div><input name=b>") == [["a"]]  # div stays inside the form
    assert names("<form><input name=a><p><b><input name=b>") == [["a", "b"]]  # never closed
    assert names("<table><form><tr><td><input name=a></td></tr></form></table><form><input name=b></form>") == [[], ["b"]]
    assert names("<form><table><tr><td><div></td><td><input name=a></table><input name=b></form>") == [["a", "b"]]
    assert names("</form></div><input name=a><form><input name=b/></form>") == [["b/"]]
    assert names("<form><table><tr><td></form></div><input name=a></table>") == [["a"]]


def test_attributes():
    a = html.analyse("""<a title="x > y" HREF='/q?a=1&amp;b=2'>1</a><a href=/u class=c>2</a><a href>3</a><a href="/u">4</a><a href="/v" href="/w">5</a><title> A &lt;b&gt; &eacute; </title><form ACTION=/f METHOD=Get>""")
    assert a["links"] == ["/q?a=1&b=2", "/u", "/v"] and a["title"] == "A <b> é" and a["forms"][0]["method"] == "Get"
    assert html.analyse("<a href='/" + "'><a href='/".join(str(i) for i in range(30)) + "'>")["links"] == [f"/{i}" for i in range(20)]


def test_empty_null_and_long_pages(spark):
    pages = [None, "", "no tags", "<", "<a href=", "<a " * 200_000, "<div>" * 50_000 + "<form><input name=x>", '<a href="' * 50_000]
    got = spark.createDataFrame([(p,) for p in pages], "h string").select(html.page_analysis("h").alias("a")).select("a.*").collect()
    assert [(r.title, len(r.forms), r.links, r.scripts) for r in got[:6]] == [(None, 0, [], [])] * 6 and len(got[6].forms[0].inputs) == 1


def test_crawl_sites(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    site = {
        "http://a.test": "<title>home</title>" + link("/x", "y?k=1", "http://a.test/z", "http://other.test/", "/x", "/f#top"),
        "http://a.test/x": link("deep") + '<form action="save" method=get><input name=n value=v><input value=q></form>',
        "http://a.test/y?k=1": link("http://a.test/x/deep", "/far"),
        "http://a.test/x/deep": "<title>deep</title>" + link("deeper"),
        "http://a.test/x/deep/deeper": "",
        "http://a.test/z": "",
        "http://other.test/": "never",
    }
    p = spark.createDataFrame(list(site.items()), "url string, html string")
    seeds = spark.createDataFrame([("a", " http://a.test ", 0)], "site string, url string, ord long")
    pages, targets = recon.crawl_sites(p, seeds, 2, 20)
    assert [(r.visit, r.url, r.depth, r.title, r.forms, r.links) for r in sorted(pages.collect(), key=lambda r: r.visit)] == [
        (1, "http://a.test", 0, "home", 0, 5), (2, "http://a.test/x", 1, None, 1, 1), (3, "http://a.test/y?k=1", 1, None, 0, 2),
        (4, "http://a.test/z", 1, None, 0, 0), (5, "http://a.test/x/deep", 2, "deep", 0, 1),
    ]
    got = {(r.method, r.url): [tuple(x) for x in r.params] for r in targets.collect()}
    assert got == {
        ("GET", "http://a.test/x"): [], ("GET", "http://a.test/y?k=1"): [("k", "1")], ("GET", "http://a.test/z"): [], ("GET", "http://a.test/x/save"): [("n", "v")],
        ("GET", "http://a.test/x/deep"): [], ("GET", "http://a.test/y?k=1/far"): [("k", "1/far")], ("GET", "http://a.test/x/deep/deeper"): [],
    }
    assert [r.url for r in recon.crawl_sites(p, seeds, 2, 3)[0].orderBy("visit").collect()] == ["http://a.test", "http://a.test/x", "http://a.test/y?k=1"]
    assert recon.crawl_sites(p, seeds, 0, 20)[0].count() == 1 and recon.crawl_sites(p, seeds, 9, None)[0].count() == 6
    assert recon.crawl_sites(p.limit(0), seeds)[0].count() == 0 and recon.crawl_sites(p, seeds.filter(F.lit(False)))[1].count() == 0


def test_strict_references_need_their_semicolon(spark):
    page = '<title> a &amp b &ampc; &lt;i&gt; &eacute; &#33; &amp</title><a href="/q?x=1&amp;y=2&amp">x</a>'
    loose, strict = html.analyse(page), html.analyse(page, strict=True)
    assert (loose["title"], loose["links"]) == ("a & b &c; <i> é ! &", ["/q?x=1&y=2&"])
    assert (strict["title"], strict["links"]) == ("a &amp b &ampc; <i> é ! &amp", ["/q?x=1&y=2&amp"])
    assert spark.createDataFrame([(page,)], "h string").select(html.page_analysis("h", strict=True)["title"]).first()[0] == strict["title"]


def _sf_of_pages(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"SET threads = 1; CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return str(tmp_path), lambda name: sorted(map(str, c.sql(queries_pages.ORACLE_SQL[name]).fetchall()))


def test_cut_titles_match_sql(spark, tmp_path):
    sf, sql = _sf_of_pages(spark, tmp_path, [(1, "http://a.test/x", '<html><title>of &amp; that &amp</title><a href="/y">y</a></html>'), (2, "http://a.test/y", "<title>whole</title>")])
    for name in ("page_structure", "crawled_pages"):
        assert sorted(str(tuple(r)) for r in queries_pages.QUERIES[name](spark, sf).collect()) == sql(name)


def test_first_page_of_a_url_counts(spark, tmp_path):
    """Pages with one URL: the first by page_id is crawled, which is the one that SQL takes in the order of the table."""
    sf, sql = _sf_of_pages(spark, tmp_path, [(1, "http://a.test/x", '<a href="/zebra">z</a>'), (2, "http://a.test/x", '<a href="/ant">a</a>'), (3, "http://a.test/x#f", '<a href="/bee">b</a>')])
    for name in ("crawl_targets", "crawled_pages"):
        assert sorted(str(tuple(r)) for r in queries_pages.QUERIES[name](spark, sf).collect()) == sql(name)
    assert [r.url for r in queries_pages.crawl_targets(spark, sf).collect()] == ["http://a.test/x/zebra"]
