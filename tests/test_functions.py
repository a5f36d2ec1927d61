import gzip

import pytest
from pyspark.sql import functions as F

from crawlens.functions import html, structured, text, url
from crawlens.sources import sitemaps


def one(spark, column, **values):
    names = list(values) or ["_"]
    return spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{n} {kind(v)}" for n, v in values.items()) or "_ int").select(column.alias("x")).first()["x"] if names else None


def kind(v):
    return "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "map<string,string>" if isinstance(v, dict) else "string"


def test_normalize():
    assert url.normalize("https://e.com/a#frag") == "https://e.com/a"
    assert url.normalize("HTTPS://E.com") == "https://e.com/"
    assert url.normalize("https://e.com/a?b=2&a=1") == url.normalize("https://e.com/a?a=1&b=2")
    assert url.normalize_for_match("HTTPS://E.com/A/?utm_source=x&q=1#t") == "https://e.com/a?q=1"


@pytest.mark.parametrize("code,group", [(200, "2xx"), (301, "3xx"), (404, "4xx"), (500, "5xx"), (None, "unknown"), (600, "other")])
def test_status_group(spark, code, group):
    assert spark.createDataFrame([(code,)], "c int").select(url.status_group("c")).first()[0] == group


@pytest.mark.parametrize("ct,u,kind_", [("text/html; charset=utf-8", "https://e.com", "html"), ("", "https://e.com/style.css", "css"), (None, "https://e.com/page", "other"), ("image/png", "/", "image"), ("application/javascript", "/", "js"), (None, "https://e.com/a.svg?x=1", "image")])
def test_resource_type(spark, ct, u, kind_):
    assert spark.createDataFrame([(ct, u)], "c string, u string").select(url.resource_type("c", "u")).first()[0] == kind_


def test_hosts_and_paths(spark):
    d = spark.createDataFrame([("https://www.E.com:80/a/b/c/?q#f",), ("https://other.org",), ("mailto:x",)], "u string")
    got = d.select(url.host("u"), url.path("u"), url.folder_depth("u"), url.is_internal("u", ["e.com"]), url.is_internal("u", [], "r.org")).collect()
    assert [tuple(r) for r in got] == [("www.e.com", "/a/b/c/", 3, True, False), ("other.org", "/", 0, False, True), (None, "x", 1, False, False)]


def test_shape(spark):
    d = spark.createDataFrame([("/es/literatura/10197-x",), ("/es/10000-n",), ("/es/novedades",), (None,), ("/",), ("/9/a",)], "p string")
    assert [r[0] for r in d.select(url.shape("p")).collect()] == ["/es/{s}/{n}", "/es/{n}", "/es/{s}", "/", "/", "/{n}/{s}"]


def test_follow(spark):
    d = spark.createDataFrame([("https://e.com/blog/a",), ("https://e.com/x/y/z",), ("https://e.com/private",)], "u string")
    rule = url.follow("u", ["*/blog/*"], ["private$"], max_depth=1)
    assert [r[0] for r in d.select(rule).collect()] == [True, False, False]
    assert [r[0] for r in d.select(url.follow("u", [], [], max_depth=2)).collect()] == [True, False, True]


def test_likely_html(spark):
    d = spark.createDataFrame([("https://e.com/a",), ("https://e.com/a.PDF",), ("https://e.com/a.php",), ("https://e.com/v1.2/",)], "u string")
    assert [r[0] for r in d.select(url.likely_html("u")).collect()] == [True, False, True, True]


def test_text_functions(spark):
    d = spark.createDataFrame([("  a \n b ", "noindex nofollow", "120px"), (" ", "None", "x"), (None, None, None)], "t string, r string, n string")
    got = d.select(text.clean("t"), text.says_noindex("r"), text.contains_noindex("r"), text.parse_int("n"), text.pixel_width("t")).collect()
    assert [tuple(r)[:4] for r in got] == [("a b", True, True, 120), (None, True, False, None), (None, False, False, None)]
    assert got[2][4] == 0


def test_page_facts():
    page = html.parse_page(
        """<html><head><svg><title>no</title></svg><title> A  b </title><META NAME="Description" content="d"><meta name=robots content=noindex><meta name=ROBOTS content=nofollow>
        <link rel=canonical href="/x"><link rel=alternate hreflang=es href="/es"><script type="application/ld+json">{"@type": ["A", "B"]}</script></head>
        <body><div class="site-header"><nav><a href="/a">Go <img src=i.png alt="pic"></a></nav></div><h1>T <b>x</b></h1><template><h2>no</h2>a b</template>
        <a href="mailto:x">m</a><a href="#f">f</a><a href="/a">again</a><a href="/z" target=_blank>z</a><map><area href="/m" alt="map"></map>
        <img src="http://e.com/k.png" alt=""><img srcset="/s1.png 1x, /s2.png 2x"></body></html>""",
        "https://e.com/dir/p",
    )
    m = page["meta"]
    assert (m["title"], m["meta_description"], m["meta_robots"], m["canonical_href"]) == ("A b", "d", "noindex, nofollow", "https://e.com/x")
    assert [(k["url"], k["link_position"], k["link_type"], k["follow"]) for k in page["links"]] == [("https://e.com/a", "nav", "image_text", False), ("https://e.com/a", "content", "hyperlink", False), ("https://e.com/z", "content", "hyperlink", False), ("https://e.com/m", "content", "hyperlink", False)]
    assert page["links"][3]["anchor_text"] == "map"
    assert page["headings"] == [{"tag": "h1", "position": 0, "text": "T x"}]
    assert page["hreflang"] == [{"lang": "es", "href": "https://e.com/es"}]
    assert page["structured_data"][0]["schema_type"] == "A, B"
    assert [(r["url"], r["alt_text"], r["is_mixed_content"]) for r in page["resources"]] == [("https://e.com/dir/i.png", "pic", False), ("http://e.com/k.png", "", True), ("https://e.com/s1.png", None, False)]
    assert page["mixed_content"] == ["http://e.com/k.png"] and page["has_unsafe_crossorigin"]


def test_page_facts_edges(spark):
    assert html.parse_page("")["word_count"] == 0
    assert html.parse_page("<body><template>a b</template>one two <p>three")["word_count"] == 3
    d = html.facts(spark.createDataFrame([(None, None), ("<title>x", "https://e.com")], "html string, url string"))
    assert [r["t"] for r in d.select(F.col("page.meta.title").alias("t")).collect()] == [None, "x"]


def test_base_href():
    assert html.parse_page('<base href="/es/"><a href="x">x</a>', "https://e.com/a/b")["links"][0]["url"] == "https://e.com/es/x"


def test_boilerplate():
    page = html.parse_page("<body><header>h</header><main><p>Body text</p><div class='newsletter-box'>join</div><p>We use cookies here</p></main></body>")
    assert page["main_text"] == "Body text"


def test_structured_data(spark):
    rows = ['{"@type":"Product"}', '{"name":"x"}', '{"@type":"WebPage"}', '"s"', None, '[{"@type":"Event","Name":"n"}, 3]', '{"@graph":[{"@type":"Person","name":"p"},{"x":1}]}', "not json"]
    got = structured.checked(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, raw string")).orderBy("id").collect()
    assert [r["validation_status"] for r in got] == ["warning", "error", "ok", "ok", "ok", "warning", "error", "ok"]
    assert got[5]["validation_issues"] == ["Event: missing required property 'startdate'"]


def test_security_headers(spark):
    d = spark.createDataFrame([({"Strict-Transport-Security": "x", "REFERRER-POLICY": "origin"},)], "h map<string,string>")
    r = d.select(html.security_headers("h").alias("s")).first()["s"]
    assert r["has_hsts"] and not r["has_csp"] and r["referrer_policy"] == "origin"


def test_sitemaps(spark):
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="i"><url><loc> https://e.com/a </loc><image:image><image:loc>https://e.com/i.png</image:loc></image:image></url><url><loc>/b</loc></url></urlset>'
    assert sitemaps.parse_sitemap(ns, "https://e.com/") == (["https://e.com/a", "https://e.com/b"], [])
    assert sitemaps.parse_sitemap(gzip.compress(ns.encode()), "https://e.com/")[0][0] == "https://e.com/a"
    index = "<sitemapindex><sitemap><loc>https://e.com/s1.xml</loc></sitemap></sitemapindex>"
    assert sitemaps.parse_sitemap(index) == ([], ["https://e.com/s1.xml"])
    assert sitemaps.parse_sitemap("garbage") == ([], [])
    assert sitemaps.parse_sitemap("<urlset><url><loc>https://e.com/a</loc></url><url><loc>https://e.com/b?x&y</loc></urlset>")[0][0] == "https://e.com/a"
    robots = spark.createDataFrame([("https://e.com/", "User-agent: *\nSITEMAP: /a.xml # c\n#Sitemap: no\nsitemap:https://e.com/b.xml\nSitemap: /a.xml")], "base_url string, text string")
    assert [r["sitemap"] for r in sitemaps.robots_sitemaps(robots).orderBy("n").collect()] == ["https://e.com/a.xml", "https://e.com/b.xml"]
    files = spark.createDataFrame([("https://e.com/r.xml", index.encode()), ("https://e.com/s1.xml", ns.encode())], "url string, content binary")
    pages, complete = sitemaps.follow(files, files.where("url like '%r.xml'").select("url"))
    assert sorted(r[0] for r in pages.collect()) == ["https://e.com/a", "https://e.com/b"] and complete


def test_registered_functions(spark):
    from crawlens.functions.register import register

    register(spark)
    assert spark.sql("SELECT normalize_url('HTTPS://E.com#x')").first()[0] == "https://e.com/"
    assert [tuple(r) for r in spark.sql("SELECT tag, text FROM page_headings('<h1>a</h1><h2>b</h2>')").collect()] == [("h1", "a"), ("h2", "b")]
    assert spark.sql("SELECT url FROM page_links('<a href=/x>x</a>', 'https://e.com/')").first()[0] == "https://e.com/x"
