import pytest
from pyspark.sql import functions as F

from crawlens.functions import url
from crawlens.operators import cleaning, explorer, graph, rules, semantic, upserts
from crawlens.sources import archive

URL = "job_id string, id long, url string, url_hash string, path string, is_internal boolean, is_html boolean, status_code int, status_group string, crawl_depth int, word_count int, text_ratio double, body_hash string, in_sitemap boolean, redirect_url string"


def urls(spark, *rows):
    base = {"job_id": "j", "is_internal": True, "is_html": True, "status_code": 200, "status_group": "2xx", "crawl_depth": 1, "word_count": 300, "text_ratio": 20.0, "body_hash": None, "in_sitemap": None, "redirect_url": None}
    full = [base | {"id": i, "url": f"https://e.com/{i}", "url_hash": f"h{i}", "path": f"/{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(f[c.split()[0]] for c in URL.split(", ")) for f in full], URL)


def kinds(df):
    return sorted((r["url_id"], r["issue_type"]) for r in df.select("url_id", "issue_type").collect())


def test_http(spark):
    u = urls(spark, {"status_group": "4xx"}, {"status_group": "5xx"}, {"status_group": "timeout"}, {"status_group": "other"}, {"status_group": None})
    assert kinds(rules.http_issues(u)) == [(0, "4xx_error"), (1, "5xx_error"), (2, "connection_error")]


def meta(spark, *rows):
    schema = "url_id long, title string, title_len int, meta_description string, meta_description_len int, meta_robots string, x_robots_tag string, canonical_href string"
    base = dict.fromkeys(c.split()[0] for c in schema.split(", "))
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def test_titles(spark):
    u = urls(spark, {}, {}, {}, {}, {"status_code": 404}, {}, {})
    m = meta(spark, {"url_id": 0, "title": None}, {"url_id": 1, "title": " \t"}, {"url_id": 2, "title": "Home page here"}, {"url_id": 3, "title": " home PAGE here "}, {"url_id": 4, "title": "home page here"}, {"url_id": 5, "title": "x" * 61}, {"url_id": 6, "title": "a" * 9})
    assert kinds(rules.title_issues(u, m)) == [(0, "title_missing"), (1, "title_missing"), (2, "title_duplicate"), (3, "title_duplicate"), (5, "title_too_long"), (6, "title_too_short")]


def test_h1(spark):
    h = spark.createDataFrame([(0, 1, "h1", "Same"), (1, 2, "h1", "same "), (2, 3, "h1", None), (3, 4, "h1", "x"), (4, 4, "h1", "x")], "id long, url_id long, tag string, text string")
    assert kinds(rules.h1_issues(urls(spark, {}, {}, {}, {}, {}), h)) == [(0, "h1_missing"), (1, "h1_duplicate"), (2, "h1_duplicate"), (4, "h1_multiple")]


def test_canonical(spark):
    u = urls(spark, {}, {"status_code": 404}, {}, {}, {})
    m = meta(spark, {"url_id": 0, "canonical_href": "https://e.com/1"}, {"url_id": 2, "canonical_href": " "}, {"url_id": 3, "canonical_href": "https://www.e.com/3"}, {"url_id": 4, "canonical_href": "https://e.com/4#x"})
    assert kinds(rules.canonical_issues(u, m)) == [(0, "canonical_broken"), (2, "canonical_missing"), (3, "canonical_cross_domain")]


def test_hreflang(spark):
    u = urls(spark, {}, {}, {"status_code": 301}, {})
    h = spark.createDataFrame([(0, 0, "en", "https://e.com/1"), (1, 1, "es", "https://e.com/0"), (2, 0, "fr", "https://e.com/2"), (3, 3, "x-default", "https://e.com/0"), (4, 3, "en_US", "https://e.com/none")], "id long, url_id long, lang string, href string")
    assert kinds(rules.hreflang_issues(u, h)) == [(0, "hreflang_broken_target"), (0, "hreflang_missing_return"), (3, "hreflang_invalid_lang")]


def test_noindex_and_indexable(spark):
    u = urls(spark, {}, {}, {}, {})
    m = meta(spark, {"url_id": 0, "meta_robots": "NOINDEX, follow"}, {"url_id": 1, "meta_robots": "none"}, {"url_id": 2, "canonical_href": "https://e.com/0"})
    assert kinds(rules.indexability_issues(u, m)) == [(0, "noindex_page")]
    assert {r["id"]: r["indexable"] for r in rules.with_indexable(u, m).collect()} == {0: False, 1: True, 2: False, 3: None}


def test_redirects(spark):
    to = lambda i: {"redirect_url": f"https://e.com/{i}"}
    u = urls(spark, to(1), to(2), to(3), {}, to(5), to(4), to(6))
    got = {r["url_id"]: (r["hops"], r["loops"]) for r in graph.redirect_chains(u).collect()}
    assert got == {0: (3, False), 1: (2, False), 2: (1, False), 4: (2, True), 5: (2, True), 6: (1, True)}
    assert kinds(rules.redirect_issues(u)) == [(0, "redirect_chain"), (4, "redirect_loop"), (5, "redirect_loop"), (6, "redirect_loop")]


def test_urls(spark):
    cases = {"/A": "url_uppercase", "/a_b": "url_underscores", "/a//b": "url_multiple_slashes", "/x;filters/": "url_cms_faceted", "/café": "url_non_ascii", "/a%00": "url_non_seo_friendly", "/filters/": None}
    u = urls(spark, *[{"url": f"https://e.com{p}", "path": p} for p in cases])
    assert kinds(rules.url_issues(u)) == [(i, k) for i, k in enumerate(cases.values()) if k]


def test_sitemap_gate(spark):
    u = urls(spark, {"in_sitemap": False}, {"in_sitemap": None}).withColumns({"inlinks_count": F.lit(0), "indexable": F.lit(True)})
    assert kinds(rules.sitemap_issues(u)) == []
    u = urls(spark, {"in_sitemap": False}, {"in_sitemap": True}, {"in_sitemap": True, "crawl_depth": 0}).withColumns({"inlinks_count": F.lit(0), "indexable": F.lit(True)})
    assert kinds(rules.sitemap_issues(u)) == [(0, "not_in_sitemap"), (1, "sitemap_orphan")]


LINK = "job_id string, id long, from_url_id long, to_url_hash string, to_url string, is_internal boolean, follow boolean, link_position string"


def test_graph(spark):
    u = urls(spark, {}, {}, {}, {})
    rows = [(0, 1, "content", True), (0, 1, "footer", True), (0, 2, "nav", True), (1, 2, "content", True), (2, 0, "content", False)]
    k = spark.createDataFrame([("j", i, a, f"h{b}", f"u{b}", True, follow, pos) for i, (a, b, pos, follow) in enumerate(rows)], LINK)
    c = {r["id"]: (r["inlinks_count"], r["unique_inlinks_count"], r["outlinks_count"]) for r in graph.link_counts(u, k).collect()}
    assert c == {0: (1, 1, 3), 1: (2, 1, 1), 2: (2, 2, 1), 3: (0, 0, 0)}
    edges = {(r["src"], r["dst"]): r["w"] for r in graph.pagerank_edges(u, k).collect()}
    assert edges == {(0, 1): 1.0, (0, 2): 0.25, (1, 2): 1.0}
    pr = {r["id"]: r["pagerank"] for r in graph.pagerank(u, k).collect()}
    r = dict.fromkeys(range(4), 0.25)
    for _ in range(100):
        lost = (r[2] + r[3]) / 4
        got = {1: r[0] * 0.8, 2: r[0] * 0.2 + r[1]}
        r = {i: 0.15 / 4 + 0.85 * (got.get(i, 0) + lost) for i in r}
    assert pr == {i: pytest.approx(round(v / max(r.values()) * 10, 4), abs=2e-4) for i, v in r.items()}
    depth = {r["id"]: r["depth"] for r in graph.crawl_depth(u, k, u.where("id = 0").select("job_id", "id")).collect()}
    assert depth == {0: 0, 1: 1, 2: 1}
    assert graph.pagerank(u.limit(0), k).count() == 0


def test_cleaning(spark):
    rs = [{"type": "line_exact", "value": "drop me"}, {"type": "cut_from_line", "value": "END"}, {"type": "remove_substring", "value": "junk"}]
    d = spark.createDataFrame([(1, "keep this line\n drop me \nmore  text\nEND here\nlost"), (2, "END one line junk"), (3, None), (4, ""), (5, "END\n" + "x" * 50), (6, "a   b")], "id int, t string")
    got = {r["id"]: tuple(r["r"]) for r in d.select("id", cleaning.clean_with_safety("t", rs).alias("r")).collect()}
    assert got[1] == ("keep this line\nmore text", 25, False)
    assert got[2] == ("END one line", 5, False)
    assert got[3] == (None, 0, False) and got[4] == ("", 0, False)
    assert got[5][1:] == (0, True) and got[6] == ("a b", 2, False)
    assert cleaning.problems([{"type": "line_exact", "value": "ab"}, {"type": "x"}]) and not cleaning.problems(rs)


def test_apply_and_revert(spark):
    d = spark.createDataFrame([(1, "one junk two", "md junk md", None, None)], "url_id int, content_text string, content_markdown string, content_text_original string, content_markdown_original string").withColumn("cleaned_at", F.lit(None).cast("timestamp"))
    rs = [{"type": "remove_substring", "value": "junk"}]
    a = cleaning.apply(d, rs)
    r = a.first()
    assert (r["content_text"], r["content_text_original"], r["content_length"]) == ("one two", "one junk two", 7)
    b = cleaning.revert(a).first()
    assert (b["content_text"], b["content_text_original"], b["cleaned_at"]) == ("one junk two", None, None)


def test_explorer_params():
    conds, need = explorer.predicates(explorer.Query({"word_count_gte": "x", "title_len_lte": 5}))
    assert len(conds) == 1 and need
    assert explorer.page_info(0, explorer.Query())["pages"] == 1
    assert explorer.crawl_progress(5, 5, None) == 50.0


def test_vectors(spark):
    rows = [(i, [1.0, 0.1 * i, 0.0], 1.0, 0.0) for i in range(8)] + [(8, [0.0, 0.0, 1.0], 1.0, 0.0), (9, [0.0, 0.0, 0.0], 1.0, 0.0)]
    v = semantic.weights(spark.createDataFrame(rows, "id long, embedding array<double>, pagerank double, clicks double"))
    assert {r["weight"] for r in v.collect()} == {1e-6}
    d = semantic.rings(semantic.distances(v))
    assert {r["id"]: r["semantic_role"] for r in d.collect()}[8] == "outlier"
    p = {(r["id_dominant"], r["id_weak"]) for r in semantic.pairs(v, 0.99, block=3, most_cells=3).collect()}
    exp = {(a, b) for a in range(8) for b in range(a + 1, 8) if (1 + 0.01 * a * b) / ((1 + 0.01 * a * a) ** 0.5 * (1 + 0.01 * b * b) ** 0.5) >= 0.99}
    assert p == exp


def test_chunks():
    part = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    text = "\n\n".join(part(i, 30) for i in range(10))
    got = semantic.chunk(text, 100, 35)
    assert [(c.split()[0], len(c.split())) for c in got] == [("w0_0", 90), ("w2_0", 90), ("w4_0", 90), ("w6_0", 90), ("w8_0", 60)]
    assert "\n" not in got[0]
    # a paragraph of more than the size falls apart into sentences, one without sentences stays
    text = part(0, 20) + "\n \n" + ". ".join(part(i, 15) for i in range(1, 9)) + "\n\n" + part(9, 70)
    assert [(c.split()[0], len(c.split())) for c in semantic.chunk(text, 50, 15)] == [("w0_0", 50), ("w2_0", 45), ("w4_0", 45), ("w6_0", 45), ("w8_0", 85)]
    assert semantic.chunk("One two. Three four! " + part(1, 8), 500) == ["One two. Three four! " + part(1, 8)]
    assert semantic.chunk("too short") == [] and semantic.chunk("") == []


def test_upserts(spark):
    old = spark.createDataFrame([("j", "a", 3, 200, 1)], "job_id string, url_hash string, crawl_depth int, status_code int, seq int")
    new = spark.createDataFrame([("j", "a", 5, 404, 2), ("j", "b", 1, 200, 2)], old.schema)
    assert sorted(tuple(r) for r in upserts.upsert_pages(old, new).collect()) == [("j", "a", 3, 404, 2), ("j", "b", 1, 200, 2)]
    assert upserts.merged_config({"crawl_behavior": {"a": 1}, "x": 1}, {"crawl_behavior": {"b": 2}, "x": 2}) == {"crawl_behavior": {"a": 1, "b": 2}, "x": 2}


def test_page_vectors(spark):
    from crawlens.operators.embedding import page_vectors

    class Letters:
        """A stand-in backend: counts of a, b and c."""

        dimensions = 3

        def embed_documents(self, texts):
            return [[float(t.count(c)) for c in "abc"] for t in texts]

        def embed_query(self, text):
            return self.embed_documents([text])[0]

    d = spark.createDataFrame([(1, "\n\n".join(["a " * 400, "b " * 400, "b c " * 150])), (2, "c " * 20), (3, None)], "url_id long, content_text string")
    got = {r["url_id"]: (r["chunk"], r["embedding"]) for r in page_vectors(d, Letters()).collect()}
    assert got[1][0] == 1 and got[2] == (0, [0.0, 0.0, 20.0]) and 3 not in got


def test_stored_search_metrics(spark, tmp_path):
    import json

    from crawlens.sources import search_console

    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"keys": ["https://e.com/", "q"], "clicks": 3, "impressions": 10, "ctr": 0.33333, "position": 2.26}]}))
    r = search_console.read(spark, str(tmp_path), ("url", "query")).first()
    assert tuple(r) == ("https://e.com/", "q", 3, 10, 0.3333, 2.3)


def test_gsc_summary(spark):
    d = spark.createDataFrame([(1, 1, 1.0), (10, 1000, 5.0), (0, 0, None)], "clicks int, impressions int, position double")
    r = semantic.gsc_summary(d).first()
    assert (r["avg_ctr"], r["avg_position"]) == (round(11 / 1001, 4), round(5001 / 1001, 1))


def test_archive_warnings_and_zip(spark, tmp_path):
    from crawlens.sources import archive

    u = spark.createDataFrame([("j", 5, "u5"), ("j", 9, "u9")], "job_id string, id long, url string")
    m = spark.createDataFrame([(5, "t5"), (None, "t"), (77, "t77")], "url_id long, title string")
    path = str(tmp_path / "a")
    archive.export_job({"urls": u, "html_meta": m}, path, "j")
    (tmp_path / "a" / "html_meta" / "extra.json").write_text("not json\n")
    got, warnings = archive.import_job(spark, path, {"urls": u.schema, "html_meta": m.schema}, "k", 100)
    assert sorted(tuple(r) for r in got["urls"].select("job_id", "id", "url").collect()) == [("k", 100, "u5"), ("k", 101, "u9")]
    assert [tuple(r) for r in got["html_meta"].select("url_id", "title").collect()] == [(100, "t5")]
    assert {(r["table"], r["problem"]): r["n"] for r in warnings.collect()} == {("html_meta", "bad JSON"): 1, ("html_meta", "no page key"): 1, ("html_meta", "unknown page"): 1}
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "j.zip").write_bytes(archive.zip_folder(spark, path))
    assert archive.read_zips(spark, str(tmp_path / "z")).where("table = 'urls'").count() == 2


def test_job_tables(spark, tmp_path):
    from crawlens.sources import exports, tables

    u = urls(spark, {}, {"status_code": 404})
    tables.write(u, str(tmp_path), "urls")
    tables.write(u.withColumn("job_id", F.lit("k")), str(tmp_path), "urls")
    d = tables.scan(spark, str(tmp_path), "urls", "k", F.col("status_code") == 404, columns=["id", "url"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in d.collect()] == [(1, "https://e.com/1")]
    assert "PartitionFilters: [isnotnull(job_id" in plan and "EqualTo(status_code,404)" in plan and "word_count" not in plan
    assert "pagerank" in tables.missing(u, "urls")
    assert list(exports.csv_lines(d)) == ["﻿id,url\r\n", "1,https://e.com/1\r\n"]


def test_pagerank_comes_to_rest(spark):
    """Ranks of a small graph at the operator's own tolerance, scale and places, against a power iteration."""
    import random

    r = random.Random(4)
    n, weights = 12, {"content": 1.0, "footer": 0.15, None: 0.3}
    edges = [(r.randrange(n), r.randrange(n), r.choice(list(weights))) for _ in range(30)]
    pages = spark.createDataFrame([("j", i, f"h{i}", True) for i in range(n)], "job_id string, id long, url_hash string, is_internal boolean")
    links = spark.createDataFrame([("j", a, f"h{b}", True, True, w) for a, b, w in edges], "job_id string, from_url_id long, to_url_hash string, is_internal boolean, follow boolean, link_position string")
    best = {}
    for a, b, w in edges:
        if a != b:
            best[a, b] = max(best.get((a, b), 0), weights[w])
    out = {a: sum(w for (x, _), w in best.items() if x == a) for a, _ in best}
    rank = [1 / n] * n
    while True:
        lost = sum(rank[i] for i in range(n) if i not in out)
        new = [0.15 / n + 0.85 * (lost / n + sum(rank[a] * w / out[a] for (a, b), w in best.items() if b == i)) for i in range(n)]
        moved, rank = max(abs(x - y) for x, y in zip(new, rank, strict=True)), new
        if moved < 1e-12:
            break
    got = {x["id"]: x["pagerank"] for x in graph.pagerank(pages, links).collect()}
    assert max(got.values()) == 10.0 and all(abs(got[i] - rank[i] / max(rank) * 10) < 5e-4 for i in range(n))


def test_long_redirects(spark):
    """A loop of sixty pages is a loop, a chain of sixty a chain."""
    rows = [("j", i, f"u{i}", f"u{(i + 1) % 60}") for i in range(60)] + [("j", 100 + i, f"v{i}", f"v{i + 1}") for i in range(60)]
    d = spark.createDataFrame(rows, "job_id string, id long, url string, redirect_url string")
    got = {r["url_id"]: (r["hops"], r["loops"]) for r in graph.redirect_chains(d).where("url_id in (0, 100)").collect()}
    assert got == {0: (60, True), 100: (60, False)}


def test_gsc_rows_with_tracking_parameters(spark):
    """Pages of one normal form: a row finds the one whose tracking parameters it has, most of them first."""
    u = "https://e.com/a"
    pages = spark.createDataFrame([(1, f"{u}?utm_source=feed"), (2, u), (3, f"{u}?utm_source=feed&gclid=1"), (4, "https://e.com/b?gclid=9"), (5, "https://e.com/b?gclid=8")], "id long, url string")
    want = {f"{u}/?utm_source=x#t": 2, f"{u}/": 2, f"{u.upper()}?UTM_SOURCE=FEED&utm_source=x": 1, f"{u}/?utm_source=feed&gclid=1&gclid=2": 3, u: 2, "https://e.com/b": 4, "https://e.com/c": None}
    rows = spark.createDataFrame([(k,) for k in want], "url string")
    got = semantic.gsc_to_urls(rows, pages, url.match_url, url.match_urls)
    assert {r["url"]: r["url_id"] for r in got.collect()} == want


def test_import_numbers_pages_once(spark, tmp_path, monkeypatch):
    """New keys are numbered in one run of the range sort, whose partitions are not the same in another."""
    n = 5000
    urls = spark.range(n).select(F.lit("j1").alias("job_id"), (F.col("id") * 7).alias("id"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    archive.export_job({"urls": urls}, str(tmp_path / "a"), "j1")
    sort, runs = type(urls).repartitionByRange, []

    def once(self, *cols):
        seen = spark.sparkContext.accumulator(0)
        runs.append(seen)
        return sort(self, *cols).mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), "id long")

    monkeypatch.setattr(type(urls), "repartitionByRange", once)
    got, _ = archive.import_job(spark, str(tmp_path / "a"), {"urls": urls.schema}, "j2", 10)
    assert {r["url"]: r["id"] for r in got["urls"].collect()} == {f"u{i}": 10 + i for i in range(n)}
    assert [r.value for r in runs] == [n]
