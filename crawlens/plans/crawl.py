"""Queries over sinks, jobs, tabs, templates and pages of a crawl, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlens.functions import url
from crawlens.functions.structured import checked
from crawlens.operators import cleaning, explorer, graph, rules, scores, semantic, upserts
from crawlens.plans import explore
from crawlens.plans.views import tables, with_views
from crawlens.sources import exports
from crawlens.sources.tables import conform

_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def meta_upsert(spark, sf_dir):
    """Meta rows that come again with another title, also for pages that don't exist."""
    t = tables(spark, sf_dir, "urls", "html_meta")
    old = t["html_meta"].select("url_id", "title", F.lit(1).alias("seq"))
    new = old.where("url_id % 3 = 0").select("url_id", F.lit("again").alias("title"), F.lit(2).alias("seq"))
    lost = new.select((F.col("url_id") + 10_000_000).alias("url_id"), "title", "seq")
    return upserts.upsert_children(old, new.unionByName(lost), t["urls"])


_SQL["meta_upsert"] = (("html_meta",), " SELECT url_id, CASE WHEN url_id % 3 = 0 THEN 'again' ELSE title END AS title, CASE WHEN url_id % 3 = 0 THEN 2 ELSE 1 END AS seq FROM html_meta")


def headings_replaced(spark, sf_dir):
    """Pages that are crawled again have their new headings only."""
    old = tables(spark, sf_dir, "headings")["headings"].select("url_id", "tag", "position")
    new = old.where("url_id % 5 = 0 and tag = 'h2'").withColumn("tag", F.lit("h6"))
    return upserts.replace_children(old, new).groupBy("tag", "position").agg(F.count("*").alias("n"))


_SQL["headings_replaced"] = (("headings",), " SELECT CASE WHEN url_id % 5 = 0 THEN 'h6' ELSE tag END AS tag, position, count(*) AS n FROM headings WHERE url_id % 5 <> 0 OR tag = 'h2' GROUP BY 1, 2")


def job_deleted(spark, sf_dir):
    u = tables(spark, sf_dir, "urls")["urls"].withColumn("job_id", F.concat(F.lit("j"), (F.col("id") % 3).cast("string")))
    return upserts.delete_job(u, "j1").groupBy("job_id").agg(F.count("*").alias("n"))


_SQL["job_deleted"] = (("urls",), " SELECT 'j' || CAST(id % 3 AS VARCHAR) AS job_id, count(*) AS n FROM urls WHERE id % 3 <> 1 GROUP BY 1")


def redirect_hop_rows(spark, sf_dir):
    u = tables(spark, sf_dir, "urls")["urls"].where("id % 4 = 0")
    pages = u.select("job_id", "url", F.array(F.concat("url", F.lit("#a")), F.concat("url", F.lit("#b"))).alias("redirect_urls"), F.array(F.lit(302), F.lit(None).cast("int")).alias("redirect_statuses"))
    return graph.redirect_hops(pages).select("from_url", "to_url", "status", "hop")


_SQL["redirect_hop_rows"] = (("urls",), " SELECT url || '#a' AS from_url, url || '#b' AS to_url, 302 AS status, 0 AS hop FROM urls WHERE id % 4 = 0 UNION ALL SELECT url || '#b', url, 301, 1 FROM urls WHERE id % 4 = 0")


def js_templates(spark, sf_dir):
    """Links and words of raw and rendered pages by template; rendering adds links to every fifth page."""
    u = tables(spark, sf_dir, "urls")["urls"]
    raw = F.array(F.lit("a"), F.col("url"))
    more = F.when(F.col("id") % 5 == 0, F.array_union(raw, F.array(F.lit("b"), F.lit("c"), F.lit("b")))).otherwise(raw)
    pages = u.select("path", raw.alias("raw_links"), more.alias("rendered_links"), (F.col("id") % 100).alias("raw_words"), (F.col("id") % 100 + 5).alias("rendered_words"))
    d = graph.js_dependence(pages, url.shape("path"))
    return d.select("template", "pages", "hidden_links", F.round("raw_words", 4).alias("raw_words"), F.round("rendered_words", 4).alias("rendered_words"), "graph_reliable")


_SHAPE = "'/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s, i: CASE WHEN regexp_matches(s, '^[0-9]') THEN '{n}' WHEN i = 1 THEN s ELSE '{s}' END), '/')"
_SQL["js_templates"] = (
    ("urls",),
    f""" SELECT {_SHAPE} AS template, count(*) AS pages, CAST(2 * count(*) FILTER (WHERE id % 5 = 0) AS BIGINT) AS hidden_links, round(avg(id % 100), 4) AS raw_words, round(avg(id % 100 + 5), 4) AS rendered_words,
           count(*) FILTER (WHERE id % 5 = 0) = 0 AS graph_reliable FROM urls GROUP BY 1""",
)


def column_operators(spark, sf_dir):
    u = tables(spark, sf_dir, "urls")["urls"]
    return u.agg(*[F.count_if(explorer.compare("word_count", op, 200)).alias(name) for op, name in (("=", "eq"), (">=", "ge"), (">", "gt"), ("<=", "le"), ("<", "lt"))])


_SQL["column_operators"] = (("urls",), " SELECT count(*) FILTER (WHERE word_count = 200) AS eq, count(*) FILTER (WHERE word_count >= 200) AS ge, count(*) FILTER (WHERE word_count > 200) AS gt, count(*) FILTER (WHERE word_count <= 200) AS le, count(*) FILTER (WHERE word_count < 200) AS lt FROM urls")


def _jobs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    reason = F.when(F.col("o_orderkey") % 3 == 0, "max_urls_reached").when(F.col("o_orderkey") % 3 == 1, "finished")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("status"), (F.col("o_custkey") % 4).cast("string").alias("client_id"), (F.col("o_orderkey") % 50).alias("created_at"), reason.alias("finish_reason"))


_JOBS = "(SELECT o_orderkey AS id, o_orderpriority AS status, CAST(o_custkey % 4 AS VARCHAR) AS client_id, o_orderkey % 50 AS created_at, CASE o_orderkey % 3 WHEN 0 THEN 'max_urls_reached' WHEN 1 THEN 'finished' END AS finish_reason FROM orders) j"


def job_listing(spark, sf_dir):
    return explorer.jobs(_jobs(spark, sf_dir), "5-LOW", "2", 2, 20).select("id", "created_at")


_SQL["job_listing"] = ((), f"SELECT id, created_at FROM {_JOBS} WHERE status = '5-LOW' AND client_id = '2' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")


def job_completeness(spark, sf_dir):
    return explorer.completeness(_jobs(spark, sf_dir)).groupBy("finish_reason", "truncated").agg(F.count("*").alias("n"))


_SQL["job_completeness"] = ((), f"SELECT finish_reason, coalesce(finish_reason = 'max_urls_reached', FALSE) AS truncated, count(*) AS n FROM {_JOBS} GROUP BY 1, 2")


def pages_by_shape(spark, sf_dir):
    return explorer.select_pages(tables(spark, sf_dir, "urls")["urls"], url.shape("path"), "/s0/{s}/{n}", r"/p/\d*5$").select("id", "path")


_SQL["pages_by_shape"] = (("urls",), rf" SELECT id, path FROM urls WHERE is_html AND {_SHAPE} = '/s0/{{s}}/{{n}}' AND regexp_matches(url, '/p/\d*5$')")


def page_detail(spark, sf_dir):
    t = tables(spark, sf_dir, "urls", "html_meta", "headings")
    issues = rules.http_issues(t["urls"]).unionByName(rules.title_issues(t["urls"], t["html_meta"]))
    d = explorer.url_detail(t | {"issues": issues}, 87)
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), " ")
    return d.select("url_id", "url", "title", joined("headings", "tag").alias("tags"), joined("issues", "issue_type").alias("issues"))


_SQL["page_detail"] = (
    ("urls", "html_meta", "headings"),
    """ SELECT id AS url_id, url, title, (SELECT string_agg(tag, ' ' ORDER BY position) FROM headings h WHERE h.url_id = 87) AS tags, CASE WHEN status_group = '5xx' THEN '5xx_error' END AS issues
        FROM urls LEFT JOIN html_meta m ON m.url_id = id WHERE id = 87""",
)


def schema_types(spark, sf_dir):
    return scores.schema_types(checked(tables(spark, sf_dir, "structured_raw")["structured_raw"]))


_SQL["schema_types"] = (
    ("structured_raw",),
    """ SELECT schema_type, count(*) AS n FROM (SELECT unnest(CASE url_id % 7 WHEN 0 THEN ['Product'] WHEN 2 THEN ['WebPage'] WHEN 3 THEN ['Event'] WHEN 4 THEN ['Article'] ELSE [] END) AS schema_type
        FROM structured_raw) x GROUP BY 1 ORDER BY n DESC, schema_type LIMIT 10""",
)


def languages(spark, sf_dir):
    t = tables(spark, sf_dir, "urls", "hreflang")
    return scores.languages(t["hreflang"], t["urls"].where("is_internal"))


_SQL["languages"] = (("urls", "hreflang"), " SELECT lang, count(*) AS n FROM hreflang WHERE url_id IN (SELECT id FROM urls WHERE is_internal) GROUP BY 1")


def compact_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url.compact_key(F.sha2("url", 256)).cast("string").alias("key"))


_SQL["compact_keys"] = ((), "SELECT page_id, CAST(CAST('0x' || substr(sha256(url), 1, 16) AS UBIGINT) AS VARCHAR) AS key FROM pages")


def body_hashes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    return p.select("page_id", url.body_hash("html", kind, F.when(F.col("page_id") % 4 == 1, 404).otherwise(200)).alias("body_hash"))


_SQL["body_hashes"] = ((), "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 4 <> 1 THEN sha256(html) END AS body_hash FROM pages")


def header_canonicals(spark, sf_dir):
    u = tables(spark, sf_dir, "urls")["urls"]
    header = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" <"), "url", F.lit('> ; rel="canonical"'))).when(F.col("id") % 3 == 1, F.concat(F.lit("<"), "url", F.lit('>; rel="next"')))
    return u.select("id", url.header_canonical(header).alias("canonical"))


_SQL["header_canonicals"] = (("urls",), " SELECT id, CASE WHEN id % 3 = 0 THEN split_part(url, ';', 1) END AS canonical FROM urls")


def resource_gate(spark, sf_dir):
    u = tables(spark, sf_dir, "urls")["urls"]
    on = explorer.kept_resources(u).groupBy("resource_type").agg(F.count("*").alias("n")).withColumn("images", F.lit(True))
    off = explorer.kept_resources(u, {"crawl_images": False}).groupBy("resource_type").agg(F.count("*").alias("n")).withColumn("images", F.lit(False))
    return on.unionByName(off)


_SQL["resource_gate"] = (("urls",), " SELECT resource_type, count(*) AS n, TRUE AS images FROM urls GROUP BY 1 UNION ALL SELECT resource_type, count(*) AS n, FALSE FROM urls WHERE resource_type <> 'image' GROUP BY 1")


def excerpts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", cleaning.excerpt("text", 300).alias("excerpt"))


_SQL["excerpts"] = ((), "SELECT doc_id, CASE WHEN length(text) <= 300 THEN coalesce(text, '') ELSE substr(text, 1, 150) || chr(10) || '[...]' || chr(10) || right(text, 150) END AS excerpt FROM documents")


def ruleset_history(spark, sf_dir):
    h = _jobs(spark, sf_dir).withColumn("job_id", F.col("client_id"))
    return cleaning.rulesets(h, "1").select("id", "created_at")


_SQL["ruleset_history"] = ((), f"SELECT id, created_at FROM {_JOBS} WHERE client_id = '1'")


def duplicate_members(spark, sf_dir):
    """Membership of groups of pages with the same depth and status: some have over a hundred members."""
    u = tables(spark, sf_dir, "urls")["urls"]
    d = u.select("job_id", F.col("id").alias("url_id"), "url", F.concat_ws("-", "crawl_depth", "status_code").alias("k"))
    return rules.duplicate_groups(d, "k").select("key", "url_id", "n")


_SQL["duplicate_members"] = (("urls",), " , k AS (SELECT id AS url_id, url, concat_ws('-', crawl_depth, status_code) AS key FROM urls) SELECT key, url_id, count(*) OVER (PARTITION BY key) AS n FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1")


def large_duplicate_groups(spark, sf_dir):
    """Issues of large groups give their number of members, smaller ones list them too."""
    u = tables(spark, sf_dir, "urls")["urls"].withColumn("body_hash", F.when(F.col("id") % 2 == 0, "even").otherwise(F.concat(F.lit("b"), (F.col("id") % 30).cast("string"))))
    d = rules.duplicate_content_issues(u)
    n = F.get_json_object("details", "$.duplicates").cast("long")
    listed = F.size(F.from_json(F.get_json_object("details", "$.duplicate_urls"), "array<string>"))
    return d.groupBy(n.alias("duplicates"), F.coalesce(F.greatest(listed, F.lit(0)), F.lit(0)).alias("listed")).agg(F.count("*").alias("pages"))


_SQL["large_duplicate_groups"] = (
    ("urls",),
    """ , k AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'b' || CAST(id % 30 AS VARCHAR) END AS h FROM urls), g AS (SELECT h, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
    SELECT n - 1 AS duplicates, CASE WHEN n <= 100 THEN n - 1 ELSE 0 END AS listed, CAST(sum(n) AS BIGINT) AS pages FROM g GROUP BY 1, 2""",
)


def template_samples(spark, sf_dir):
    """The number of pages sampled of each of the largest templates, and whether they are the template's own."""
    u = tables(spark, sf_dir, "urls")["urls"]
    d = explorer.template_sample(u, 4, 3)
    own = d.join(u.select("url", explorer.templates(F.col("path")).alias("own")), "url")
    return own.groupBy("template", "pages").agg(F.countDistinct("url").alias("sampled"), F.count_if(F.col("own") != F.col("template")).alias("strangers"))


_SQL["template_samples"] = (
    ("urls",),
    """ , t AS (SELECT CASE WHEN regexp_matches(path, '(?i)^/[a-z]{2}/?$') THEN 'home' ELSE 'otras · ' || len(list_filter(string_split(path, '/'), lambda s: s <> '')) || ' niveles' END AS template, count(*) AS pages FROM urls GROUP BY 1)
    SELECT template, pages, least(pages, 4) AS sampled, 0 AS strangers FROM t ORDER BY pages DESC, template LIMIT 3""",
)


def tab_views(spark, sf_dir):
    """The number of rows and columns of every tab of the explorer."""
    t = tables(spark, sf_dir, "urls", "html_meta")
    u, m = conform(rules.with_indexable(t["urls"], t["html_meta"]), "urls"), t["html_meta"]
    views = {name: explorer.tab(u, m, name) for name in explorer.TABS}
    out = None
    for name, v in views.items():
        row = v.agg(F.count("*").alias("n"), F.count("url").alias("urls")).select(F.lit(name).alias("tab"), "n", "urls", F.lit(len(v.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


_WIDTHS = {"all": 16, "html": 16, "js": 6, "css": 6, "image": 5, "pdf": 5, "internal": 13, "external": 6, "2xx": 13, "3xx": 7, "4xx": 6, "5xx": 6, "indexable": 9, "noindex": 6}
_PRESET = {"all": "all", "html": "html", "js": "js", "css": "css", "image": "images", "pdf": "pdf", "internal": "internal", "external": "external", "2xx": "2xx", "3xx": "3xx", "4xx": "4xx", "5xx": "5xx", "indexable": "indexable", "noindex": "non_indexable"}
_ROWS = ", ".join(f"('{tab}', '{_PRESET[tab]}', {n})" for tab, n in _WIDTHS.items())


def any_of_issues(spark, sf_dir):
    t = tables(spark, sf_dir, "urls", "html_meta")
    issues = rules.http_issues(t["urls"]).unionByName(rules.title_issues(t["urls"], t["html_meta"]))
    return explorer.affected_by_any(issues, t["urls"], ["4xx_error", "title_missing", "5xx_error"], 30).select("id", "url")


_SQL["any_of_issues"] = (
    ("urls", "html_meta"),
    """ SELECT id, url FROM ((SELECT id, url FROM urls WHERE status_group = '4xx' ORDER BY id LIMIT 30) UNION (SELECT id, url FROM urls WHERE status_group = '5xx' ORDER BY id LIMIT 30)
          UNION (SELECT id, url FROM urls JOIN html_meta ON url_id = id WHERE is_html AND trim(coalesce(title, '')) = '' ORDER BY id LIMIT 30)) x""",
)


def latest_analyses(spark, sf_dir):
    a = _jobs(spark, sf_dir).withColumn("job_id", F.col("client_id"))
    return semantic.latest_analysis(a).select("job_id", "id", "created_at", "status")


_SQL["latest_analyses"] = ((), f"SELECT client_id AS job_id, id, created_at, status FROM {_JOBS} QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, id DESC) = 1")


def target_actions(spark, sf_dir):
    """What to reinforce and what to refocus for a target, over pages whose distances and weights are given."""
    v = tables(spark, sf_dir, "vectors")["vectors"].select("id", ((F.col("id") * 37) % 1001 / 1000).alias("distance_to_target"), ((F.col("id") * 53) % 997 / 1000).alias("weight"))
    near, heavy = F.col("distance_to_target") <= 0.5, F.col("weight") >= 0.4
    d = v.withColumn("action", F.when(near & ~heavy, "reinforce").when(~near & heavy, "refocus"))
    return semantic.action_lists(d, 10).select("id", "action")


_SQL["target_actions"] = (
    ("vectors",),
    """ , v AS (SELECT id, (id * 37) % 1001 / 1000 AS d, (id * 53) % 997 / 1000 AS w FROM vectors)
    (SELECT id, 'reinforce' AS action FROM v WHERE d <= 0.5 AND w < 0.4 ORDER BY d, id LIMIT 10) UNION ALL (SELECT id, 'refocus' FROM v WHERE d > 0.5 AND w >= 0.4 ORDER BY w DESC, id LIMIT 10)""",
)


def semantic_export(spark, sf_dir):
    """The export of a vector analysis with search metrics, as its file's columns."""
    t = tables(spark, sf_dir, "urls", "gsc")
    pages = t["urls"].select(F.col("id"), (F.col("id") % 4).alias("cluster_id"), F.lit("Core").alias("ring"), F.lit("core").alias("semantic_role"), (F.col("id") % 16 / 16).alias("distance_to_centroid"), *[F.lit(0.5).alias(c) for c in ("weight", "pr_norm", "clicks_norm", "x", "y")])
    return exports.semantic(pages, t["urls"], t["gsc"].withColumn("ctr", F.lit(0.25)).withColumn("position", F.lit(1.5)))


_SQL["semantic_export"] = (
    ("urls", "gsc"),
    """ SELECT url, CAST(id % 4 AS VARCHAR) AS cluster_id, 'Core' AS ring, 'core' AS semantic_role, CAST(id % 16 / 16 AS VARCHAR) AS distance_to_centroid, '0.5' AS weight, '0.5' AS pr_norm, '0.5' AS clicks_norm, '0.5' AS x, '0.5' AS y,
        CAST(clicks AS VARCHAR) AS clicks, CAST(impressions AS VARCHAR) AS impressions, CASE WHEN clicks IS NOT NULL THEN '0.25' END AS ctr, CASE WHEN clicks IS NOT NULL THEN '1.5' END AS position FROM urls LEFT JOIN gsc ON url_id = id""",
)


def pair_names(spark, sf_dir):
    """Pairs with the names, clicks and shared queries of both sides."""
    t = tables(spark, sf_dir, "urls", "gsc", "gsc_queries")
    found = t["urls"].where("id % 3 = 0").select(F.col("id").alias("id_dominant"), (F.col("id") + 1).alias("id_weak"), (F.col("id") % 7 / 8).alias("cosine"))
    d = semantic.pair_view(found, t["urls"], t["gsc"], t["gsc_queries"], ["click"])
    return d.select("url_dominant", "url_weak", "cosine", "dominant_clicks", F.round("weak_position", 4).alias("weak_position"), F.array_join("queries", "|").alias("queries"), "n_shared")


_SQL["pair_names"] = (
    ("urls", "gsc", "gsc_queries"),
    """ , f AS (SELECT id AS d, id + 1 AS w, id % 7 / 8 AS cosine FROM urls WHERE id % 3 = 0), q AS (SELECT DISTINCT url_id, lower(query) AS query FROM gsc_queries WHERE NOT contains(lower(query), 'click')),
    s AS (SELECT d, w, list_sort(list(a.query))[1:10] AS qs FROM f JOIN q a ON a.url_id = d JOIN q b ON b.url_id = w AND a.query = b.query GROUP BY 1, 2)
    SELECT ud.url AS url_dominant, uw.url AS url_weak, cosine, gd.clicks AS dominant_clicks, round(gw.position, 4) AS weak_position, coalesce(array_to_string(qs, '|'), '') AS queries, coalesce(len(qs), 0) AS n_shared
    FROM f LEFT JOIN urls ud ON ud.id = d LEFT JOIN urls uw ON uw.id = w LEFT JOIN gsc gd ON gd.url_id = d LEFT JOIN gsc gw ON gw.url_id = w LEFT JOIN s USING (d, w)""",
)

_NAMES = [n for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {n: with_views(sql, *views) if views else sql for n, (views, sql) in _SQL.items()}
ORACLES["tab_views"] = f"WITH p AS ({explore.ORACLES['explorer_presets']}) SELECT tab, n, n AS urls, columns FROM (VALUES {_ROWS}) v(tab, preset, columns) JOIN p USING (preset)"
