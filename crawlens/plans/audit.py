"""Queries over the audit rules and the link graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.functions.structured import checked
from crawlens.operators import graph, rules
from crawlens.plans.views import tables, with_views

_ISSUE = ["url_id", "issue_type", "severity", "details"]


def _t(spark, sf_dir, *names):
    return tables(spark, sf_dir, *names)


def http_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.http_issues(_t(spark, sf_dir, "urls")["urls"]).select(_ISSUE)


def title_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "html_meta")
    return rules.title_issues(t["urls"], t["html_meta"]).select(_ISSUE)


def description_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "html_meta")
    return rules.description_issues(t["urls"], t["html_meta"]).select("url_id", "issue_type", "severity")


def h1_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "headings")
    return rules.h1_issues(t["urls"], t["headings"]).select(_ISSUE)


def canonical_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "html_meta")
    return rules.canonical_issues(t["urls"], t["html_meta"]).select("url_id", "issue_type", "severity")


def hreflang_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "hreflang")
    return rules.hreflang_issues(t["urls"], t["hreflang"]).select("url_id", "issue_type", "severity")


def structured_data_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "structured_raw")
    sd = checked(t["structured_raw"]).withColumn("job_id", F.lit("j1"))
    return rules.structured_data_issues(sd).select("url_id", "issue_type", "severity", F.get_json_object("details", "$.validation_issues").alias("problems"))


def indexability(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "html_meta")
    d = rules.with_indexable(t["urls"], t["html_meta"]).join(t["html_meta"].withColumnRenamed("url_id", "id"), "id", "left")
    reason = graph.indexability_status(F.col("status_code"), F.col("meta_robots"), F.col("x_robots_tag"), F.col("canonical_href"), F.col("url"))
    return d.select("id", "indexable", reason.alias("indexability_status"), rules.noindex().alias("says_noindex"))


def duplicate_content(spark, sf_dir):
    return rules.duplicate_content_issues(_t(spark, sf_dir, "urls")["urls"]).select(_ISSUE)


def redirect_chains(spark, sf_dir):
    return graph.redirect_chains(_t(spark, sf_dir, "urls")["urls"]).select("url_id", "hops", "loops", F.array_join("chain", " ").alias("chain"))


def redirect_issues(spark, sf_dir):
    return rules.redirect_issues(_t(spark, sf_dir, "urls")["urls"]).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


def image_alt_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "resources")
    return rules.image_issues(t["urls"], t["resources"]).select(_ISSUE)


def security_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "security_headers")
    return rules.security_issues(t["urls"], t["security_headers"]).select("url_id", "issue_type", "severity")


def content_issues(spark, sf_dir):
    return rules.content_issues(_t(spark, sf_dir, "urls")["urls"]).select("url_id", "issue_type", "severity")


def url_issues(spark, sf_dir):
    return rules.url_issues(_t(spark, sf_dir, "urls")["urls"]).select("url_id", "issue_type", "severity")


def link_counts(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "links")
    return graph.link_counts(t["urls"], t["links"]).select("id", "inlinks_count", "unique_inlinks_count", "outlinks_count", "external_outlinks_count")


def link_issues(spark, sf_dir):
    from crawlens.config import Thresholds

    t = _t(spark, sf_dir, "urls", "links")
    return rules.link_issues(graph.link_counts(t["urls"], t["links"]), Thresholds(max_outlinks=12)).select("url_id", "issue_type", "severity")


def sitemap_issues(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "html_meta", "links")
    counted = graph.link_counts(rules.with_indexable(t["urls"], t["html_meta"]), t["links"])
    return rules.sitemap_issues(counted).select("url_id", "issue_type", "severity")


def sitemap_membership(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "links")
    listed = t["urls"].where("status_code = 200").select("job_id", "url_hash")
    whole = spark.createDataFrame([("j1", True)], "job_id string, complete boolean")
    return graph.sitemap_membership(t["urls"], listed, whole).select("id", "in_sitemap")


def frontier(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "links")
    return graph.frontier(t["links"], t["urls"].where("status_code < 500")).select("to_url_hash", "to_url", "link_id")


def pagerank(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "links")
    return graph.pagerank(t["urls"], t["links"], rounds=5, tolerance=0.0).select("id", F.round("pagerank", 3).alias("pagerank"))


def crawl_depth(spark, sf_dir):
    t = _t(spark, sf_dir, "urls", "links")
    return graph.crawl_depth(t["urls"], t["links"], t["urls"].where("id = 1").select("job_id", "id")).select("id", "depth")


def _all_tables(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t | {"structured_data": checked(t["structured_raw"]).withColumn("job_id", F.lit("j1"))}


def issues_union_counts(spark, sf_dir):
    """All 49 rules over the crawl, counted by type and severity."""
    return rules.run_all(_all_tables(spark, sf_dir)).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


_STRIP = "trim(%s, ' ' || chr(9) || chr(10) || chr(13))"
_SQL = {}
_SQL["http_issues"] = (
    ("urls",),
    """
    SELECT id AS url_id, CASE WHEN status_group = '4xx' THEN '4xx_error' WHEN status_group = '5xx' THEN '5xx_error' ELSE 'connection_error' END AS issue_type, 'error' AS severity,
           CASE WHEN status_code IS NULL THEN '{"error_type":"timeout"}' ELSE '{"status_code":' || status_code || '}' END AS details
    FROM urls WHERE status_group IN ('4xx', '5xx', 'timeout')""",
)


def _text_sql(col: str, length: str, name: str, lo: int, hi: int) -> str:
    return f"""
    , d AS (SELECT u.*, m.*, coalesce({_STRIP % col}, '') AS t FROM urls u JOIN html_meta m ON u.id = m.url_id WHERE is_html),
    k AS (SELECT lower(t) AS k, list_sort(list(DISTINCT url)) AS urls FROM d WHERE t <> '' AND status_code = 200 AND is_internal GROUP BY 1 HAVING count(*) > 1)
    SELECT url_id, '{name}_missing' AS issue_type, 'warning' AS severity, NULL AS details FROM d WHERE t = ''
    UNION ALL SELECT url_id, '{name}_too_short', 'warning', '{{"length":' || coalesce({length}, length(t)) || ',"min":{lo}}}' FROM d WHERE t <> '' AND coalesce({length}, length(t)) < {lo}
    UNION ALL SELECT url_id, '{name}_too_long', 'warning', '{{"length":' || coalesce({length}, length(t)) || ',"max":{hi}}}' FROM d WHERE t <> '' AND coalesce({length}, length(t)) > {hi}
    UNION ALL SELECT url_id, '{name}_duplicate', 'warning', CASE WHEN len(urls) <= 100 THEN CAST(to_json({{duplicates: len(urls) - 1, duplicate_urls: list_filter(urls, lambda x: x <> url)}}) AS VARCHAR) ELSE '{{"duplicates":' || (len(urls) - 1) || '}}' END
    FROM d JOIN k ON lower(t) = k.k WHERE t <> '' AND status_code = 200 AND is_internal"""


_SQL["title_issues"] = (("urls", "html_meta"), _text_sql("title", "title_len", "title", 10, 60))
_SQL["description_issues"] = (("urls", "html_meta"), f", x AS (WITH {_text_sql('meta_description', 'meta_description_len', 'description', 50, 160).strip().lstrip(',')}) SELECT url_id, issue_type, severity FROM x")
_SQL["h1_issues"] = (
    ("urls", "headings"),
    f"""
    , h AS (SELECT u.id AS url_id, url, text FROM urls u JOIN headings x ON x.url_id = u.id WHERE is_html AND tag = 'h1'),
    p AS (SELECT DISTINCT url_id, url, lower({_STRIP % "text"}) AS k FROM h WHERE {_STRIP % "text"} <> ''),
    g AS (SELECT k, list_sort(list(url)) AS urls FROM p GROUP BY k HAVING count(*) > 1)
    SELECT id AS url_id, 'h1_missing' AS issue_type, 'warning' AS severity, NULL AS details FROM urls WHERE is_html AND id NOT IN (SELECT url_id FROM h)
    UNION ALL SELECT url_id, 'h1_multiple', 'warning', '{{"count":' || count(*) || '}}' FROM h GROUP BY url_id HAVING count(*) > 1
    UNION ALL SELECT url_id, 'h1_duplicate', 'info', CASE WHEN len(urls) <= 100 THEN CAST(to_json({{duplicates: len(urls) - 1, duplicate_urls: list_filter(urls, lambda x: x <> url)}}) AS VARCHAR) ELSE '{{"duplicates":' || (len(urls) - 1) || '}}' END FROM p JOIN g USING (k)""",
)
_NORM = "regexp_replace(%s, '#.*$', '')"
_HOST = "regexp_extract(%s, '^https://([^/]*)', 1)"
_SQL["canonical_issues"] = (
    ("urls", "html_meta"),
    f"""
    , d AS (SELECT m.url_id, url, trim(canonical_href) AS c, canonical_href, {_NORM % 'canonical_href'} AS nc FROM urls u JOIN html_meta m ON u.id = m.url_id WHERE is_html),
    e AS (SELECT d.*, t.status_code AS s FROM d LEFT JOIN urls t ON t.url = d.nc)
    SELECT url_id, 'canonical_missing' AS issue_type, 'info' AS severity FROM d WHERE coalesce(c, '') = ''
    UNION ALL SELECT url_id, 'canonical_cross_domain', 'info' FROM d WHERE c <> '' AND nc <> url AND {_HOST % 'nc'} <> {_HOST % 'url'}
    UNION ALL SELECT url_id, 'canonical_broken', 'error' FROM e WHERE c <> '' AND nc <> url AND s <> 200""",
)
_SQL["hreflang_issues"] = (
    ("urls", "hreflang"),
    """
    , h AS (SELECT h.url_id, h.lang, h.href, t.id AS tid, t.status_code AS s, EXISTS (SELECT 1 FROM hreflang b WHERE b.url_id = t.id AND b.href = p.url) AS back
            FROM hreflang h JOIN urls p ON p.id = h.url_id LEFT JOIN urls t ON t.url = h.href)
    SELECT url_id, 'hreflang_missing_return' AS issue_type, 'warning' AS severity FROM h WHERE lang <> 'x-default' AND tid IS NOT NULL AND tid <> url_id AND NOT back
    UNION ALL SELECT url_id, 'hreflang_invalid_lang', 'warning' FROM h WHERE NOT regexp_matches(lang, '^(x-default|[a-zA-Z]{2,3}(-[a-zA-Z0-9]{1,8})*)$')
    UNION ALL SELECT url_id, 'hreflang_broken_target', 'error' FROM h WHERE s <> 200""",
)
_SQL["structured_data_issues"] = (
    ("urls", "structured_raw"),
    """
    SELECT url_id, CASE WHEN raw LIKE '{"name%' THEN 'structured_data_error' ELSE 'structured_data_warning' END AS issue_type, CASE WHEN raw LIKE '{"name%' THEN 'error' ELSE 'warning' END AS severity,
           CASE url_id % 7 WHEN 0 THEN '["Product: missing required property ''name''"]' WHEN 1 THEN '["missing @type"]' WHEN 3 THEN '["Event: missing required property ''startdate''"]' WHEN 5 THEN '["Recipe: missing required property ''name''"]' END AS problems
    FROM structured_raw WHERE url_id % 7 IN (0, 1, 3, 5)""",
)
_SQL["indexability"] = (
    ("urls", "html_meta"),
    f"""
    , d AS (SELECT u.*, m.url_id AS mid, lower(meta_robots) AS r, lower(x_robots_tag) AS x, trim(canonical_href) AS c, {_NORM % 'canonical_href'} AS nc FROM urls u LEFT JOIN html_meta m ON u.id = m.url_id)
    SELECT id, CASE WHEN is_html AND mid IS NOT NULL THEN coalesce(status_code = 200, FALSE) AND NOT coalesce(r LIKE '%noindex%' OR FALSE, FALSE) AND NOT coalesce(x LIKE '%noindex%', FALSE) AND (coalesce(c, '') = '' OR nc = url) END AS indexable,
           CASE WHEN status_code >= 500 THEN '5xx Server Error' WHEN status_code >= 400 THEN '4xx Client Error' WHEN status_code >= 300 THEN '3xx Redirect'
                WHEN r IN ('noindex, follow', 'none') OR x = 'noindex' THEN 'Noindex' WHEN nc <> url THEN 'Canonicalised' ELSE 'Indexable' END AS indexability_status,
           coalesce(r LIKE '%noindex%', FALSE) OR coalesce(x LIKE '%noindex%', FALSE) AS says_noindex
    FROM d""",
)
_SQL["duplicate_content"] = (
    ("urls",),
    """
    , g AS (SELECT body_hash, list_sort(list(DISTINCT url)) AS urls FROM urls WHERE body_hash <> '' GROUP BY 1 HAVING count(*) > 1)
    SELECT id AS url_id, 'duplicate_content' AS issue_type, 'warning' AS severity,
           CASE WHEN len(urls) <= 100 THEN CAST(to_json({body_hash: body_hash, duplicates: len(urls) - 1, duplicate_urls: list_filter(urls, lambda x: x <> url)}) AS VARCHAR) ELSE '{"body_hash":"' || body_hash || '","duplicates":' || (len(urls) - 1) || '}' END AS details
    FROM urls JOIN g USING (body_hash)""",
)
_WALK = """
    , w AS (SELECT id AS url_id, [url, redirect_url] AS chain, url = redirect_url AS loops FROM urls WHERE redirect_url IS NOT NULL
            UNION ALL SELECT w.url_id, list_append(chain, u.redirect_url), list_contains(chain, u.redirect_url) FROM w JOIN urls u ON u.url = chain[-1] WHERE NOT loops AND u.redirect_url IS NOT NULL),
    z AS (SELECT url_id, arg_max(chain, len(chain)) AS chain, arg_max(loops, len(chain)) AS loops FROM w GROUP BY url_id)"""
_SQL["redirect_chains"] = (("urls",), f"{_WALK} SELECT url_id, len(chain) - 1 AS hops, loops, array_to_string(chain, ' ') AS chain FROM z")
_SQL["redirect_issues"] = (("urls",), f"{_WALK} SELECT CASE WHEN loops THEN 'redirect_loop' ELSE 'redirect_chain' END AS issue_type, CASE WHEN loops THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM z WHERE loops OR len(chain) > 3 GROUP BY 1, 2")
_SQL["image_alt_issues"] = (("urls", "resources"), """ SELECT url_id, 'image_missing_alt' AS issue_type, 'warning' AS severity, '{"image_url":"' || resource_url || '"}' AS details FROM resources r JOIN urls u ON u.id = r.url_id WHERE r.resource_type = 'image' AND alt_text IS NULL""")
_SQL["security_issues"] = (
    ("urls", "security_headers"),
    " UNION ALL ".join(
        f"SELECT url_id, '{kind}' AS issue_type, '{sev}' AS severity FROM security_headers WHERE {cond}"
        for kind, sev, cond in (("http_url", "warning", "is_https = FALSE"), ("missing_hsts", "info", "has_hsts = FALSE"), ("missing_csp", "info", "has_csp = FALSE"), ("missing_x_content_type_options", "info", "has_x_content_type_options = FALSE"), ("missing_x_frame_options", "info", "has_x_frame_options = FALSE"), ("mixed_content", "warning", "has_mixed_content"), ("unsafe_crossorigin", "warning", "has_unsafe_crossorigin"))
    ),
)
_SQL["content_issues"] = (
    ("urls",),
    """
    , d AS (SELECT * FROM urls WHERE is_html AND is_internal AND status_code = 200)
    SELECT id AS url_id, 'low_word_count' AS issue_type, 'warning' AS severity FROM d WHERE word_count < 200
    UNION ALL SELECT id, 'very_low_text_ratio', 'warning' FROM d WHERE text_ratio < 5
    UNION ALL SELECT id, 'low_text_ratio', 'info' FROM d WHERE text_ratio >= 5 AND text_ratio < 10""",
)
_SQL["url_issues"] = (
    ("urls",),
    " UNION ALL ".join(
        f"SELECT id AS url_id, '{kind}' AS issue_type, '{sev}' AS severity FROM urls WHERE {cond}"
        for kind, sev, cond in (
            ("url_too_long", "warning", "length(url) > 115"), ("url_non_ascii", "warning", r"regexp_matches(url, '[^\x00-\x7F]')"), ("url_uppercase", "info", "path <> lower(path)"), ("url_underscores", "info", "contains(path, '_')"),
            ("url_multiple_slashes", "warning", "regexp_matches(path, '(^|[^:])//')"), ("url_has_parameters", "info", "contains(url, '?')"), ("url_non_seo_friendly", "error", "regexp_matches(url, '(?i);jsessionid=|%5Cu[0-9]{4}|%00')"),
            ("url_cms_faceted", "warning", "regexp_matches(url, '(?i)[.;|](categorias|categories|tags|labels|filters?|facets?|taxonomy)/|/ELEM_ENTRY|/BP_Categories/')"),
        )
    ),
)
_COUNTS = """
    , i AS (SELECT to_url_hash, count(*) AS n, count(DISTINCT from_url_id) AS u FROM links GROUP BY 1),
    o AS (SELECT from_url_id, count(*) FILTER (WHERE is_internal) AS n, count(*) FILTER (WHERE NOT is_internal) AS x FROM links GROUP BY 1),
    c AS (SELECT urls.*, coalesce(i.n, 0) AS inlinks_count, coalesce(i.u, 0) AS unique_inlinks_count, coalesce(o.n, 0) AS outlinks_count, coalesce(o.x, 0) AS external_outlinks_count
          FROM urls LEFT JOIN i ON i.to_url_hash = urls.url_hash LEFT JOIN o ON o.from_url_id = urls.id)"""
_SQL["link_counts"] = (("urls", "links"), f"{_COUNTS} SELECT id, inlinks_count, unique_inlinks_count, outlinks_count, external_outlinks_count FROM c")
_SQL["link_issues"] = (
    ("urls", "links"),
    f"""{_COUNTS} SELECT id AS url_id, 'orphan_page' AS issue_type, 'warning' AS severity FROM c WHERE is_html AND is_internal AND status_code = 200 AND (crawl_depth IS NULL OR crawl_depth > 0) AND inlinks_count = 0
    UNION ALL SELECT id, 'high_outlink_count', 'info' FROM c WHERE outlinks_count > 12""",
)
_SQL["sitemap_issues"] = (
    ("urls", "html_meta", "links"),
    f"""{_COUNTS}, m AS (SELECT url_id, NOT (coalesce(lower(meta_robots), '') LIKE '%noindex%' OR coalesce(lower(x_robots_tag), '') LIKE '%noindex%') AS ok, trim(canonical_href) AS cc, {_NORM % 'canonical_href'} AS nc FROM html_meta)
    SELECT id AS url_id, 'sitemap_orphan' AS issue_type, 'warning' AS severity FROM c WHERE in_sitemap AND is_html AND status_code = 200 AND (crawl_depth IS NULL OR crawl_depth <> 0) AND inlinks_count = 0
    UNION ALL SELECT id, 'not_in_sitemap', 'info' FROM c JOIN m ON m.url_id = c.id WHERE in_sitemap = FALSE AND is_html AND is_internal AND status_code = 200 AND ok AND (coalesce(cc, '') = '' OR nc = url)""",
)
_SQL["sitemap_membership"] = (("urls",), " SELECT id, coalesce(status_code = 200, FALSE) AS in_sitemap FROM urls")
_SQL["frontier"] = (("urls", "links"), " SELECT to_url_hash, arg_min(to_url, id) AS to_url, min(id) AS link_id FROM links WHERE is_internal AND to_url_hash NOT IN (SELECT url_hash FROM urls WHERE status_code < 500) GROUP BY 1")
_RANKS = ", ".join(
    f"""r{k} AS (SELECT n.id, 0.15 / c.n + 0.85 * (coalesce(g.s, 0) + l.l / c.n) AS r FROM n CROSS JOIN c
        CROSS JOIN (SELECT coalesce(sum(r), 0) AS l FROM r{k - 1} WHERE id NOT IN (SELECT src FROM e)) l
        LEFT JOIN (SELECT dst, sum(r * p) AS s FROM e JOIN r{k - 1} ON id = src GROUP BY dst) g ON g.dst = n.id)"""
    for k in range(1, 6)
)
_SQL["pagerank"] = (
    ("urls", "links"),
    f"""
    , n AS (SELECT id, url_hash FROM urls WHERE is_internal), c AS (SELECT count(*) AS n FROM n),
    e0 AS (SELECT a.id AS src, b.id AS dst, max(CASE link_position WHEN 'content' THEN 1.0::DOUBLE WHEN 'nav' THEN 0.25 WHEN 'header' THEN 0.25 WHEN 'footer' THEN 0.15 ELSE 0.3 END) AS w
           FROM links l JOIN n a ON a.id = l.from_url_id JOIN n b ON b.url_hash = l.to_url_hash WHERE is_internal AND follow AND a.id <> b.id GROUP BY 1, 2),
    e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e0), r0 AS (SELECT id, 1.0::DOUBLE / c.n AS r FROM n CROSS JOIN c), {_RANKS}
    SELECT id, round(round(r / (SELECT max(r) FROM r5) * 10, 4), 3) AS pagerank FROM r5""",
)
_SQL["crawl_depth"] = (
    ("urls", "links"),
    """
    , e AS (SELECT DISTINCT l.from_url_id AS a, u.id AS b FROM links l JOIN urls u ON u.url_hash = l.to_url_hash),
    d AS (SELECT id, 0 AS depth FROM urls WHERE id = 1 UNION SELECT e.b, d.depth + 1 FROM d JOIN e ON e.a = d.id WHERE d.depth < 14)
    SELECT id, min(depth) AS depth FROM d GROUP BY id""",
)

QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n in {*_SQL, "issues_union_counts"}}
ORACLES = {n: with_views(sql, *views) for n, (views, sql) in _SQL.items()}


def _union_sql() -> str:
    """Counts by type of the oracles above, each over its own crawl tables."""
    parts = []
    for name in ("http_issues", "title_issues", "description_issues", "h1_issues", "canonical_issues", "hreflang_issues", "structured_data_issues", "duplicate_content", "image_alt_issues", "security_issues", "content_issues", "url_issues", "sitemap_issues"):
        parts.append(f"SELECT issue_type, severity, count(*) AS n FROM ({ORACLES[name]}) GROUP BY 1, 2")
    links = ORACLES["link_issues"].replace("> 12", "> 100")
    parts.append(f"SELECT issue_type, severity, count(*) AS n FROM ({links}) GROUP BY 1, 2")
    parts.append(f"SELECT * FROM ({ORACLES['redirect_issues']})")
    noindex = with_views(" SELECT m.url_id FROM urls u JOIN html_meta m ON u.id = m.url_id WHERE is_html AND (lower(meta_robots) LIKE '%noindex%' OR lower(x_robots_tag) LIKE '%noindex%')", "urls", "html_meta")
    parts.append(f"SELECT 'noindex_page' AS issue_type, 'info' AS severity, count(*) AS n FROM ({noindex})")
    return "SELECT issue_type, severity, n FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


ORACLES["issues_union_counts"] = _union_sql()
