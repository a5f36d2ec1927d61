"""Ready-made diagnostic queries as SQL text over the crawl tables; the same text runs in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from crawlens.plans import audit
from crawlens.plans.views import _braces, tables, with_views

#: name -> (crawl tables and results of audit queries, SQL)
SQL = {
    "diag_url_overview": (
        ("urls", "html_meta"),
        """SELECT u.id, u.url, u.status_code, m.title, m.meta_robots, u.word_count FROM urls u LEFT JOIN html_meta m ON m.url_id = u.id WHERE u.is_internal ORDER BY u.word_count DESC NULLS LAST, u.id""",
    ),
    "diag_headings_by_tag": (("urls", "headings"), """SELECT h.tag, count(*) AS n, count(DISTINCT h.url_id) AS pages, count(*) FILTER (WHERE h.text IS NULL) AS without_text FROM headings h JOIN urls u ON u.id = h.url_id GROUP BY h.tag"""),
    "diag_link_graph": (
        ("urls", "links"),
        """SELECT s.url AS source, t.url AS target, count(*) AS n, count(*) FILTER (WHERE l.follow) AS followed FROM links l JOIN urls s ON s.id = l.from_url_id JOIN urls t ON t.url_hash = l.to_url_hash AND t.job_id = l.job_id GROUP BY s.url, t.url""",
    ),
    "diag_duplicate_hashes": (("urls",), """SELECT job_id, url, count(*) AS n FROM urls GROUP BY job_id, url HAVING count(*) > 1"""),
    "diag_links_without_source": (("urls", "links"), """SELECT count(*) AS orphans FROM links l WHERE NOT EXISTS (SELECT 1 FROM urls u WHERE u.id = l.from_url_id)"""),
    "diag_unresolved_targets": (
        ("urls", "links"),
        """SELECT count(*) AS links, count(DISTINCT l.to_url_hash) AS targets FROM links l LEFT JOIN urls u ON u.url_hash = l.to_url_hash WHERE u.id IS NULL AND l.is_internal""",
    ),
    "diag_status_matrix": (
        ("urls",),
        """SELECT crawl_depth, count(*) AS total, count(*) FILTER (WHERE status_group = '2xx') AS ok, count(*) FILTER (WHERE status_group = '3xx') AS redirects, count(*) FILTER (WHERE status_group IN ('4xx', '5xx')) AS errors, count(*) FILTER (WHERE status_code IS NULL) AS no_answer FROM urls GROUP BY crawl_depth""",
    ),
    "diag_flag_nulls": (
        ("urls",),
        """SELECT count(*) AS total, count(*) FILTER (WHERE in_sitemap IS TRUE) AS listed, count(*) FILTER (WHERE in_sitemap IS FALSE) AS unlisted, count(*) FILTER (WHERE in_sitemap IS NULL) AS unknown FROM urls""",
    ),
    "diag_position_mix": (("links",), """SELECT coalesce(link_position, 'unknown') AS position, count(*) AS n, round(CAST(100 * count(*) AS DOUBLE) / sum(count(*)) OVER (), 2) AS share FROM links GROUP BY coalesce(link_position, 'unknown')"""),
    "diag_images_alt": (
        ("resources",),
        """SELECT count(*) FILTER (WHERE alt_text IS NULL) AS absent, count(*) FILTER (WHERE alt_text = '') AS decorative, count(*) FILTER (WHERE alt_text <> '') AS described FROM resources WHERE resource_type = 'image'""",
    ),
    "diag_site_ctr": (("gsc",), """SELECT sum(clicks) AS clicks, sum(impressions) AS impressions, round(CAST(sum(clicks) AS DOUBLE) / nullif(sum(impressions), 0), 4) AS ctr, round(sum(position * impressions) / nullif(sum(impressions), 0), 2) AS position FROM gsc"""),
    "diag_top_queries": (
        ("gsc_queries",),
        """SELECT url_id, query, clicks FROM (SELECT url_id, query, clicks, row_number() OVER (PARTITION BY url_id ORDER BY clicks DESC, query) AS r FROM gsc_queries) t WHERE r <= 3""",
    ),
    "diag_title_repeats": (
        ("urls", "html_meta"),
        """SELECT lower(trim(m.title)) AS title, count(*) AS pages, min(u.url) AS sample FROM html_meta m JOIN urls u ON u.id = m.url_id WHERE trim(m.title) <> '' GROUP BY lower(trim(m.title)) HAVING count(*) > 1""",
    ),
    "diag_redirect_targets": (
        ("urls",),
        """SELECT t.status_group AS target_group, count(*) AS n FROM urls u LEFT JOIN urls t ON t.url = u.redirect_url WHERE u.redirect_url IS NOT NULL GROUP BY t.status_group""",
    ),
    "diag_full_page": (
        ("urls", "html_meta", "headings"),
        """SELECT u.id, u.url, m.title, h.n_headings, h.first_h1 FROM urls u LEFT JOIN html_meta m ON m.url_id = u.id LEFT JOIN (SELECT url_id, count(*) AS n_headings, min(CASE WHEN tag = 'h1' THEN text END) AS first_h1 FROM headings GROUP BY url_id) h ON h.url_id = u.id""",
    ),
    "diag_indexable_split": (("urls", "indexability"), """SELECT i.indexable, count(*) AS n FROM urls u JOIN indexability i ON i.id = u.id WHERE u.is_internal AND u.status_code = 200 AND u.is_html GROUP BY i.indexable"""),
    "diag_canonicalised": (
        ("urls", "html_meta", "indexability"),
        """SELECT u.id, u.url, m.canonical_href FROM urls u JOIN html_meta m ON m.url_id = u.id JOIN indexability i ON i.id = u.id WHERE i.indexability_status = 'Canonicalised' ORDER BY u.id LIMIT 20""",
    ),
    "diag_not_indexable_share": (
        ("urls", "indexability"),
        """SELECT count(*) FILTER (WHERE NOT i.indexable) AS not_indexable, count(*) AS total FROM urls u JOIN indexability i ON i.id = u.id WHERE u.is_internal AND u.status_code = 200 AND u.is_html""",
    ),
    "diag_more_links_than_pages": (("link_counts",), """SELECT count(*) FILTER (WHERE inlinks_count > unique_inlinks_count) AS more, count(*) FILTER (WHERE inlinks_count < unique_inlinks_count) AS fewer, count(*) AS total FROM link_counts"""),
    "diag_inlinks_differ": (
        ("urls", "link_counts"),
        """SELECT count(*) FILTER (WHERE c.inlinks_count <> c.unique_inlinks_count) AS differ, count(*) AS total FROM urls u JOIN link_counts c ON c.id = u.id WHERE u.is_internal""",
    ),
    "diag_timing": (
        ("urls",),
        """SELECT count(*) FILTER (WHERE response_time_ms > 0) AS timed, count(*) FILTER (WHERE response_time_ms = 0) AS zero, count(*) FILTER (WHERE response_time_ms IS NULL) AS unknown FROM urls WHERE is_html AND status_code = 200""",
    ),
    "diag_links_of_page": (("urls", "links"), """SELECT u.url, count(*) AS n FROM links l JOIN urls u ON u.id = l.from_url_id WHERE u.id = 10 GROUP BY u.url"""),
    "diag_malformed_links": (("links",), """SELECT id, to_url FROM links WHERE to_url NOT LIKE 'http%' ORDER BY id LIMIT 20"""),
    "diag_orphans": (
        ("urls", "link_issues"),
        """SELECT u.id, u.url, u.crawl_depth, u.status_code FROM link_issues i JOIN urls u ON u.id = i.url_id WHERE i.issue_type = 'orphan_page' ORDER BY u.id LIMIT 20""",
    ),
    "diag_false_orphans": (
        ("urls", "link_issues"),
        """SELECT count(*) AS n FROM link_issues i JOIN urls u ON u.id = i.url_id WHERE i.issue_type = 'orphan_page' AND (u.crawl_depth = 0 OR u.status_code <> 200)""",
    ),
    "diag_low_words_status": (
        ("urls", "content_issues"),
        """SELECT u.status_code, count(*) AS n FROM content_issues i JOIN urls u ON u.id = i.url_id WHERE i.issue_type = 'low_word_count' GROUP BY u.status_code""",
    ),
    "diag_title_duplicate_status": (
        ("urls", "title_issues"),
        """SELECT u.status_code, count(*) AS n FROM title_issues i JOIN urls u ON u.id = i.url_id WHERE i.issue_type = 'title_duplicate' GROUP BY u.status_code""",
    ),
    "diag_structured_data_status": (("structured_data_issues",), """SELECT issue_type, severity, count(*) AS n, count(DISTINCT url_id) AS pages FROM structured_data_issues GROUP BY issue_type, severity"""),
    "diag_hreflang_by_page": (
        ("urls", "hreflang", "hreflang_issues"),
        """SELECT h.lang, count(*) AS n, count(i.url_id) AS with_issue FROM hreflang h JOIN urls u ON u.id = h.url_id LEFT JOIN (SELECT DISTINCT url_id FROM hreflang_issues) i ON i.url_id = h.url_id GROUP BY h.lang""",
    ),
    "diag_nofollow_pages": (
        ("urls", "links", "html_meta"),
        """SELECT l.follow, count(*) AS n FROM links l JOIN urls u ON u.id = l.from_url_id JOIN html_meta m ON m.url_id = u.id WHERE lower(m.meta_robots) LIKE '%nofollow%' OR lower(m.meta_robots) = 'none' GROUP BY l.follow""",
    ),
    "diag_sitemap_issues": (
        ("urls", "sitemap_issues", "link_counts"),
        """SELECT i.issue_type, u.status_code, c.inlinks_count, count(*) AS n FROM sitemap_issues i JOIN urls u ON u.id = i.url_id JOIN link_counts c ON c.id = u.id GROUP BY i.issue_type, u.status_code, c.inlinks_count""",
    ),
    "diag_relative_canonicals": (
        ("urls", "html_meta"),
        """SELECT count(*) FILTER (WHERE m.canonical_href IS NOT NULL AND m.canonical_href NOT LIKE 'http%') AS relative, count(*) FILTER (WHERE m.canonical_href IS NOT NULL) AS total FROM html_meta m JOIN urls u ON u.id = m.url_id""",
    ),
    "diag_issues_by_severity": (("title_issues",), """SELECT severity, issue_type, count(*) AS n FROM title_issues GROUP BY severity, issue_type"""),
    "diag_best_pagerank": (
        ("urls", "pagerank", "link_counts"),
        """SELECT u.id, u.url, p.pagerank, c.inlinks_count, c.unique_inlinks_count, u.word_count FROM urls u JOIN pagerank p ON p.id = u.id JOIN link_counts c ON c.id = u.id WHERE u.is_html AND u.status_code = 200 ORDER BY p.pagerank DESC, u.id LIMIT 50""",
    ),
    "diag_internal_graph": (("urls", "links"), """SELECT s.url AS from_url, l.to_url, l.link_position, l.follow FROM links l JOIN urls s ON s.id = l.from_url_id WHERE l.is_internal"""),
    "diag_headings_of_page": (("urls", "headings"), """SELECT h.tag, h.position, h.text FROM headings h JOIN urls u ON u.id = h.url_id WHERE u.id = 20"""),
    "diag_structured_rows": (("urls", "structured_raw"), """SELECT u.url, s.raw FROM structured_raw s JOIN urls u ON u.id = s.url_id WHERE u.is_internal"""),
}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names, sql = SQL[name]
    t = tables(spark, sf_dir, *[n for n in names if n not in audit.QUERIES])
    t |= {n: audit.QUERIES[n](spark, sf_dir) for n in names if n in audit.QUERIES}
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(_braces(sql, names), **t)


def _oracle(names: tuple[str, ...], sql: str) -> str:
    """The SQL after its tables, and after the SQL of the audit queries that it reads."""
    made = [n for n in names if n in audit.QUERIES]
    results = ", ".join(f"{n} AS ({audit.ORACLES[n]})" for n in made)
    if len(made) == len(names):
        return f"WITH {results} {sql}"
    whole = with_views(" " + sql, *[n for n in names if n not in made])
    return whole.replace("WITH RECURSIVE ", f"WITH RECURSIVE {results}, ", 1) if made else whole


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, name)

    query.__name__ = name
    return query


QUERIES = {n: _query(n) for n in SQL}
ORACLES = {n: _oracle(names, sql) for n, (names, sql) in SQL.items()}
