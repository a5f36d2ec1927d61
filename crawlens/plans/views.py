"""A crawl projected from the test tables: the same SQL makes the crawl tables in Spark and in the oracle."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "orders", "lineitem", "part", "documents", "embeddings", "events", "pages", "conversations")


def url_of(c: str) -> str:
    """The URL of page number c, as SQL; pages of all kinds occur."""
    return (
        f"('https://' || CASE WHEN {c} % 11 = 10 THEN 'ext' || CAST({c} % 3 AS STRING) || '.org' ELSE 'www.e.com' END || {path_of(c)}"
        f" || CASE WHEN {c} % 14 = 3 THEN '?x=1' WHEN {c} % 14 = 5 THEN ';jsessionid=1' WHEN {c} % 28 = 9 THEN '%00' ELSE '' END"
        f" || CASE WHEN {c} % 37 = 5 THEN repeat('x', 110) ELSE '' END)"
    )


def path_of(c: str) -> str:
    kinds = ["/A/Page", "/a_b/c", "/x//y", "/p;filters/z", "/x/ELEM_ENTRY", "/café", "/es/2020-x/7"]
    cases = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    return f"(CASE {c} % 12 {cases} ELSE '/s' || CAST({c} % 5 AS STRING) || '/p' END || '/' || CAST({c} AS STRING))"


VIEWS = {
    "urls": f"""
        SELECT c.*, CASE WHEN status_code IS NULL THEN 'timeout' WHEN status_code < 300 THEN '2xx' WHEN status_code < 400 THEN '3xx'
                         WHEN status_code < 500 THEN '4xx' ELSE '5xx' END AS status_group,
               CASE WHEN c_redirect IS NULL THEN NULL ELSE {url_of('c_redirect')} END AS redirect_url
        FROM (SELECT 'j1' AS job_id, c_custkey AS id, {url_of('c_custkey')} AS url, 'h' || CAST(c_custkey AS STRING) AS url_hash, {path_of('c_custkey')} AS path,
                     CASE WHEN c_custkey % 11 = 10 THEN 'ext' || CAST(c_custkey % 3 AS STRING) || '.org' ELSE 'www.e.com' END AS host,
                     c_custkey % 11 <> 10 AS is_internal, c_custkey % 9 <> 8 AS is_html,
                     CASE WHEN c_custkey % 17 = 16 THEN NULL ELSE CAST(c_custkey % 5 AS INT) END AS crawl_depth,
                     CASE c_custkey % 20 WHEN 3 THEN 404 WHEN 7 THEN 500 WHEN 11 THEN NULL WHEN 13 THEN 301 WHEN 17 THEN 410 ELSE 200 END AS status_code,
                     CASE WHEN c_custkey % 9 <> 8 THEN 'html' WHEN c_custkey % 2 = 0 THEN 'image' ELSE 'pdf' END AS resource_type,
                     CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST((c_custkey * 37) % 600 AS INT) END AS word_count,
                     CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST((c_custkey * 13) % 400 AS DOUBLE) / 16 END AS text_ratio,
                     CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'b' || CAST((c_custkey * 7) % 911 AS STRING) END AS body_hash,
                     CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS in_sitemap,
                     CASE WHEN c_custkey % 25 = 24 THEN NULL ELSE CAST((c_custkey * 29) % 900 AS DOUBLE) END AS response_time_ms,
                     CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 WHEN c_custkey % 5 <> 0 THEN c_custkey + 1 ELSE NULL END AS c_redirect
              FROM customer) c""",
    "html_meta": f"""
        SELECT c_custkey AS url_id,
               CASE c_custkey % 15 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Short' WHEN 3 THEN repeat('long title ', 8)
                    WHEN 4 THEN ' Home Page ' || CAST(c_custkey % 40 AS STRING) || ' ' WHEN 5 THEN 'HOME PAGE ' || CAST(c_custkey % 40 AS STRING)
                    ELSE 'A good page title ' || CAST(c_custkey AS STRING) END AS title,
               CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 15 = 2 THEN 5 WHEN c_custkey % 15 = 3 THEN 88 ELSE NULL END AS title_len,
               CASE c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'tiny' WHEN 2 THEN repeat('very long description ', 9) WHEN 3 THEN repeat('same words here ', 5)
                    ELSE 'A description that is long enough to pass the lower bound, number ' || CAST(c_custkey AS STRING) END AS meta_description,
               CAST(NULL AS INT) AS meta_description_len,
               CASE c_custkey % 16 WHEN 0 THEN 'NOINDEX, follow' WHEN 1 THEN 'none' WHEN 2 THEN 'index' ELSE NULL END AS meta_robots,
               CASE WHEN c_custkey % 29 = 0 THEN 'noindex' ELSE NULL END AS x_robots_tag,
               CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'https://o.com/' || CAST(c_custkey AS STRING) WHEN 3 THEN {url_of('(c_custkey + 4)')}
                    WHEN 4 THEN {url_of('c_custkey')} || '#top' ELSE {url_of('c_custkey')} END AS canonical_href
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "headings": """
        SELECT c_custkey * 3 AS id, c_custkey AS url_id, 'h1' AS tag, 0 AS position,
               CASE WHEN c_custkey % 50 = 1 THEN NULL ELSE ' Head ' || CAST(c_custkey % 300 AS STRING) END AS text FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT c_custkey * 3 + 1, c_custkey, 'h1', 1, 'Head B ' || CAST(c_custkey AS STRING) FROM customer WHERE c_acctbal > 5000
        UNION ALL SELECT c_custkey * 3 + 2, c_custkey, 'h2', 2, 'Sub' FROM customer""",
    "links": """
        SELECT o_orderkey AS id, 'j1' AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN 10 WHEN o_custkey % 6 = 0 THEN o_custkey + 1 ELSE o_custkey END AS from_url_id, 'h' || CAST(t AS STRING) AS to_url_hash, 'u' || CAST(t AS STRING) AS to_url, t AS target,
               o_orderkey % 23 <> 0 AS is_internal, o_orderkey % 10 <> 0 AS follow,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'content' WHEN '2' THEN 'nav' WHEN '3' THEN 'header' WHEN '5' THEN 'footer' ELSE NULL END AS link_position
        FROM (SELECT *, CASE WHEN t0 % 29 = 5 THEN t0 + 1 ELSE t0 END AS t
              FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * o_orderkey) % 40 ELSE (o_orderkey * 31) % (n + 20) END AS t0
                    FROM orders CROSS JOIN (SELECT count(*) AS n FROM customer) k) w) o""",
    "hreflang": f"""
        SELECT c_custkey AS id, c_custkey AS url_id,
               CASE c_custkey % 10 WHEN 0 THEN 'xx_bad' WHEN 1 THEN 'x-default' WHEN 2 THEN 'zh-Hant-TW' ELSE 'en' END AS lang,
               {url_of('(CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END)')} AS href
        FROM customer WHERE c_acctbal < 6000""",
    "structured_raw": """
        SELECT c_custkey AS id, c_custkey AS url_id,
               CASE c_custkey % 7 WHEN 0 THEN '{"@type":"Product"}' WHEN 1 THEN '{"name":"x"}' WHEN 2 THEN '{"@type":"WebPage"}' WHEN 3 THEN '{"@type":"Event","name":"n"}'
                    WHEN 4 THEN '{"@type":"Article","headline":"h"}' WHEN 5 THEN '{"@graph":[{"@type":"Recipe"},{"@type":"Person","name":"p"}]}' ELSE '"text"' END AS raw
        FROM customer""",
    "resources": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS url_id, 'https://cdn.e.com/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS resource_url,
               CASE WHEN l_suppkey % 3 = 0 THEN 'css' ELSE 'image' END AS resource_type,
               CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'alt ' || CAST(l_suppkey AS STRING) END AS alt_text
        FROM lineitem""",
    "security_headers": """
        SELECT c_custkey AS url_id, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_custkey % 7 <> 0 END AS is_https, c_custkey % 12 = 5 AS has_mixed_content,
               c_custkey % 2 = 0 AS has_hsts, c_custkey % 5 < 2 AS has_csp, CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE c_custkey % 4 = 0 END AS has_x_content_type_options,
               c_custkey % 6 <> 1 AS has_x_frame_options, c_custkey % 19 = 3 AS has_unsafe_crossorigin
        FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "gsc": """
        SELECT user_id AS url_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(*) AS impressions, avg(value) AS position FROM events GROUP BY user_id""",
    "gsc_queries": """
        SELECT user_id AS url_id, event_type || ' ' || CAST(event_id % 7 AS STRING) AS query, count(*) AS clicks FROM events GROUP BY user_id, event_type || ' ' || CAST(event_id % 7 AS STRING)""",
    "vectors": """
        SELECT vec_id AS id, embedding, CAST(label + 1 AS DOUBLE) AS pagerank, CAST(vec_id % 50 AS DOUBLE) AS clicks, label AS cluster_id FROM embeddings""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named crawl tables (all by default) over the test tables of sf_dir."""
    base = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE}
    out = {}
    for name in names or tuple(VIEWS):
        sql = VIEWS[name]
        used = {b: base[b] for b in BASE if f" {b}" in sql}
        for b in used:
            sql = sql.replace(f"FROM {b}", f"FROM {{{b}}}")
        used = {b: df for b, df in used.items() if f"{{{b}}}" in sql}
        out[name] = spark.sql(_braces(sql, tuple(used)), **used)
    return out


@cache
def _braces(sql: str, names: tuple[str, ...]) -> str:
    """Doubles the braces of JSON literals, which formatting would take for its own."""
    for n in names:
        sql = sql.replace(f"{{{n}}}", f"\x00{n}\x01")
    return sql.replace("{", "{{").replace("}", "}}").replace("\x00", "{").replace("\x01", "}")


def with_views(query: str, *names: str) -> str:
    """A query for the oracle with the named crawl tables before it."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH RECURSIVE {views} {query}" if not query.lstrip().startswith(",") else f"WITH RECURSIVE {views}{query}"
