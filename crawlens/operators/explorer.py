"""Explorer queries: filters, search, sorting and pages over the crawl tables, and the job statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL = ("status_group", "is_internal", "resource_type", "indexable", "status_code")
RANGES = {
    **dict.fromkeys(("pagerank", "content_length", "transfer_size", "word_count", "response_time_ms", "inlinks_count", "outlinks_count", "external_outlinks_count", "unique_inlinks_count", "url_length", "folder_depth", "text_ratio", "crawl_depth", "status_code", "redirect_type"), False),
    "title_len": True,
    "meta_description_len": True,
}
#: parameter -> (column, whether it is one of html_meta)
CONTAINS = {
    **{f"{c}_contains": (c, False) for c in ("host", "content_type", "status_text", "redirect_url", "indexability_status", "http_version", "last_modified")},
    **{f"{c}_contains": (c, True) for c in ("title", "meta_robots", "og_title", "og_image", "og_type", "og_url", "twitter_card")},
    "description_contains": ("meta_description", True),
    "canonical_contains": ("canonical_href", True),
}
SORTS = {
    **dict.fromkeys(("url", "status_code", "word_count", "response_time_ms", "content_length", "transfer_size", "crawl_depth", "inlinks_count", "outlinks_count", "external_outlinks_count", "unique_inlinks_count", "pagerank", "url_length", "folder_depth", "text_ratio", "host", "last_crawled_at"), False),
    **dict.fromkeys(("title", "title_len", "meta_description", "meta_description_len"), True),
}
_code = lambda lo: (F.col("status_code") >= lo) & (F.col("status_code") < lo + 100)
PRESETS = {
    "all": lambda: F.lit(True),
    "html": lambda: F.col("resource_type") == "html",
    "js": lambda: F.col("resource_type") == "js",
    "css": lambda: F.col("resource_type") == "css",
    "images": lambda: F.col("resource_type") == "image",
    "pdf": lambda: F.col("resource_type") == "pdf",
    "internal": lambda: F.col("is_internal"),
    "external": lambda: ~F.col("is_internal"),
    "2xx": lambda: _code(200),
    "3xx": lambda: _code(300),
    "4xx": lambda: _code(400),
    "5xx": lambda: _code(500),
    "indexable": lambda: F.col("indexable") & F.col("is_internal"),
    "non_indexable": lambda: ~F.col("indexable") & F.col("is_internal"),
}
OPERATORS = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, "<": lambda c, v: c < v}
# The tabs of the explorer, each with its filter and its columns.
TABS: dict[str, tuple[dict[str, object], tuple[str, ...]]] = {
    "all": ({}, ("url", "status_code", "title", "title_len", "meta_description", "meta_description_len", "content_type", "content_length", "response_time_ms", "crawl_depth", "word_count", "inlinks_count", "outlinks_count", "pagerank", "indexable", "canonical_href")),
    "html": ({"resource_type": "html"}, ("url", "status_code", "title", "title_len", "meta_description", "meta_description_len", "word_count", "response_time_ms", "content_length", "inlinks_count", "outlinks_count", "external_outlinks_count", "pagerank", "indexable", "canonical_href", "meta_robots")),
    "js": ({"resource_type": "js"}, ("url", "status_code", "content_length", "transfer_size", "response_time_ms", "last_modified")),
    "css": ({"resource_type": "css"}, ("url", "status_code", "content_length", "transfer_size", "response_time_ms", "last_modified")),
    "image": ({"resource_type": "image"}, ("url", "status_code", "content_length", "transfer_size", "response_time_ms")),
    "pdf": ({"resource_type": "pdf"}, ("url", "status_code", "content_length", "transfer_size", "response_time_ms")),
    "internal": ({"is_internal": True}, ("url", "status_code", "title", "title_len", "meta_description", "word_count", "inlinks_count", "outlinks_count", "external_outlinks_count", "pagerank", "crawl_depth", "indexable", "canonical_href")),
    "external": ({"is_internal": False}, ("url", "status_code", "host", "content_type", "content_length", "response_time_ms")),
    "2xx": ({"status_group": "2xx"}, ("url", "status_code", "title", "title_len", "meta_description", "meta_description_len", "word_count", "response_time_ms", "inlinks_count", "outlinks_count", "pagerank", "indexable", "canonical_href")),
    "3xx": ({"status_group": "3xx"}, ("url", "status_code", "redirect_url", "redirect_type", "response_time_ms", "inlinks_count", "crawl_depth")),
    "4xx": ({"status_group": "4xx"}, ("url", "status_code", "status_text", "inlinks_count", "crawl_depth", "content_type")),
    "5xx": ({"status_group": "5xx"}, ("url", "status_code", "status_text", "response_time_ms", "crawl_depth", "inlinks_count")),
    "indexable": ({"indexable": True, "is_internal": True}, ("url", "status_code", "title", "title_len", "meta_description", "word_count", "inlinks_count", "pagerank", "canonical_href")),
    "noindex": ({"indexable": False, "is_internal": True}, ("url", "status_code", "indexability_status", "title", "meta_robots", "canonical_href")),
}
# Resource types that a crawl keeps, by the switch in its configuration and whether that is on by default.
RESOURCE_SWITCHES = {
    "image": ("crawl_images", True), "css": ("crawl_css", True), "js": ("crawl_js", True), "pdf": ("crawl_pdfs", True), "font": ("crawl_fonts", False), "svg": ("crawl_svg", True),
    "other": ("crawl_other", True),
}
# Page templates by path, the first that matches.
TEMPLATES = [
    ("cms · asset publisher", r"/-/asset_publisher/"),
    ("cms · otros portlets", r"/-/[a-z_]+/"),
    ("home", r"^/?$|^/[a-z]{2}/?$"),
    ("blog · post", r"^/blog/.+/.+"),
    ("blog · categoria", r"^/blog/[^/]+/?$"),
    ("blog · indice", r"^/blog/?$"),
    ("ficha de producto", r"^/[a-z]{2}/(hoteles|hotels)/[^/]+/[^/]+/"),
    ("categoria nivel 2", r"^/[a-z]{2}/(hoteles|hotels)/[^/]+/[^/]+/?$"),
    ("categoria nivel 1", r"^/[a-z]{2}/(hoteles|hotels)/[^/]+/?$"),
    ("listado producto", r"^/[a-z]{2}/(hoteles|hotels)/?$"),
    ("marca", r"^/[a-z]{2}/[a-z0-9-]*(hotels|resorts|collection)[a-z0-9-]*/?$"),
    ("legal", r"(privacidad|privacy|datenschutz|aviso-legal|cookies|terminos)"),
]


@dataclass(frozen=True)
class Query:
    """What an explorer request asks for. params holds equality values by column, <column>_gte / <column>_lte bounds and
    <column>_contains patterns (any case; % and _ are wildcards). Malformed bounds are ignored."""

    params: Mapping[str, object] = field(default_factory=dict)
    search: str | None = None
    issue_type: str | None = None
    severity: str | None = None
    preset: str | None = None
    sort: str | None = None
    descending: bool = False
    page: int = 1
    page_size: int = 50


def compare(column: str, operator: str, value: float) -> Column:
    return OPERATORS[operator](F.col(column), F.lit(value))


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def predicates(q: Query) -> tuple[list[Column], bool]:
    """The conditions of a query and whether they need html_meta."""
    out, meta = [], q.search is not None
    for c in EQUAL:
        if (v := q.params.get(c)) is not None:
            out.append(F.col(c) == F.lit(v))
    for c, of_meta in RANGES.items():
        for end, op in (("gte", ">="), ("lte", "<=")):
            if (v := _number(q.params.get(f"{c}_{end}"))) is not None:
                out.append(compare(c, op, v))
                meta |= of_meta
    for p, (c, of_meta) in CONTAINS.items():
        if v := q.params.get(p):
            out.append(F.col(c).ilike(f"%{v}%"))
            meta |= of_meta
    if q.search is not None:
        out.append(F.col("url").ilike(f"%{q.search}%") | F.col("title").ilike(f"%{q.search}%"))
    if q.preset:
        out.append(PRESETS[q.preset]())
    return out, meta or SORTS.get(q.sort or "", False)


def matching(urls: DataFrame, meta: DataFrame, q: Query, issues: DataFrame | None = None) -> DataFrame:
    """The URLs that a query matches; html_meta is joined only where it is needed."""
    conds, need = predicates(q)
    d = urls.join(meta.withColumnRenamed("url_id", "id"), "id", "left") if need else urls
    for c in conds:
        d = d.where(c)
    if issues is not None and (q.issue_type or q.severity):
        for column, value in (("issue_type", q.issue_type), ("severity", q.severity)):
            issues = issues.where(F.col(column) == value) if value else issues
        d = d.join(issues.select(F.col("url_id").alias("id")), "id", "left_semi")
    return d


def ordered(d: DataFrame, sort: str | None, descending: bool) -> DataFrame:
    """Ascending puts nulls first, descending last; id decides ties and is the default."""
    if sort not in SORTS:
        return d.orderBy("id")
    c = F.col(sort)
    return d.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "id")


def page(urls: DataFrame, meta: DataFrame, q: Query, issues: DataFrame | None = None) -> DataFrame:
    d = ordered(matching(urls, meta, q, issues), q.sort, q.descending)
    return d.offset((q.page - 1) * q.page_size).limit(q.page_size)


def page_info(total: int, q: Query) -> dict[str, int]:
    return {"total": total, "page": q.page, "page_size": q.page_size, "pages": max(1, math.ceil(total / q.page_size))}


def tab(urls: DataFrame, meta: DataFrame, name: str) -> DataFrame:
    """The rows and columns of a tab of the explorer, by id."""
    params, columns = TABS[name]
    d = urls
    for column, value in params.items():
        d = d.where(F.col(column) == F.lit(value))
    if any(c not in d.columns for c in columns):
        d = d.join(meta.withColumnRenamed("url_id", "id"), "id", "left")
    return d.orderBy("id").select(*columns)


def kept_resources(urls: DataFrame, switches: Mapping[str, bool] | None = None) -> DataFrame:
    """The rows whose resource type a crawl's configuration keeps; pages and redirects always."""
    on = {kind for kind, (name, default) in RESOURCE_SWITCHES.items() if (switches or {}).get(name, default)}
    return urls.where(F.col("resource_type").isin("html", "redirect", *on))


def templates(path: Column, patterns: list[tuple[str, str]] = TEMPLATES) -> Column:
    """The name of the first pattern (any case) that a path matches, else its number of levels."""
    out = None
    for name, pattern in patterns:
        cond = path.rlike(f"(?i){pattern}")
        out = F.when(cond, name) if out is None else out.when(cond, name)
    levels = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    other = F.concat(F.lit("otras · "), levels.cast("string"), F.lit(" niveles"))
    return other if out is None else out.otherwise(other)


def template_sample(urls: DataFrame, n: int = 3, largest: int | None = None, seed: int = 42, patterns: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, pages, url): n pages of each template, chosen by a seeded hash; of the largest templates only, if a
    number is given. Pages are reduced to the n least hashes before any group is put together."""
    d = urls.select(templates(F.col("path"), patterns).alias("template"), "url", F.xxhash64(F.lit(seed), "url").alias("h"))
    sizes = d.groupBy("template").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "template")
    sizes = sizes.limit(largest) if largest else sizes
    rank = F.row_number().over(Window.partitionBy("template").orderBy("h", "url"))
    return d.withColumn("k", rank).where(F.col("k") <= n).join(F.broadcast(sizes), "template").select("template", "pages", "url")


def select_pages(urls: DataFrame, shape: Column, group_key: str | None = None, url_regex: str | None = None) -> DataFrame:
    """HTML pages of a path shape and/or whose URL matches; all of them without either."""
    d = urls.where("is_html")
    if group_key:
        d = d.where(shape == group_key)
    if url_regex:
        re.compile(url_regex)
        d = d.where(F.col("url").rlike(url_regex))
    return d


def outlinks(links: DataFrame, urls: DataFrame, url_id: int, limit: int = 200) -> DataFrame:
    src = urls.select(F.col("id").alias("from_url_id"), F.col("url").alias("source_url"))
    return links.where(F.col("from_url_id") == url_id).join(src, "from_url_id", "left").orderBy("id").limit(limit)


def inlinks(links: DataFrame, urls: DataFrame, job_id: str, url_hash: str, limit: int = 200) -> DataFrame:
    src = urls.select(F.col("id").alias("from_url_id"), F.col("url").alias("source_url"))
    return links.where((F.col("job_id") == job_id) & (F.col("to_url_hash") == url_hash)).join(src, "from_url_id", "left").orderBy("id").limit(limit)


def affected_urls(issues: DataFrame, urls: DataFrame, issue_type: str, limit: int = 50) -> DataFrame:
    """The URLs with an issue, each once."""
    ids = issues.where(F.col("issue_type") == issue_type).select(F.col("url_id").alias("id"))
    return urls.join(ids, "id", "left_semi").select("id", "url", "status_code").orderBy("id").limit(limit)


def affected_by_any(issues: DataFrame, urls: DataFrame, issue_types: Sequence[str], limit: int = 50) -> DataFrame:
    """The URLs with any of some issues, `limit` of each type, each URL once."""
    return reduce(DataFrame.unionByName, [affected_urls(issues, urls, t, limit) for t in issue_types]).dropDuplicates(["id"])


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


def top_hosts(urls: DataFrame, limit: int = 20) -> DataFrame:
    return urls.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(limit)


def job_stats(urls: DataFrame) -> DataFrame:
    """Totals of each job in one pass; a URL of unknown side counts as external."""
    d = urls.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if("is_internal").alias("internal"), F.count_if("indexable").alias("indexable"), F.avg("response_time_ms").alias("avg_response_ms"))
    return d.withColumn("external", F.col("total") - F.col("internal"))


def jobs(table: DataFrame, status: str | None = None, client_id: str | None = None, page_no: int = 1, page_size: int = 50) -> DataFrame:
    for column, value in (("status", status), ("client_id", client_id)):
        table = table.where(F.col(column) == value) if value is not None else table
    return table.orderBy(F.desc("created_at"), "id").offset((page_no - 1) * page_size).limit(page_size)


def completeness(jobs_: DataFrame) -> DataFrame:
    """Jobs with `truncated`: whether a crawl ended at its limit of URLs, so that its graph is a part of the site's."""
    return jobs_.withColumn("truncated", F.coalesce(F.col("finish_reason") == "max_urls_reached", F.lit(False)))


def url_detail(tables: Mapping[str, DataFrame], url_id: int) -> DataFrame:
    """One URL with its metadata, headings and issues nested."""
    of = lambda name, *cols: tables[name].where(F.col("url_id") == url_id).groupBy("url_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    d = tables["urls"].where(F.col("id") == url_id).withColumnRenamed("id", "url_id").join(tables["html_meta"], "url_id", "left")
    return d.join(of("headings", "position", "tag", "text"), "url_id", "left").join(of("issues", "issue_type", "severity", "details"), "url_id", "left")


def crawl_progress(crawled: int, pending: int, max_urls: int | None) -> float:
    """Per cent of max_urls, or of what is known, that is crawled."""
    whole = max_urls or crawled + pending
    return min(100.0, 100.0 * crawled / whole) if whole else 0.0
