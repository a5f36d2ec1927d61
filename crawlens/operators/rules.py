"""The audit rules: 49 issue types over the crawl tables.

Every function returns issues (job_id, url_id, issue_type, severity, details), details a JSON string or null. Rules over
one scan are one expression, an array of issues exploded; rules over groups aggregate before they join back. run_all
writes the pages and their metadata once, with normalised URLs, and raises all rules over a row in one scan each. Flags are
three-valued: a rule asks for TRUE or FALSE, and NULL (unknown) never raises an issue.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.config import Thresholds
from crawlens.functions.text import contains_noindex
from crawlens.functions.url import host, normalize_url
from crawlens.operators import graph
from crawlens.storage import Tables

ISSUE = "struct<issue_type:string,severity:string,details:string>"
CONNECTION = ("timeout", "dns_error", "conn_refused", "error", "unknown")
LANG = r"^(?:x-default|[a-zA-Z]{2,3}(?:-[a-zA-Z0-9]{1,8})*)$"


def _json(**fields: Column | str | float) -> Column:
    cols = [(F.lit(v) if isinstance(v, int | float) else F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*cols))


def _issue(cond: Column, kind: str, severity: str, details: Column | None = None) -> Column:
    made = F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if details is None else details).alias("details"))
    return F.when(cond, made)


def _raise(df: DataFrame, *issues: Column, job: str = "job_id", url_id: str = "url_id") -> DataFrame:
    """The issues that hold for each row of one scan."""
    found = F.filter(F.array(*[i.cast(ISSUE) for i in issues]), lambda x: x.isNotNull())
    return df.select(F.col(job).alias("job_id"), F.col(url_id).alias("url_id"), F.explode(found).alias("x")).select("job_id", "url_id", "x.*")


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """Membership of groups of two or more pages (url_id, url) with the same job and key: job_id, key, url_id, url, n."""
    pages = rows.where(F.col(key).isNotNull()).select("job_id", F.col(key).alias("key"), "url_id", "url").distinct()
    # written, so that the join has plain shuffles on both sides, of which AQE splits a hot key
    sizes = Tables(rows.sparkSession).save(pages.groupBy("job_id", "key").agg(F.count("*").alias("n")).where("n > 1"))
    return pages.join(sizes, ["job_id", "key"])


def _duplicates(rows: DataFrame, key: str, kind: str, severity: str, listed: int, extra: str | None = None) -> DataFrame:
    groups = duplicate_groups(rows, key)
    small = groups.where(F.col("n") <= listed).groupBy("job_id", "key").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    d = groups.join(small, ["job_id", "key"], "left")
    others = F.filter("urls", lambda u: u != F.col("url"))
    fields = {extra: F.col("key")} if extra else {}
    return _raise(d, _issue(F.lit(True), kind, severity, _json(**fields, duplicates=F.col("n") - 1, duplicate_urls=others)))


def _http_rules() -> list[Column]:
    g = F.col("status_group")
    return [
        _issue(g == "4xx", "4xx_error", "error", _json(status_code="status_code")),
        _issue(g == "5xx", "5xx_error", "error", _json(status_code="status_code")),
        _issue(g.isin(*CONNECTION), "connection_error", "error", _json(error_type="status_group")),
    ]


def http_issues(urls: DataFrame) -> DataFrame:
    return _raise(urls, *_http_rules(), url_id="id")


def _html_with_meta(urls: DataFrame, meta: DataFrame) -> DataFrame:
    return urls.where("is_html").join(meta.withColumnRenamed("url_id", "id"), "id").withColumnRenamed("id", "url_id")


def _stripped(col: str) -> tuple[Column, Column]:
    """A text without white space around it, and whether there is one."""
    text = F.btrim(F.col(col), F.lit(" \t\n\r\f\x0b"))
    return text, F.col(col).isNotNull() & (text != "")


def _text_rules(col: str, length: str, name: str, lo: int, hi: int) -> list[Column]:
    text, has = _stripped(col)
    n = F.coalesce(F.col(length), F.length(text))
    return [
        _issue(~has | F.col(col).isNull(), f"{name}_missing", "warning"),
        _issue(has & (n < lo), f"{name}_too_short", "warning", _json(length=n, min=lo)),
        _issue(has & (n > hi), f"{name}_too_long", "warning", _json(length=n, max=hi)),
    ]


def _text_duplicates(d: DataFrame, col: str, name: str, listed: int) -> DataFrame:
    text, has = _stripped(col)
    ok = d.where(has & (F.col("status_code") == 200) & F.col("is_internal")).withColumn("_key", F.lower(text))
    return _duplicates(ok, "_key", f"{name}_duplicate", "warning", listed)


def _title_rules(t: Thresholds) -> list[Column]:
    return _text_rules("title", "title_len", "title", t.title_min, t.title_max)


def _description_rules(t: Thresholds) -> list[Column]:
    return _text_rules("meta_description", "meta_description_len", "description", t.description_min, t.description_max)


def title_issues(urls: DataFrame, meta: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    d = _html_with_meta(urls, meta)
    return _raise(d, *_title_rules(t)).unionByName(_text_duplicates(d, "title", "title", t.listed))


def description_issues(urls: DataFrame, meta: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    d = _html_with_meta(urls, meta)
    return _raise(d, *_description_rules(t)).unionByName(_text_duplicates(d, "meta_description", "description", t.listed))


def _normal(d: DataFrame, of: str, name: str) -> DataFrame:
    """d with the normalised URLs of a column, unless it has them."""
    return d if name in d.columns else d.withColumn(name, normalize_url(of))


def h1_issues(urls: DataFrame, headings: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    html = urls.where("is_html").select("job_id", F.col("id").alias("url_id"), "url")
    h1 = headings.where("tag = 'h1'").join(html, "url_id")
    counts = h1.groupBy("job_id", "url_id").agg(F.count("*").alias("n"))
    missing = html.join(counts.select("url_id"), "url_id", "left_anti")
    texts = h1.withColumn("_key", F.nullif(F.lower(F.btrim(F.col("text"), F.lit(" \t\n\r\f\x0b"))), F.lit("")))
    return (
        _raise(missing, _issue(F.lit(True), "h1_missing", "warning"))
        .unionByName(_raise(counts, _issue(F.col("n") > 1, "h1_multiple", "warning", _json(count="n"))))
        .unionByName(_duplicates(texts, "_key", "h1_duplicate", "info", t.listed))
    )


def canonical_issues(urls: DataFrame, meta: DataFrame) -> DataFrame:
    """The target is the page with exactly the canonical URL, else the first one with the same normalised URL."""
    d = _normal(_html_with_meta(urls, meta), "url", "norm_url")
    return _canonical(_normal(d, "canonical_href", "norm_canon"), urls)


def _canonical(d: DataFrame, urls: DataFrame) -> DataFrame:
    d = d.select("job_id", "url_id", "url", "canonical_href", "norm_url", "norm_canon")
    pages = _normal(urls, "url", "norm_url").select("job_id", "id", "url", "status_code", "norm_url")
    exact = pages.groupBy("job_id", "url").agg(F.min_by("status_code", "id").alias("exact"))
    by_norm = pages.withColumnRenamed("norm_url", "norm").groupBy("job_id", "norm").agg(F.min_by("status_code", "id").alias("close"))
    d = d.join(exact.withColumnRenamed("url", "canonical_href"), ["job_id", "canonical_href"], "left")
    d = d.join(by_norm.withColumnRenamed("norm", "norm_canon"), ["job_id", "norm_canon"], "left")
    status = F.coalesce("exact", "close")
    has = F.coalesce(F.btrim(F.col("canonical_href")) != "", F.lit(False))
    other = has & (F.col("norm_canon") != F.col("norm_url"))
    cross = other & (host("canonical_href") != host("url"))
    return _raise(
        d,
        _issue(~has, "canonical_missing", "info"),
        _issue(cross, "canonical_cross_domain", "info", _json(canonical="canonical_href", canonical_host=host("canonical_href"))),
        _issue(other & status.isNotNull() & (status != 200), "canonical_broken", "error", _json(canonical="canonical_href", target_status=status)),
    )


def hreflang_checks(urls: DataFrame, hreflang: DataFrame) -> DataFrame:
    """hreflang rows with lang_valid, return_tag_ok (NULL: unknown, for x-default, targets not crawled and self) and
    target_status."""
    pages = _normal(urls, "url", "norm_url").select("job_id", "id", "url", "status_code", F.col("norm_url").alias("norm"))
    target = pages.groupBy("job_id", "norm").agg(F.max("id").alias("target_id"), F.min_by("status_code", "id").alias("target_status"))
    h = hreflang.join(pages.select("job_id", F.col("id").alias("url_id"), "url", F.col("norm").alias("page_norm")), "url_id")
    h = h.withColumn("norm_href", normalize_url("href"))
    back = h.select(F.col("url_id").alias("target_id"), F.col("norm_href").alias("page_norm"), F.lit(True).alias("back")).distinct()
    h = h.join(target.withColumnRenamed("norm", "norm_href"), ["job_id", "norm_href"], "left").join(back, ["target_id", "page_norm"], "left")
    unknown = (F.lower("lang") == "x-default") | F.col("target_id").isNull() | (F.col("target_id") == F.col("url_id"))
    return h.withColumn("lang_valid", F.coalesce(F.col("lang").rlike(LANG), F.lit(False))).withColumn("return_tag_ok", F.when(~unknown, F.coalesce("back", F.lit(False))))


def hreflang_issues(urls: DataFrame, hreflang: DataFrame) -> DataFrame:
    h = hreflang_checks(urls, hreflang.select("id", "url_id", "lang", "href"))
    status = F.col("target_status")
    return _raise(
        h,
        _issue(~F.col("return_tag_ok"), "hreflang_missing_return", "warning", _json(lang="lang", href="href")),
        _issue(~F.col("lang_valid"), "hreflang_invalid_lang", "warning", _json(lang="lang")),
        _issue(status.isNotNull() & (status != 200), "hreflang_broken_target", "error", _json(href="href", target_status="target_status")),
    )


def structured_data_issues(checked: DataFrame) -> DataFrame:
    """checked: job_id, url_id, schema_type, validation_status, validation_issues."""
    details = _json(schema_type="schema_type", validation_issues="validation_issues")
    return _raise(checked, *[_issue(F.col("validation_status") == s, f"structured_data_{s}", s, details) for s in ("error", "warning")])


def noindex(meta_robots: str = "meta_robots", x_robots: str = "x_robots_tag") -> Column:
    return contains_noindex(meta_robots) | contains_noindex(x_robots)


def _indexability_rules() -> list[Column]:
    return [_issue(noindex(), "noindex_page", "info")]


def indexability_issues(urls: DataFrame, meta: DataFrame) -> DataFrame:
    return _raise(_html_with_meta(urls, meta), *_indexability_rules())


def duplicate_content_issues(urls: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    d = urls.withColumnRenamed("id", "url_id").withColumn("_key", F.nullif("body_hash", F.lit("")))
    return _duplicates(d, "_key", "duplicate_content", "warning", t.listed, "body_hash")


def redirect_issues(urls: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """urls: job_id, id, url, redirect_url."""
    c = graph.redirect_chains(urls)
    return _raise(
        c,
        _issue(F.col("loops"), "redirect_loop", "error", _json(chain="chain")),
        _issue(~F.col("loops") & (F.col("hops") > t.redirect_hops), "redirect_chain", "warning", _json(chain="chain", hops="hops")),
    )


def image_issues(urls: DataFrame, resources: DataFrame) -> DataFrame:
    d = resources.join(urls.select("job_id", F.col("id").alias("url_id")), "url_id")
    return _raise(d, _issue((F.col("resource_type") == "image") & F.col("alt_text").isNull(), "image_missing_alt", "warning", _json(image_url="resource_url")))


def security_issues(urls: DataFrame, security: DataFrame) -> DataFrame:
    d = security.join(urls.select("job_id", F.col("id").alias("url_id")), "url_id")
    absent = {"is_https": ("http_url", "warning"), "has_hsts": ("missing_hsts", "info"), "has_csp": ("missing_csp", "info"), "has_x_content_type_options": ("missing_x_content_type_options", "info"), "has_x_frame_options": ("missing_x_frame_options", "info")}
    present = {"has_mixed_content": ("mixed_content", "warning"), "has_unsafe_crossorigin": ("unsafe_crossorigin", "warning")}
    return _raise(d, *[_issue(~F.col(c), *v) for c, v in absent.items()], *[_issue(F.col(c), *v) for c, v in present.items()])


def _content_rules(t: Thresholds) -> list[Column]:
    page = F.col("is_html") & F.col("is_internal") & (F.col("status_code") == 200)
    r = F.col("text_ratio")
    return [
        _issue(page & (F.col("word_count") < t.low_words), "low_word_count", "warning", _json(word_count="word_count")),
        _issue(page & (r < t.very_low_ratio), "very_low_text_ratio", "warning", _json(text_ratio="text_ratio")),
        _issue(page & (r >= t.very_low_ratio) & (r < t.low_ratio), "low_text_ratio", "info", _json(text_ratio="text_ratio")),
    ]


def content_issues(urls: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return _raise(urls, *_content_rules(t), url_id="id")


def _url_rules(t: Thresholds) -> list[Column]:
    u, p = F.col("url"), F.nullif("path", F.lit(""))
    seo = r"(?i);jsessionid=|%5Cu\d{4}|\\u[0-9a-fA-F]{4}|%00"
    faceted = r"(?i)[.;|](?:categorias|categories|tags|labels|filters?|facets?|taxonomy)/|/ELEM_ENTRY|/BP_Categories/"
    return [
        _issue(F.length(u) > t.url_length, "url_too_long", "warning", _json(length=F.length(u))),
        _issue(u.rlike(r"[^\x00-\x7F]"), "url_non_ascii", "warning"),
        _issue(p != F.lower(p), "url_uppercase", "info"),
        _issue(p.contains("_"), "url_underscores", "info"),
        _issue(p.rlike("(?<!:)//+"), "url_multiple_slashes", "warning"),
        _issue(u.contains("?"), "url_has_parameters", "info"),
        _issue(u.rlike(seo), "url_non_seo_friendly", "error"),
        _issue(u.rlike(faceted), "url_cms_faceted", "warning", _json(hint=F.lit("faceted navigation"))),
    ]


def url_issues(urls: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return _raise(urls, *_url_rules(t), url_id="id")


def link_issues(counted: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """counted: urls with inlinks_count and outlinks_count (see graph.link_counts)."""
    alone = F.coalesce("inlinks_count", F.lit(0)) == 0
    page = F.col("is_html") & F.col("is_internal") & (F.col("status_code") == 200)
    return _raise(
        counted,
        _issue(page & F.coalesce(F.col("crawl_depth") > 0, F.lit(True)) & alone, "orphan_page", "warning"),
        _issue(F.col("outlinks_count") > t.max_outlinks, "high_outlink_count", "info", _json(count="outlinks_count")),
        url_id="id",
    )


def sitemap_issues(counted: DataFrame) -> DataFrame:
    """counted: urls with in_sitemap, inlinks_count and indexable. A job without any page in a sitemap has no issue."""
    jobs = counted.where("in_sitemap").select("job_id").distinct()
    d = counted.join(jobs, "job_id", "left_semi")
    page = F.col("is_html") & (F.col("status_code") == 200)
    alone = F.coalesce("inlinks_count", F.lit(0)) == 0
    return _raise(
        d,
        _issue(F.col("in_sitemap") & page & F.coalesce(F.col("crawl_depth") != 0, F.lit(True)) & alone, "sitemap_orphan", "warning"),
        _issue(~F.col("in_sitemap") & page & F.col("is_internal") & F.col("indexable"), "not_in_sitemap", "info"),
        url_id="id",
    )


def with_indexable(urls: DataFrame, meta: DataFrame) -> DataFrame:
    """urls with indexable as analysis sees it: for HTML pages with a meta row; NULL for all others."""
    m = _normal(meta, "canonical_href", "norm_canon")
    m = m.select(F.col("url_id").alias("id"), "meta_robots", "x_robots_tag", "canonical_href", "norm_canon", F.lit(True).alias("_has"))
    kept = urls.columns
    d = _normal(urls.drop("indexable"), "url", "norm_url").join(m, "id", "left")
    canon = F.coalesce(F.btrim(F.col("canonical_href")), F.lit(""))
    own = (canon == "") | (F.col("norm_canon") == F.col("norm_url"))
    ok = F.coalesce(F.col("status_code") == 200, F.lit(False)) & ~noindex() & F.coalesce(own, F.lit(True))
    return d.withColumn("indexable", F.when(F.col("is_html") & F.col("_has"), ok)).select(*[c for c in kept if c != "indexable"], "indexable")


def run_all(tables: dict[str, DataFrame], t: Thresholds = Thresholds(), skip: tuple[str, ...] = ()) -> DataFrame:
    """All issues of the crawl tables: urls, html_meta, headings, links, hreflang, structured_data (checked), resources,
    security_headers. Link counts come before orphans, indexability before sitemap coverage."""
    saved = Tables(tables["urls"].sparkSession)
    u = saved.save(_normal(tables["urls"], "url", "norm_url"))
    m = saved.save(_normal(tables["html_meta"], "canonical_href", "norm_canon"))
    d = saved.save(_html_with_meta(u, m))
    counted = saved.save(graph.link_counts(with_indexable(u, m), tables["links"]))
    of_url = {"http": _http_rules(), "content": _content_rules(t), "urls": _url_rules(t)}
    of_meta = {"title": _title_rules(t), "description": _description_rules(t), "indexability": _indexability_rules()}
    chosen = lambda of: [rule for name, rules in of.items() if name not in skip for rule in rules]
    scans = [_raise(rows, *rules, url_id=key) for rows, rules, key in ((u, chosen(of_url), "id"), (d, chosen(of_meta), "url_id")) if rules]
    parts: dict[str, Callable[[], DataFrame]] = {
        "title": lambda: _text_duplicates(d, "title", "title", t.listed),
        "description": lambda: _text_duplicates(d, "meta_description", "description", t.listed),
        "h1": lambda: h1_issues(u, tables["headings"], t),
        "canonical": lambda: _canonical(d, u),
        "hreflang": lambda: hreflang_issues(u, tables["hreflang"]),
        "structured_data": lambda: structured_data_issues(tables["structured_data"]),
        "duplicate_content": lambda: duplicate_content_issues(u, t),
        "redirects": lambda: redirect_issues(u, t),
        "images": lambda: image_issues(u, tables["resources"]),
        "security": lambda: security_issues(u, tables["security_headers"]),
        "links": lambda: link_issues(counted, t),
        "sitemap": lambda: sitemap_issues(counted),
    }
    return reduce(DataFrame.unionByName, scans + [f() for name, f in parts.items() if name not in skip])


def write_issues(issues: DataFrame, path: str) -> None:
    """Replaces the issues of the jobs in `issues` under path, one partition a job."""
    out = issues.withColumn("detected_at", F.current_timestamp())
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)
