"""SQL names for the functions that need Python, and table functions over HTML."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from crawlens.functions import html, url


@udtf(returnType="url string, anchor_text string, rel string, link_position string, target string, alt_text string, follow boolean, link_type string")
class PageLinks:
    def eval(self, source: str, page_url: str):
        if source is not None:
            for k in html.parse_page(source, page_url)["links"]:
                yield tuple(k.values())


@udtf(returnType="tag string, position int, text string")
class PageHeadings:
    def eval(self, source: str):
        if source is not None:
            for h in html.parse_page(source)["headings"]:
                yield tuple(h.values())


@udtf(returnType="url string, resource_type string, alt_text string, width int, height int, is_mixed_content boolean")
class PageResources:
    def eval(self, source: str, page_url: str):
        if source is not None:
            for r in html.parse_page(source, page_url)["resources"]:
                yield tuple(r.values())


def register(spark: SparkSession) -> None:
    """normalize_url, match_url, resolve_url, page_facts; page_links, page_headings and page_resources as table functions."""
    for name, f in {"normalize_url": url.normalize_url, "match_url": url.match_url, "resolve_url": url.resolve, "page_facts": html.page_facts}.items():
        spark.udf.register(name, f)
    for name, t in {"page_links": PageLinks, "page_headings": PageHeadings, "page_resources": PageResources}.items():
        spark.udtf.register(name, t)
