"""CSV exports: URLs, links, content and vector analytics. Nulls are empty fields; the byte-order mark is written once at
the head of the header, so that spreadsheets read the file as UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"
# The columns of the exported files, in their order.
URL_COLUMNS = (
    "url", "host", "path", "scheme", "is_internal", "crawl_depth", "status_code", "status_group", "status_text", "content_type", "content_length", "transfer_size",
    "response_time_ms", "is_html", "resource_type", "redirect_url", "redirect_type", "indexable", "indexability_status", "url_length", "folder_depth",
    "word_count", "text_ratio", "last_modified", "http_version", "inlinks_count", "unique_inlinks_count", "outlinks_count", "external_outlinks_count",
    "pagerank", "in_sitemap", "title", "title_len", "title_pixel_width", "meta_description", "meta_description_len", "meta_description_pixel_width",
    "meta_robots", "canonical_href", "meta_refresh", "has_meta_outside_head", "content_text", "content_char_count",
)
LINK_COLUMNS = ("from_url", "to_url", "anchor_text", "link_type", "link_position", "rel", "follow", "target", "is_internal", "alt_text")
CONTENT_COLUMNS = ("url", "status_code", "title", "meta_description", "word_count", "content_char_count", "content_text", "content_markdown")
SEMANTIC_COLUMNS = ("url", "cluster_id", "ring", "semantic_role", "distance_to_centroid", "weight", "pr_norm", "clicks_norm", "x", "y", "clicks", "impressions", "ctr", "position")


def _columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named columns in order as text, flags as True and False; a table that lacks one is an error (tables.conform
    adds the declared columns of older tables)."""
    flags = {f.name for f in df.schema if f.dataType.typeName() == "boolean"}
    text = lambda c: F.initcap(F.col(c).cast("string")) if c in flags else F.col(c).cast("string")
    return df.select(*[text(c).alias(c) for c in names])


def _pages(urls_: DataFrame, meta: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """Pages with their meta row and text columns; content_char_count is the text's own length, not the response's."""
    c = texts.withColumnsRenamed({"url_id": "id", "content_length": "content_char_count"})
    return urls_.join(meta.withColumnRenamed("url_id", "id"), "id", "left").join(c, "id", how)


def urls(urls_: DataFrame, meta: DataFrame, content_: DataFrame, cut: int = 500) -> DataFrame:
    """Every page, with the first `cut` characters of its text."""
    texts = content_.select("url_id", "content_length", F.substring("content_text", 1, cut).alias("content_text"))
    return _columns(_pages(urls_, meta, texts, "left"), URL_COLUMNS)


def links(links_: DataFrame, urls_: DataFrame) -> DataFrame:
    d = links_.join(urls_.select(F.col("id").alias("from_url_id"), F.col("url").alias("from_url")), "from_url_id", "left")
    return _columns(d, LINK_COLUMNS)


def content(urls_: DataFrame, meta: DataFrame, content_: DataFrame) -> DataFrame:
    """The pages that have a content row, with their whole texts."""
    texts = content_.select("url_id", "content_length", "content_text", "content_markdown")
    return _columns(_pages(urls_, meta, texts, "inner"), CONTENT_COLUMNS)


def semantic(pages: DataFrame, urls_: DataFrame, gsc: DataFrame) -> DataFrame:
    have = [c for c in ("clicks", "impressions", "ctr", "position") if c in gsc.columns]
    d = pages.drop(*have).join(urls_.select("id", "url"), "id").join(gsc.select(F.col("url_id").alias("id"), *have), "id", "left")
    return _columns(d.orderBy("distance_to_centroid"), SEMANTIC_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    first = df.columns[0]
    out = df.withColumnRenamed(first, BOM + first)
    out.write.mode("overwrite").options(header=True, nullValue="", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def csv_lines(df: DataFrame):
    """The rows as CSV lines, partition by partition, for a client that reads while the job runs."""
    import csv
    import io

    def line(values) -> str:
        out = io.StringIO()
        csv.writer(out).writerow(["" if v is None else v for v in values])
        return out.getvalue()

    yield BOM + line(df.columns)
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield line(row)
