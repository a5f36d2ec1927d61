"""Queries over files and streams: what they read is first written to a temporary folder of the session's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.plans.views import tables, with_views
from crawlens.sources import archive, exports
from crawlens.sources.tables import conform
from crawlens.storage import Tables
from crawlens.streaming import pages as stream


def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of a job and import under another: pages and links by new key."""
    t = tables(spark, sf_dir, "urls", "html_meta")
    path = Tables(spark).root + "/archive"
    archive.export_job({"urls": t["urls"], "html_meta": t["html_meta"]}, path, "j1")
    got, _ = archive.import_job(spark, path, {n: t[n].schema for n in ("urls", "html_meta")}, "j2", 1000)
    return got["urls"].join(got["html_meta"].withColumnRenamed("url_id", "id"), "id", "left").select("job_id", "id", "url", "title")


def _exported(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named crawl tables with all declared columns, and documents as page texts."""
    out = {n: conform(t, n) for n, t in tables(spark, sf_dir, *names).items()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 > 0")
    texts = docs.select(F.col("doc_id").alias("url_id"), F.col("text").alias("content_text"), F.col("n_chars").cast("int").alias("content_length"))
    return out | {"page_content": conform(texts, "page_content")}


def _reread(df: DataFrame, path: str) -> DataFrame:
    """What a client of the written file reads: every column as text."""
    exports.write_csv(df, path)
    back = df.sparkSession.read.options(header=True, multiLine=True, escape='"').csv(path)
    return back.withColumnRenamed(back.columns[0], df.columns[0])


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _exported(spark, sf_dir, "urls", "html_meta")
    d = _reread(exports.urls(t["urls"], t["html_meta"], t["page_content"]), Tables(spark).root + "/csv")
    return d.withColumn("content_text", F.sha2("content_text", 256))


def links_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _exported(spark, sf_dir, "urls", "links")
    return exports.links(t["links"], t["urls"])


def content_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _exported(spark, sf_dir, "urls", "html_meta")
    return exports.content(t["urls"], t["html_meta"], t["page_content"])


def stream_upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages seen twice, first deep and old, then shallow and new, through the upsert sink."""
    u = tables(spark, sf_dir, "urls")["urls"].select("job_id", "url_hash", "url", "status_code", F.lit(9).alias("crawl_depth"), F.lit(1).alias("seq"))
    root = Tables(spark).root
    u.write.parquet(f"{root}/in/a")
    u.where("status_code = 200").withColumn("crawl_depth", F.lit(2)).withColumn("status_code", F.lit(304)).withColumn("seq", F.lit(2)).write.parquet(f"{root}/in/b")
    s = stream.page_stream(spark, f"{root}/in/*", u.schema)
    stream.upsert_to(s, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return stream.current(spark, f"{root}/out").select("url_hash", "status_code", "crawl_depth")


_FLAG = "CASE WHEN {0} THEN 'True' WHEN NOT {0} THEN 'False' END"


def _empty(*names: str) -> str:
    return ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)


_SQL = {
    "ndjson_roundtrip": (("urls", "html_meta"), " SELECT 'j2' AS job_id, 1000 + row_number() OVER (ORDER BY id) - 1 AS id, url, title FROM urls LEFT JOIN html_meta ON url_id = id"),
    "csv_export": (
        ("urls", "html_meta"),
        f""" SELECT url, host, path, {_empty('scheme')}, {_FLAG.format('is_internal')} AS is_internal, CAST(crawl_depth AS VARCHAR) AS crawl_depth, CAST(status_code AS VARCHAR) AS status_code,
               status_group, {_empty('status_text', 'content_type', 'content_length', 'transfer_size')}, CAST(response_time_ms AS VARCHAR) AS response_time_ms, {_FLAG.format('is_html')} AS is_html,
               resource_type, redirect_url, {_empty('redirect_type', 'indexable', 'indexability_status', 'url_length', 'folder_depth')}, CAST(word_count AS VARCHAR) AS word_count,
               CAST(text_ratio AS VARCHAR) AS text_ratio, {_empty('last_modified', 'http_version', 'inlinks_count', 'unique_inlinks_count', 'outlinks_count', 'external_outlinks_count', 'pagerank')},
               {_FLAG.format('in_sitemap')} AS in_sitemap, title, CAST(title_len AS VARCHAR) AS title_len, {_empty('title_pixel_width')}, meta_description, CAST(meta_description_len AS VARCHAR) AS meta_description_len,
               {_empty('meta_description_pixel_width')}, meta_robots, canonical_href, {_empty('meta_refresh', 'has_meta_outside_head')}, sha256(substr(d.text, 1, 500)) AS content_text, CAST(n_chars AS VARCHAR) AS content_char_count
          FROM urls LEFT JOIN html_meta ON url_id = id LEFT JOIN documents d ON doc_id = id AND doc_id % 3 > 0""",
    ),
    "links_export": (
        ("urls", "links"),
        f""" SELECT u.url AS from_url, to_url, {_empty('anchor_text', 'link_type')}, link_position, {_empty('rel')}, {_FLAG.format('follow')} AS follow, CAST(target AS VARCHAR) AS target,
               {_FLAG.format('l.is_internal')} AS is_internal, {_empty('alt_text')} FROM links l LEFT JOIN urls u ON u.id = l.from_url_id""",
    ),
    "content_export": (
        ("urls", "html_meta"),
        """ SELECT url, CAST(status_code AS VARCHAR) AS status_code, title, meta_description, CAST(word_count AS VARCHAR) AS word_count, CAST(n_chars AS VARCHAR) AS content_char_count, text AS content_text,
               CAST(NULL AS VARCHAR) AS content_markdown FROM urls JOIN documents ON doc_id = id AND doc_id % 3 > 0 LEFT JOIN html_meta ON url_id = id""",
    ),
    "stream_upsert_pages": (("urls",), " SELECT url_hash, CASE WHEN status_code = 200 THEN 304 ELSE status_code END AS status_code, CASE WHEN status_code = 200 THEN 2 ELSE 9 END AS crawl_depth FROM urls"),
}
QUERIES = {f.__name__: f for f in (ndjson_roundtrip, csv_export, links_export, content_export, stream_upsert_pages)}
ORACLES = {n: with_views(sql, *views) for n, (views, sql) in _SQL.items()}
