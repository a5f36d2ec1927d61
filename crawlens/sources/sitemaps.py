"""robots.txt and sitemap files as tables."""

from __future__ import annotations

import gzip
import re
import zlib
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.functions.url import resolve
from crawlens.storage import Tables

MAX_URLS, MAX_FILES = 50_000, 500


def robots_sitemaps(robots: DataFrame, text: str = "text", base: str = "base_url") -> DataFrame:
    """(base_url, sitemap, n): the Sitemap lines of robots.txt texts, resolved, each once in order."""
    lines = robots.select(F.col(base).alias("base_url"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("n", "line"))
    bare = F.btrim(F.substring_index("line", "#", 1))
    found = lines.select("base_url", "n", F.btrim(F.regexp_extract(bare, r"(?i)^sitemap\s*:\s*(.*)$", 1)).alias("u")).where("u <> ''")
    return found.withColumn("sitemap", resolve("base_url", "u")).groupBy("base_url", "sitemap").agg(F.min("n").alias("n"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _entries(body: bytes):
    """(kind, loc) of a sitemap's entries as far as the XML can be read; extensions' locs are left."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    root = None
    path: list[str] = []
    try:
        for i in range(0, len(body), 65_536):
            parser.feed(body[i : i + 65_536])
            for event, el in parser.read_events():
                if event == "start":
                    path.append(_local(el.tag))
                    root = root or path[0]
                    continue
                if len(path) == 3 and path[-1] == "loc" and path[1] in ("url", "sitemap"):
                    yield root, path[1], (el.text or "").strip()
                path.pop()
    except ElementTree.ParseError:
        # malformed from here on: plain entries are still found by their tags
        rest = re.findall(rb"<(?:\w+:)?(url|sitemap)\b[^>]*>\s*<(?:\w+:)?loc\b[^>]*>([^<]*)", body)
        for kind, loc in rest:
            yield root, kind.decode(), loc.decode("utf-8", "replace").strip().replace("&amp;", "&")


def parse_sitemap(body: bytes | str, base: str = "") -> tuple[list[str], list[str]]:
    """Page URLs and child sitemaps of a file, gzipped or not; nothing for what is no sitemap."""
    raw = body.encode() if isinstance(body, str) else body
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return [], []
    pages: dict[str, None] = {}
    children: dict[str, None] = {}
    for root, kind, loc in _entries(raw):
        if loc:
            url = urljoin(base, loc) if base else loc
            if url not in pages and url not in children:
                (children if kind == "sitemap" or root == "sitemapindex" else pages)[url] = None
        if len(pages) >= MAX_URLS:
            break
    return list(pages), list(children)


def entries(files: DataFrame, url: str = "url", body: str = "content") -> DataFrame:
    """(url, loc, is_sitemap) for sitemap files (url, content)."""

    def run(batches):
        for batch in batches:
            rows = [(u, loc, child) for u, b in zip(batch.column("u").to_pylist(), batch.column("b").to_pylist(), strict=True) if b is not None for child, locs in enumerate(parse_sitemap(b, u or "")) for loc in locs]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array([bool(c) for c in cols[2]], pa.bool_())], names=["url", "loc", "is_sitemap"])

    return files.select(F.col(url).alias("u"), F.col(body).alias("b")).mapInArrow(run, "url string, loc string, is_sitemap boolean")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored sitemap files under a folder: (url, content), the path as URL."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


def follow(files: DataFrame, roots: DataFrame, max_files: int = MAX_FILES) -> tuple[DataFrame, bool]:
    """All pages reachable from root sitemaps (url) through indexes over stored files (url, content), and whether the walk
    was complete: within max_files, with every file there."""
    t = Tables(files.sparkSession)
    found = t.save(entries(files))
    have = files.select("url").distinct()
    seen = frontier = t.save(roots.select("url").distinct())
    complete = frontier.join(have, "url", "left_anti").isEmpty()
    pages = None
    while True:
        got = t.save(found.join(frontier, "url"))
        leaf = got.where("not is_sitemap").select("loc")
        pages = leaf if pages is None else pages.unionAll(leaf)
        new = got.where("is_sitemap").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        room = max_files - seen.count()
        frontier = t.save(new.orderBy("url").limit(max(0, room)))
        n, cut = frontier.count(), new.count()
        complete = complete and n == cut and frontier.join(have, "url", "left_anti").isEmpty()
        if not n:
            return pages.distinct(), complete
        seen = t.save(seen.unionAll(frontier))
