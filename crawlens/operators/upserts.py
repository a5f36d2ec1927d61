"""Sinks for crawl rows: the newest of each page with the least depth, children replaced by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_pages(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """One row a (job_id, url_hash): the fields of the newest row, the least crawl_depth of all."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("job_id", "url_hash", "crawl_depth")]
    best = both.groupBy("job_id", "url_hash").agg(F.max_by(F.struct(*rest), F.coalesce(order, F.lit(-1))).alias("r"), F.min("crawl_depth").alias("crawl_depth"))
    return best.select("job_id", "url_hash", "crawl_depth", "r.*").select(both.columns)


def upsert_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str = "url_id", order: str = "seq") -> DataFrame:
    """One row a page, the newest; rows of unknown pages are left."""
    both = old.unionByName(new, allowMissingColumns=True).join(parents.select(F.col("id").alias(key)), key, "left_semi")
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.coalesce(order, F.lit(-1))).alias("r")).select(key, "r.*").select(both.columns)


def replace_children(old: DataFrame, new: DataFrame, key: str = "url_id") -> DataFrame:
    """Rows of pages that come anew replace all their old rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_job(table: DataFrame, job_id: str) -> DataFrame:
    return table.where(F.col("job_id") != job_id)


def merged_config(old: dict, new: dict) -> dict:
    """A job's configuration with new top-level values; crawl_behavior is merged, the rest replaced."""
    out = old | {k: v for k, v in new.items() if k != "crawl_behavior"}
    if "crawl_behavior" in new:
        out["crawl_behavior"] = (old.get("crawl_behavior") or {}) | new["crawl_behavior"]
    return out
