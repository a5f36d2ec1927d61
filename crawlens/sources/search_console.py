"""Search metrics from stored API responses: rows of keys, clicks, impressions, ctr, position."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAG_DAYS = 3
ROWS = "array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"


def window(today: date, days: int = 90) -> tuple[date, date]:
    """First and last day of a request: `days` long, ending before the days that are not final yet."""
    end = today - timedelta(days=LAG_DAYS)
    return end - timedelta(days=days), end


def read(spark: SparkSession, path: str, dimensions: tuple[str, ...] = ("url",)) -> DataFrame:
    """Stored JSON responses (one object a file or line, with `rows`) as (dimensions..., clicks, impressions, ctr, position)."""
    rows = spark.read.option("multiLine", True).schema(f"rows {ROWS}").json(path).select(F.explode("rows").alias("r"))
    keys = [F.get("r.keys", F.lit(i)).alias(name) for i, name in enumerate(dimensions)]
    return rows.select(*keys, F.col("r.clicks").cast("int").alias("clicks"), F.col("r.impressions").cast("int").alias("impressions"), F.round("r.ctr", 4).alias("ctr"), F.round("r.position", 1).alias("position"))
