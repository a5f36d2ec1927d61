"""Crawl streams: pages deduplicated, upserted batch by batch, counted while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from crawlens.operators.upserts import upsert_pages


def page_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 200) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, at: str = "seen_at", within: str = "1 hour") -> DataFrame:
    """Each (job_id, url_hash) once; state is kept for `within` of event time."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(["job_id", "url_hash"])


def upsert_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps under path the newest row and least depth of each page. A batch writes a new version and then names it in
    `current`, so a batch that is run again gives the same table and readers never see half of one."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, before=batch_id)
        table = upsert_pages(old, batch) if old is not None else upsert_pages(batch.limit(0), batch)
        table.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("overwrite").json(f"{path}/current/{batch_id}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a table that upsert_to keeps; None before the first."""
    try:
        versions = [r["version"] for r in spark.read.schema("version long").json(f"{path}/current/*").collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None


def counters(stream: DataFrame, at: str = "seen_at", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Running counts by job, status group and minute; rows later than `late` are left."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), "job_id", "status_group").agg(F.count("*").alias("pages"))


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Beyond crawls: tumbling or sliding windows over an event stream (ts, event_type, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
