"""Shared pieces: batch sizes for Arrow, worker memory, size-checked broadcasts, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.storage import Tables

__all__ = ["SPACE", "Tables", "components", "hinted", "small_batches", "trimmed", "without"]

#: White space as the corpus contracts define it.
SPACE = "\\x20\\x09-\\x0D"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of a bounded number of rows: whole texts may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(run):
    """A function over batches that, when it has ended, gives the memory of its tables back to the system: Spark keeps
    its Python workers for later tasks."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, root), root the smallest id that id reaches. Vertices
    without an edge to another are left out. Alternates large-star and small-star steps. The minima are partial
    aggregates, written before they are joined back, so that AQE splits a vertex with very many neighbours."""
    e = tables.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = state(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tables.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.save(large)
        low2 = tables.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = tables.save(small.where("u <> v").distinct())
        tables.drop(e, large, low, low2)
        now, e = state(new), new
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


#: Up to so many keys, and so many bytes of them as text, a set of keys is broadcast; beyond it, the join shuffles.
BROADCAST_KEYS, BROADCAST_BYTES = 2_000_000, 100_000_000


def hinted(keys: DataFrame, most: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A written table of keys, to be broadcast if it has at most so many rows and bytes."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*keys.columns)))), F.lit(0))
    rows, held = keys.agg(F.count("*"), size).first()
    return F.broadcast(keys) if rows <= most and held <= most_bytes else keys


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs but for the rows whose key is in dropped (a column `key`); rows with a null key stay. Texts are shuffled only
    if there are too many keys to broadcast them."""
    dropped = dropped.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(hinted(dropped), key, "left_anti").select(docs.columns)
