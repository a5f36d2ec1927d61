"""Crawl tables as Parquet, one partition a job: scans prune to the job, deletion is dropping its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.schemas import DDL, schema


def write(df: DataFrame, root: str, table: str) -> None:
    """Replaces the jobs in df (which has job_id) in a table under root; other jobs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{root}/{table}")


def scan(spark: SparkSession, root: str, table: str, job_id: str, *conditions: Column, columns: list[str] | None = None) -> DataFrame:
    """A job's rows of a table: partition, columns and conditions reach the Parquet scan."""
    kind = schema(table)
    if "job_id" not in kind.names:
        kind = schema(table).add("job_id", "string")
    df = spark.read.schema(kind).parquet(f"{root}/{table}").where(F.col("job_id") == job_id)
    for c in conditions:
        df = df.where(c)
    return df.select(columns) if columns else df


def missing(df: DataFrame, table: str) -> list[str]:
    """Columns of a table's schema that df lacks."""
    return [c for c in schema(table).names if c not in df.columns] if table in DDL else []


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the declared columns that it lacks as typed nulls: tables written before a column was declared."""
    kinds = {f.name: f.dataType for f in schema(table)}
    return df.withColumns({c: F.lit(None).cast(kinds[c]) for c in missing(df, table)})
