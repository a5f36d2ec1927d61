"""Job archives: NDJSON of each table and a manifest, as a folder or as a ZIP file; import with new keys."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.storage import Tables

FORMAT_VERSION = "1.0"
#: table -> its key to the page, if it has one
TABLES = {"urls": None, "html_meta": "url_id", "headings": "url_id", "links": "from_url_id", "hreflang": "url_id", "structured_data": "url_id", "resources": "url_id", "page_content": "url_id", "security_headers": "url_id", "issues": "url_id"}


def export_job(tables: dict[str, DataFrame], path: str, job_id: str, include_content: bool = True) -> dict:
    """Writes a folder per table under path, then manifest.json; returns the manifest. Row counts come from one pass."""
    chosen = {n: d for n, d in tables.items() if n in TABLES and (include_content or n != "page_content")}
    for name, df in chosen.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    spark = next(iter(chosen.values())).sparkSession
    counts = None
    for name, df in chosen.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        counts = one if counts is None else counts.unionAll(one)
    manifest = {"format_version": FORMAT_VERSION, "job_id": job_id, "row_counts": {r["t"]: r["n"] for r in counts.collect()}, "has_page_content": "page_content" in chosen}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect()))
    if str(manifest.get("format_version", "")).split(".")[0] != FORMAT_VERSION.split(".")[0]:
        raise ValueError(f"format version {manifest.get('format_version')!r}")
    return manifest


def import_job(spark: SparkSession, path: str, schemas: dict[str, T.StructType], job_id: str, first_id: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of an archive under a new job, pages numbered from first_id in the order of their old keys, and a table
    of warnings (table, problem, n): lines that are no JSON, rows without a page key, rows whose page is not there."""
    read_manifest(spark, path)
    out, warnings = {}, []

    def warn(df: DataFrame, name: str, problem: str) -> None:
        warnings.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(problem).alias("problem"), "n"))

    def read(name: str) -> DataFrame:
        schema = T.StructType([*schemas[name].fields, T.StructField("_bad", T.StringType())])
        raw = spark.read.text(f"{path}/{name}").where("trim(value) <> ''")
        parsed = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
        warn(parsed.where("r is null or r._bad is not null"), name, "bad JSON")
        return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")

    urls = read("urls")
    # consecutive numbers without one global sort in a task: a range sort, then offsets of its partitions. It is written: run
    # again, the sort would draw other bounds, and partitions may be put together in another way
    part = urls.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    part = Tables(spark).save(part)
    sizes = {r["p"]: r["n"] for r in part.groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, offsets = first_id, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    offset = spark.createDataFrame(offsets, "p int, o long")
    ids = part.join(F.broadcast(offset), "p").select(F.col("id").alias("_old"), (F.col("o") + F.col("k")).alias("_new"))
    out["urls"] = urls.join(ids, F.col("id") == F.col("_old")).drop("id", "_old").withColumnRenamed("_new", "id").withColumn("job_id", F.lit(job_id))
    for name, key in TABLES.items():
        if key and name in schemas:
            rows = read(name)
            warn(rows.where(F.col(key).isNull()), name, "no page key")
            warn(rows.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_old"), "left_anti"), name, "unknown page")
            got = rows.join(ids, F.col(key) == F.col("_old")).drop(key, "_old").withColumnRenamed("_new", key)
            out[name] = got.withColumn("job_id", F.lit(job_id)) if "job_id" in got.columns else got
    found = warnings[0]
    for w in warnings[1:]:
        found = found.unionAll(w)
    return out, found.where("n > 0")


def zip_folder(spark: SparkSession, path: str) -> bytes:
    """The archive folder as one ZIP, for jobs that fit the driver's memory."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(read_manifest(spark, path)))
        for name in TABLES:
            try:
                lines = spark.read.text(f"{path}/{name}")
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    continue
                raise
            with z.open(f"{name}.ndjson", "w") as f:
                for r in lines.toLocalIterator():
                    f.write(r["value"].encode() + b"\n")
    return buffer.getvalue()


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, line) for the NDJSON members of the ZIP files under path, one task a file."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(".ndjson"):
                            with z.open(member) as f:
                                lines = [x.decode().rstrip("\n") for x in f]
                            table = member.removesuffix(".ndjson").rsplit("/", 1)[-1]
                            yield pa.RecordBatch.from_arrays([pa.array([x] * len(lines), pa.string()) for x in (name, table)] + [pa.array(lines, pa.string())], names=["file", "table", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, table string, line string")
