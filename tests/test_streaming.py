import datetime as dt

from pyspark.sql import functions as F

from crawlens.streaming import pages

SCHEMA = "job_id string, url_hash string, status_group string, crawl_depth int, seq int, seen_at timestamp"


def stream(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([("j", h, g, d, s, dt.datetime(2024, 1, 1, 0, m)) for h, g, d, s, m in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    return pages.page_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema, 1)


def drain(df, tmp_path, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_first_seen(spark, tmp_path):
    s = stream(spark, tmp_path, [("a", "2xx", 1, 1, 0), ("b", "2xx", 1, 1, 1)], [("a", "2xx", 2, 2, 3), ("c", "4xx", 2, 2, 4)])
    got = drain(pages.first_seen(s), tmp_path, "seen")
    assert sorted(r["url_hash"] for r in got.collect()) == ["a", "b", "c"]


def test_counters_leave_late_rows(spark, tmp_path):
    s = stream(spark, tmp_path, [("a", "2xx", 1, 1, 1), ("b", "2xx", 1, 1, 1)], [("c", "4xx", 1, 1, 50)], [("d", "4xx", 1, 1, 51)], [("late", "2xx", 1, 1, 2), ("e", "4xx", 1, 1, 52)])
    got = drain(pages.counters(s), tmp_path, "counts").where("status_group = '2xx'").select(F.minute("window.start").alias("m"), "pages").collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_upsert_is_idempotent(spark, tmp_path):
    s = stream(spark, tmp_path, [("a", "2xx", 3, 1, 0)], [("a", "4xx", 5, 2, 1), ("b", "2xx", 1, 2, 1)])
    pages.upsert_to(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    pages.upsert_to(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = pages.current(spark, f"{tmp_path}/out").select("url_hash", "status_group", "crawl_depth")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "4xx", 3), ("b", "2xx", 1)]
    assert pages.current(spark, f"{tmp_path}/none") is None
