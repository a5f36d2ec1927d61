"""Quality selection by importance resampling.

Target text (good labelled documents) and raw text (the whole corpus) each have a generative model over hashed word
unigrams and bigrams. A document's importance is the ratio of the two, its logarithm the sum over its n-grams; Gumbel
noise from a seeded hash of doc_id makes the top k of log ratio plus noise a sample without replacement by importance.

Raw counts cover every document. The target model is fitted on at most about FIT labelled documents, chosen by hash,
which are marked by a broadcast join of that bound. Counts are BUCKETS numbers a task, summed by bucket; the two models
are one broadcast table of BUCKETS numbers. The k-th largest key is found by narrowing a quantile bracket, never by
sorting the corpus or gathering it.

Null and empty texts have no n-grams, weight 0. Repeated rows are documents of their own, with the same key; all keys
that tie with the k-th stay. Without labelled documents of either kind nothing can be told apart: all weights are 0
and all stay. Of several labels of a document the worst holds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import Tables, small_batches, trimmed
from crawlens.llm.near import PRIME, WordHash, mix

BUCKETS, FIT = 1 << 16, 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Tokens(WordHash):
    """token -> 64-bit hash"""

    def __missing__(self, token: str) -> int:
        self[token] = h = WordHash.__missing__(self, token.encode())
        return h


def buckets(text: str | None, known: Tokens) -> np.ndarray:
    """The buckets of a text's unigrams and bigrams."""
    tokens = TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    if len(known) > 200_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    both = np.concatenate([mix(h), mix(h[:-1] * PRIME + h[1:])])
    return (both % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts by bucket of all docs (text, target) and of the target ones."""

    def run(batches):
        known, raw, good = Tokens(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                n = np.bincount(buckets(text, known), minlength=BUCKETS)
                raw += n
                if target:
                    good += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    rows = docs.mapInArrow(trimmed(run), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    out = np.zeros((2, BUCKETS))
    out[0, rows.bucket], out[1, rows.bucket] = rows.raw, rows.good
    return out[0], out[1]


def log_ratio(raw: np.ndarray, good: np.ndarray, prior: float = 1.0) -> np.ndarray:
    """log of target over raw probability by bucket, with `prior` counts of raw proportions added to the target."""
    if not raw.sum() or not good.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1) / (raw + 1).sum()
    q = (good + prior * BUCKETS * p * 0.01) / (good + prior * BUCKETS * p * 0.01).sum()
    return np.log(q / p)


def weighted(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def run(batches):
        known = Tokens()
        for batch in batches:
            got = [buckets(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in got], pa.int64()), pa.array([float(shared.value[b].sum()) for b in got], pa.float64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def kth_largest(df: DataFrame, key: str, k: int, few: int = 100_000) -> float:
    """The k-th largest value of a double column without nulls, 1 <= k <= rows."""
    part = df.select(F.col(key).alias("x"))
    while (n := part.count()) > few:
        q = sorted({max(0.0, 1 - k / n - 0.002), min(1.0, 1 - k / n + 0.002)})
        got = part.agg(F.percentile_approx("x", q, 10_000).alias("q")).first()["q"]
        lo, hi = got[0], got[-1]
        above, inside = part.agg(F.count_if(F.col("x") > hi), F.count_if(F.col("x").between(lo, hi))).first()
        if not above < k <= above + inside:  # the bracket missed: look on the side where it is
            part, k = (part.where(F.col("x") > hi), k) if k <= above else (part.where(F.col("x") < lo), k - above - inside)
        elif lo == hi or inside == n:
            return lo if lo == hi else part.orderBy(F.desc("x")).offset(k - 1).first()["x"]
        else:
            part, k = part.where(F.col("x").between(lo, hi)), k - above
    return sorted((r["x"] for r in part.collect()), reverse=True)[k - 1]


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_grams, log_weight, key, kept. `share` of the documents are kept; where
    none is given, the share of good ones among the labelled (labels: doc_id, quality 0/1, toxic 0/1)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    per_doc = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality is not null and doc_id is not null")
    n, good = per_doc.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    share = share if share is not None else good / n if n else 1.0
    target = per_doc.where("quality = 1 and toxic = 0").select("doc_id", (F.xxhash64("doc_id").bitwiseAND(F.lit(2**53 - 1)) / 2**53).alias("h"))
    target = target.where(F.col("h") <= FIT / max(good, 1)).select("doc_id", F.lit(True).alias("target")).limit(2 * FIT)
    ratio = log_ratio(*counts(docs.join(F.broadcast(target), "doc_id", "left").select("text", "target")))
    tables = Tables(spark)
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit(2**53 - 1)) + 0.5) / 2**53
    rows = tables.save(weighted(docs, ratio).withColumn("key", F.col("log_weight") - F.log(-F.log(u))))
    total = rows.count()
    k = round(share * total)
    cut = kth_largest(rows, "key", k) if ratio.any() and 0 < k < total else float("-inf") if k else float("inf")
    return rows.select("doc_id", "n_grams", "log_weight", "key", (F.col("key") >= cut).alias("kept"))
