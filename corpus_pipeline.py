"""The corpus pipeline: language identification, exact and near deduplication, mixing, tokenisation.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the docs of the next. All but the last return the columns of documents.

Nulls: a null text is `und` and goes at the first stage. Rows with a null doc_id stay where a stage decides by doc_id.
Rows that repeat a doc_id: equal texts are left once by the second stage; rows of one doc_id with different texts stay
or go together in the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlens.llm import bpe, exact, langid, mixing, near
from crawlens.llm.common import SPACE, Tables, hinted, without
from crawlens.llm.queries import TOKENIZERS

#: A language is accepted at this posterior; `und` never is.
SURE = 0.5

#: Up to so many rows the mix's decisions are broadcast (about 50 MB); beyond it, texts are shuffled to them.
BROADCAST_ROWS = 500_000

#: The stages' methods (subset sums, forward sums, merges) have no SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter and those of which no language is more likely than all others together."""
    labelled = docs.where(~langid.held_out()).select("text", "lang", F.col("doc_id").alias("key"))
    model = langid.train(labelled, f"{TOKENIZERS}/piece_bpe_32k.model")
    into = max(docs.columns, key=len) + "_language"  # no column's name
    got = langid.predict(docs, model, into=into)
    return got.where((F.col(f"{into}.lang_pred") != "und") & (F.col(f"{into}.score") >= SURE)).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, leaves the document with the smallest doc_id."""
    tables, work = Tables(spark), Tables(spark)
    got = exact.dedup(docs, tables=work)
    got = tables.save(got.select("doc_id", "keep_id", "kept", F.col("text_sha256").alias("sha")))
    work.clear()
    often = tables.save(got.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    gone = got.where("not kept").select("doc_id")
    if not often.count():
        return without(docs, gone)
    # documents with a repeated doc_id are told apart by their texts
    rows = docs.withColumn("_sha", F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{SPACE}]+", " "), 256))
    rows = rows.join(hinted(often), "doc_id", "left_semi")
    stay = got.where("kept").select("doc_id", F.col("sha").alias("_sha"))
    rows = rows.join(stay, ["doc_id", "_sha"], "left_semi")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_sha").orderBy("source", "lang"))).where("_n = 1")
    return without(docs, gone.unionAll(often)).unionByName(rows.select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more, leaves the one with the smallest doc_id."""
    tables, work = Tables(spark), Tables(spark)
    got = tables.save(near.dedup(docs, tables=work).where("not kept").select("doc_id"))
    work.clear()
    return without(docs, got)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each document as often as the mix takes it. Of rows that agree in doc_id, source and size, the n-th by text
    stands for the n-th most taken."""
    tables, work = Tables(spark), Tables(spark)
    same = Window.partitionBy("doc_id", "source", "size")
    got = mixing.mix(docs, tables=work).select("doc_id", "source", "size", F.expr("if(size > 0, taken div size, 0)").alias("times"))
    got = got.withColumn("n", F.count("*").over(same)).withColumn("k", F.row_number().over(same.orderBy(F.desc("times"))))
    got = tables.save(got.where("times > 0"))
    work.clear()
    one, more = got.where("n = 1"), got.where("n > 1")
    rows = docs.withColumn("_size", mixing.words())
    alike = F.expr("d.doc_id <=> g.doc_id and d.source <=> g.source and d._size = g.size")
    each = lambda d: d.select(*[F.col(f"d.{c}") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("g.times"))).alias("_n")).select(docs.columns)
    out = each(rows.alias("d").join(hinted(one, BROADCAST_ROWS).alias("g"), alike))
    if more.isEmpty():
        return out
    keys = tables.save(more.select("doc_id", "source", "size").distinct())
    twins = rows.alias("d").join(hinted(keys, BROADCAST_ROWS).alias("g"), alike, "left_semi")
    twins = twins.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy("text")))
    return out.unionByName(each(twins.alias("d").join(more.alias("g"), alike & F.expr("d._k = g.k"))))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what lies between them is written to the shared folder."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, tables.save(stage(spark, docs, sf_dir))
        if n:
            tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
