"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of BLOCK signs. Equal blocks get one integer name: distinct blocks are dealt
by value, sorted within their partition and numbered there, so that a name stands for one block and no hash is
trusted. Then adjacent names are paired and the distinct pairs named in the same way, round by round, until each
document has one name: two documents have the same name in the same round if and only if their texts are equal.

A text crosses the network once at most. Each task first numbers its own distinct blocks, so a block that very many
documents hold leaves a task about once, and the names travel back as integers. Sizes of groups are written before
they are joined, so that both sides of the join are plain shuffles, which AQE splits where one name is very frequent.
All rounds are written to the shared folder.

Null texts count as empty, and empty texts are equal. Each row is a document of its own, also with a repeated or null
doc_id; of equal texts the smallest doc_id stays (null ones last), and of rows with that same doc_id the first.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import SPACE, Tables, small_batches, trimmed

BLOCK = 4096
#: Runs of white space that are not one space already.
RUN = re.compile(f"[\\x09-\\x0D][{SPACE}]*|\\x20[{SPACE}]+")


def normalise(text: str | None) -> str:
    return RUN.sub(" ", text) if text else ""


def _blocks(docs: DataFrame, size: int, held: int = 48_000_000) -> DataFrame:
    """(rid, doc_id, sha, pos, n, at, same_as, block) for each block of docs (doc_id, text). `at` numbers blocks, and
    same_as is the number of the first equal block that the task still holds; only that row carries the text."""
    kind = docs.schema["doc_id"].dataType
    fields = [("rid", T.LongType()), ("doc_id", kind), ("sha", T.StringType()), ("pos", T.IntegerType()), ("n", T.IntegerType()), ("same_as", T.LongType()), ("block", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        rid = at = TaskContext.get().partitionId() << 36
        first: dict[str, int] = {}
        chars = 0
        for batch in batches:
            ids = batch.column("doc_id")
            out = {name: [] for name, _ in fields}
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                norm = normalise(text)
                sha = hashlib.sha256(norm.encode()).hexdigest()
                n = max(1, -(-len(norm) // size))
                for pos in range(n):
                    block = norm[pos * size : (pos + 1) * size]
                    same = first.get(block)
                    if same is None:
                        if chars > held:
                            first, chars = {}, 0
                        first[block] = same = at
                        chars += len(block) + 100
                        out["block"].append(block)
                    else:
                        out["block"].append(None)
                    out["same_as"].append(same)
                    out["rid"].append(rid)
                    out["sha"].append(None if pos else sha)
                    out["pos"].append(pos)
                    out["n"].append(n)
                    rows.append(i)
                    at += 1
                rid += 1
            del out["doc_id"]
            cols = [ids.take(pa.array(rows, pa.int64())) if name == "doc_id" else pa.array(out[name], t) for name, t in (("rid", pa.int64()), ("doc_id", None), ("sha", pa.string()), ("pos", pa.int32()), ("n", pa.int32()), ("same_as", pa.int64()), ("block", pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[name for name, _ in fields])

    return docs.mapInArrow(trimmed(run), schema)


def _named(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns and sorted within partitions, with an integer `name` that is equal where they are.
    Every partition numbers its own values, in their order."""
    names_of, kinds = df.columns, df.schema.fields

    def run(batches):
        name, last = (TaskContext.get().partitionId() << 36) - 1, None
        for batch in batches:
            values = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            names = []
            for v in values:
                if v != last:
                    name, last = name + 1, v
                names.append(name)
            rest = [c for c in names_of if c not in by]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(names, pa.int64())], names=[*rest, "name"])

    schema = T.StructType([f for f in kinds if f.name not in by] + [T.StructField("name", T.LongType())])
    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def identities(tables: Tables, docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, doc_id, sha, round, name) for each row of docs (doc_id, text): round and name together are the identity."""
    small_batches(docs.sparkSession)
    blocks = tables.save(_blocks(docs, size))
    names = _named(blocks.where("block is not null").select("same_as", "block"), "block")
    level = tables.save(blocks.select("rid", "pos", "n", "same_as").join(names, "same_as").select("rid", "pos", "n", "name"))
    most = blocks.agg(F.max("n")).first()[0] or 0
    rounds = [level.where("n = 1").select("rid", F.lit(0).alias("round"), "name")]
    left, k = most, 0
    while left > 1:
        k += 1
        half = F.expr("pos div 2").cast("int").alias("pos")
        pairs = level.where("n > 1").groupBy("rid", half).agg(F.max("n").alias("n"), F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        pairs = tables.save(pairs.select("rid", "pos", F.expr("cast((n + 1) div 2 as int)").alias("n"), "l", "r"))
        distinct = pairs.select("l", "r", F.col("l").alias("by_l"), F.col("r").alias("by_r")).distinct()
        names = _named(distinct, "by_l", "by_r")
        level = tables.save(pairs.join(names, ["l", "r"]).select("rid", "pos", "n", "name"))
        tables.drop(pairs)
        rounds.append(level.where("n = 1").select("rid", F.lit(k).alias("round"), "name"))
        left = (left + 1) // 2
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionAll(r)
    return blocks.where("pos = 0").select("rid", "doc_id", "sha").join(out, "rid")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK, tables: Tables | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    tables = tables or Tables(docs.sparkSession)
    ids = tables.save(identities(tables, docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = tables.save(ids.groupBy("round", "name").agg(first.alias("first"), F.count("*").alias("group_size")))
    return ids.join(groups, ["round", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"))
