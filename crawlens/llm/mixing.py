"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources, in code point order with null last, have the weights given in turn
and share `share` of all sizes; a source's target stops at `limit` times its size and the excess goes to the others by
weight, until none is above. A source's target holds a number of whole passes over its documents and a rest. The rest
is fitted by document counts of each exact size. From the largest size down, each gives its part of the rest in whole
documents, but for FREE times the largest size; what that leaves over passes to the next size, and is never more than
FREE + 1 times the largest size (see proportional). So what is left of the budget is a bounded knapsack over the counts
that remain, in a table of 10 * (FREE + 1) bytes a word of the longest document, which dynamic programming solves for the
nearest sum. Which documents of a size are taken is decided by a seeded hash of doc_id, so reruns agree.

Only counts by source and size are gathered: one row for each size that a source has, dealt by source. The order within
a size is made in SLOTS hash slots, of which only one is cut, so that a size which very many documents have is no
single task. Sources are ranked in range partitions, and the budget is shared in rounds of one-row aggregates over them,
so that their number has no bound; nothing but those rows and one count a partition reaches the driver.

Null and empty texts have size 0 and are taken 0 words. Repeated rows are documents of their own, and rows that agree in
doc_id, source and size are taken alike or not in any order; a null doc_id is dealt at random, as nothing tells such rows
apart. Other columns are ignored. Where all of a source is taken or nothing, the result is exact; else it is as near as
whole documents come.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.common import SPACE, Tables

SLOTS, FREE = 256, 4


def words(text: str = "text") -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def shares(tables: Tables, sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """sizes (source, n), one row a source, with its target. In a round, sources whose part of what is left reaches limit
    times their size get that, and the others share the rest by weight; a part a unit of weight only grows, so that the
    rounds end when it stays."""
    order = F.col("source").asc_nulls_last()
    ids = sizes.repartitionByRange(order).sortWithinPartitions(order).select("*", F.monotonically_increasing_id().alias("id"))
    ids = tables.save(ids).withColumn("part", F.shiftright("id", 33))
    before, starts = 0, {}
    for r in ids.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts[r["part"]], before = before, before + r["n"]
    first = F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv])
    rank = first[F.col("part")] + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    rows = tables.save(ids.select("source", "n", weight.alias("w")))
    total, of = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    most = F.lit(float(limit)) * F.col("n")
    part, now = None, share * total / of if of else 0.0
    while part is None or now > part:
        part = now
        full = F.lit(part) * F.col("w") >= most
        spent, of = rows.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        now = (share * total - spent) / of if of else part
    return rows.select("source", "n", F.least(most, F.lit(part) * F.col("w")).alias("target"))


def proportional(sizes: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """How many documents of each size their part of the budget holds, with FREE times the largest size held back, and what
    is left over. From the largest size down: a size that has documents to spare leaves less than one of them beside what
    is held back, one that runs out of documents leaves at most what it was handed, as its own part is at most its own
    words. So at most FREE + 1 times the largest size is left."""
    total = int((sizes * counts).sum())
    take, left, held = np.zeros(len(sizes), np.int64), 0.0, FREE * int(sizes.max(initial=0))
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i]:
            have = left + int(sizes[i]) * int(counts[i]) * budget / total
            take[i] = min(int(counts[i]), int(max(0, have - held) // int(sizes[i])))
            left = have - int(take[i]) * int(sizes[i])
    return take, budget - int((sizes * take).sum())


def choose(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that the sum is as near to budget as whole documents come."""
    if budget >= int((sizes * counts).sum()):
        return counts.copy()
    take, left = proportional(sizes, counts, budget)
    rest = counts - take
    ok = (sizes > 0) & (rest > 0)
    items = []
    for i in np.flatnonzero(ok):
        n, step = int(min(rest[i], 2 * max(left, 1) // sizes[i] + 1)), 1
        while n:
            items.append((int(i), min(step, n)))
            n, step = n - min(step, n), step * 2
    top = 2 * left + 1 if len(items) and left else left + int(sizes[ok].max(initial=0))
    by = np.full(top + 1, -1, np.int32)  # the item that first reached each sum
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    for k, (i, n) in enumerate(items):
        w = int(sizes[i]) * n
        if w > top:
            continue
        new = np.flatnonzero(reached[: top + 1 - w] & ~reached[w:]) + w
        reached[new] = True
        by[new] = k
        if reached[left]:
            break
    sums = np.flatnonzero(reached)
    s = int(sums[np.argmin(np.abs(sums - left))])
    while s:
        i, n = items[by[s]]
        take[i] += n
        s -= n * int(sizes[i])
    return take


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 7, tables: Tables | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken."""
    tables = tables or Tables(docs.sparkSession)
    h = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).otherwise(F.xxhash64(F.lit(seed), F.col(doc_id)))
    rows = tables.save(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), h.alias("h"), F.pmod(h, F.lit(SLOTS)).cast("int").alias("slot")))
    return _mix(tables, rows, weights, share, limit)


def _mix(tables: Tables, rows: DataFrame, weights, share: float, limit: float) -> DataFrame:
    sizes = tables.save(rows.groupBy("source").agg(F.sum("size").alias("n")))
    some = F.col("n") > 0
    passes = F.when(some, F.least(F.floor(F.col("target") / F.col("n")), F.lit(int(limit)))).otherwise(0).cast("int")
    plan = shares(tables, sizes, weights, share, limit).withColumn("passes", passes)
    budget = F.when(some, F.round(F.col("target") - F.col("passes") * F.col("n"))).otherwise(0).cast("long")
    plan = tables.save(plan.select("source", F.col("n").alias("source_size"), "target", "passes", budget.alias("budget")))

    counts = rows.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    counts = tables.save(counts)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("size", kind="stable")
        take = choose(order["size"].to_numpy(np.int64), order["n"].to_numpy(np.int64), int(order["budget"].iloc[0]))
        return pd.DataFrame({"source": order["source"], "size": order["size"], "take": take})

    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_size = by_size.join(plan.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    take = by_size.groupBy("source").applyInPandas(fit, "source string, size long, take long")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = counts.withColumn("before", F.coalesce(before, F.lit(0))).alias("c").join(take.alias("t"), F.expr("c.source <=> t.source and c.size = t.size"))
    slots = slots.select("c.source", "c.size", "c.slot", F.greatest(F.lit(0), F.least(F.col("c.n"), F.col("t.take") - F.col("before"))).alias("first"))
    slots = slots.join(plan.select(F.col("source").alias("s"), "source_size", "target", "passes"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("h", "doc_id"))
    ranked = rows.withColumn("rank", rank).alias("r")
    got = ranked.join(slots.alias("x"), F.expr("r.source <=> x.source and r.size = x.size and r.slot = x.slot"))
    taken = F.col("r.size") * (F.col("passes") + F.when(F.col("rank") <= F.col("first"), 1).otherwise(0))
    return got.select("r.doc_id", "r.source", "r.size", "source_size", "target", taken.cast("long").alias("taken"))
