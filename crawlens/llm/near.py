"""MinHash near-deduplication with odd sketches.

A text's set is its distinct five-word shingles. SAMPLES minimal hash values of a set give the keys of BANDS bands of
ROWS values each, and are folded into an odd sketch: a bitmap in which each sample flips one bit. Sets that share a
band key are candidates; the number of bits in which their sketches differ estimates a high similarity closely, and
candidates that it puts below the threshold by more than five standard errors are left. The rest is confirmed on full
sets (64-bit shingle hashes).

Groups of equal sets are one class with one representative before any band is built. In a bucket of classes, all are
first compared with the one whose buckets are fullest (the text the others were made from, if there is one) and what
that links is one component. Buckets that still hold several components are compared pair by pair between components:
small ones by a join, large ones in blocks inside a task that carries the full sets, so that no pairs are emitted but
links that join components. A bucket of any size is thus covered, and no link between components is lost.

Null texts and texts without words have an empty set and are linked with nothing; a text of fewer than five words is
one shingle. Each row is a document of its own, also with a repeated or null doc_id. With 25 bands of 5 values, a pair
at similarity 0.85 shares no band with a probability of 4e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import Tables, components, hinted, small_batches, trimmed

WORDS, BANDS, ROWS, BITS = 5, 25, 5, 256
SAMPLES = BANDS * ROWS
SMALL, CHUNK_ROWS, CHUNK_BYTES = 32, 1024, 16_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * PRIME)
FLIP, TIMES = SEEDS[:SAMPLES, None], SEEDS[SAMPLES:, None] | np.uint64(1)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: WordHash, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    if len(words) > 200_000:
        words.clear()
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * PRIME + h[i : len(h) - width + 1 + i]
    return np.unique(mix(out))


def samples(s: np.ndarray) -> np.ndarray:
    """The minimal value of the set under each of SAMPLES hash functions."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, ((s[None, i : i + 2048] ^ FLIP) * TIMES).min(1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME
    for column in low.reshape(BANDS, ROWS).T:
        out = mix(out * PRIME + column)
    return out


def odd_sketch(low: np.ndarray) -> np.ndarray:
    at = mix(low + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) % 2).astype(np.uint8)).view(np.uint64)


def most_bits(similarity: float, errors: float = 5.0) -> int:
    """The number of differing sketch bits above which a pair is left."""
    low = similarity - errors * (np.sqrt(similarity * (1 - similarity) / SAMPLES) + 0.003)
    return int(np.ceil(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - low) / BITS))))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.reshape(-1).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(r) for r in rows]])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), _signed(flat)).cast(pa.list_(pa.int64()))


def signatures(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n, digest, bands, sketch) for each row of docs (doc_id, text)."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("rid", T.LongType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", longs), T.StructField("sketch", longs)])

    def run(batches):
        rid, words = TaskContext.get().partitionId() << 36, WordHash()
        for batch in batches:
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                low = samples(s)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low))
                sketch.append(odd_sketch(low))
            rids = pa.array(np.arange(rid, rid + len(n)), pa.int64())
            rid += len(n)
            yield pa.RecordBatch.from_arrays([rids, batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(bands), _lists(sketch)], names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def full_sets(docs: DataFrame) -> DataFrame:
    """(digest, items) for each row of docs (text)."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches):
        words = WordHash()
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), _lists(sets)], names=schema.names)

    return docs.select("text").mapInArrow(trimmed(run), schema)


def _differ(a: str, b: str) -> Column:
    bits = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    a = sets.select(F.col("cid").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("items").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of the same large bucket. rows: (bkey, i, j, side, cid, comp, sketch, bands,
    items), where i and j are two parts of the bucket, compared with each other, and side says whose row it is."""
    limit = most_bits(percent / 100)

    def links(key, group):
        bkey, i, j = key
        cid, comp, side = (np.array([g[c] for g in group]) for c in ("cid", "comp", "side"))
        sketch, bands = (np.array([g[c] for g in group], np.int64) for c in ("sketch", "bands"))
        sketch = sketch.view(np.uint64)  # the bits of a negative number are not those of its absolute value
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if i != j else left
        parent: dict[int, int] = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for k in left:
            near = right[np.bitwise_count(sketch[k] ^ sketch[right]).sum(1) <= limit]
            near = near[comp[near] != comp[k]]
            if i == j:
                near = near[near > k]
            if len(near):  # each pair in the first band that it shares only
                same = bands[near] == bands[k]
                near = near[bands[k][same.argmax(1)] == bkey]
            for m in near:
                r, s = root(int(comp[k])), root(int(comp[m]))
                if r == s:
                    continue
                x, y = group[k]["items"], group[m]["items"]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    parent[r] = s
                    yield int(cid[k]), int(cid[m])

    def run(batches):
        key, group, out = None, [], []
        for batch in batches:
            items = batch.column("items")
            flat, ends = items.values.to_numpy(), items.offsets.to_numpy()
            small = batch.drop_columns(["items"]).to_pylist()
            for n, row in enumerate(small):
                row["items"] = flat[ends[n] : ends[n + 1]].copy()
                k = (row["bkey"], row["i"], row["j"])
                if k != key:
                    if group:
                        out += links(key, group)
                    key, group = k, []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
                out = []
        out = list(links(key, group)) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return rows.repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j").mapInArrow(trimmed(run), "a long, b long")


def dedup(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept. Links are at percent similarity or more."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = tables or Tables(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sigs = tables.save(signatures(docs))
    some = sigs.where("n > 0")
    # what joins with its own aggregate joins with a written one: AQE splits a hot key of plain shuffles only
    reps = tables.save(some.groupBy("digest").agg(F.min("rid").alias("cid")))
    members = some.select("rid", "digest").join(reps, "digest").select("rid", "cid")
    members = tables.save(members)
    heads = members.where("rid = cid").select(F.col("rid").alias("cid"))
    classes = tables.save(some.withColumnRenamed("rid", "cid").join(heads, "cid", "left_semi"))

    keys = classes.select("cid", F.explode("bands").alias("bkey"))
    sizes = tables.save(keys.groupBy("bkey").agg(F.count("*").alias("size")).where("size > 1"))
    buckets = tables.save(keys.join(sizes, "bkey").select("bkey", "cid", "size"))
    full = tables.save(buckets.groupBy("cid").agg(F.sum("size").alias("full")))
    near = tables.save(full.join(classes.select("cid", "doc_id", "digest", "n", "bands", "sketch"), "cid"))
    wanted = hinted(tables.save(near.select("doc_id").distinct()))
    sets = full_sets(docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi"))
    sets = sets.join(near.select("cid", "digest"), "digest").dropDuplicates(["cid"]).select("cid", "items")
    sets = tables.save(sets)

    pivots = tables.save(buckets.join(full, "cid").groupBy("bkey").agg(F.max(F.struct("full", F.col("cid").alias("b"))).alias("p")))
    sketch = near.select("cid", "sketch")
    star = buckets.join(pivots.select("bkey", "p.b"), "bkey").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    star = tables.save(star)
    limit = most_bits(percent / 100)

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketch.select(F.col("cid").alias("a"), F.col("sketch").alias("x")), "a")
        both = both.join(sketch.select(F.col("cid").alias("b"), F.col("sketch").alias("y")), "b")
        return both.where(_differ("x", "y") <= limit).select("a", "b")

    links = tables.save(verified(likely(star), sets, percent))
    first = tables.save(components(tables, links).withColumnRenamed("id", "cid").withColumnRenamed("root", "comp"))

    # buckets that still hold several components
    now = buckets.join(first, "cid", "left").select("bkey", "cid", "size", F.coalesce("comp", "cid").alias("comp"))
    now = tables.save(now)
    open_ = now.groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bkey")
    open_ = tables.save(open_)
    rest = tables.save(now.join(open_, "bkey", "left_semi"))
    x = rest.where(f"size <= {SMALL}").alias("x")
    y = rest.where(f"size <= {SMALL}").alias("y")
    pairs = x.join(y, F.expr("x.bkey = y.bkey and x.cid < y.cid and x.comp <> y.comp"))
    pairs = pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    more = verified(likely(pairs), sets, percent)

    large = rest.where(f"size > {SMALL}").join(near.select("cid", "n", "sketch", "bands"), "cid")
    parts = large.groupBy("bkey").agg(F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("parts"))
    parts = tables.save(parts)
    large = large.join(parts, "bkey").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    large = large.withColumn("other", other).select("bkey", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "cid", "comp", "sketch", "bands")
    more = tables.save(more.unionAll(_in_blocks(large.join(sets, "cid"), percent)))

    comp = first.select(F.col("cid").alias("id"), F.col("comp").alias("c"))
    joins = more.join(comp.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a", "left").join(comp.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b", "left")
    joins = joins.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(tables, joins).withColumnRenamed("id", "comp")
    roots = members.join(first, "cid", "left").select("rid", F.coalesce("comp", "cid").alias("comp"))
    roots = roots.join(second, "comp", "left").select("rid", F.coalesce("root", "comp").alias("root"))
    rows = sigs.select("rid", "doc_id", "n").join(roots, "rid", "left").select("rid", "doc_id", "n", F.coalesce("root", "rid").alias("root"))
    rows = tables.save(rows)
    least = tables.save(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(least, "root")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
