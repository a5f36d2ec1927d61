"""Embedding near-deduplication with an inverted multi-index.

Vectors are halved and each half has its codebook; the two form a product grid, and a vector stands in the cell of its
nearest centroids. A query traverses the cells from the nearest on: both halves' centroids are ordered by the least
distance that a vector of theirs can have from the query (by the plane between the centroid and the query's nearest
one), and the traversal over the two sequences ends where the sum of the squares exceeds the squared distance that the
cosine threshold allows. Every cell that can hold a link is visited, so recall is 1 and not a matter of tuning.

What travels is small: a query goes once to each row of the grid that it visits, with one bit a cell of the row and a
sketch of a byte for each of the directions in which the vectors vary most. Distances between sketches, less their
rounding, are lower bounds; a query and a vector of a visited cell that the bound lets pass are marked. Only what is marked
is sent as a vector, and verified in double precision.

Codebooks are fitted on a sample of at most 2 * FIT vectors or FIT_BYTES bytes, chosen by hash; a codebook has about the
0.4th power of a label's vectors, so that rows visited a vector grow slower than that. Every vector is indexed and every
vector is a query. Equal vectors of a label are one class first. Rows of the grid are compared in parts of SKETCHES, marked
vectors in blocks of BLOCK by BLOCK, so a cell or label of any size is many tasks; a block gives each query's number of
links and, for the components, a spanning forest of its links instead of the links.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows without a
label; vectors of different length never link. Each row is a vector of its own, also with a repeated or null vec_id. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import Tables, components

FIT, FIT_BYTES, BLOCK, SKETCHES = 20_000, 64_000_000, 1024, 65_536
#: Directions that a sketch has, steps of a direction, and pairs that are compared at once.
DIRECTIONS, STEPS, AT_ONCE = 16, 127, 8_000_000


def _clean(vecs: DataFrame) -> DataFrame:
    """Adds dim (null for vectors that link with nothing), raw (components in double precision) and digest."""
    schema = T.StructType([*vecs.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("raw", T.BinaryType()), T.StructField("digest", T.BinaryType())])

    def run(batches):
        for batch in batches:
            dims, raws, digests = [], [], []
            for v in batch.column("embedding").to_pylist():
                a = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                ok = len(a) and np.isfinite(a).all() and a.any()
                raw = (a + 0.0).tobytes() if ok else None
                dims.append(len(a) if ok else None)
                raws.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(digests, pa.binary())], names=schema.names)

    return vecs.mapInArrow(run, schema)


def unit(raw: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def _k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = x[at == i].mean(0)
    return np.unique(c, axis=0)


class MultiIndex:
    """Two codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [_k_means(sample[:, : self.half], k), _k_means(sample[:, self.half :], k)]
        self.apart = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(2), 0)) for b in self.books]
        some = sample[:2000] - sample[:2000].mean(0)
        self.directions = np.linalg.svd(some, full_matrices=False)[2][:DIRECTIONS].T

    def _halves(self, x: np.ndarray):
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances to the centroids of both halves."""
        return [np.maximum((h * h).sum(1)[:, None] - 2 * h @ b.T + (b * b).sum(1), 0) for h, b in zip(self._halves(x), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each vector's cell."""
        a, b = (d.argmin(1) for d in self.distances(x))
        return a, b

    def sketches(self, x: np.ndarray) -> np.ndarray:
        return np.rint(x @ self.directions * STEPS).astype(np.int8)

    def traverse(self, x: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each vector visits, for links at a squared distance of at most `square`: the vector's number, a row of the
        grid, and the row's cells as bits. Of the second sequence, a row takes the cells up to where the sum is too great."""
        least = []
        for d, apart in zip(self.distances(x), self.apart, strict=True):
            gap = apart[d.argmin(1)]
            low = np.where(gap > 0, (d - d.min(1, keepdims=True)) / np.where(gap > 0, 2 * gap, 1), 0)
            least.append(np.maximum(low, 0) ** 2)
        p, q = least
        order = np.argsort(q, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        steps = np.take_along_axis(q, order, axis=1)
        stop = np.stack([np.searchsorted(s, square + 1e-9 - r, side="right") for s, r in zip(steps, p, strict=True)]) if len(x) else np.zeros(p.shape, int)
        of, row = np.nonzero(stop)
        bits = [np.packbits(place[of[i : i + 4096]] < stop[of[i : i + 4096], row[i : i + 4096], None], axis=1) for i in range(0, len(of), 4096)]
        return of, row, np.concatenate(bits) if bits else np.zeros((0, 1), np.uint8)


def sketch_limit(square: float, directions: int) -> float:
    """The greatest squared distance, in steps, between sketches of vectors at a squared distance of at most `square`:
    each direction of both is off by half a step at most."""
    return (math.sqrt(square) * STEPS + math.sqrt(directions) + 1e-6) ** 2


VISIT = ["cid", "side", "cell", "at", "sketch", "bits"]


def _visits(classes: DataFrame, index: dict[int, MultiIndex], square: float) -> DataFrame:
    """(cid, side, cell, at, sketch, bits), cell a row of the grid: side 1 where a class is indexed, with its column at;
    side 0 for each row that it visits, with the columns as bits. Lengths without an index have one cell and no sketch."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            cid, dim = batch.column("cid").to_numpy(), np.array(batch.column("dim").to_pylist())
            raw = batch.column("raw").to_pylist()
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                if int(d) not in shared.value:
                    none = [b""] * (2 * len(rows))
                    yield table(np.repeat(cid[rows], 2), np.tile([0, 1], len(rows)), [0] * len(none), [0] * len(none), none, none)
                    continue
                m, x = shared.value[int(d)], unit([raw[i] for i in rows])
                sketch = [s.tobytes() for s in m.sketches(x)]
                u, v = m.cells(x)
                yield table(cid[rows], [1] * len(rows), u, v, sketch, [b""] * len(rows))
                of, row, bits = m.traverse(x, square)
                yield table(cid[rows][of], [0] * len(of), row, [0] * len(of), [sketch[i] for i in of], [b.tobytes() for b in bits])

    def table(*cols):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=VISIT)

    return classes.select("cid", "dim", "raw").mapInArrow(run, "cid long, side int, cell int, at int, sketch binary, bits binary")


def marked(x: np.ndarray, at: np.ndarray, cid: np.ndarray, y: np.ndarray, bits: np.ndarray, other: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors (sketches x, columns at, ids cid) and which queries (sketches y, bits, ids other) are within the limit
    of one another, where the query visits the vector's cell."""
    mine, theirs = np.zeros(len(x), bool), np.zeros(len(y), bool)
    x = x.astype(np.float32)
    long = (x * x).sum(1)
    step = max(1, AT_ONCE // max(1, len(x)))
    for i in range(0, len(y), step):
        q = y[i : i + step].astype(np.float32)
        near = (q * q).sum(1)[:, None] + long - 2 * q @ x.T <= limit + 0.5
        rows, cols = np.nonzero(near)
        seen = (bits[i + rows, at[cols] >> 3] >> (7 - (at[cols] & 7)).astype(np.uint8)) & 1
        ok = (seen == 1) & (other[i + rows] != cid[cols])
        mine[cols[ok]] = theirs[i + rows[ok]] = True
    return mine, theirs


def _rows(values: list[bytes], kind: type) -> np.ndarray:
    """Values of one length as the rows of a matrix."""
    joined = b"".join(values)
    return (np.frombuffer(joined, kind) if joined else np.zeros(0, kind)).reshape(len(values), -1)


def _marked(rows: DataFrame, square: float) -> DataFrame:
    """(cid, side, cell): of the rows (block, side, cid, cell, at, sketch, bits), which are one block a part of a row of the
    grid, the vectors and visits that a link may join; a row may come more than once."""

    def run(batches):
        block = None
        held: dict[str, list] = {}  # the block's vectors, which come before its queries
        mark = np.zeros(0, bool)

        def end():
            if held and mark.any():
                yield table(held["cid"][mark], 1, held["cell"][mark])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy() for c in ("block", "side", "cid", "cell", "at")}
            text = {c: batch.column(c).to_pylist() for c in ("sketch", "bits")}
            cuts = np.flatnonzero((np.diff(cols["block"]) != 0) | (np.diff(cols["side"]) != 0)) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                if cols["block"][i] != block:
                    yield from end()
                    block, held, mark = cols["block"][i], {}, np.zeros(0, bool)
                mine = {c: cols[c][i:j] for c in ("cid", "cell", "at")}
                mine["sketch"] = _rows(text["sketch"][i:j], np.int8)
                if cols["side"][i] == 1:
                    held = {c: np.concatenate([held[c], x]) if held else x for c, x in mine.items()}
                    mark = np.zeros(len(held["cid"]), bool)
                elif held and not mine["sketch"].shape[1]:  # a length without an index
                    mark[:] = True
                    yield table(mine["cid"], 0, mine["cell"])
                elif held:
                    bits = _rows(text["bits"][i:j], np.uint8)
                    got, near = marked(held["sketch"], held["at"], held["cid"], mine["sketch"], bits, mine["cid"], sketch_limit(square, mine["sketch"].shape[1]))
                    mark |= got
                    yield table(mine["cid"][near], 0, mine["cell"][near])
        yield from end()

    def table(cid, side, cell):
        return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(np.full(len(cid), side), pa.int32()), pa.array(cell, pa.int32())], names=["cid", "side", "cell"])

    return rows.repartition("block").sortWithinPartitions("block", F.desc("side")).mapInArrow(run, "cid long, side int, cell int")


def _dealt(rows: DataFrame, sizes: DataFrame, by: list[str], block: int) -> DataFrame:
    """rows with qpart and xpart: queries (side 0) and vectors of a group in parts of about `block`, each part of the one
    with each part of the other. sizes: the groups with their numbers of both, written."""
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    v = rows.join(sizes.where("nq > 0 and nx > 0").select(*by, parts("nq").alias("nq"), parts("nx").alias("nx")), by)
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("side") == 0, F.col("nq")).otherwise(F.col("nx"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nx")).otherwise(F.col("nq")) - 1)
    v = v.withColumn("own", own).withColumn("other", F.explode(others))
    qpart = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    xpart = F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    return v.withColumn("qpart", qpart).withColumn("xpart", xpart).drop("own", "other", "nq", "nx")


def _sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col("side") == 0).alias("nq"), F.count_if(F.col("side") == 1).alias("nx"))


def _blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, other): a query's links in a block and a vertex that it is connected with there (other is null
    where there is none); rows with links 0 tell how indexed vectors are connected."""

    def links(group):
        side = np.array([g[0] for g in group])
        cid = np.array([g[1] for g in group], np.int64)
        mult = np.array([g[2] for g in group], np.int64)
        q, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(q) or not len(x):
            return
        u = unit([g[3] for g in group])
        hit = (u[q] @ u[x].T >= threshold) & (cid[q][:, None] != cid[x][None])
        rows_, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows_):
            return
        hit, a, b = hit[np.ix_(rows_, cols)], cid[q][rows_], cid[x][cols]
        n = hit @ mult[x][cols]
        top = np.iinfo(np.int64).max
        la, lb = a.copy(), b.copy()
        while True:
            na = np.minimum(la, np.where(hit, lb[None], top).min(1))
            nb = np.minimum(lb, np.where(hit, na[:, None], top).min(0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        yield from zip(a.tolist(), n.tolist(), la.tolist(), strict=True)
        yield from zip(b.tolist(), [0] * len(b), lb.tolist(), strict=True)

    def run(batches):
        key, group = None, []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["cid", "links", "other"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("label", "dim", "cell", "qpart", "xpart", "side", "cid", "mult", "raw")]
            out = []
            for *k, side, cid, mult, raw in zip(*cols, strict=True):
                if k != key:
                    if group:
                        out += links(group)
                    key, group = k, []
                group.append((side, cid, mult, raw))
            yield batch_of(out)
        yield batch_of(list(links(group)) if group else [])

    by = ["label", "dim", "cell", "qpart", "xpart"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "cid long, links long, other long")


def dedup(vecs: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", k: int | None = None) -> DataFrame:
    """One row for each row of vecs: vec_id, n_links, component_id, kept. Links are at cosine >= threshold, in a label. k:
    centroids of a half, instead of a number by the labels' size."""
    spark = vecs.sparkSession
    tables = Tables(spark)
    vecs = vecs.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    rows = tables.save(_clean(vecs).drop("embedding"))
    some = rows.where("dim is not null and label is not null")
    reps = some.groupBy("label", "digest").agg(F.min("rid").alias("cid"), F.count("*").alias("mult"))
    reps = tables.save(reps)
    members = some.select("rid", "label", "digest").join(reps, ["label", "digest"]).select("rid", "cid", "mult")
    members = tables.save(members)
    classes = tables.save(some.join(reps.select(F.col("cid").alias("rid"), "mult"), "rid").select(F.col("rid").alias("cid"), "label", "dim", "raw", "mult"))

    n = {r["dim"]: (r["n"], r["labels"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect()}
    total, bytes_ = sum(v[0] for v in n.values()), sum(8 * d * v[0] for d, v in n.items())
    share = min(FIT / max(total, 1), FIT_BYTES / max(bytes_, 1) / 2)
    most = 2 * max(1, round(share * total))
    sample = classes.where(F.xxhash64("cid").bitwiseAND(F.lit(2**53 - 1)) / 2**53 <= share).select("cid", "dim", "raw").limit(most).collect()
    index = {}
    for dim, (count, labels) in n.items():
        fit = [bytes(r["raw"]) for r in sorted(sample, key=lambda r: r["cid"]) if r["dim"] == dim]
        if fit and dim > 1:
            index[dim] = MultiIndex(unit(fit), k or max(2, min(len(fit) // 8, round((count / max(labels, 1)) ** 0.4))))

    square, by = 2 - 2 * threshold, ["label", "dim", "cell"]
    visits = tables.save(_visits(classes, index, square).join(classes.select("cid", "label", "dim"), "cid"))
    dealt = _dealt(visits, tables.save(_sizes(visits, by)), by, SKETCHES)
    near = _marked(dealt.select(F.xxhash64(*by, "qpart", "xpart").alias("block"), *VISIT), square).distinct()
    near = tables.save(near.join(classes.select("cid", "label", "dim", "mult"), "cid"))
    tables.drop(visits)
    v = _dealt(near, tables.save(_sizes(near, by)), by, BLOCK)
    found = tables.save(_blocks(v.join(classes.select("cid", "raw"), "cid"), threshold))

    links = tables.save(found.groupBy("cid").agg(F.sum("links").alias("links")))
    roots = components(tables, found.select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cid")
    got = members.join(links, "cid", "left").join(tables.save(roots), "cid", "left")
    got = got.select("rid", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    out = rows.select("rid", "vec_id").join(got, "rid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rid").alias("root"))
    out = tables.save(out)
    least = tables.save(out.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    return out.join(least, "root").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
