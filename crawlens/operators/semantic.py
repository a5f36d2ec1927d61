"""Vector analytics over page embeddings: weights, centroid, rings, pairs, drift, gaps.

Scalars of the whole site (bounds, percentiles, the centroid) are one-row aggregates that are joined back as such. Pairs
are found in blocks of vectors inside Arrow tasks; only pairs above the threshold leave them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.storage import Tables

FLOOR = 1e-6
BRAND_PAIRS = 10


def eligible(pages: DataFrame, min_words: int = 150) -> DataFrame:
    n = F.size(F.filter(F.split("content_text", r"\s+"), lambda w: w != ""))
    return pages.where((F.col("status_code") == 200) & F.col("is_html") & F.col("indexable") & (n >= min_words))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def weights(pages: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """pages (pagerank, clicks) with pr_norm, clicks_norm and weight: log values scaled to 0..1 (0 if all are equal). A
    site without clicks counts PageRank alone."""
    if not (0 <= alpha <= 1 and 0 <= beta <= 1 and abs(alpha + beta - 1) < 1e-9):
        raise ValueError("alpha and beta must lie in 0..1 and sum to 1")
    d = pages.withColumn("_p", F.log1p(F.coalesce("pagerank", F.lit(0.0)))).withColumn("_c", F.log1p(F.coalesce("clicks", F.lit(0.0))))
    b = d.agg(F.min("_p").alias("p0"), F.max("_p").alias("p1"), F.min("_c").alias("c0"), F.max("_c").alias("c1"), F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("any"))
    scaled = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    d = d.crossJoin(F.broadcast(b)).withColumn("pr_norm", scaled("_p", "p0", "p1")).withColumn("clicks_norm", scaled("_c", "c0", "c1"))
    mixed = F.when(F.col("any") > 0, alpha * F.col("pr_norm") + beta * F.col("clicks_norm")).otherwise(F.col("pr_norm"))
    return d.withColumn("weight", F.greatest(mixed, F.lit(FLOOR))).drop("_p", "_c", "p0", "p1", "c0", "c1", "any")


def centroid(pages: DataFrame) -> DataFrame:
    """One row: the weighted mean of the unit vectors, at length 1."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(unit(F.col("embedding"))), F.col("weight"))
    return pages.select(mean.alias("m")).select(unit(vector_to_array("m")).alias("centroid"))


def distances(pages: DataFrame) -> DataFrame:
    """pages with distance_to_centroid."""
    return pages.crossJoin(F.broadcast(centroid(pages))).withColumn("distance_to_centroid", distance(unit(F.col("embedding")), F.col("centroid"))).drop("centroid")


def thresholds(pages: DataFrame, column: str = "distance_to_centroid") -> DataFrame:
    q = pages.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75), F.lit(0.95))).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select(q1.alias("q1"), q3.alias("q3"), F.col("q")[2].alias("p95"), (q3 + 1.5 * (q3 - q1)).alias("limit"))


def rings(pages: DataFrame, column: str = "distance_to_centroid") -> DataFrame:
    """pages with ring and semantic_role."""
    d, x = pages.crossJoin(F.broadcast(thresholds(pages, column))), F.col(column)
    ring = F.when(x <= F.col("q1"), "Core").when(x <= F.col("q3"), "Focus").when(x <= F.col("limit"), "Expansion").otherwise("Peripheral")
    role = F.when(x > F.col("limit"), "outlier").when(F.col("ring") == "Core", "core").otherwise("peripheral")
    return d.withColumn("ring", ring).withColumn("semantic_role", role).drop("q1", "q3", "p95", "limit")


def _centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k directions around which unit vectors lie."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (sample @ c.T).argmax(1)
        for i in range(k):
            m = sample[at == i].sum(0)
            c[i] = m / n if (n := np.linalg.norm(m)) > 0 else c[i]
    return c


def _around(v: DataFrame, centres: np.ndarray) -> DataFrame:
    """v (id, weight, u) with the nearest centre of each vector and its angle to it."""

    def run(batches):
        for batch in batches:
            u = np.array(batch.column("u").to_pylist(), float).reshape(batch.num_rows, -1)
            cos = u @ centres.T
            cell = cos.argmax(1) if len(u) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cos[np.arange(len(u)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=[*batch.schema.names, "cell", "angle"])

    return v.mapInArrow(run, T.StructType([*v.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def pairs(pages: DataFrame, threshold: float = 0.92, block: int = 4096, most_cells: int = 128, sample: int = 4096) -> DataFrame:
    """Pairs (id_dominant, id_weak, cosine) at cosine >= threshold; the greater weight dominates, the smaller id on a tie.

    Vectors lie around centres (of a bounded sample); two cells are compared only if the angle between their centres, less
    the widest angles in both, leaves a pair at the threshold possible. A cell is dealt to parts of about `block` vectors;
    each pair of parts is one group of rows, compared as matrices. Zero vectors have no pairs."""
    spark = pages.sparkSession
    tables = Tables(spark)
    v = tables.save(pages.select("id", "weight", unit(F.col("embedding")).alias("u")).where(F.exists("u", lambda x: x != 0)))
    n = v.count()
    some = [r["u"] for r in v.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= (sample << 20) // max(n, 1)).orderBy("id").limit(2 * sample).select("u").collect()]
    some = some or [r["u"] for r in v.limit(1).select("u").collect()]
    k = max(1, min(most_cells, n // block, len(some)))
    centres = _centres(np.array(some, float), k) if some else np.zeros((1, 1))
    v = tables.save(_around(v, centres))
    of = {r["cell"]: (r["n"], r["r"]) for r in v.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()}
    apart, wide = np.arccos(np.clip(centres @ centres.T, -1, 1)), np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    parts = {c: -(-m // block) for c, (m, _) in of.items()}
    near = [(c, d, parts[c], parts[d]) for c in of for d in of if c == d or apart[c, d] - of[c][1] - of[d][1] <= wide]
    near = spark.createDataFrame(near, "cell int, ocell int, own int, others int")
    v = v.join(F.broadcast(near), "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    v = v.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, other = F.struct("cell", F.col("b").alias("p")), F.struct(F.col("ocell").alias("cell"), F.col("o").alias("p"))
    v = v.select("id", "weight", "u", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), (mine > other).cast("int").alias("side"))

    def links(i, j, side, ids, w, u):
        side, ids, w, u = np.array(side), np.array(ids), np.array(w), np.array(u, float)
        left = np.flatnonzero(side == 0)
        right = left if i == j else np.flatnonzero(side == 1)
        for k in range(0, len(left), 1024):
            cos = u[left[k : k + 1024]] @ u[right].T
            a, b = np.nonzero(cos >= threshold)
            for p, q, c in zip(left[k + a], right[b], cos[a, b], strict=True):
                if i == j and ids[p] >= ids[q]:
                    continue
                first = (w[p], -ids[p]) >= (w[q], -ids[q])
                x, y = (p, q) if first else (q, p)
                yield int(ids[x]), int(ids[y]), round(float(c), 4)

    def run(batches):
        key, held = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["id_dominant", "id_weak", "cosine"])

        for batch in batches:
            made = []
            for i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side", "id", "weight", "u")), strict=True):
                i, j = tuple(i.values()), tuple(j.values())
                if (i, j) != key:
                    if held:
                        made += links(*key, *zip(*held, strict=True))
                    key, held = (i, j), []
                held.append(row)
            yield out(made)
        yield out(list(links(*key, *zip(*held, strict=True))) if held else [])

    return v.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "id_dominant long, id_weak long, cosine double")


def drift(pages: DataFrame, n: int = 20) -> DataFrame:
    """The pages that pull most from the centroid: weight times distance."""
    return pages.withColumn("drift", F.col("weight") * F.col("distance_to_centroid")).orderBy(F.desc("drift"), "id").limit(n)


def gap(pages: DataFrame, query: DataFrame, n: int = 20) -> DataFrame:
    """The pages nearest to a query vector (one row: query) by cosine, with their cosine to the centroid."""
    d = pages.crossJoin(F.broadcast(query)).crossJoin(F.broadcast(centroid(pages))).withColumn("u", unit(F.col("embedding")))
    d = d.withColumn("cosine", dot(F.col("u"), unit(F.col("query")))).withColumn("cosine_to_centroid", dot(F.col("u"), F.col("centroid")))
    return d.orderBy(F.desc("cosine"), "id").limit(n).drop("u", "query", "centroid")


def target_rings(pages: DataFrame, query: DataFrame) -> DataFrame:
    """pages with distance_to_target, target_ring, alignment (cosine of centroid and target), and what to do: reinforce
    near pages of low weight, refocus far pages of high weight."""
    q = query.select(unit(F.col("query")).alias("target"))
    c = centroid(pages)
    d = pages.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(c))
    d = d.withColumn("distance_to_target", distance(unit(F.col("embedding")), F.col("target"))).withColumn("alignment", dot(F.col("centroid"), F.col("target")))
    r = rings(d.drop("ring", "semantic_role"), "distance_to_target").withColumnRenamed("ring", "target_ring").drop("semantic_role")
    m = r.agg(F.median("distance_to_target").alias("md"), F.median("weight").alias("mw"))
    r = r.crossJoin(F.broadcast(m))
    near, heavy = F.col("distance_to_target") <= F.col("md"), F.col("weight") >= F.col("mw")
    return r.withColumn("action", F.when(near & ~heavy, "reinforce").when(~near & heavy, "refocus")).drop("md", "mw", "target", "centroid")


def action_lists(targets: DataFrame, n: int = 10) -> DataFrame:
    """The n nearest pages to reinforce and the n heaviest to refocus."""
    a = targets.where("action = 'reinforce'").orderBy("distance_to_target", "id").limit(n)
    return a.unionByName(targets.where("action = 'refocus'").orderBy(F.desc("weight"), "id").limit(n))


def site_metrics(ringed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: focus, radius, drift of the five heaviest, ring counts, clusters, outliers, pairs, thresholds."""
    d = ringed.agg(F.count("*").alias("pages"), F.avg("distance_to_centroid").alias("mean"), *[F.count_if(F.col("ring") == r).alias(r.lower()) for r in ("Core", "Focus", "Expansion", "Peripheral")], F.count_if(F.col("semantic_role") == "outlier").alias("outliers"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"))
    top = drift(ringed, 5).agg(F.avg("drift").alias("drift"))
    d = d.crossJoin(thresholds(ringed)).crossJoin(top).crossJoin(found.agg(F.count("*").alias("pairs")))
    return d.withColumn("focus", F.when(F.col("p95") > 0, 1 - F.col("mean") / F.col("p95")).otherwise(0.0)).withColumnRenamed("p95", "radius").drop("mean")


def gsc_summary(rows: DataFrame) -> DataFrame:
    """Clicks, impressions, click rate and the position weighted by impressions."""
    known = F.col("position").isNotNull()
    d = rows.agg(F.count("*").alias("rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.when(known, F.col("position") * F.col("impressions"))).alias("_p"))
    rate = lambda a: F.when(F.col("impressions") > 0, a / F.col("impressions"))
    return d.withColumn("avg_ctr", F.round(rate(F.col("clicks")), 4)).withColumn("avg_position", F.round(rate(F.col("_p")), 1)).drop("_p")


def gsc_to_urls(rows: DataFrame, urls: DataFrame, normal, forms) -> DataFrame:
    """rows (url, ...) with url_id: the page of exactly this URL, else of the same normal form. Of several such pages, it is
    one whose URL has no tracking parameters but the row's first ones, most of them if it can be: forms gives these forms of
    a URL, from the nearest on. The page with the least id stands for those that are left."""
    exact = urls.groupBy("url").agg(F.min("id").alias("_exact"))
    near = urls.groupBy(forms(F.col("url"))[0].alias("_f")).agg(F.min("id").alias("_near"))
    close = urls.withColumn("_n", normal(F.col("url"))).groupBy("_n").agg(F.min("id").alias("_close"))
    tried = rows.select("url").distinct().select("url", F.posexplode(forms(F.col("url"))).alias("_at", "_f")).join(near, "_f")
    tried = tried.groupBy("url").agg(F.min_by("_near", "_at").alias("_near"))
    d = rows.withColumn("_n", normal(F.col("url"))).join(exact, "url", "left").join(tried, "url", "left").join(close, "_n", "left")
    return d.withColumn("url_id", F.coalesce("_exact", "_near", "_close")).drop("_exact", "_near", "_close", "_n")


def shared_queries(found: DataFrame, queries: DataFrame, brands: list[str] = (), limit: int = 10) -> DataFrame:
    """found pairs with the search queries both pages rank for (lower case, none with a brand term), sorted, ten at most."""
    q = queries.select("url_id", F.lower("query").alias("query")).distinct()
    for b in brands:
        q = q.where(~F.col("query").contains(b.lower()))
    p = found.select("id_dominant", "id_weak")
    both = p.join(q.withColumnRenamed("url_id", "id_dominant"), "id_dominant").join(q.withColumnRenamed("url_id", "id_weak"), ["id_weak", "query"])
    from pyspark.sql import Window

    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("id_dominant", "id_weak").orderBy("query"))).where(F.col("_n") <= limit)
    shared = first.groupBy("id_dominant", "id_weak").agg(F.array_sort(F.collect_list("query")).alias("queries"))
    return found.join(shared, ["id_dominant", "id_weak"], "left").withColumn("queries", F.coalesce("queries", F.array().cast("array<string>"))).withColumn("n_shared", F.size("queries"))


SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
BLANK_LINES = re.compile(r"\n\s*\n")


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each job (job_id, id, created_at)."""
    rest = F.struct(*[c for c in analyses.columns if c != "job_id"])
    return analyses.groupBy("job_id").agg(F.max_by(rest, F.struct("created_at", "id")).alias("a")).select("job_id", "a.*").select(analyses.columns)


def pair_view(found: DataFrame, urls: DataFrame, gsc: DataFrame, queries: DataFrame, brands: list[str] = ()) -> DataFrame:
    """found pairs with both URLs, their clicks and positions, and the search queries that they share, closest first."""
    names = urls.select("id", "url").join(gsc.select(F.col("url_id").alias("id"), "clicks", "position"), "id", "left")
    side = lambda s: names.select(F.col("id").alias(f"id_{s}"), F.col("url").alias(f"url_{s}"), F.col("clicks").alias(f"{s}_clicks"), F.col("position").alias(f"{s}_position"))
    d = shared_queries(found, queries, brands).join(side("dominant"), "id_dominant", "left").join(side("weak"), "id_weak", "left")
    return d.orderBy(F.desc("cosine"), "id_dominant", "id_weak")


def _units(text: str, size: int) -> list[str]:
    """What a chunk may not cut: paragraphs, but sentences where there is one paragraph or where one has over `size` words."""
    pieces = lambda p, x: [s for s in map(str.strip, p.split(x)) if s]
    paragraphs = pieces(BLANK_LINES, text)
    whole = size if len(paragraphs) > 1 else -1
    return [u for p in paragraphs for u in ([p] if len(p.split()) <= whole else pieces(SENTENCE_END, p))]


def chunk(text: str, size: int = 500, overlap: int = 50, least: int = 10) -> list[str]:
    """Chunks are ranges of units: as many as have at most `size` words together (one at least), joined by a space. The
    next range starts early enough to repeat at most `overlap` words; chunks under `least` words are left."""
    units = _units(text, size)
    before = list(accumulate((len(u.split()) for u in units), initial=0))  # words before each unit
    out, start, stop = [], 0, 0
    while stop < len(units):
        stop = max(stop + 1, bisect_right(before, before[start] + size) - 1)
        if before[stop] - before[start] >= least:
            out.append(" ".join(units[start:stop]))
        start = max(start, bisect_left(before, before[stop] - overlap))
    return out


def chunks(pages: DataFrame, text: str = "content_text", key: str = "url_id", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk, text): one row a chunk."""

    @F.arrow_udf("array<string>")
    def split(col: pa.Array) -> pa.Array:
        return pa.array([chunk(t, size, overlap) if t else [] for t in col.to_pylist()], pa.list_(pa.string()))

    return pages.select(key, F.posexplode(split(F.col(text))).alias("chunk", "text"))


def representative(chunk_vectors: DataFrame, key: str = "url_id") -> DataFrame:
    """The chunk whose vector is nearest to the page's mean; the first on a tie."""
    e = chunk_vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy(key, "i").agg(F.avg("x").alias("x")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    d = chunk_vectors.join(mean.select(key, F.transform("m", lambda s: s["x"]).alias("mean")), key)
    n = norm(F.col("mean")) * norm(F.col("embedding"))
    d = d.withColumn("cosine", F.when(n > 0, dot(F.col("mean"), F.col("embedding")) / n).otherwise(0.0))
    best = F.max_by(F.struct("chunk", "embedding"), F.struct("cosine", (-F.col("chunk")).alias("k")))
    return d.groupBy(key).agg(best.alias("b")).select(key, F.col("b.chunk").alias("chunk"), F.col("b.embedding").alias("embedding"))


def plane(pages: DataFrame, id_: str = "id") -> DataFrame:
    """(id, x, y): the first two principal components of the centred unit vectors; a linear stand-in for a manifold map."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = pages.select(id_, array_to_vector(unit(F.col("embedding"))).alias("u"))
    d = StandardScaler(withMean=True, withStd=False, inputCol="u", outputCol="c").fit(d).transform(d)
    d = PCA(k=2, inputCol="c", outputCol="p").fit(d).transform(d).withColumn("p", vector_to_array("p"))
    return d.select(id_, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def clusters(pages: DataFrame, k: int | None = None, least: int = 5, seed: int = 42) -> DataFrame:
    """(id, cluster_id): bisecting k-means, clusters under `least` pages are noise (-1); a stand-in for density clusters."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    d = pages.select("id", array_to_vector(unit(F.col("embedding"))).alias("features"))
    n = d.count()
    d = BisectingKMeans(k=k or max(2, min(20, n // 50)), seed=seed).fit(d).transform(d).withColumnRenamed("prediction", "cluster_id")
    big = d.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return d.join(big, "cluster_id", "left").select("id", F.when(F.col("n").isNotNull(), F.col("cluster_id")).otherwise(-1).alias("cluster_id"))


def ring_layout(ringed: DataFrame, radii: dict[str, float] | None = None) -> DataFrame:
    """Polar placement: a page's angle is its rank among the n of its ring, its radius the ring's. Adds x, y and needs_boost
    (low PageRank and no clicks)."""
    radii = radii or {"Core": 0.25, "Focus": 0.5, "Expansion": 0.75, "Peripheral": 1.0}
    r = F.create_map(*[F.lit(x) for kv in radii.items() for x in kv])[F.col("ring")]
    order = ["ring", "distance_to_centroid", "id"]
    # the place in a ring: rows in order, numbered within range partitions, less the rows before the ring
    d = Tables(ringed.sparkSession).save(ringed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    d = d.withColumn("_part", F.shiftright("_id", 33))
    parts = d.groupBy("_part", "ring").agg(F.count("*").alias("n"), F.min("_id").alias("first")).orderBy("first").collect()
    starts, total = [], {}
    for p in parts:
        starts.append((p["_part"], p["ring"], total.get(p["ring"], 0) - p["first"]))
        total[p["ring"]] = total.get(p["ring"], 0) + p["n"]
    table = [(part, ring, shift, total[ring]) for part, ring, shift in starts]
    d = d.join(F.broadcast(ringed.sparkSession.createDataFrame(table, "_part long, ring string, _shift long, _n long")), ["_part", "ring"])
    d = d.withColumn("_a", 2 * np.pi * (F.col("_id") + F.col("_shift")) / F.col("_n")).drop("_id", "_part", "_shift")
    return d.withColumn("x", r * F.cos("_a")).withColumn("y", r * F.sin("_a")).withColumn("needs_boost", (F.col("pr_norm") < 0.1) & (F.coalesce("clicks", F.lit(0.0)) == 0)).drop("_a", "_n")


def report(pages: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report: five heaviest pages a cluster, 15 closest pairs, 10 greatest drifts."""
    from pyspark.sql import Window

    w = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "id")
    return {"clusters": pages.withColumn("rank", F.row_number().over(w)).where("rank <= 5"), "pairs": found.orderBy(F.desc("cosine"), "id_dominant", "id_weak").limit(15), "drift": drift(pages, 10)}
