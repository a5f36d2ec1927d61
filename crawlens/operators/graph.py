"""The link graph: counts, PageRank, crawl depth, redirect chains, sitemap membership."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.functions.text import says_noindex
from crawlens.functions.url import normalize_url
from crawlens.storage import Tables

# Weight of a link by its position; an unknown position counts OTHER_POSITION.
POSITION_WEIGHTS = {"content": 1.0, "sidebar": 0.4, "aside": 0.35, "nav": 0.25, "header": 0.25, "footer": 0.15, "form": 0.1}
OTHER_POSITION = 0.3


def link_counts(urls: DataFrame, links: DataFrame) -> DataFrame:
    """urls with inlinks_count, unique_inlinks_count, outlinks_count and external_outlinks_count, 0 where there is no
    link. Links are aggregated by target and by source before they meet the pages, so hubs don't skew the joins."""
    by_pair = links.groupBy("job_id", "to_url_hash", "from_url_id").agg(F.count("*").alias("n"))
    into = by_pair.groupBy("job_id", "to_url_hash").agg(F.sum("n").alias("inlinks_count"), F.count("*").alias("unique_inlinks_count"))
    out = links.groupBy(F.col("job_id"), F.col("from_url_id").alias("id")).agg(F.count_if("is_internal").alias("outlinks_count"), F.count_if(~F.col("is_internal")).alias("external_outlinks_count"))
    counts = ("inlinks_count", "unique_inlinks_count", "outlinks_count", "external_outlinks_count")
    d = urls.drop(*counts).join(into.withColumnRenamed("to_url_hash", "url_hash"), ["job_id", "url_hash"], "left").join(out, ["job_id", "id"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})


def indexability_status(status: Column, meta_robots: Column, x_robots: Column, canonical: Column, url: Column) -> Column:
    """Why a page is not indexable, as the crawl sees it; Indexable otherwise."""
    out = F.when((status >= 500) & (status < 600), "5xx Server Error").when((status >= 400) & (status < 500), "4xx Client Error")
    out = out.when((status >= 300) & (status < 400), "3xx Redirect").when(says_noindex(meta_robots) | says_noindex(x_robots), "Noindex")
    away = (canonical != "") & (normalize_url(canonical) != normalize_url(url))
    return out.when(away, "Canonicalised").otherwise("Indexable")


def position_weight(position: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in POSITION_WEIGHTS.items() for x in kv])
    return F.coalesce(known[position], F.lit(OTHER_POSITION))


def pagerank_edges(urls: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, src, dst, w): followed internal links between internal pages, without self-links, the heaviest of each
    pair. Weights are reduced by source and target hash before the join that resolves targets."""
    pages = urls.where("is_internal").select("job_id", "id", "url_hash")
    some = links.where("is_internal and follow").withColumn("w", position_weight(F.col("link_position")))
    some = some.groupBy("job_id", "from_url_id", "to_url_hash").agg(F.max("w").alias("w"))
    e = some.join(pages.select("job_id", F.col("id").alias("dst"), F.col("url_hash").alias("to_url_hash")), ["job_id", "to_url_hash"])
    e = e.join(pages.select("job_id", F.col("id").alias("from_url_id")), ["job_id", "from_url_id"], "left_semi")
    return e.where("from_url_id <> dst").groupBy("job_id", F.col("from_url_id").alias("src"), "dst").agg(F.max("w").alias("w"))


def pagerank(urls: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, scale: float = 10.0) -> DataFrame:
    """(job_id, id, pagerank) for internal pages: weighted PageRank per job, mass of pages without links spread over all,
    until no page of any job moves by tolerance; scaled so that a job's greatest is `scale`, to 4 places.

    Each round reads the ranks three times and is therefore written; whether they still move is asked every five."""
    t = Tables(urls.sparkSession)
    nodes = urls.where("is_internal").select("job_id", "id").distinct()
    n = nodes.groupBy("job_id").agg(F.count("*").alias("n"))
    nodes = t.save(nodes.join(n, "job_id"))
    e = pagerank_edges(urls, links)
    total = e.groupBy("job_id", "src").agg(F.sum("w").alias("sum_w"))
    e = t.save(e.join(total, ["job_id", "src"]).select("job_id", "src", "dst", (F.col("w") / F.col("sum_w")).alias("p")))
    out = e.select("job_id", F.col("src").alias("id")).distinct().withColumn("has_out", F.lit(True))
    nodes = t.save(nodes.join(out, ["job_id", "id"], "left").withColumn("has_out", F.coalesce("has_out", F.lit(False))))
    ranks = last = nodes.withColumn("r", 1 / F.col("n"))
    for k in range(1, rounds + 1):
        lost = ranks.groupBy("job_id").agg(F.sum(F.when(~F.col("has_out"), F.col("r")).otherwise(0.0)).alias("lost"))
        got = e.join(ranks.select("job_id", F.col("id").alias("src"), "r"), ["job_id", "src"]).groupBy("job_id", F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("got"))
        new = ranks.join(got, ["job_id", "id"], "left").join(lost, "job_id")
        r = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        new = t.save(new.select("job_id", "id", "n", "has_out", r.alias("r"), F.abs(r - F.col("r")).alias("moved")))
        if k > 1:
            t.drop(last)
        last, ranks = new, new.drop("moved")
        if k % 5 == 0 or k == rounds:
            moved = new.agg(F.max("moved")).first()[0]
            if moved is None or moved < tolerance:
                break
    top = ranks.groupBy("job_id").agg(F.max("r").alias("top"))
    return ranks.join(top, "job_id").select("job_id", "id", F.round(F.col("r") / F.col("top") * scale, 4).alias("pagerank"))


def crawl_depth(urls: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(job_id, id, depth): the fewest links from a seed (job_id, id). One frontier join a level; each level is written."""
    t = Tables(urls.sparkSession)
    pages = urls.select("job_id", "id", "url_hash")
    e = links.select("job_id", "from_url_id", "to_url_hash").distinct().join(pages.select("job_id", F.col("id").alias("dst"), F.col("url_hash").alias("to_url_hash")), ["job_id", "to_url_hash"])
    e = t.save(e.select("job_id", F.col("from_url_id").alias("id"), "dst"))
    seen = frontier = t.save(seeds.select("job_id", "id").distinct().withColumn("depth", F.lit(0)))
    for d in count(1):
        reached = e.join(frontier.select("job_id", "id"), ["job_id", "id"]).select("job_id", F.col("dst").alias("id")).distinct()
        frontier = t.save(reached.join(seen.select("job_id", "id"), ["job_id", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = t.save(seen.unionByName(frontier))
    return seen


def redirect_chains(urls: DataFrame) -> DataFrame:
    """(job_id, url_id, chain, hops, loops) for each page with a redirect: the walk from it over redirects to a page that
    has none, or back to a page of the walk, so that every walk ends. One join a hop, over the walks that are still open."""
    t = Tables(urls.sparkSession)
    hop = t.save(urls.where("redirect_url is not null").groupBy("job_id", "url").agg(F.min_by("redirect_url", "id").alias("next")))
    start = urls.where("redirect_url is not null")
    open_ = start.select("job_id", F.col("id").alias("url_id"), F.array("url", "redirect_url").alias("chain"), (F.col("url") == F.col("redirect_url")).alias("loops"))
    done = None
    while True:
        step = open_.join(hop.withColumnRenamed("url", "_at"), (open_["job_id"] == hop["job_id"]) & (F.element_at("chain", -1) == F.col("_at")), "left").select(open_["job_id"], "url_id", "chain", "loops", "next")
        step = t.save(step)
        ended = step.where("loops or next is null").drop("next")
        done = ended if done is None else done.unionByName(ended)
        more = step.where("not loops and next is not null")
        open_ = more.select("job_id", "url_id", F.concat("chain", F.array("next")).alias("chain"), F.array_contains("chain", F.col("next")).alias("loops"))
        if more.isEmpty():
            break
    return done.select("job_id", "url_id", "chain", (F.size("chain") - 1).alias("hops"), "loops")


def redirect_hops(pages: DataFrame) -> DataFrame:
    """Rows (job_id, from_url, to_url, status, hop) from pages with an array of redirect URLs, their statuses (301 where
    unknown) and the final url."""
    hops = pages.select("job_id", F.concat("redirect_urls", F.array("url")).alias("u"), "redirect_statuses", F.posexplode("redirect_urls").alias("hop", "from_url"))
    return hops.select("job_id", "from_url", F.get("u", F.col("hop") + 1).alias("to_url"), F.coalesce(F.get("redirect_statuses", F.col("hop")), F.lit(301)).alias("status"), "hop")


def sitemap_membership(urls: DataFrame, listed: DataFrame, complete: DataFrame) -> DataFrame:
    """urls with in_sitemap: TRUE for listed hashes (job_id, url_hash); FALSE for others only where the job's sitemaps
    were read completely (complete: job_id, complete); else, and without any sitemap, NULL."""
    mark = listed.select("job_id", "url_hash").distinct().withColumn("_in", F.lit(True))
    d = urls.drop("in_sitemap").join(mark, ["job_id", "url_hash"], "left").join(complete, "job_id", "left")
    return d.withColumn("in_sitemap", F.when(F.col("_in"), True).when(F.col("complete"), False)).drop("_in", "complete")


def frontier(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Internal link targets that were never crawled, one row a hash (the first link's)."""
    new = links.where("is_internal").join(urls.select("job_id", F.col("url_hash").alias("to_url_hash")), ["job_id", "to_url_hash"], "left_anti")
    return new.groupBy("job_id", "to_url_hash").agg(F.min_by("to_url", "id").alias("to_url"), F.min("id").alias("link_id"))


def js_dependence(pages: DataFrame, template: Column) -> DataFrame:
    """By template: links only in the rendered page and mean words of both (raw_links, rendered_links, raw_words,
    rendered_words); the graph is reliable where no link is hidden."""
    hidden = F.size(F.array_except("rendered_links", "raw_links"))
    d = pages.groupBy(template.alias("template")).agg(F.count("*").alias("pages"), F.sum(hidden).alias("hidden_links"), F.avg("raw_words").alias("raw_words"), F.avg("rendered_words").alias("rendered_words"))
    return d.withColumn("graph_reliable", F.col("hidden_links") == 0)
