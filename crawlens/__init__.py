"""Website-crawl analytics on Spark: page facts, audit rules, link graph, scores, explorer queries, vectors, cleaning."""
