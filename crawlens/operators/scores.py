"""Score cards: one pass over each fact table, one row of scores. Percentages have one place, scores are whole numbers,
both rounded half to even."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of each card in the overall score.
SHARES = {"crawlability": 0.25, "content": 0.25, "links": 0.20, "security": 0.15, "structured_data": 0.10, "i18n": 0.05}


def _pct(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * a / b, 1))


def _above(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def _score(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(x, 0))).cast("int")


def _recs(*items: tuple[str, str, Column, Column]) -> Column:
    """Recommendations as an array of (priority, code, affected) where their condition holds."""
    made = [F.when(cond, F.struct(F.lit(p).alias("priority"), F.lit(code).alias("code"), n.cast("long").alias("affected"))) for p, code, cond, n in items]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def crawlability(urls: DataFrame) -> DataFrame:
    d = urls.agg(
        F.count_if("is_internal").alias("total"),
        *[F.count_if(F.col("is_internal") & (F.col("status_group") == g)).alias(f"n_{g}") for g in ("2xx", "3xx", "4xx", "5xx")],
        F.count_if(F.col("is_internal") & F.col("indexable")).alias("indexable"),
    )
    d = d.withColumns({f"pct_{g}": _pct(f"n_{g}", "total") for g in ("2xx", "3xx", "4xx", "5xx")} | {"pct_indexable": _pct("indexable", "total")})
    score = F.col("pct_2xx") * 0.5 + F.col("pct_indexable") * 0.3 + _above(100 - F.col("pct_4xx") * 5 - F.col("pct_5xx") * 10) * 0.2
    recs = _recs(
        ("alta", "fix_4xx", F.col("n_4xx") > 0, F.col("n_4xx")),
        ("alta", "fix_5xx", F.col("n_5xx") > 0, F.col("n_5xx")),
        ("media", "reduce_redirects", F.col("pct_3xx") > 10, F.col("n_3xx")),
        ("media", "improve_indexability", (F.col("total") > 0) & (F.col("pct_indexable") < 80), F.col("total") - F.col("indexable")),
    )
    return d.withColumn("score", _score(score)).withColumn("recommendations", recs)


def _issues(issues: DataFrame, **groups: tuple[str, ...]) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("issue_type").isin(*kinds)).alias(name) for name, kinds in groups.items()])


def content(urls: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue counts are of all URLs, the whole is the internal HTML pages."""
    page = F.col("is_internal") & F.col("is_html")
    u = urls.agg(F.count_if(page).alias("html"), F.coalesce(F.avg(F.when(page, F.col("word_count"))), F.lit(0.0)).alias("avg_words"))
    four = lambda n: tuple(f"{n}_{k}" for k in ("missing", "too_short", "too_long", "duplicate"))
    i = _issues(
        issues,
        title_missing=("title_missing",),
        title=four("title"),
        desc_missing=("description_missing",),
        desc=four("description"),
        h1=("h1_missing", "h1_multiple", "h1_duplicate"),
        thin=("low_word_count", "very_low_text_ratio", "low_text_ratio"),
    )
    d = u.crossJoin(i)
    ok = lambda c: _pct(F.greatest(F.lit(0), F.col("html") - F.col(c)), "html")
    d = d.withColumns({"pct_title_ok": ok("title"), "pct_desc_ok": ok("desc"), "pct_h1_ok": ok("h1"), "pct_thin": _pct("thin", "html")})
    score = F.col("pct_title_ok") * 0.3 + F.col("pct_desc_ok") * 0.25 + F.col("pct_h1_ok") * 0.2 + _above(100 - F.col("pct_thin") * 2) * 0.15 + F.least(F.lit(100.0), F.col("avg_words") / 3) * 0.1
    recs = _recs(
        ("alta", "add_titles", F.col("title_missing") > 0, F.col("title_missing")),
        ("media", "improve_titles", F.col("title") > F.col("title_missing"), F.col("title") - F.col("title_missing")),
        ("alta", "add_descriptions", F.col("desc_missing") > 0, F.col("desc_missing")),
        ("media", "fix_h1", F.col("h1") > 0, F.col("h1")),
        ("media", "extend_thin_content", F.col("thin") > 0, F.col("thin")),
    )
    return d.withColumn("score", _score(score)).withColumn("recommendations", recs)


def links(urls: DataFrame, links_: DataFrame, issues: DataFrame) -> DataFrame:
    page = F.col("is_internal") & F.col("is_html")
    u = urls.agg(F.count_if(page).alias("pages"), F.coalesce(F.avg(F.when(page, F.col("inlinks_count"))), F.lit(0.0)).alias("avg_inlinks"))
    k = links_.agg(F.count_if("is_internal").alias("internal_links"), F.count_if(F.col("is_internal") & ~F.col("follow")).alias("nofollow"))
    i = _issues(issues, orphans=("orphan_page",), broken=("4xx_error", "5xx_error"), high=("high_outlink_count",))
    d = u.crossJoin(k).crossJoin(i)
    d = d.withColumns({"pct_orphan": _pct("orphans", "pages"), "pct_nofollow": _pct("nofollow", "internal_links"), "pct_broken": _pct("broken", "pages")})
    score = _above(100 - F.col("pct_orphan") * 3) * 0.35 + F.least(F.lit(100.0), F.col("avg_inlinks") * 10) * 0.25 + _above(100 - F.col("pct_nofollow") * 2) * 0.15 + _above(100 - F.col("pct_broken") * 5) * 0.25
    recs = _recs(
        ("alta", "link_orphans", F.col("orphans") > 0, F.col("orphans")),
        ("alta", "fix_broken_links", F.col("broken") > 0, F.col("broken")),
        ("baja", "reduce_outlinks", F.col("high") > 0, F.col("high")),
    )
    return d.withColumn("score", _score(score)).withColumn("recommendations", recs)


def security(urls: DataFrame, headers: DataFrame) -> DataFrame:
    flags = {"https": "is_https", "hsts": "has_hsts", "csp": "has_csp", "mixed": "has_mixed_content", "xcto": "has_x_content_type_options", "xfo": "has_x_frame_options"}
    d = headers.join(urls.where("is_internal").select(F.col("id").alias("url_id")), "url_id", "left_semi")
    d = d.agg(F.count("*").alias("checked"), *[F.count_if(c).alias(n) for n, c in flags.items()]).withColumns({f"pct_{n}": _pct(n, "checked") for n in flags})
    p = lambda n: F.col(f"pct_{n}")
    score = p("https") * 0.35 + p("hsts") * 0.2 + p("csp") * 0.15 + _above(100 - p("mixed") * 5) * 0.15 + p("xcto") * 0.075 + p("xfo") * 0.075
    lack = lambda n: F.col("checked") - F.col(n)
    recs = _recs(
        ("baja", "no_security_data", F.col("checked") == 0, F.lit(0)),
        ("alta", "move_to_https", lack("https") > 0, lack("https")),
        ("alta", "remove_mixed_content", F.col("mixed") > 0, F.col("mixed")),
        ("media", "add_hsts", (lack("hsts") > 0) & (F.col("https") > 0), lack("hsts")),
        ("baja", "add_csp", lack("csp") > 0, lack("csp")),
    )
    return d.withColumn("score", F.when(F.col("checked") == 0, 0).otherwise(_score(score))).withColumn("recommendations", recs)


def structured_data(urls: DataFrame, sd: DataFrame) -> DataFrame:
    u = urls.agg(F.count_if(F.col("is_internal") & F.col("is_html")).alias("html"))
    d = sd.join(urls.select(F.col("id").alias("url_id"), "is_internal"), "url_id")
    d = d.agg(F.count("*").alias("blocks"), F.countDistinct(F.when(F.col("is_internal"), F.col("url_id"))).alias("pages"), F.count_if(F.col("validation_status") == "error").alias("errors"))
    d = u.crossJoin(d).withColumns({"pct_with": _pct("pages", "html"), "pct_errors": _pct("errors", "blocks")})
    score = F.least(F.lit(100.0), F.col("pct_with") * 1.2) * 0.6 + _above(100 - F.col("pct_errors") * 3) * 0.4
    without = F.col("html") - F.col("pages")
    recs = _recs(("media", "add_structured_data", (without > 0) & (F.col("pct_with") < 50), without), ("alta", "fix_validation_errors", F.col("errors") > 0, F.col("errors")))
    return d.withColumn("score", _score(score)).withColumn("recommendations", recs)


def schema_types(sd: DataFrame, limit: int = 10) -> DataFrame:
    return sd.where("schema_type is not null").groupBy("schema_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "schema_type").limit(limit)


def languages(hreflang: DataFrame, urls: DataFrame) -> DataFrame:
    """The languages that pages refer to, with their numbers of references."""
    return hreflang.join(urls.select(F.col("id").alias("url_id")), "url_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


def i18n(checks: DataFrame) -> DataFrame:
    """checks: hreflang rows with return_tag_ok and lang_valid; an unknown return tag counts as not confirmed."""
    d = checks.agg(F.count("*").alias("total"), F.count_if("return_tag_ok").alias("return_ok"), F.count_if("lang_valid").alias("valid"), F.array_sort(F.collect_set("lang")).alias("languages"))
    d = d.withColumns({"pct_return_ok": _pct("return_ok", "total"), "pct_lang_valid": _pct("valid", "total")})
    score = F.when(F.col("total") == 0, 100).otherwise(_score(F.col("pct_return_ok") * 0.5 + F.col("pct_lang_valid") * 0.5))
    missing, invalid = F.col("total") - F.col("return_ok"), F.col("total") - F.col("valid")
    recs = _recs(("alta", "fix_return_tags", missing > 0, missing), ("media", "fix_languages", invalid > 0, invalid))
    return d.withColumn("score", score).withColumn("recommendations", recs)


def overall(cards: dict[str, DataFrame]) -> DataFrame:
    """One row (card, score) a card, and the overall score of the rounded ones."""
    rows = reduce(DataFrame.unionByName, [c.select(F.lit(name).alias("card"), F.col("score").cast("int").alias("score")) for name, c in cards.items()])
    share = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])
    total = rows.agg(_score(F.sum(F.col("score") * share[F.col("card")])).alias("score")).select(F.lit("overall").alias("card"), "score")
    return rows.unionByName(total)


def security_checklist(headers: DataFrame) -> DataFrame:
    """Seven checks a page and the share of them that hold."""
    good = [F.col("is_https"), ~F.col("has_mixed_content"), F.col("has_hsts"), F.col("has_csp"), F.col("has_x_content_type_options"), F.col("has_x_frame_options"), ~F.col("has_unsafe_crossorigin")]
    n = reduce(lambda a, b: a + b, [F.coalesce(g, F.lit(False)).cast("int") for g in good])
    return headers.select("url_id", n.alias("passed"), F.round(n / 7 * 100, 1).alias("score"))
