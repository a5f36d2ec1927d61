"""Rule-based cleaning of page texts with preview, apply and revert, as column expressions.

Rules are dicts of type and value: line_exact, line_prefix, line_contains, cut_from_line, remove_substring, regex.
Regular expressions are Java's, ^ and $ at line ends."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.functions.url import shape

MAX_REMOVAL = 0.60
LINE_RULES = ("line_exact", "line_prefix", "line_contains", "cut_from_line")
TEXT_RULES = ("remove_substring", "regex")
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def problems(rules: list[dict]) -> list[str]:
    """What is wrong with the rules; empty if nothing."""
    out = [] if rules else ["no rules"]
    for i, rule in enumerate(rules):
        kind, value = rule.get("type"), str(rule.get("value") or "")
        if kind not in LINE_RULES + TEXT_RULES:
            out.append(f"rule {i}: unknown type {kind!r}")
        elif not value.strip():
            out.append(f"rule {i}: empty value")
        elif kind in LINE_RULES and len(value.strip()) < 3:
            out.append(f"rule {i}: fewer than 3 characters")
        elif kind == "remove_substring" and len(value) < 4:
            out.append(f"rule {i}: fewer than 4 characters")
        elif kind == "regex":
            try:
                re.compile(value)
            except re.error as e:
                out.append(f"rule {i}: {e}")
    return out


def _line_action(line: Column, rules: list[dict]) -> Column:
    """drop, cut or keep: the first rule that matches a line decides."""
    bare = F.btrim(line, F.lit(_BLANKS))
    tests = {"line_exact": lambda v: bare == v, "line_prefix": lambda v: bare.startswith(v), "line_contains": lambda v: line.contains(v), "cut_from_line": lambda v: line.contains(v)}
    out = None
    for r in rules:
        cond, act = tests[r["type"]](str(r["value"])), "cut" if r["type"] == "cut_from_line" else "drop"
        out = F.when(cond, act) if out is None else out.when(cond, act)
    return out.otherwise("keep")


def _by_lines(text: Column, rules: list[dict]) -> Column:
    # a text without line ends passes; after a cut nothing is kept
    lines = F.transform(F.split(text, "\n", -1), lambda s: F.struct(s.alias("s"), _line_action(s, rules).alias("a")))
    cut = F.array_position(F.transform(lines, lambda x: x["a"]), "cut")
    before = F.when(cut > 0, F.slice(lines, F.lit(1), (cut - 1).cast("int"))).otherwise(lines)
    kept = F.array_join(F.transform(F.filter(before, lambda x: x["a"] == "keep"), lambda x: x["s"]), "\n")
    return F.when(text.contains("\n"), kept).otherwise(text)


def apply_rules(text: Column | str, rules: list[dict]) -> Column:
    """The cleaned text; null and empty texts stay as they are. White space is tidied whether or not a rule matched."""
    raw = F.col(text) if isinstance(text, str) else text
    lines = [r for r in rules if r["type"] in LINE_RULES]
    out = _by_lines(raw, lines) if lines else raw
    for r in rules:
        if r["type"] == "remove_substring":
            out = F.replace(out, F.lit(str(r["value"])), F.lit(" "))
        elif r["type"] == "regex":
            out = F.regexp_replace(out, f"(?m){r['value']}", " ")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return F.when(raw == "", raw).otherwise(F.btrim(out, F.lit(_BLANKS)))


def clean_with_safety(text: Column | str, rules: list[dict]) -> Column:
    """struct(text, removed, skipped): where more than MAX_REMOVAL of a text would go, it stays and is skipped."""
    raw = F.col(text) if isinstance(text, str) else text
    cleaned = apply_rules(raw, rules)
    gone = F.coalesce(F.length(raw) - F.length(cleaned), F.lit(0))
    skip = F.coalesce((F.length(raw) > 0) & (gone / F.length(raw) > MAX_REMOVAL), F.lit(False))
    return F.struct(F.when(skip, raw).otherwise(cleaned).alias("text"), F.when(skip, 0).otherwise(gone).alias("removed"), skip.alias("skipped"))


def excerpt(text: Column | str, limit: int = 1200) -> Column:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    half = limit // 2
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, half), F.lit("\n[...]\n"), F.right(t, F.lit(half))))


def groups(pages: DataFrame) -> DataFrame:
    """Path shapes of pages with content: pages, cleaned, mean length and three sample URLs, the largest first."""
    g = pages.groupBy(shape("path").alias("group_key")).agg(F.count("*").alias("pages"), F.count_if(F.col("cleaned_at").isNotNull()).alias("cleaned"), F.floor(F.sum("content_length") / F.count("*")).alias("avg_length"))
    from pyspark.sql import Window

    first = pages.select(shape("path").alias("group_key"), "url", F.row_number().over(Window.partitionBy(shape("path")).orderBy("url")).alias("n")).where("n <= 3")
    samples = first.groupBy("group_key").agg(F.array_sort(F.collect_list("url")).alias("samples"))
    return g.join(samples, "group_key").orderBy(F.desc("pages"), "group_key")


def preview(pages: DataFrame, rules: list[dict], column: str = "content_text", n: int = 5) -> DataFrame:
    """Before and after of the first n (20 at most) pages by url_id."""
    d = pages.orderBy("url_id").limit(min(n, 20)).withColumn("r", clean_with_safety(column, rules))
    share = F.when(F.length(column) > 0, F.round(F.col("r.removed") / F.length(column) * 100, 1)).otherwise(0.0)
    return d.select("url_id", excerpt(column).alias("before"), excerpt(F.col("r.text")).alias("after"), F.col("r.removed").alias("removed"), F.col("r.skipped").alias("skipped"), share.alias("removed_pct"))


def apply(content: DataFrame, rules: list[dict], targets: tuple[str, ...] = ("content_text", "content_markdown")) -> DataFrame:
    """content with the targets cleaned; originals are saved the first time. Adds removed and skipped of the page."""
    if found := problems(rules):
        raise ValueError("; ".join(found))
    d = content
    for t in targets:
        d = d.withColumn(f"_{t}", clean_with_safety(t, rules))
    removed = sum((F.coalesce(F.col(f"_{t}.removed"), F.lit(0)) for t in targets[1:]), F.coalesce(F.col(f"_{targets[0]}.removed"), F.lit(0)))
    skipped = F.lit(False)
    for t in targets:
        skipped = skipped | F.col(f"_{t}.skipped")
    d = d.withColumn("removed", removed).withColumn("skipped", skipped)
    changed = F.col("removed") > 0
    for t in targets:
        d = d.withColumn(f"{t}_original", F.when(changed, F.coalesce(f"{t}_original", t)).otherwise(F.col(f"{t}_original")))
        d = d.withColumn(t, F.when(changed, F.col(f"_{t}.text")).otherwise(F.col(t))).drop(f"_{t}")
    d = d.withColumn("cleaned_at", F.when(changed, F.current_timestamp()).otherwise(F.col("cleaned_at")))
    return d.withColumn("content_length", F.length("content_text")) if "content_text" in targets else d


def revert(content: DataFrame) -> DataFrame:
    """Originals back in place where a page was cleaned."""
    d = content
    for t in ("content_text", "content_markdown"):
        d = d.withColumn(t, F.when(F.col("cleaned_at").isNotNull(), F.coalesce(f"{t}_original", t)).otherwise(F.col(t)))
        d = d.withColumn(f"{t}_original", F.when(F.col("cleaned_at").isNull(), F.col(f"{t}_original")))
    return d.withColumn("content_length", F.length("content_text")).withColumn("cleaned_at", F.lit(None).cast("timestamp"))


def rulesets(history: DataFrame, job_id: str) -> DataFrame:
    return history.where(F.col("job_id") == job_id).orderBy(F.desc("created_at"), "id")
