"""License scans by ordered signature rules.

A text is reduced to its words, one space between them. Several hundred signatures (license_rules: hand-written grants,
notices, headers, openings and addresses, and names in forms of tags and mentions) are regular expressions over words. A
document is looked at only if it holds one of a few stems, and a signature only if the document holds its keyword; every
text that a signature matches holds both, so the gates lose nothing. Detections are intervals
of words; one that lies within another of the same or a better priority is suppressed (of equal intervals the better
priority, then the earlier rule stays). What survives gives the labels and, by the form's confidence, the score.

The base signatures are phrases of plain words: every place of them counts, and no other detection suppresses them.

All of it is DataFrame expressions in one pass: the rules are a literal array, texts never leave the scan's stage, and
only the intervals of documents that have any are dealt by row. Null and empty texts have no words and no labels.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.license_rules import BASE, SIGNATURES, STEMS, kin, named, piece

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, sign by sign (the regular expressions of Java look such a class up in a table). Capital
#: letters A-Z, and only these, become small ones.
GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    score: float
    base: bool = False


def rules() -> list[Rule]:
    """All signatures in order: base phrases, hand-written texts, names in every form."""
    out = [Rule(label, phrase, keyword, 0, 1.0, True) for label, phrase, keyword in BASE]
    return out + [Rule(label, pattern, keyword, priority, score) for label, keyword, pattern, priority, score in (*SIGNATURES, *named())]


def _literal(values: list, kind: str) -> Column:
    """Values of one kind as an array: a constant that is parsed once, instead of an expression for each value."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _by_kin(items: list[Rule]) -> Column:
    """The rules as structs (kin, keys), keys of structs (keyword, rules): each is looked for once, and a keyword only
    where its kin is."""
    by: dict[str, dict[str, list[dict]]] = {}
    for i, r in enumerate(items):
        rule = {"id": i, "piece": piece(r.pattern), "pattern": f"(?i)(?<= )(?:{r.pattern})(?= )"}
        by.setdefault(kin(r.pattern), {}).setdefault(r.keyword, []).append(rule)
    values = [{"kin": k, "keys": [{"keyword": x, "rules": rules} for x, rules in of.items()]} for k, of in by.items()]
    return _literal(values, "struct<kin:string,keys:array<struct<keyword:string,rules:array<struct<id:int,piece:string,pattern:string>>>>>")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, items: list[Rule]) -> DataFrame:
    """docs (rid, doc_id, text) to rows (rid, doc_id, n_words, rule, start, stop): one for each place of a rule, and
    one with nulls for a rule or document without any."""
    d = docs.select("rid", "doc_id", F.btrim(F.regexp_replace("text", GAP, " ")).alias("t"))
    n_words = F.when(F.col("t") == "", 0).otherwise(F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    # low is for what is looked for before a pattern is tried, as it makes more than A-Z small
    d = d.select("rid", "doc_id", n_words.cast("long").alias("n_words"), F.concat(F.lit(" "), "t", F.lit(" ")).alias("norm"), F.lower("t").alias("low"))
    gate = None
    for stem in STEMS:
        has = F.contains("low", F.lit(stem))
        gate = has if gate is None else gate | has
    d = d.select("rid", "doc_id", "n_words", F.when(gate, F.col("norm")).alias("norm"), F.when(gate, F.col("low")).alias("low"))
    low = F.col("low")
    of_kin = F.filter(_by_kin(items), lambda k: F.contains(low, k["kin"]))
    of_key = F.transform(of_kin, lambda k: F.filter(k["keys"], lambda x: F.contains(low, x["keyword"])))
    near = F.flatten(F.transform(F.flatten(of_key), lambda k: k["rules"]))
    some = F.filter(near, lambda r: F.contains(low, r["piece"]) & F.rlike(F.col("norm"), r["pattern"]))
    d = d.select("rid", "doc_id", "n_words", "norm", F.explode_outer(F.when(F.col("norm").isNotNull(), some)).alias("r"))
    between = F.transform(F.split("norm", F.col("r.pattern"), -1), _spaces)
    within = F.transform(F.regexp_extract_all("norm", F.col("r.pattern"), F.lit(0)), _spaces)
    # the piece before each place and the place itself; the piece after the last one has no place
    d = d.select("rid", "doc_id", "n_words", F.col("r.id").alias("rule"), F.posexplode_outer(F.arrays_zip(between.alias("b"), within.alias("w"))).alias("k", "x"))
    d = d.where("x is null or x.w is not null").select("rid", "doc_id", "n_words", "rule", "k", F.col("x.b").alias("b"), F.col("x.w").alias("w"))
    so_far = Window.partitionBy("rid", "rule").orderBy("k")
    start = F.sum("b").over(so_far) + F.sum("w").over(so_far) - F.col("w") - 1
    return d.select("rid", "doc_id", "n_words", "rule", start.cast("long").alias("start"), (start + F.col("w") + 1).cast("long").alias("stop"))


def oracle_sql(items: list[Rule]) -> str:
    """The digest of scan() as DuckDB SQL over a view `documents`, every signature tried on every text. Words stand in two
    spaces each, so that places that follow one another share none."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    wide = lambda p: " (?:" + p.replace(" ?", "\t").replace(" ", "  ").replace("\t", "(?:  )?") + ") "
    values = ", ".join(f"({i}, {quote(r.label)}, {quote(wide(r.pattern))}, {r.priority}, {r.score}::DOUBLE, {str(r.base).upper()})" for i, r in enumerate(items))
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    return f"""
        WITH r(id, label, pattern, priority, score, base) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT rid, doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS s FROM d),
        m AS (SELECT rid, r.*, regexp_split_to_array(s, pattern) AS b, regexp_extract_all(s, pattern) AS g FROM s JOIN r ON regexp_matches(s, pattern)),
        k AS (SELECT * EXCLUDE (b, g), unnest(b[:len(g)]) AS b, unnest(g) AS g, unnest(range(len(g))) AS k FROM m),
        p AS (SELECT *, CAST(sum({words('b')} + {words('g')}) OVER (PARTITION BY rid, id ORDER BY k) AS BIGINT) AS stop FROM k),
        x AS (SELECT *, stop - {words('g')} AS start FROM p),
        y AS (SELECT *, base OR NOT EXISTS (SELECT 1 FROM x y WHERE y.rid = x.rid AND y.start <= x.start AND y.stop >= x.stop AND y.priority <= x.priority
                                            AND (y.start < x.start OR y.stop > x.stop OR y.priority < x.priority OR y.id < x.id)) AS stays FROM x),
        a AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word, list_sort(list(DISTINCT label) FILTER (WHERE base)) AS bl,
                     list_sort(list(DISTINCT label) FILTER (WHERE stays)) AS l, max(score) FILTER (WHERE stays) AS score FROM y GROUP BY rid)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
               coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0) AS score
        FROM s LEFT JOIN a USING (rid)"""


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", items: list[Rule] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    the surviving detections as an array of (label, start, stop)."""
    items = rules() if items is None else items
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of = _literal([{"label": r.label, "priority": r.priority, "score": r.score, "base": r.base} for r in items], "struct<label:string,priority:int,score:double,base:boolean>")
    found = detections(rows, items).withColumn("r", F.get(of, F.col("rule")))
    # earlier rows start before or with this one and, where they start with it, reach as far at least
    above = Window.partitionBy("rid").orderBy(F.col("start"), F.col("stop").desc(), F.col("r.priority"), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in items})
    reach = F.create_map(*[x for p in levels for x in (F.lit(p), F.coalesce(F.max(F.when(F.col("r.priority") <= p, F.col("stop"))).over(above), F.lit(-1)))])
    found = found.withColumn("stays", F.col("start").isNotNull() & (F.col("r.base") | (reach[F.col("r.priority")] < F.col("stop"))))
    base = F.col("r.base") & F.col("start").isNotNull()
    join = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("r.label")))), ",")
    return found.groupBy("rid", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.col("stays")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("r.score"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("stays"), F.struct("start", "stop", F.col("r.label").alias("label"))))).alias("detections"),
    ).drop("rid")
