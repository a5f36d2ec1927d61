import random
import re

from crawlens.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for i, (_, t) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if norm[j] == norm[i]]
        known = [g for g in group if g is not None]
        out.append((rows[i][0], min(known) if known else None, len(group)))
    return sorted(out, key=str)


def check(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact.dedup(df, size=size).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute(rows)
    for r in got:
        assert r["kept"] is not None and (not r["kept"] or r["doc_id"] == r["keep_id"])
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(k) == 1 for k in groups.values())


def test_small_blocks(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab \t\n") for _ in range(r.randint(0, 40))) for _ in range(60)]
    rows = [(i, r.choice(texts)) for i in range(150)]
    check(spark, rows, 3)


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " "), (7, "a  b"), (2, "a\tb"), (2, "a b"), (None, "a b"), (None, "alone"), (9, "a b"), (1, "x" * 5000), (0, "x" * 5000), (8, "x" * 4999)]
    check(spark, rows, 64)


def test_empty(spark):
    assert exact.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 9, "n"), (2, "a", 9, "n")], "doc_id long, text string, rid long, name string")
    assert {(r["doc_id"], r["kept"]) for r in exact.dedup(df).collect()} == {(1, True), (2, False)}
