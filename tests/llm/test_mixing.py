import itertools

import numpy as np
import pytest

from crawlens.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_choose_is_nearest():
    """The nearest sum of what the counts that remain beside the proportional part can make; with few documents, of all."""
    g = np.random.default_rng(0)
    for _ in range(300):
        sizes = np.unique(g.integers(1, 12, g.integers(1, 5)))
        counts = g.integers(0, 4, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(g.integers(0, total + 1))
        take = mixing.choose(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        low = mixing.proportional(sizes, counts, budget)[0] if budget < total else counts
        assert (take >= low).all()
        sums = {int((sizes * c).sum()) for c in itertools.product(*[range(a, n + 1) for a, n in zip(low, counts, strict=True)])}
        assert abs(int((sizes * take).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_proportional_leaves_few_documents():
    g = np.random.default_rng(4)
    for _ in range(300):
        sizes = np.unique(g.integers(0, 10 ** int(g.integers(1, 7)), g.integers(1, 60)))
        counts = g.integers(0, 50, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(g.integers(0, total + 1)) if total else 0
        if budget < total:
            take, left = mixing.proportional(sizes, counts, budget)
            assert (take >= 0).all() and (take <= counts).all() and -1 <= left <= (mixing.FREE + 1) * sizes.max() + 1


def test_large_budget():
    sizes, counts = np.arange(1, 3000), np.full(2999, 500)
    total = int((sizes * counts).sum())
    take = mixing.choose(sizes, counts, total // 3)
    assert int((sizes * take).sum()) == total // 3


def brute_shares(sizes, weights, share, limit):
    """The contract's words, one source after another."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, target, left = dict(order), {}, share * sum(n for _, n in order)
    while open_ := [s for s in size if s not in target]:
        each = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if each[s] > limit * size[s]]
        if not over:
            return target | each
        target |= {s: limit * size[s] for s in over}
        left -= sum(target[s] for s in over)
    return target


def test_shares(spark):
    from crawlens.llm.common import Tables

    g = np.random.default_rng(2)
    for n in (0, 1, 3, 40, 700):
        sizes = [(None if i == 1 else f"s{i}é" if i % 7 else f"\U0001f600{i}", int(g.integers(0, 10 ** int(g.integers(1, 6))))) for i in range(n)]
        df = spark.createDataFrame(sizes, "source string, n long").repartition(5)
        got = {r["source"]: r["target"] for r in mixing.shares(Tables(spark), df, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(brute_shares(sizes, (3, 1, 2), 1.5, 2.0))
        assert sum(got.values()) == pytest.approx(1.5 * sum(k for _, k in sizes)) and all(got[s] <= 2 * k + 1e-6 for s, k in sizes)


def test_mix(spark):
    g = np.random.default_rng(1)
    rows = [(i, " ".join("w" for _ in range(int(g.integers(0, 30)))), ["s1", "s2", None][int(g.integers(3))]) for i in range(400)] + [(400, None, "s1"), (7, "a b", "s2")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(rows)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    for s in ("s1", "s2", None):
        own = [r for r in got if r["source"] == s]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edges(spark):
    """Rows with null ids, repeated rows, very long texts, columns of clashing names."""
    rows = [(None, "w " * 10, "a", 1, 1)] * 30 + [(5, "w " * 7, "a", 1, 1)] * 4 + [(6, "w " * 200_000, "b", 1, 1), (7, "", "b", 1, 1), (8, None, None, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", size long, taken long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and {r["size"] for r in got} == {10, 7, 200_000, 0}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    a = [r for r in got if r["source"] == "a"]
    assert sum(r["taken"] for r in a) == a[0]["target"] == 2 * 328
