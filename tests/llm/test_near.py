import random

import pytest

from crawlens.llm import near


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [sets_of(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sorted((rows[i][0], len(s[i]), min(comp[find(i)])) for i in range(len(rows)))


def corpus(seed, n=30):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice((3, 8, 60, 150)))]
        for _ in range(r.choice((1, 1, 3, 8))):
            c = list(words)
            for _ in range(r.choice((0, 1, 2, 4, 8))):
                c[r.randrange(len(c))] = f"x{r.randint(0, 99)}"
            rows.append((len(rows), " ".join(c)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_as_brute_force(spark, percent):
    rows = corpus(percent)
    got = near.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, percent)


def test_one_large_bucket(spark, monkeypatch):
    """Near copies of one text that mostly link through it, and blocks smaller than their bucket."""
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "CHUNK_ROWS", 7)
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 70):
        c = list(words)
        for _ in range(r.randint(1, 5)):
            c[r.randrange(len(c))] = f"x{i}"
        rows.append((i, " ".join(c)))
    got = near.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 80)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()) == brute(rows, 80)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "É a b c d"), (8, "é a b c d"), (9, "a b"), (10, "w " * 50)]
    got = near.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 85)
    assert near.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = near.dedup(spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (None, "q", 1)], "doc_id long, text string, cid int"))
    assert sorted((str(r["doc_id"]), r["kept"]) for r in same.collect()) == [("1", True), ("1", True), ("None", False)]


def test_sketch_bound():
    assert 128 * (1 - 2.718 ** (-4 * 125 * 0.15 / 256)) < near.most_bits(0.85) < 128


def test_block_links_as_brute_force(spark):
    """Every link between components of a bucket is found, whatever the signs of its sketches as integers."""
    import numpy as np

    r = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    known, group = near.WordHash(), []
    for i in range(60):
        c = list(base)
        for _ in range(r.randint(0, 2)):
            c[r.randrange(90)] = f"x{i}{r.random()}"
        s = near.shingles(" ".join(c), known)
        low = near.samples(s)
        group.append((i, near.odd_sketch(low).view(np.int64).tolist(), [7] * near.BANDS, s.view(np.int64).tolist(), frozenset(s.tolist())))
    rows = [(7, 0, 0, 0, i, i, sk, b, items) for i, sk, b, items, _ in group]
    df = spark.createDataFrame(rows, "bkey long, i int, j int, side int, cid long, comp long, sketch array<long>, bands array<long>, items array<long>")
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in near._in_blocks(df, 80).collect():
        parent[find(x["a"])] = find(x["b"])
    got = [find(i) for i in range(60)]
    exp = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                a, b = group[i][4], group[j][4]
                if 100 * len(a & b) >= 80 * len(a | b):
                    exp[i] = exp[j] = min(exp[i], exp[j])
    assert all((got[i] == got[j]) == (exp[i] == exp[j]) for i in range(60) for j in range(60))


def test_without_broadcast(spark, monkeypatch):
    """Beyond the size bound, texts are shuffled to the candidates."""
    monkeypatch.setattr(near, "hinted", lambda keys: keys.hint("shuffle_merge"))
    rows = corpus(3, 12)
    got = near.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 80)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 80)
