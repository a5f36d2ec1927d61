import numpy as np

from crawlens.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t):
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ok = [e is not None and len(e) > 0 and None not in e and np.isfinite(np.float32(e)).all() and np.any(e) for _, e, _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t:
                    n[i] += 1
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    comp = {}
    for i, r in enumerate(rows):
        comp.setdefault(find(i), []).append(r[0])
    return sorted((rows[i][0], n[i], min(comp[find(i)])) for i in range(len(rows)))


def check(spark, rows, t, **k):
    got = vectors.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), t, **k).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows, t)


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SKETCHES", 20)
    g = np.random.default_rng(2)
    base = g.normal(size=(40, 8))
    rows = [(i, (base[g.integers(40)] * g.uniform(0.5, 3) + g.normal(size=8) * g.choice([0, 0.05, 0.2])).tolist(), int(g.integers(2))) for i in range(200)]
    for t in (0.98, 0.9):
        check(spark, rows, t, k=4)


def test_edges(spark):
    rows = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [float("nan"), 1.0], 1), (3, [1.0, None], 1), (4, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 2), (8, [], 1), (9, [1.0], 1), (10, [3.0], 1), (11, [1e30, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0], 1)]
    check(spark, rows, 0.98)
    assert vectors.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def units(n, dim, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_traversal_reaches_every_cell_in_the_radius():
    x = units(400, 6)
    m = vectors.MultiIndex(x, 6)
    u, v = m.cells(x)
    of, row, bits = m.traverse(x, 0.3)
    seen = np.zeros((400, 6, 6), bool)
    seen[of, row] = np.unpackbits(bits, axis=1)[:, : len(m.books[1])]
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.3
    assert all(seen[i, u[j], v[j]] for i, j in zip(*np.nonzero(near), strict=True))
    assert seen.sum() < 0.8 * seen.size


def test_sketches_are_bounds():
    """No pair within the radius is lost to its sketches, and most others are told apart."""
    x = units(300, 24)
    x = np.concatenate([x, x[:100] + 0.02 * units(100, 24, 5)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m, square = vectors.MultiIndex(x, 4), 0.04
    s = m.sketches(x)
    d = ((s[:, None].astype(int) - s[None].astype(int)) ** 2).sum(2)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= square
    limit = vectors.sketch_limit(square, s.shape[1])
    assert (d[near] <= limit).all() and (d[~near] <= limit).mean() < 0.05
    cid = np.arange(400)
    bits = np.packbits(np.ones((400, 4), bool), axis=1)
    mine, theirs = vectors.marked(s, np.zeros(400, int), cid, s, bits, cid, limit)
    assert (mine == theirs).all() and mine[near.sum(1) > 1].all()
    none, _ = vectors.marked(s, np.full(400, 3), cid, s, np.packbits(np.eye(4, dtype=bool)[[0] * 400], axis=1), cid, limit)
    assert not none.any()  # no query visits column 3


def test_one_dense_group_and_clashing_columns(spark, monkeypatch):
    """Many vectors that all link with one another, in several parts; columns with the operator's own names."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "SKETCHES", 50)
    x = np.ones(12) + 0.01 * np.random.default_rng(1).normal(size=(150, 12))
    rows = [(i if i % 40 else None, v.tolist(), 1, i, 5, "z") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA + ", cid int, cell int, side string")
    got = vectors.dedup(df, 0.9).collect()
    assert {r["n_links"] for r in got} == {149} and {r["component_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1
