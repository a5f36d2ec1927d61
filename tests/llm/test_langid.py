import math
import os
import zlib
from fractions import Fraction

import numpy as np
import pytest

from crawlens.llm import langid
from crawlens.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["a", "b", "ab", "▁", "▁a", "ba"])
    p = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T
    order = {int(h): i for i, h in enumerate(pieces.hashes)}
    prob = lambda s: p[order[langid.Pieces._hash(s)]] if langid.Pieces._hash(s) in order else np.full(2, langid.FLOOR) if len(s) == 1 else np.zeros(2)

    def total(w):
        return np.ones(2) if not w else sum(prob(w[:k]) * total(w[k:]) for k in range(1, len(w) + 1))

    words = ["▁abab", "▁", "▁ac", "▁babba"]
    assert np.allclose(langid.log_likelihood(pieces, p, words), np.log([total(w) for w in words]))


def sums(pieces, p, word):
    """log of the sums over all segmentations of each prefix, in exact arithmetic."""
    order = {int(h): i for i, h in enumerate(pieces.hashes)}
    out = [[Fraction(1)] * p.shape[1]]
    for i in range(1, len(word) + 1):
        row = [Fraction(0)] * p.shape[1]
        for k in range(1, min(i, pieces.longest) + 1):
            at = order.get(langid.Pieces._hash(word[i - k : i]))
            for lang in range(p.shape[1]):
                prob = p[at, lang] if at is not None else langid.FLOOR if k == 1 else 0
                row[lang] += out[i - k][lang] * Fraction(prob)
        out.append(row)
    return [[math.log(x.numerator) - math.log(x.denominator) for x in row] for row in out]


def test_long_words(spark):
    """Whole words of any length are summed, in letters that are no pieces too, and pieces of any length count."""
    pieces = langid.Pieces(["a", "b", "ab", "▁", "▁a", "ba", "abababababababab", "b" * 20])
    assert pieces.longest == 20
    p = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 3).T
    words = ["▁" + "ab" * 60, "▁" + "c" * 90, "▁a", "▁" + "b" * 41, "▁" + "abc" * 25, "▁" + "c" * 33 + "ab" * 20]
    got = langid.log_likelihood(pieces, p, words)
    assert np.isfinite(got).all()
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, sums(pieces, p, w)[-1], rtol=1e-9), w
    long = langid.log_likelihood(pieces, p, ["▁" + "ab" * 4000, "▁ab"])
    assert np.isfinite(long).all() and (long[0] < long[1]).all()


def test_expected_counts():
    """One round of the fit against expected counts by enumeration, for a word longer than what one scale holds too."""
    pieces = langid.Pieces(["a", "b", "ab", "▁", "▁a", "bab"])
    words, counts = ["▁abab", "▁b", "▁" + "ab" * 9, "▁abc"], np.array([[2.0, 0], [1, 3], [1, 1], [0, 2]])
    names = [p for p in ["a", "b", "ab", "▁", "▁a", "bab"]]
    at = {p: int(np.flatnonzero(pieces.hashes == np.uint64(langid.Pieces._hash(p)))[0]) for p in names}

    def cuts(w):
        if not w:
            yield []
        for k in range(1, min(3, len(w)) + 1):
            if w[:k] in at or k == 1:
                for rest in cuts(w[k:]):
                    yield [w[:k], *rest]

    seen = np.full((pieces.size, 2), 0.02)
    for w, n in zip(words, counts, strict=True):
        ways = [(c, np.prod([1 / pieces.size if x in at else langid.FLOOR for x in c])) for c in cuts(w)]
        whole = sum(x for _, x in ways)
        for c, x in ways:
            for piece in c:
                if piece in at:
                    seen[at[piece]] += n * x / whole
    assert np.allclose(langid.fit(pieces, words, counts, rounds=1), seen / seen.sum(0))


def test_together():
    words = ["a" * n for n in (5, 1, 300_000, 900_000, 2, 3)]
    got = [list(x) for x in langid.together(words, 4)]
    assert [i for x in got for i in x] == [1, 4, 5, 0, 2, 3] and len(got) == 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("out"))
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.select("doc_id", "out").collect())
    model = langid.train(docs.where("not out").withColumnRenamed("doc_id", "key"), MODEL)
    got = langid.predict(docs, model).where("out").collect()
    assert sum(r["lang"] == r["language"]["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["language"]["score"] <= 1 for r in got)


def test_edges(spark):
    train = spark.createDataFrame([("the house is here", "en", 1), ("das haus ist hier", "de", 2), (None, "de", 3), ("x", None, 4)], "text string, lang string, key long")
    model = langid.train(train, MODEL)
    rows = [(1, None, "q"), (2, "", "q"), (3, "123 !!", "q"), (4, "das haus", "q"), (5, "½ ²", "q"), (6, "das " * 20000, "q")]
    out = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model, into="x")
    assert {r["lang_pred"] for r in out.collect()} == {"q"}  # the table's own column
    got = {r["doc_id"]: tuple(r["x"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == got[5] == ("und", 0.0) and got[4][0] == got[6][0] == "de"
    none = langid.train(train.limit(0), MODEL)
    assert {r["language"]["lang_pred"] for r in langid.predict(train, none).collect()} == {"und"}


def test_language_of_long_texts_only(spark):
    rows = [("the house is here", "en", i) for i in range(20)] + [("das haus ist hier " * 2000, "de", i) for i in range(20, 30)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string, key long"), MODEL, docs=5)
    assert model[1] == ["de", "en"]
    got = langid.predict(spark.createDataFrame([("das haus",), ("the house",)], "text string"), model).collect()
    assert {r["text"]: r["language"]["lang_pred"] for r in got} == {"das haus": "de", "the house": "en"}
