import os

import pytest

import corpus_pipeline
from crawlens.llm import exact, near
from crawlens.llm.queries import TOKENIZERS

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files")
DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage against its operator's decisions, on what the one before it left."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        assert name == "bpe" or docs.columns == columns
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    before, after = seen["language_id"]
    assert ids(after) == ids(before.where("text rlike '\\\\p{L}'"))
    before, after = seen["exact_dedup"]
    assert ids(after) == ids(exact.dedup(before).where("kept"))
    before, after = seen["near_dedup"]
    assert ids(after) == ids(near.dedup(before, 80).where("kept"))
    before, after = seen["mixing"]
    total = lambda d: sum(len((r["text"] or "").split()) for r in d.collect())
    assert abs(total(after) - 1.5 * total(before)) <= 0.01 * total(before)
    before, after = seen["bpe"]
    assert ids(after) == ids(before)
    assert corpus_pipeline.run(spark, DIR).count() == after.count()


def test_odd_rows(spark):
    rows = [(1, "das haus ist hier und dort", "de", "a", 1), (1, "das  haus ist hier und dort", "de", "a", 1), (1, "etwas ganz anderes steht hier", "de", "a", 1), (2, None, None, None, None), (3, "", "de", "a", 0), (None, "noch ein text ohne nummer", None, None, None), (4, "!!! 123", "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, DIR)
    assert sorted((str(r["doc_id"]), r["text"].split()[0]) for r in out.collect()) == [("1", "das"), ("1", "etwas"), ("None", "noch")]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), DIR)
    assert docs.count() == 0


def test_mix_of_rows_that_agree(spark, monkeypatch):
    """Rows with the same doc_id, source and size are taken as the mix takes them, one by one."""
    from crawlens.llm import mixing

    rows = [(1, f"word {i} here", "de", "a", 1) for i in range(4)] + [(2, "b c d", "de", "a", 1), (None, "x y", "de", None, 1), (None, "y x", "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = [(1, "a", 3, 3), (1, "a", 3, 6), (1, "a", 3, 0), (1, "a", 3, 0), (2, "a", 3, 3), (None, None, 2, 4), (None, None, 2, 2)]
    monkeypatch.setattr(mixing, "mix", lambda docs, tables: spark.createDataFrame(taken, "doc_id long, source string, size long, taken long"))
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.mix(spark, docs, DIR).collect())
    assert got == [("1", "word 0 here"), ("1", "word 0 here"), ("1", "word 1 here"), ("2", "b c d"), ("None", "x y"), ("None", "x y"), ("None", "y x")]


def test_clashing_columns(spark):
    rows = [(i, "das haus ist hier und dort und da", "de", "a", 1, "mine", 0.25, 7) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, size long")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, DIR)
        assert out.columns == docs.columns and {(r["lang_pred"], r["score"], r["size"]) for r in out.collect()} == {("mine", 0.25, 7)}
