import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlens.llm import bpe
from crawlens.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.WordBpe(PATH), Tokenizer.from_file(PATH)


def encode(model, text):
    words = model.words(text)
    ids = dict(zip(words, model.encode_words(words), strict=True)) if words else {}
    return [i for w in words for i in ids[w]]


TEXTS = ["", " ", "Hello, WORLD!! it's 2024's ﬁne", "aaaaaaaaaa bbbb aaa", "ΣΑΣ ΟΔΟΣ σς İI", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "école école naïve", "中文字符 日本語テスト 한국어", "👩‍👩‍👧 emoji ☃", "\x00\x1c\x85​　tab\tnew\nline", "x" * 3000, "\U0003d000\U000f0000 a\u0c5cb"]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(pair, text):
    model, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert encode(model, text) == ids
    assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, text):
    model, library = pair
    assert encode(model, text) == library.encode(text, add_special_tokens=False).ids


def test_queries(spark, pair):
    import hashlib

    model, library = pair
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[2]])], "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH).collect()}
    for i, t in enumerate([*TEXTS, "", TEXTS[2]]):
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in back)
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_plain_pattern(pair):
    """The pattern with its signs written out splits like the vocabulary's own, for every two signs that it is for."""
    model, _ = pair
    signs = [chr(c) for c in range(bpe.PLAIN)]
    text = "".join(a + b for a in signs for b in signs)
    assert model._plain.findall(text) == model._words.findall(text)
    assert not model._far.search(text) and model._far.search("a" + chr(bpe.PLAIN))
