"""BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a batch stand as symbols in one flat array. A round finds, by binary search over the sorted
pair keys, the rank of every adjacent pair, takes each word's lowest and merges all its places at once; words without
a pair left leave the array. Words and their results are kept in a bounded table for each task, so that a frequent
word is merged once. Texts are split as the vocabulary file says (added tokens on the raw text, NFC, lower case per
code point, words); the file itself is read on the driver and its tables are broadcast (about 2 MB, fixed).

Null and empty texts give no tokens; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import small_batches, trimmed

#: Fixed values, from the Unicode character database: letters and digits newer than the vocabulary's own library
#: knows; for it they are other signs.
NEW_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Fixed values, from the same database: ranges of capitals newer than this Python knows, with the distance to their
#: small letters.
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
NEW_LOWER = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)}
#: For the split, new letters stand as a sign of that kind.
_HIDE = dict.fromkeys((c for a, b in NEW_LETTERS for c in range(a, b + 1)), "!")
NONE = np.iinfo(np.int64).max
#: Signs below this one are most of what there is; for texts of them the split has a faster pattern.
PLAIN = 0x250


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary of the kind of word_bpe_49k.json. Plain data: pickled to the executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(self.tokens)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._ready()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self._words = regex.compile(self.pattern)
        # the same pattern with its kinds of signs written out, for texts of signs below PLAIN
        plain = self.pattern
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            signs = [chr(c) for c in range(PLAIN) if regex.fullmatch(kind, chr(c))]
            plain = plain.replace(kind, "".join(map(re.escape, signs)))
        self._plain, self._far = re.compile(plain), re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        odd = [f"{chr(a)}-{chr(b)}" for a, b in NEW_LETTERS] + [f"{chr(a)}-{chr(b)}" for a, b, _ in NEW_CAPITALS]
        self._odd = regex.compile("[" + "".join(odd) + "]")

    def words(self, text: str) -> list[str]:
        """The words of a text in order; added tokens stand as themselves."""
        parts = self._split.split(text) if any(a in text for a in self.added) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.added:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    if self._odd.search(part):
                        part = part.translate(NEW_LOWER).lower()
                        out += [part[m.start() : m.end()] for m in self._words.finditer(part.translate(_HIDE))]
                        continue
                part = part.lower()
                out += (self._words if self._far.search(part) else self._plain).findall(part)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by merge rounds over all of them at once."""
        raw = [b"" if w in self.added else w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(sizes)
        sym[ends[sizes > 0] - 1] = self.last[flat[ends[sizes > 0] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.append(np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            hit = rank == best
            # of overlapping places (the pair of a symbol with itself) every second one counts, from the left
            places = np.flatnonzero(hit)
            new_run = np.r_[True, (np.diff(places) > 1)]
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            sym[places] = self.made[rank[places]]
            keep = np.ones(len(sym), bool)
            keep[places + 1] = False
            sym, word = sym[keep], word[keep]
        ids = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(words) + 1))
        ids = ids[order].tolist()
        return [[self.added[w]] if w in self.added else ids[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space: the vocabulary file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


class WordTable(dict):
    """word -> what make() gives for its ids; bounded, and filled for all new words of a batch at once. Its twins are
    tables of the same words with something else."""

    def __init__(self, model: WordBpe, make, *twins, bound: int = 100_000):
        self.model, self.make, self.bound, self.twins = model, make, bound, [(make, {}) for make in twins]

    def learn(self, docs: list[list[str]]) -> None:
        if len(self) > self.bound:
            for table in (self, *[t for _, t in self.twins]):
                table.clear()
        new = list(set().union(*docs).difference(self))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = self.model.encode_words(some)
            for make, table in ((self.make, self), *self.twins):
                table.update(zip(some, map(make, ids), strict=True))


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def _parts(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many characters, one text at least."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the token ids of its texts in the array column ids (one of that name before is replaced)."""
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(WordBpe(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(col: pa.Array) -> pa.Array:
        texts, m = [t or "" for t in col.to_pylist()], model.value
        table = WordTable(m, lambda x: x)
        out = []
        for a, b in _parts(texts):
            docs = [m.words(t) for t in texts[a:b]]
            table.learn(docs)
            out += [[i for w in words for i in table[w]] for words in docs]
        return pa.array(out, pa.list_(pa.int32()))

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the decoded text of its token ids in the string column text; null ids give an empty text."""
    model = df.sparkSession.sparkContext.broadcast(WordBpe(path))

    @F.arrow_udf(T.StringType())
    def run(col: pa.Array) -> pa.Array:
        return pa.array([model.value.decode(x or ()) for x in col.to_pylist()], pa.string())

    return df.withColumn(text, run(F.col(ids)))


def digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each row of df: every text encoded, then its ids
    decoded, in one pass without a shuffle."""
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(WordBpe(path))
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        m = model.value
        table = WordTable(m, lambda x: " ".join(map(str, x)), m.decode)
        of_ids, of_text = table.__getitem__, table.twins[0][1].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts, n, ids, back = _texts(batch, "text"), [], [], []
            for a, b in _parts(texts):
                docs = [m.words(t) for t in texts[a:b]]
                table.learn(docs)
                for words in docs:
                    joined = " ".join(map(of_ids, words))
                    n.append(joined.count(" ") + 1 if words else 0)
                    ids.append(sha(joined))
                    back.append(sha(" ".join(map(of_text, words))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(trimmed(run), schema)
