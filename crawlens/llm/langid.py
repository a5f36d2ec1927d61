"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is
the sum over all its segmentations into pieces, which a forward algorithm gives in one sweep; a text's is the product
over its words. The probabilities come from expectation maximisation: expected piece counts from forward and backward
sums over labelled words. Words are runs of letters in lower case, whole, with the piece vocabulary's mark before the
first letter; a letter that is no piece has the probability FLOOR. Sums are scaled as they go, so that words of any
length have one; a word costs time by its length, and is summed once a batch of tables, however often it stands.

The fit takes about `docs` documents of each language, chosen by a hash of doc_id among those of at most `chars`
characters, or among all of a language that has none so short; that bounds what the driver gathers. Prediction reads
every whole text. Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be
learned. Rows stay as they are, repeated ones too; the score is the posterior of the predicted language among the learned
ones, each equally likely before. The prediction is one column of the name that the caller gives; one of that name
before is replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import small_batches, trimmed

WORD = re.compile(r"[^\W\d_]+")
MARK, FLOOR = "▁", 1e-9
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words are summed together as long as words by letters by languages stay under this.
CELLS = 2_000_000


def marked(word: str) -> str:
    """A word's letters with the mark; empty if it has no letter."""
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return MARK + word if word else ""


def text_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Pieces:
    """The vocabulary: sorted hashes of its pieces, and for a batch of words the piece that stands at each place."""

    def __init__(self, pieces: list[str]):
        kept = sorted({p for p in pieces if p})
        self.longest = max(map(len, kept), default=1)
        hashes = np.array([self._hash(p) for p in kept], np.uint64)
        self.hashes = np.sort(hashes)
        self.size = len(self.hashes)

    @staticmethod
    def load(model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return Pieces([sp.id_to_piece(i) for i in plain])

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for each piece length k an array (word, start) with the piece's number; size stands for no
        piece, size + 1 for a letter that is none."""
        lengths = np.array([len(w) for w in words], np.int64)
        most = int(lengths.max())
        codes = np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), most).astype(np.uint64)
        prefix = np.zeros((len(words), most + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(most):
                prefix[:, i + 1] = prefix[:, i] * BASE + codes[:, i] + np.uint64(1)
            out, power = [], np.uint64(1)
            for k in range(1, min(self.longest, most) + 1):
                power = power * BASE
                h = prefix[:, k:] - prefix[:, :-k] * power
                at = np.searchsorted(self.hashes, h)
                at[at == self.size] = 0
                inside = np.arange(most - k + 1)[None, :] + k <= lengths[:, None]
                out.append(np.where(inside & (self.hashes[at] == h), at, np.where(inside & (k == 1), self.size + 1, self.size)))
        return lengths, out


def _rescale(sums: np.ndarray, logs: np.ndarray, lo: int, hi: int) -> None:
    """Brings the sums of places lo to hi near 1, for each word and language, and notes by how much."""
    top = sums[lo:hi].max(0)
    top[top == 0] = 1
    sums[lo:hi] /= top
    logs[lo:hi] += np.log(top)


def _forward(p: np.ndarray, lengths: np.ndarray, lattice: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations of each prefix and the logarithms of their scales: (position, word, language). What a
    sum is made of has one scale always."""
    n, most, reach = len(lengths), lattice[0].shape[1], len(lattice)
    a, logs = np.zeros((most + 1, n, p.shape[1])), np.zeros((most + 1, n, p.shape[1]))
    a[0] = 1
    for i in range(1, most + 1):
        logs[i] = logs[i - 1]
        for k in range(1, min(reach, i) + 1):
            a[i] += a[i - k] * p[lattice[k - 1][:, i - k]]
        if i % 16 == 0:
            _rescale(a, logs, max(0, i + 1 - reach), i + 1)
    return a, logs


def _backward(p: np.ndarray, lengths: np.ndarray, lattice: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same for each suffix."""
    n, most, reach = len(lengths), lattice[0].shape[1], len(lattice)
    b, logs = np.zeros((most + 1, n, p.shape[1])), np.zeros((most + 1, n, p.shape[1]))
    b[lengths, np.arange(n)] = 1
    for s in range(most - 1, -1, -1):
        logs[s] = logs[s + 1]
        for k in range(1, min(reach, most - s) + 1):
            b[s] += b[s + k] * p[lattice[k - 1][:, s]]
        if s % 16 == 0:
            _rescale(b, logs, s, min(most + 1, s + reach))
    return b, logs


def _table(p: np.ndarray) -> np.ndarray:
    """Piece probabilities with the two rows for no piece and for an unknown letter."""
    return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), FLOOR)])


def log_likelihood(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """The log probability of each word in each language: (word, language)."""
    lengths, lattice = pieces.lattice(words)
    a, logs = _forward(_table(p), lengths, lattice)
    each = np.arange(len(words))
    return np.log(a[lengths, each]) + logs[lengths, each]


def together(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """The numbers of words in order of length, in parts that are summed together."""
    order = np.argsort([len(w) for w in words], kind="stable")
    first = 0
    for i, w in enumerate(order):
        if (i + 1 - first) * (len(words[w]) + 1) * max(langs, 1) > CELLS and i > first:
            yield order[first:i]
            first = i
    if first < len(order):
        yield order[first:]


def fit(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = 5, prior: float = 0.02) -> np.ndarray:
    """Piece probabilities (piece, language) from words and their counts (word, language)."""
    langs = counts.shape[1]
    p = np.full((pieces.size, langs), 1.0 / pieces.size)
    for _ in range(rounds):
        table, seen = _table(p), np.full((pieces.size, langs), prior)
        for some in together(words, langs):
            batch, n, each = [words[j] for j in some], counts[some], np.arange(len(some))
            lengths, lattice = pieces.lattice(batch)
            a, of_a = _forward(table, lengths, lattice)
            b, of_b = _backward(table, lengths, lattice)
            whole, of_whole = a[lengths, each], of_a[lengths, each]
            for k, at in enumerate(lattice, 1):
                for s in range(at.shape[1]):
                    is_piece = at[:, s] < pieces.size
                    ids = at[is_piece, s]
                    scale = np.exp((of_a[s] + of_b[s + k] - of_whole)[is_piece])
                    got = (a[s] * b[s + k] * n / whole)[is_piece] * scale * table[ids]
                    for lang in range(langs):
                        seen[:, lang] += np.bincount(ids, got[:, lang], pieces.size)
        p = seen / seen.sum(0)
    return p


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 3, is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, model_file: str, docs: int = 300, chars: int = 20_000) -> tuple[Pieces, list[str], np.ndarray]:
    """Learn from the labelled rows of df (text, lang, key): about `docs` of each language, chosen by hash of key."""
    h = F.xxhash64("key").bitwiseAND(F.lit(2**53 - 1)) / 2**53
    ok = df.where("text is not null and lang is not null").select("text", "lang", (F.length("text") <= chars).alias("short"), h.alias("h"))
    found = ok.groupBy("lang").agg(F.count_if("short").alias("short"), F.count("*").alias("n")).collect()
    n = {r["lang"]: r["short"] or r["n"] for r in found}
    pieces = Pieces.load(model_file)
    langs = sorted(n)
    if not langs:
        return pieces, [], np.zeros((pieces.size, 0))
    cut = F.create_map(*[F.lit(x) for lang in langs for x in (lang, docs / n[lang])])

    def count(batches):
        for pdf in batches:
            rows = [(lang, m, 1) for text, lang in zip(pdf.text, pdf.lang, strict=True) for w in text_words(text) if (m := marked(w))]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"]).groupby(["lang", "word"], as_index=False).sum()

    only_long = [r["lang"] for r in found if not r["short"]]
    chosen = ok.where((F.col("h") < cut[F.col("lang")]) & (F.col("short") | F.col("lang").isin(only_long))).select("text", "lang")
    got = chosen.mapInPandas(trimmed(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    wide = got.pivot_table(index="word", columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=langs, fill_value=0).sort_index()
    return pieces, langs, fit(pieces, list(wide.index), wide.to_numpy(float)) if len(wide) else np.full((pieces.size, len(langs)), 1.0 / pieces.size)


def predict(df: DataFrame, model: tuple[Pieces, list[str], np.ndarray], text: str = "text", into: str = "language", bound: int = 100_000) -> DataFrame:
    """df with a column `into` of lang_pred and score for the whole text of each row."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pieces, langs, p = shared.value
        known: dict[str, int] = {}
        held = 0
        scores, letters = np.zeros((0, len(langs))), np.zeros(0, bool)
        for col in batches:
            names, sure = [], []
            docs = [text_words(t) for t in col.to_pylist()]
            if len(known) > bound or held > 100 * bound:
                known, scores, letters, held = {}, scores[:0], letters[:0], 0
            new = list(dict.fromkeys(w for words in docs for w in words if w not in known))
            if new and langs:
                held += sum(map(len, new))
                words = [marked(w) for w in new]
                has = np.array([bool(w) for w in words])
                some = np.flatnonzero(has)
                add = np.zeros((len(new), len(langs)))
                for part in together([words[i] for i in some], len(langs)):
                    at = some[part]
                    add[at] = log_likelihood(pieces, p, [words[i] for i in at])
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                scores, letters = np.vstack([scores, add]), np.concatenate([letters, has])
            for words in docs:
                at = np.fromiter((known[w] for w in words), np.int64, len(words)) if langs else np.zeros(0, np.int64)
                if not len(at) or not letters[at].any():
                    names.append("und")
                    sure.append(0.0)
                    continue
                total = scores[at].sum(0)
                best = int(total.argmax())
                names.append(langs[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(run)(batches)

    udf = F.arrow_udf(typed, "lang_pred string, score double")
    return df.withColumn(into, udf(F.col(text)))
