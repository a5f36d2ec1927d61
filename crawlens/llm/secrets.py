"""Secret scans with a random forest that removes false positives.

Candidates come from patterns for known key formats, for values assigned to names that speak of credentials, and for
long runs of key characters. A random forest trained on labelled findings then scores each: length, entropy, character
transitions (between classes, and against a bigram model of words), dictionary coverage (how much of the candidate
words of a public vocabulary spell), the path (tests, examples, documentation) and the words around it.

Scanning reads every whole text in one pass; candidates are rows of a few numbers, which the forest (Spark ML, trained
distributed on the labelled findings given) scores in the JVM. Findings that it rejects stay in the result, marked.
Labelled findings are a table (text, path, start, stop, label); labelled_findings() makes one of the stated size.

Null and empty texts have no findings; overlapping candidates are one finding, the first pattern's; repeated rows are
scanned each. Candidates of any length are looked at whole. A null path says nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import small_batches

#: kind and pattern, in order; the value is group v
PATTERNS = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?P<v>[A-Za-z0-9+/=\s]{40,})-----END"),
    ("aws_key", r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})"),
    ("slack_token", r"(?<![A-Za-z0-9])(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("google_key", r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_-]{35})"),
    ("service_key", r"(?<![A-Za-z0-9])(?P<v>(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj-)?[A-Za-z0-9_-]{16,})"),
    ("jwt", r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"),
    ("assigned", r"(?i:(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[A-Za-z_]{0,20})[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"']?(?P<v>[^\s\"'<>,;]{6,})"),
    ("long_run", r"(?<![A-Za-z0-9+/=_-])(?P<v>(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2})(?![A-Za-z0-9+/_-])"),
)
SCAN = re.compile("|".join(f"(?:{p.replace('?P<v>', f'?P<v{i}>')})" for i, (_, p) in enumerate(PATTERNS)))
FOR = frozenset("password passwd pwd secret token key apikey auth credential credentials login access bearer private".split())
AGAINST = frozenset("example sample test dummy fake placeholder your changeme hash checksum digest commit sha256 sha1 md5 uuid id version template revision etag".split())
PATHS = re.compile(r"(?i)test|spec|example|sample|doc|fixture|mock|readme|vendor|lock")
#: Addresses say nothing about the candidate beside them.
ADDRESS = re.compile(r"[\w.+-]*@[\w.-]+|\b(?:\w+\.)+(?:com|org|net)\b")
KINDS = {kind: i for i, (kind, _) in enumerate(PATTERNS)}


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the candidates of a text, without overlaps, in order."""
    if not text:
        return []
    return [(PATTERNS[i][0], m.start(f"v{i}"), m.end(f"v{i}")) for m in SCAN.finditer(text) for i in (int(m.lastgroup[1:]),)]


class Words:
    """A dictionary, and the bigram log probabilities of its letters."""

    def __init__(self, words: list[str]):
        self.words = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())
        n = np.ones((27, 27))
        for w in self.words:
            for a, b in zip(w, w[1:], strict=False):
                n[ord(a) - 97, ord(b) - 97] += 1
        self.bigram = np.log(n / n.sum(1, keepdims=True))

    @staticmethod
    def load(tokenizer_json: str) -> Words:
        """The whole words of a public vocabulary with word ends."""
        import json

        with open(tokenizer_json, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        return Words([t[:-4] for t in vocab if t.endswith("</w>")])

    def coverage(self, s: str) -> float:
        """The part of s that words of the dictionary spell, longest first from the left."""
        low, i, got = s.lower(), 0, 0
        while i < len(low):
            for n in range(min(12, len(low) - i), 3, -1):
                if low[i : i + n] in self.words:
                    got += n
                    i += n
                    break
            else:
                i += 1
        return got / max(1, len(low))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, path: str | None, kind: str, start: int, stop: int, words: Words) -> list[float]:
    v = text[start:stop]
    n, kinds = len(v), [_kind(c) for c in v]
    seen = Counter(v)
    low = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in v.lower()]
    around = re.findall(r"[a-z0-9]+", ADDRESS.sub(" ", text[max(0, start - 60) : start] + " " + text[stop : stop + 40]).lower())
    inside = set(re.findall(r"[a-z]+", v.lower()))
    return [
        float(n),
        -sum(c / n * math.log2(c / n) for c in seen.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(words.bigram[a, b] for a, b in zip(low, low[1:], strict=False)) / max(1, n - 1),
        sum(a == b for a, b in zip(v, v[1:], strict=False)) / max(1, n - 1),
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        words.coverage(v),
        float(bool(path and PATHS.search(path))),
        float(sum(w in FOR for w in around)),
        float(sum(w in AGAINST for w in around) + len(inside & AGAINST)),
        float(bool(re.search(r"[$<{%*]|\.\.\.|xxx|^[0-9a-f]{8}-[0-9a-f]{4}-", v.lower()))),
        float(KINDS[kind]),
    ]


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 5) -> DataFrame:
    """n labelled findings (text, path, start, stop, label), made from templates of true secrets and of what is
    mistaken for them; a stand-in where no reviewed findings are at hand."""
    r = random.Random(seed)
    plain = "the value of this line is set when service starts and then read again for each call in order to check it before".split()
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    any_of = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    some = lambda k: " ".join(r.choice(plain) for _ in range(k))
    true = [
        lambda: ("", "AKIA" + any_of(16, upper + digit), ""),
        lambda: ("", "ghp_" + any_of(36, lower + upper + digit), ""),
        lambda: ("api_key = '", "sk_live_" + any_of(24, lower + upper + digit), "'"),
        lambda: ("password=", any_of(r.randint(10, 22), hexa), ""),
        lambda: ("password: ", any_of(r.randint(8, 20), lower + upper + digit + "!#%&*+-_"), ""),
        lambda: ('token = "', any_of(r.choice((32, 40, 48)), r.choice((hexa, lower + upper + digit))), '"'),
        lambda: ("secret=", any_of(r.randint(20, 44), lower + upper + digit + "+/"), ""),
        lambda: ("", "AIza" + any_of(35, lower + upper + digit + "_-"), ""),
        lambda: ("auth: ", "eyJ" + any_of(20, lower + upper + digit) + "." + any_of(40, lower + upper + digit) + "." + any_of(30, lower + upper + digit), ""),
    ]
    word = lambda: r.choice(["change", "pass", "word", "secret", "admin", "user", "default", "service", "value", "example", "token", "your", "insert", "here", "none", "required", "string", "hidden"])
    false = [
        lambda: ("password=", word() + word(), ""),
        lambda: ("password: ", r.choice(["********", "<password>", "${DB_PASSWORD}", "{{ password }}", "%(password)s", "xxxxxxxx", "required", "hunter_example", "process.env.PASSWORD", "get_password()"]), ""),
        lambda: ('token = "', "_".join(word() for _ in range(r.randint(2, 4))).upper(), '"'),
        lambda: ("", "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLE000000000"]), ""),
        lambda: ("commit ", any_of(40, hexa), ""),
        lambda: ("sha256 checksum ", any_of(64, hexa), ""),
        lambda: ("md5 hash of file ", any_of(32, hexa), ""),
        lambda: ("request id ", "-".join(any_of(k, hexa) for k in (8, 4, 4, 4, 12)), ""),
        lambda: ("see ", "/".join(word() for _ in range(6)) + str(r.randint(1, 99)), ""),
        lambda: ("api_key = '", "sk_test_" + "0" * 24, "'"),
        lambda: ("tokens: ", str(r.randint(100000, 99999999)), ""),
        lambda: ("version ", f"{word()}-{word()}-{word()}-{r.randint(1, 9)}-{r.randint(0, 20)}-snapshot", ""),
    ]
    rows = []
    for i in range(n):
        label = i % 2
        before, value, after = r.choice(true if label else false)()
        head = some(r.randint(0, 12))
        text = f"{head} {before}{value}{after} {some(r.randint(0, 8))}"
        start = len(head) + 1 + len(before)
        path = r.choice(["src/app.py", "config/prod.env", "main.go", None] if label or r.random() < 0.5 else ["tests/test_app.py", "docs/readme.md", "examples/run.sh"])
        rows.append((text, path, start, start + len(value), label))
    return spark.createDataFrame(rows, "text string, path string, start int, stop int, label int")


def train(findings: DataFrame, dictionary: Words, trees: int = 40, depth: int = 9, seed: int = 3):
    """A forest from labelled findings (text, path, start, stop, label)."""
    shared = findings.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                at = next((k for k, a, b in candidates(t.text) if a < t.stop and t.start < b), "long_run")
                rows.append((features(t.text, t.path, at, t.start, t.stop, shared.value), float(t.label)))
            yield pd.DataFrame(rows, columns=["features", "label"])

    data = findings.where("text is not null and stop > start").mapInPandas(run, "features array<double>, label double")
    data = data.select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(data)


def scan(docs: DataFrame, model, dictionary: Words, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each candidate: doc_id, start, stop, kind, value_sha256, score, is_secret. path names a column of
    paths, if there is one."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    shared = src.sparkSession.sparkContext.broadcast(dictionary)
    schema = T.StructType([src.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value_sha256", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (t, p) in enumerate(zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for kind, a, b in candidates(t):
                    at.append(i)
                    out.append((a, b, kind, hashlib.sha256(t[a:b].encode()).hexdigest(), features(t, p, kind, a, b, shared.value)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names)

    found = src.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))
    score = F.get(vector_to_array("probability"), F.lit(1))
    scored = model.transform(found).withColumn("score", score)
    return scored.select("doc_id", "start", "stop", "kind", "value_sha256", "score", (F.col("score") >= threshold).alias("is_secret"))
