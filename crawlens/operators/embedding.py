"""Embedding of page texts by a pluggable backend; no backend of this library reaches a network."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.operators.semantic import chunks, representative


class Embedder(Protocol):
    dimensions: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def embed(df: DataFrame, backend: Embedder, text: str = "text", batch: int = 100) -> DataFrame:
    """df with the column embedding: batches of texts through the backend, inside Arrow tasks."""

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        texts = [t or "" for t in col.to_pylist()]
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            out += backend.embed_documents(texts[i : i + batch])
        return pa.array(out, pa.list_(pa.float64()))

    return df.withColumn("embedding", run(F.col(text)))


def page_vectors(pages: DataFrame, backend: Embedder, text: str = "content_text", key: str = "url_id") -> DataFrame:
    """(key, chunk, embedding): each page's chunk that is nearest to the mean of its chunks."""
    return representative(embed(chunks(pages, text, key), backend), key)
