"""Where models attach: embedders, rerankers and completers as small protocols, with deterministic stand-ins that need no network.

A stand-in's results are marked by its ``name``; nothing here calls a service.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ingest, retrieval


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    name: str

    def score(self, query: str, passages: list[str]) -> list[float]: ...


class Completer(Protocol):
    name: str

    def complete(self, prompts: list[str]) -> list[str]: ...


class Retriever(Protocol):
    """Finds chunks for queries (``qid, query``) and reads on from a chunk; both give ``document, ord`` rows."""

    def find(self, queries: DataFrame, limit: int) -> DataFrame: ...

    def read_section(self, anchors: DataFrame, limit: int) -> DataFrame: ...


class TableRetriever:
    """A retriever over a table of chunks (``document, section, ord, text``): full text and hashed vectors, put in order by lexical scores."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks

    def find(self, queries: DataFrame, limit: int = 3) -> DataFrame:
        hits = retrieval.joined_hits([retrieval.bm25_top(queries, self.chunks, retrieval.CHANNEL), retrieval.vector_top(queries, self.chunks, retrieval.CHANNEL)])
        return retrieval.fuse(retrieval.lexical_of(hits, queries, self.chunks), F.col("lexical") / (F.col("lexical") + 4.0), limit)

    def read_section(self, anchors: DataFrame, limit: int = 6) -> DataFrame:
        return ingest.contiguous(ingest.continuation(self.chunks, anchors, limit))


class HashEmbedder:
    """Unit vectors from hashed tokens: texts that share words are near."""

    name = "hash-embedder"

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for t in text.lower().split():
                h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class OverlapReranker:
    """The share of a query's words that a passage holds."""

    name = "overlap-reranker"

    def score(self, query: str, passages: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(p.lower().split())) / max(1, len(asked)) for p in passages]


class EchoCompleter:
    """The first sentence of a prompt."""

    name = "echo-completer"

    def complete(self, prompts: list[str]) -> list[str]:
        return [p.split(".")[0].strip() for p in prompts]


def embedded(rows: DataFrame, text: str, embedder: Embedder, batch: int = 32, name: str = "embedding") -> DataFrame:
    """``rows`` with a vector of ``text``, asked in batches inside the tasks; null and empty texts get null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [None] * len(pdf)
            asked = [k for k, t in enumerate(pdf[text]) if isinstance(t, str) and t]
            for a in range(0, len(asked), batch):
                part = asked[a : a + batch]
                for k, v in zip(part, embedder.embed([pdf[text].iloc[k] for k in part]), strict=True):
                    out[k] = v
            yield pdf.assign(**{name: out})

    return rows.mapInPandas(run, rows.withColumn(name, F.lit(None).cast("array<double>")).schema)


def reranked(hits: DataFrame, reranker: Reranker) -> DataFrame:
    """``hits`` (``qid, query, passage`` and more) with ``rerank``; a query's shortlist is scored in one call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(rerank=reranker.score(pdf["query"].iloc[0], pdf["passage"].tolist()))

    return hits.groupBy("qid").applyInPandas(run, hits.withColumn("rerank", F.lit(0.0)).schema)


def completed(rows: DataFrame, prompt: str, completer: Completer, name: str = "completion", batch: int = 10) -> DataFrame:
    """``rows`` with the answer to ``prompt``; rows with no prompt are never sent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [None] * len(pdf)
            asked = [k for k, t in enumerate(pdf[prompt]) if isinstance(t, str) and t.strip()]
            for a in range(0, len(asked), batch):
                part = asked[a : a + batch]
                for k, v in zip(part, completer.complete([pdf[prompt].iloc[k] for k in part]), strict=True):
                    out[k] = v
            yield pdf.assign(**{name: out})

    return rows.mapInPandas(run, rows.withColumn(name, F.lit(None).cast("string")).schema)
