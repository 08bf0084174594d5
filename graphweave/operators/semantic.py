"""Search by vectors: exact top-k for given queries, stale vectors and a deterministic encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.config import EMBEDDING_MODEL
from graphweave.operators.text import embedding_text

DIMENSIONS = 384


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors in double precision, added in order of place."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def semantic_topk(vectors: DataFrame, query: list[float], k: int = 10, kind: str | None = None, oversample: int = 4, key: str = "vec_id", vec: str = "embedding", type_col: str = "label") -> DataFrame:
    """The k vectors nearest to a query: the first oversample x k are taken, then the type filter, so fewer than k may be left.

    The query is a literal, so the scan computes one number a row and only heaps of candidates meet.
    Scores are rounded to 4 places for output, after ordering.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(vec).isNotNull()).select(key, type_col, dot(F.col(vec), q).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k * oversample if kind is not None else k)
    if kind is not None:
        best = best.where(F.col(type_col) == kind).orderBy(F.desc("score"), key).limit(k)
    return best.select(key, type_col, F.round("score", 4).alias("score"))


def stale(nodes: DataFrame, vectors: DataFrame, model: str = EMBEDDING_MODEL) -> DataFrame:
    """(id): symbols, files apart, without a usable vector of the model."""
    have = vectors.where((F.col("model") == model) & (F.size("vec") > 0)).select(F.col("node_id").alias("id"))
    return nodes.where("type <> 'FILE'").select("id").join(have, "id", "left_anti")


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector from hashed words and letter triples: the same text always gives the same vector."""
    out = np.zeros(dimensions)
    low = text.lower()
    for w in low.replace("_", " ").replace(".", " ").split():
        for piece in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
            h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
            out[h % dimensions] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(out)
    return out / n if n else out


def encode(nodes: DataFrame, model: str = "hash-384", dimensions: int = DIMENSIONS) -> DataFrame:
    """(node_id, vec, model) of symbols by the hashing encoder, in Arrow batches; any encoder of this shape can take its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node_id": b["id"], "vec": [hash_vector(t, dimensions).astype(np.float32) for t in b["t"]], "model": model})

    text = embedding_text(F.col("qualified_name"), F.col("name"), F.col("signature"), F.col("docstring"))
    return nodes.select("id", F.coalesce(text, F.lit("")).alias("t")).mapInPandas(run, "node_id string, vec array<float>, model string")
