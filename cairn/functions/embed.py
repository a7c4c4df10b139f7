"""Embedders that need no model: a hash-seeded one, token counts, keywords."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cairn.session import spread

from . import text as tx
from .vectors import normalise

DIMS = 384
#: The multiplier and increment of the 64-bit congruential generator.
_A, _C = 6364136223846793005, 1442695040888963407


def hashed(value: str, dims: int = DIMS) -> list[float]:
    """A unit vector that only depends on the text: draws of a generator seeded by its sha256."""
    seed = 0
    for byte in hashlib.sha256(value.encode()).digest():
        seed = (seed * 31 + byte) % 2**64
    v = np.empty(dims)
    for i in range(dims):
        seed = (seed * _A + _C) % 2**64
        v[i] = np.float32((seed >> 33) / 2**31)
    return (v / np.linalg.norm(v)).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else hashed(t))


def keywords(text: Column, words: list[str]) -> Column:
    """1 for each word in the lower-cased text as a substring, else 0, at length 1."""
    low = F.lower(text)
    return normalise(F.array(*[F.when(low.contains(w), 1.0).otherwise(0.0) for w in words]))


def term_counts(docs: DataFrame, key: str, text: str = "text", stop: list[str] | None = tx.STOP_WORDS) -> DataFrame:
    """key, token, n: the sparse count vector of each text."""
    return docs.select(key, F.explode(tx.tokens(F.col(text), stop)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, text: str = "text", stop: list[str] | None = tx.STOP_WORDS) -> DataFrame:
    """token, n and docs (rows that hold it).  A row's tokens are sorted and the first of each is marked, so one
    exchange by token, after partial sums, is enough."""
    tokens = F.array_sort(tx.tokens(F.col(text), stop))
    marked = F.transform("tokens", lambda w, i: F.struct(w.alias("token"), F.when((i == 0) | (w != F.get("tokens", i - 1)), 1).otherwise(0).alias("first")))
    each = spread(docs.select(text)).select(tokens.alias("tokens")).select(F.explode(marked).alias("x")).select("x.token", "x.first")
    return each.groupBy("token").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


class EmbeddingError(RuntimeError):
    pass


def checked(texts: list[str], model: Callable[[list[str]], list[list[float] | None]], dims: int | None = None, timeout: float | None = None) -> list[list[float]]:
    """The model's vectors for texts: an error if there are too few, if one is empty or of other dimensions, or if
    the model takes longer than `timeout` seconds."""
    pool = ThreadPoolExecutor(1)
    try:
        got = pool.submit(model, texts).result(timeout)
    except TimeoutError as e:
        raise EmbeddingError(f"no vectors after {timeout} s") from e
    finally:
        pool.shutdown(wait=False)  # a call that hangs is left behind
    if len(got) != len(texts):
        raise EmbeddingError(f"{len(got)} vectors for {len(texts)} texts")
    for v in got:
        if not v or (dims is not None and len(v) != dims):
            raise EmbeddingError(f"a vector of {len(v or [])} dimensions" + f" instead of {dims}" * (dims is not None))
    return got


def from_model(model: Callable[[list[str]], list[list[float] | None]], dims: int | None = None, timeout: float | None = None) -> Callable[[Column], Column]:
    """An embedder for `app` from a callable that takes a batch of texts; null texts have no vector."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embedder(values: pd.Series) -> pd.Series:
        known = values.dropna()
        vectors = iter(checked(known.tolist(), model, dims, timeout) if len(known) else [])
        return pd.Series([next(vectors) if ok else None for ok in values.notna()], dtype=object)

    return lambda text: embedder(text)


def term_cosine(a: DataFrame, b: DataFrame, ka: str, kb: str) -> DataFrame:
    """Cosine of each pair of sparse vectors that share a token: ka, kb, score.  Lengths travel with the
    entries, so pairs meet in one join on tokens and one sum.  For few vectors against many and only the
    best of them, `search.top_k_terms` moves far less."""

    def unit(d: DataFrame, k: str, name: str) -> DataFrame:
        size = d.groupBy(k).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
        return d.join(size, k).select(k, "token", (F.col("n") / F.col("size")).alias(name))

    return unit(a, ka, "x").join(unit(b, kb, "y"), "token").groupBy(ka, kb).agg(F.sum(F.col("x") * F.col("y")).alias("score"))
