"""Exact cosine search.

One query is a literal: the plan is scan, filter, project and a take-ordered, whose heaps are per
partition.  A set of queries meets the rows in packed blocks, one matrix product per pair of
blocks, and only each block's k best go to the final rank."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import vectors
from cairn.session import spread

DEFAULT_K = 5
#: Blocks of queries are broadcast up to this many bytes; beyond it the blocks are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _size(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows of v, added up from the first dimension on, as the JVM does."""
    return np.sqrt(np.cumsum(v * v, axis=1)[:, -1])


def _score(query: Sequence[float], vector: str) -> Column | None:
    """The cosine to a query, null for rows of other dimensions, of length 0 or with NaN; None for a query of
    length 0, and an error for one without dimensions."""
    if not len(query):
        raise ValueError("an empty query vector")
    size = float(_size(np.asarray(query, float)[None])[0])
    if not size:
        return None
    cosine = F.try_divide(vectors.dot(F.col(vector), vectors.literal(query)), vectors.norm(F.col(vector)) * F.lit(size))
    return F.when(F.size(vector) == len(query), F.nanvl(cosine, F.lit(None).cast("double")))


def scored(rows: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """Rows that have one with their `score`."""
    score = _score(query, vector)
    if score is None:
        return rows.where("false").withColumn("score", F.lit(0.0))
    return rows.withColumn("score", score).where(F.col("score").isNotNull())


def top_k(rows: DataFrame, query: Sequence[float], k: int = DEFAULT_K, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows, ties by id, with score and rank.  Rows without a score are ranked last and then
    left out, so a score is computed once for each row."""
    score = _score(query, vector)
    if score is None:
        return rows.where("false").withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    best = rows.withColumn("score", score).orderBy(F.desc_nulls_last("score"), F.asc(id_)).limit(max(0, k)).where(F.col("score").isNotNull())
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_))))


def _packed(rows: DataFrame, id_: str, vector: str, size: int) -> DataFrame:
    """Rows as blocks of up to `size`: d, n, ids and the matrix of their vectors, by dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(d: int) -> pa.RecordBatch:
            ids, v = (np.concatenate(c) for c in zip(*held.pop(d)))
            return pa.record_batch([pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["d", "n", "ids", "v"])

        for b in batches:
            ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            dims = np.diff(ends, prepend=0)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                m = flat.reshape(-1, d) if len(at) == len(dims) else flat[(ends[at] - d)[:, None] + np.arange(d)]
                for lo in range(0, len(at), size):
                    held.setdefault(d, []).append((ids[at[lo : lo + size]], m[lo : lo + size]))
                    if sum(len(i) for i, _ in held[d]) >= size:
                        yield out(d)
        for d in list(held):
            yield out(d)

    n = vectors.norm(F.col(vector))
    ok = rows.where((n > 0) & ~F.isnan(n) & F.col(id_).isNotNull())
    return ok.select(F.col(id_).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "d int, n int, ids binary, v binary")


#: More than a matrix product of unit vectors may be off, in any order of its sums.
_SLACK = 1e-9
#: Pairs of vectors that are looked at together when scores are computed anew.
_PAIRS = 1 << 14


def _best(u: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row numbers and scores of each query's k best rows, ties by id.  A matrix product finds all
    rows that may be among them; their scores are then added up from the first dimension on, so that
    they are the same bits in whatever blocks the rows lie."""
    nu, nm, k = _size(u), _size(m), max(1, k)
    s = (u / nu[:, None]) @ (m / nm[:, None]).T
    least = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    q, r = np.nonzero(s >= (least - _SLACK)[:, None])
    dot = np.concatenate([np.cumsum(u[q[i : i + _PAIRS]] * m[r[i : i + _PAIRS]], axis=1)[:, -1] for i in range(0, len(q), _PAIRS)])
    score = dot / (nm[r] * nu[q])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return q[top], r[top], score[top]


def top_k_batch(queries: DataFrame, rows: DataFrame, k: int = DEFAULT_K, id_: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, id, score and rank of the k rows most similar to every query of its dimension, ties by id.
    Scores are those of `top_k`, bit by bit, and don't depend on blocks."""
    size = queries.agg(F.sum(F.size(vector) * 8 + 8)).first()[0] or 0
    q = _packed(queries, id_, vector, block).select("d", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("v").alias("qv"))
    pairs = _packed(rows, id_, vector, block).join(F.broadcast(q) if size <= BROADCAST_BYTES else q, "d")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                of = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                d = b.column("d")[i].as_py()
                ids, qids, m, u = of("ids", np.int64), of("qids", np.int64), of("v", np.float64).reshape(-1, d), of("qv", np.float64).reshape(-1, d)
                for lo in range(0, len(u), 512):
                    at, r, score = _best(u[lo : lo + 512], m, ids, k)
                    yield pa.record_batch([pa.array(qids[lo + at]), pa.array(ids[r]), pa.array(score)], names=["query_id", "id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return pairs.mapInArrow(run, "query_id long, id long, score double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Entries of sparse query vectors that one block of queries holds; each block is one pass over the texts.
TERM_BLOCK = 200_000


def top_k_terms(queries: list[tuple[int, str]], docs: DataFrame, k: int, stop: Sequence[str], id_: str = "doc_id", text: str = "text", digits: int = 6) -> DataFrame:
    """query_id, id, score (rounded) and rank of the k texts whose token counts are most similar to each query's,
    ties by id.  Each batch of texts is scored against all queries of a block and passes on its k best, so
    what moves is k rows per query and batch, not a row per pair."""
    schema = "query_id long, id long, score double"
    out = docs.sparkSession.createDataFrame([], schema)
    blocks, held = [[]], 0
    for q, t in queries:
        n = _term_counts(t, stop)
        if held + len(n) > TERM_BLOCK:
            blocks, held = [*blocks, []], 0
        blocks[-1].append((q, n))
        held += len(n)
    texts = spread(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")))
    for block in [b for b in blocks if b]:
        out = out.unionByName(texts.mapInArrow(_term_scorer(block, k, stop, digits), schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _term_counts(text: str | None, stop: Sequence[str]) -> Counter:
    n = Counter(re.findall("[a-z]{3,}", (text or "").lower()))
    for w in stop:
        n.pop(w, None)
    return n


def _term_scorer(block: list[tuple[int, Counter]], k: int, stop: Sequence[str], digits: int):  # noqa: ANN202
    """Entries of all queries lie by token, one token's behind the other's; a batch of texts gives (text, token,
    weight) triples, which are repeated for the queries of their tokens and added up by text and query."""
    entries: dict[str, list[tuple[int, float]]] = {}
    for j, (_, n) in enumerate(block):
        size = math.sqrt(sum(x * x for x in n.values()))
        for w, x in n.items():
            entries.setdefault(w, []).append((j, x / size))
    number = {w: i for i, w in enumerate(entries)}
    end = np.cumsum([len(e) for e in entries.values()], dtype=np.int64)
    of, weight = (np.array([x[c] for e in entries.values() for x in e], t) for c, t in ((0, np.int64), (1, float)))
    ids = [q for q, _ in block]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                docs, at, term, x = part.column("id").to_pylist(), [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    n = _term_counts(t, stop)
                    if known := n.keys() & number.keys():
                        size = math.sqrt(sum(v * v for v in n.values()))
                        at += [i] * len(known)
                        term += [number[w] for w in known]
                        x += [n[w] / size for w in known]
                if not term or not ids:
                    continue
                last = end[term]
                many = last - np.where(np.array(term) > 0, end[np.array(term) - 1], 0)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - last, many)
                scores = np.bincount(np.repeat(at, many) * len(ids) + of[place], np.repeat(x, many) * weight[place], len(docs) * len(ids)).reshape(len(docs), len(ids))
                rows = []
                for j, q in enumerate(ids):
                    some = [(-round(float(scores[i, j]), digits), docs[i]) for i in np.flatnonzero(scores[:, j] > 0).tolist()]
                    rows += [(q, d, -s) for s, d in heapq.nsmallest(k, some)]
                yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return run
