"""Toxicity by multiple-instance learning.

Only documents carry labels.  A document is a bag of sentences; each sentence has a logistic score
over hashed words, and the document's score is their noisy-or: 1 - prod(1 - p).  The weights are
fitted to the document labels through that product, so blame falls on the sentences that explain a
label, and the same scores then locate the offending sentences.

The classifier is fitted in one task on a bounded sample (`Fit.rows` labelled documents and `Fit.bytes` of
text, taken by the hash of their id); only its weights come to the driver.  Scoring covers every text
whole.

Defined cases: null and empty texts have no sentence and score 0; null labels and ids that several
label rows disagree on are left to the largest label; without a label of both kinds every score is
0; null doc_id passes through; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
ENDS = (".", "!", "?", "\n")


@dataclass(frozen=True)
class Fit:
    """rows, bytes: labelled documents and bytes of text used at most (in expectation); longest: longer texts
    are scored but not learned from.  bits: log2 of the feature table.
    least, chi2: documents that must hold a feature, and how far its share of toxic ones must be from
    the overall share, for it to get a weight; most words of a document say nothing about its label,
    and weights for them would only remember the training rows."""

    rows: int = 12_000
    bytes: int = 64 << 20
    longest: int = 1 << 20
    bits: int = 20
    least: int = 4
    chi2: float = 20.0
    steps: int = 600
    rate: float = 1.0
    l2: float = 1e-6


class Words(dict):
    """Token -> feature number, -1 for what ends a sentence; remembers up to a bound."""

    def __init__(self, bits: int, most: int = 500_000):
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, w: str) -> int:
        i = -1 if w[0] in ENDS else common.word_hash(w) & self.mask
        if len(self) < self.most:
            self[w] = i
        return i


def features(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and the number of each word's sentence, from 0 and gapless."""
    t = TOKEN.findall(text.lower()) if text else []
    f = np.fromiter(map(words.__getitem__, t), np.int64, len(t))
    end = f < 0
    sent = np.cumsum(end)[~end]
    return f[~end], np.unique(sent, return_inverse=True)[1] if len(sent) else sent


@dataclass(frozen=True)
class Model:
    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def sentence_scores(f: np.ndarray, sent: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    z = np.bincount(sent, w[f]) + bias if len(f) else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, text and toxic of labelled documents: all of them, or so large a share that neither rows nor bytes are
    beyond the bounds of `fit`."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))

    def some(share: float) -> DataFrame:
        taken = known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))
        # at most about fit.rows rows of a few bytes
        return docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= fit.longest).join(F.broadcast(taken), "doc_id")

    share = min(1.0, fit.rows / max(1, known.count()))
    n, size = some(share).agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return some(share * min(1.0, fit.rows / max(1, n), fit.bytes / max(1, size or 0)))


def train(rows: Iterable[tuple[str | None, int]], fit: Fit = Fit()) -> Model:
    """Full-batch AdaGrad on the noisy-or likelihood; sentences of a document share its label's
    gradient in proportion to their own odds."""
    words = Words(fit.bits, 200_000)
    feats, sents, docs, y, n_sent = [], [], [], [], 0
    for text, label in rows:
        f, s = features(text, words)
        if not len(f):
            continue
        feats.append(f)
        sents.append(s + n_sent)
        docs.append(np.full(int(s[-1]) + 1, len(y)))
        n_sent += int(s[-1]) + 1
        y.append(label)
    none = Model(fit.bits, np.empty(0, np.int64), np.empty(0, np.float32), -50.0)
    if len(set(y)) < 2:
        return none
    f, sent, doc, y = np.concatenate(feats), np.concatenate(sents), np.concatenate(docs), np.array(y)
    distinct = [np.unique(x) for x in feats]
    seen, at, n_docs = np.unique(np.concatenate(distinct), return_inverse=True, return_counts=True)
    n_toxic = np.bincount(at, np.repeat(y, [len(x) for x in distinct]), len(seen))
    share, n = y.mean(), len(y)
    apart = (n_toxic - share * n_docs) ** 2 / (share * (1 - share) * n_docs * np.maximum(1 - n_docs / n, 1 / n))
    index = seen[(n_docs >= fit.least) & (apart >= fit.chi2)]
    at = np.minimum(np.searchsorted(index, f), max(0, len(index) - 1))
    known = index[at] == f if len(index) else np.zeros(len(f), bool)
    f, fs = at[known], sent[known]
    w, b, gw, gb = np.zeros(len(index)), -5.0, np.full(len(index), 1e-8), 1e-8
    for _ in range(fit.steps):
        z = np.bincount(fs, w[f], n_sent) + b
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        s = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log of the chance that no sentence is toxic
        blame = np.where(y == 1, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0)
        dz = p * blame[doc] / len(y)
        dw, db = np.bincount(f, dz[fs], len(w)) + fit.l2 * w, dz.sum()
        gw += dw**2
        gb += db**2
        w -= fit.rate * dw / np.sqrt(gw)
        b -= fit.rate * db / np.sqrt(gb)
    return Model(fit.bits, index, w.astype(np.float32), float(b))


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """The model of a sample, trained in one task on its rows in order of id, label and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((d, y, t or "") for b in batches for d, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")))))
        m = train(((t, y) for _, y, t in rows), fit)
        yield pa.record_batch([pa.array([m.index.astype("<i8").tobytes()]), pa.array([m.weight.astype("<f4").tobytes()]), pa.array([m.bias])], names=["index", "weight", "bias"])

    rows = sample(docs, labels, fit).select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int")).repartition(1)
    got = rows.mapInArrow(run, "index binary, weight binary, bias double").collect()
    if not got:  # a partition without rows runs no task
        return train([], fit)
    return Model(fit.bits, np.frombuffer(got[0]["index"], "<i8"), np.frombuffer(got[0]["weight"], "<f4"), got[0]["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a `score` from 0 to 1; other columns stay."""
    kept = docs.drop("score")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = model.dense(), Words(model.bits)
        for b in common.chunks(batches, 8 << 20):
            s = [noisy_or(sentence_scores(*features(t.as_py(), words), w, model.bias)) for t in b.column("text")]
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "score"])

    return kept.mapInArrow(run, schema)


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, sentence (from 0, of those with a word), begin and end in code
    points, text, score; sentences that score under `least` are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = model.dense(), Words(model.bits)
        for b in common.chunks(batches, 8 << 20):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                f, s = features(t, words)
                p = sentence_scores(f, s, w, model.bias)
                if len(p) and p.max() >= least:
                    spans = sentences(t)
                    rows += [(d, i, *spans[i], t[slice(*spans[i])], float(p[i])) for i in np.flatnonzero(p >= least).tolist()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.record_batch([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["doc_id", "sentence", "begin", "end", "text", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sentence long, begin long, end long, text string, score double")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans from the first to the last word of each sentence that has one; places in `text` hold as
    long as lower-casing keeps its length, else places in the lower-cased text."""
    low = text.lower()
    out: list[tuple[int, int]] = []
    new = True
    for m in TOKEN.finditer(low):
        if m[0][0] in ENDS:
            new = True
        elif new:
            out.append(m.span())
            new = False
        else:
            out[-1] = (out[-1][0], m.end())
    return out


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.crc_mod("doc_id", 3) == 1
    model = fitted(docs, labels.where(~held))
    scored = score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
