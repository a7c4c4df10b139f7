"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3, within words padded
with a blank).  A document gets the language whose profile has the smallest out-of-place distance
to the document's own list: the sum over its n-grams of the difference in rank, or of the largest
possible difference where the profile lacks the n-gram.

Profiles count all training rows, with partial sums per task; a profile has `PROFILE` entries, so
what the driver holds grows with the number of languages alone.

Defined cases: null text and text without a letter get `und` and score 0, as does every text where
nothing could be learned; null doc_id passes through; repeated rows are judged one by one; ties in
frequency go to the smaller code points and ties in distance to the language first by name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PROFILE, UNKNOWN = 400, "und"
#: Stands for what isn't a letter; not 0, so that n-grams of different orders differ.
BLANK = 1
_LETTER: np.ndarray | None = None
_BLANKS = re.compile(r"\s")


def letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's letters with one blank between, before and after its runs of letters; and the place
    of each in the text plus one."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c = np.concatenate([[BLANK], np.where(letters()[c], c, BLANK), [BLANK]])
    at = np.flatnonzero(np.concatenate([[True], (c[1:] != BLANK) | (c[:-1] != BLANK)]))
    return c[at], at


def paired(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams of coded letters, by order; 21 bits a letter or blank."""
    two = c[:-1] << 21 | c[1:]
    return c[c != BLANK], two, (two[:-1] << 21 | c[2:])[c[1:-1] != BLANK]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as integers of up to 63 bits."""
    c, _ = coded(text.lower())
    return np.concatenate(paired(c)) if len(c) > 2 else np.empty(0, np.int64)


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in pieces of about `size` characters that end at a blank, so no word is cut."""
    at = 0
    while at < len(text):
        m = _BLANKS.search(text, min(len(text), at + size))
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text in ascending order, and how often each occurs."""
    u, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in slices(text):
        v, m = counted(grams(part))
        u, n = counted(np.concatenate([u, v]), np.concatenate([n, m])) if len(u) else (v, m)
    return u, n


def weighted(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of lower-cased words with their numbers: each word's letters are looked at once."""
    c, at = coded(" ".join(words))
    if len(c) < 3:
        return (np.empty(0, np.int64),) * 2
    # a gram belongs to the word of its letter: its own, the other one's than the blank, the middle one's
    word = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    word = word[np.clip(at - 1, 0, len(word) - 1)]
    n = np.fromiter(words.values(), np.int64, len(words))[word]
    keys = paired(c)
    return counted(np.concatenate(keys), np.concatenate([n[c != BLANK], np.where(c[:-1] != BLANK, n[:-1], n[1:]), n[1:-1][c[1:-1] != BLANK]]))


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and how often each occurs."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights, len(u)).astype(np.int64)


def profiles(train: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Of rows with text and lang: for each language its most frequent n-grams, most frequent first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in common.chunks(batches, 16 << 20):
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().split())
            for lang, n in words.items():
                got, had = weighted(n), total.get(lang)
                total[lang] = got if had is None else counted(np.concatenate([had[0], got[0]]), np.concatenate([had[1], got[1]]))
        for lang, (u, n) in total.items():
            yield pa.record_batch([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n)], names=["lang", "gram", "n"])

    summed = train.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "rank", "gram").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(out.items())}


class Ranks:
    """Profiles as one table: the rank of each known n-gram in each language, `size` where it has none."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = list(by_lang), size
        self.grams = np.unique(np.concatenate([*by_lang.values(), np.empty(0, np.int64)]))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), size, np.int32)
        for j, g in enumerate(by_lang.values()):
            self.rank[np.searchsorted(self.grams, g), j] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        u, n = counts(text) if text and self.langs else ((), ())
        if not len(u):
            return UNKNOWN, 0.0
        u = u[np.argsort(-n, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.grams, u), len(self.grams) - 1)
        at = np.where(self.grams[at] == u, at, len(self.grams))
        ranks = self.rank[at]
        apart = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(u))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(u)))


def identify(docs: DataFrame, by_lang: dict[str, np.ndarray]) -> DataFrame:
    """docs (doc_id, text and others) with lang_pred and score; the others don't matter and stay."""
    ranks = Ranks(by_lang)
    kept = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", lang_pred string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, 8 << 20):
            got = [ranks.predict(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.crc_mod("doc_id", 4) == 2
    by_lang = profiles(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), by_lang).select("doc_id", "held_out", "lang_pred", "score")
