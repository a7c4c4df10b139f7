"""Substring deduplication over word windows, by super-k-mer partitioning.

Consecutive windows of `k` words that share their minimiser (the least hash of `m` consecutive words)
form a super-k-mer.  It travels once, as one packed string, to the bucket of the minimiser, so equal
windows always meet in one bucket; sorting the windows there tells exactly which documents each
occurs in.  A window that also starts in a document with a smaller id marks its words as removed;
the marks go back to the documents as packed ranges.

Before the shuffle each task settles what it can: of equal super-k-mers in one chunk of documents
only those of the smallest id travel, the others are removed for certain.  So a passage that a third
of the documents share costs one string per chunk.

Minimisers made of short words come last in the order, since such words are frequent.  Where the super-k-mers
of one minimiser would still outgrow a bucket (what surrounds a passage that many documents share), its
windows go one by one, by 128 bits of their own, to as many buckets as there are.

Defined cases: null and empty texts have no words (sha256 of the empty string); a null doc_id comes
after all ids; rows that share an id don't remove each other's words; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, ranges
from .common import U64


@dataclass(frozen=True)
class SuperKmers:
    """k: words of a window.  m: words of a minimiser.  chunk: bytes of text that a task settles at
    once.  buckets: of windows and of documents, per shuffle partition at least; bucket: bytes of
    text for each at most, on average.  hot: bytes of super-k-mers from which a minimiser's windows
    are dealt one by one.  bits: of a key that give way to its place; longer texts are taken in blocks."""

    k: int = 13
    m: int = 3
    chunk: int = 4 << 20
    buckets: int = 2
    bucket: int = 16 << 20
    hot: int = 4 << 20
    bits: int = 24


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive entries."""
    have, out = 1, a
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_argmin(a: np.ndarray, w: int, bits: int) -> np.ndarray:
    """Place of the least of each w consecutive entries, by all but the low `bits` bits, the first of equal
    ones; in blocks of 2**bits entries that overlap by w - 1, so that any number of entries will do."""
    low, size = (U64(1) << U64(bits)) - U64(1), 1 << bits
    if size < w:
        raise ValueError(f"{bits} bits are too few for the places of {w} entries")
    out = np.empty(max(0, len(a) - w + 1), np.int64)
    for at in range(0, len(out), size - w + 1):
        part = a[at : at + size]
        got = sliding_min(part & ~low | np.arange(len(part), dtype=U64), w) & low
        out[at : at + len(got)] = got.astype(np.int64) + at
    return out


def flat(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of all texts one behind the other, where each begins if one blank stands between two (and where the
    next would), and each one's text."""
    words = list(chain.from_iterable(texts))
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=begin[1:])
    return words, begin, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def super_kmers(begin: np.ndarray, h: np.ndarray, doc: np.ndarray, p: SuperKmers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each super-k-mer of the documents whose words stand
    one behind the other; begin and doc are as `flat` has them, and h has the words' hashes."""
    n = len(h) - p.k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, U64),)
    gram = common.window_hash(h, p.m)
    frequent = (begin[p.m :] - begin[: -p.m]) < 5 * p.m
    key = gram >> U64(1)
    key[frequent] |= U64(1) << U64(63)
    at = sliding_argmin(key, p.k - p.m + 1, p.bits)
    valid = doc[:n] == doc[p.k - 1 :]
    new = np.ones(n, bool)
    mini = gram[at]  # by value: a stretch that repeats itself stays together
    new[1:] = (mini[1:] != mini[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new & valid)
    last = np.append(np.flatnonzero(new)[1:], n)[np.searchsorted(np.flatnonzero(new), first)] - 1
    return first, last, mini[first]


def two_hashes(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each k consecutive words."""
    return common.window_hash(h, k), common.window_hash(h ^ U64(0x5851F42D4C957F2D), k)


def _sizes(b: pa.RecordBatch, p: SuperKmers) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers of a chunk's super-k-mers, and their bytes."""
    texts = [(t.as_py() or "").encode().split() for t in b.column("text")]
    words, begin, doc = flat(texts)
    first, last, mini = super_kmers(begin, common.hash_words(words), doc, p)
    return mini, begin[last + p.k] - begin[first] if len(first) else np.empty(0, np.int64)


def _apart(one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of windows the ones that also stand in a document with a smaller id."""
    order = np.lexsort((owner, two, one))
    flag = np.empty(len(order), bool)
    flag[order] = owner[order] > owner[order][ranges.groups(one[order], two[order])]
    return flag


def _send(batches: Iterable[pa.RecordBatch], p: SuperKmers, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in common.chunks(batches, p.chunk):
        id_ = ranges.ids(b.column("doc_id"))
        raws = [(t.as_py() or "").encode() for t in b.column("text")]
        by_id = np.argsort(id_, kind="stable")
        raws = [raws[i] for i in by_id.tolist()]
        id_, keys = id_[by_id], np.array([ranges.text_key(r) for r in raws], np.uint64)
        split = [r.split() for r in raws]
        del raws
        for group in ranges.parts([len(w) for w in split], max(1, p.chunk // 4), p.k - 1):
            own, at, _ = (np.array(c, np.int64) for c in zip(*group))
            yield from _cut_and_pack([split[i][x:y] for i, x, y in group], id_[own], keys[own], at, p, n_buckets, hot)


def _cut_and_pack(texts: list[list[bytes]], id_: np.ndarray, keys: np.ndarray, offset: np.ndarray, p: SuperKmers, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the words of texts, or of pieces of them that begin at `offset`, in order of ids."""
    words, begin, doc = flat(texts)
    h = common.hash_words(words)
    first, last, mini = super_kmers(begin, h, doc, p)
    if not len(first):
        return
    text = b" ".join(words)
    strings = [text[x:y] for x, y in zip(begin[first].tolist(), (begin[last + p.k] - 1).tolist())]
    rows = []
    if (burning := np.isin(mini, hot)).any():
        many = (last - first + 1)[burning]
        at = np.arange(many.sum()) + np.repeat(first[burning] - (np.cumsum(many) - many), many)
        one, two = (x[at] for x in two_hashes(h, p.k))
        own = doc[at]
        place = at - np.searchsorted(doc, own) + offset[own]
        gone = _apart(one, two, id_[own])
        run, count = ranges.joined_runs(gone, at, own)
        rows += ranges.packed(id_[own][run], keys[own][run], place[run], count, n_buckets)
        rows += ranges.windows(one[~gone], two[~gone], id_[own][~gone], keys[own][~gone], place[~gone], n_buckets)
        first, last, mini = first[~burning], last[~burning], mini[~burning]
        strings = [s for s, x in zip(strings, burning.tolist()) if not x]
    d = doc[first]
    start = first - np.searchsorted(doc, d) + offset[d]
    # of equal strings those in a later document than the first go at once
    seen: dict[bytes, int] = {}
    owner = np.fromiter(map(seen.setdefault, strings, id_[d].tolist()), np.int64, len(strings))
    gone = owner < id_[d]
    rows += ranges.packed(id_[d][gone], keys[d][gone], start[gone], (last - first + 1)[gone], n_buckets)
    bucket = (common.mix(mini) % U64(n_buckets)).astype(np.int32)
    stay = np.flatnonzero(~gone)
    stay = stay[np.argsort(bucket[stay], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[stay])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(stay)]):
        if lo == hi:
            continue
        own = stay[lo:hi]
        meta = common.pack(id_[d[own]], keys[d[own]], start[own].astype(np.int32))
        body = common.zip_bytes(b"\n".join([strings[i] for i in own.tolist()]))
        rows.append((ranges.STRINGS, int(bucket[own[0]]), len(own), len(meta).to_bytes(4, "little") + meta + body))
    yield ranges.batch(rows)


def _count(t: pa.Table, p: SuperKmers, n_buckets: int) -> pa.Table:
    """One bucket: ranges pass; the windows of all strings are sorted, and those that also start in a
    smaller document become ranges."""
    meta, strings, out, single = [], [], [], []
    for kind, bucket, n, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "n", "blob"))):
        if kind == ranges.RANGES:
            out.append((kind, bucket, n, blob))
            continue
        if kind == ranges.WINDOWS:
            single.append((n, blob))
            continue
        size = int.from_bytes(blob[:4], "little")
        meta.append(common.unpack(blob[4 : 4 + size], n, "i8", "u8", "i4"))
        strings.append(common.unzip_bytes(blob[4 + size :]))
    if single:
        one, two, id_, key, start = ranges.unpacked_windows(single)
        gone = id_ > id_[ranges.groups(one, two)]
        out += ranges.packed(id_[gone], key[gone], start[gone], np.ones(int(gone.sum()), np.int64), n_buckets)
    if meta:
        id_, key, start = (np.concatenate(c) for c in zip(*meta))
        text = b"\n".join(strings)
        counts = np.array([s.count(b" ") + 1 for s in text.split(b"\n")])
        h = common.hash_words(text.split())
        del text, strings
        string = np.repeat(np.arange(len(counts)), counts)
        n = len(h) - p.k + 1
        real = np.flatnonzero(string[:n] == string[p.k - 1 :])
        one, two = (x[real] for x in two_hashes(h, p.k))
        owner = id_[string[real]]
        order = np.argsort(one, kind="stable")
        same = (one[order][1:] == one[order][:-1])
        if (two[order][1:] != two[order][:-1])[same].any():  # 64 bits did not tell two windows apart
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(owner[order], head)
        flag = np.empty(len(real), bool)
        flag[order] = owner[order] > np.repeat(least, np.diff(np.append(head, len(order))))
        own = string[real]
        at, length = ranges.runs(flag, own)
        s = own[at]
        first = np.searchsorted(own, s)
        out += ranges.packed(id_[s], key[s], start[s] + at - first, length, n_buckets)
    return pa.Table.from_batches([ranges.batch(out)])


def removals(docs: DataFrame, p: SuperKmers = SuperKmers()) -> tuple[DataFrame, int]:
    """Packed ranges of windows to remove, by document bucket; and the number of buckets."""
    n = common.bucket_count(docs, p.buckets, p.bucket)
    hot = ranges.heavy(docs, lambda b: _sizes(b, p), p.chunk, p.hot)
    sent = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _send(it, p, n, hot), ranges.DDL)
    return common.by_bucket(sent, n).applyInArrow(lambda t: _count(t, p, n), ranges.DDL), n


def deduplicate(docs: DataFrame, p: SuperKmers = SuperKmers(), text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as `text`."""
    found, n = removals(docs, p)

    def make(raw: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple:
        words = raw.split()
        if len(starts):
            d = np.zeros(len(words) + 1, np.int64)
            np.add.at(d, starts, 1)
            np.add.at(d, starts + counts + p.k - 1, -1)
            kept = [w for w, x in zip(words, (np.cumsum(d[:-1]) == 0).tolist()) if x]
        else:
            kept = words
        joined = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode()] * text)

    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] * text)]
    return ranges.apply(docs, found, n, make, fields)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"), text=False)
