"""Substring deduplication over bytes, by longest previous factors in partitioned suffix arrays.

A byte is removed if a string of `depth` bytes that covers it also starts earlier in the corpus, by
document and place: if the longest previous factor of a suffix there (the longest prefix that it shares
with an earlier suffix) has `depth` bytes or more.  Longest previous factors come from the suffix array:
of the entries with a smaller text position, the nearest before and the nearest after a suffix in suffix
order share most with it, and the least of the common prefixes between them tells how much.  Suffixes are
sorted, and lengths counted, to `depth` bytes, which is all that is asked.

One suffix array of the corpus would not be distributed.  Suffixes that agree on `depth` bytes also
agree on the least hash among the `anchor`-byte strings in them; so each task cuts its texts into
runs of starts that share that anchor, and sends a run as one string to the anchor's bucket.  Each
bucket has a suffix array of its own, and no previous factor of `depth` bytes is missed.

Where the runs of one anchor would outgrow a bucket (what surrounds a string that many documents share), their
strings of `depth` bytes go one by one, by 128 bits of their own, to as many buckets as there are; equal
ones meet there in order of position.

What needs no sorting is settled before: of equal runs only the first travels and is sorted, and a run
joins the array only if it shares, beside the anchor, the half of a string that lies on one side.

Defined cases: null and empty texts have no bytes; a null doc_id comes after all ids; rows that share
an id come by a hash of their text, and equal rows count as one; a character may lose some of its
bytes, so what is kept is binary; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, ranges
from .common import U64
from .substrings import sliding_argmin


@dataclass(frozen=True)
class Suffixes:
    """depth: bytes of a repeated string.  anchor: bytes of an anchor (16).  chunk: bytes of text that a
    task cuts at once.  buckets: per shuffle partition at least; bucket: bytes of
    text for each at most, on average.  hot: bytes of runs from which an anchor's strings are
    dealt one by one.  bits: of a hash that give way to its place; more bytes are taken in blocks."""

    depth: int = 100
    anchor: int = 16
    chunk: int = 2 << 20
    buckets: int = 2
    bucket: int = 16 << 20
    hot: int = 4 << 20
    bits: int = 24

    @property
    def half(self) -> int:
        """An anchor and the longer side of any string around it have so many bytes at least."""
        return self.anchor + -(-(self.depth - self.anchor) // 2)


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number; buf is padded with eight bytes."""
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))


def hashed(x: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place, of loads x."""
    offs = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    if isinstance(at, slice):
        n = len(x) - size + 8
        parts = [x[o : o + n] for o in offs]
    else:
        parts = [x[at + o] for o in offs]
    h = parts[0] * common._MULT[0]
    for i, q in enumerate(parts[1:], 1):
        h = common.mix(h) + q * common._MULT[i]
    return common.mix(h)


def cut(buf: np.ndarray, bounds: np.ndarray, p: Suffixes) -> tuple[np.ndarray, ...]:
    """Runs of the texts that lie in buf one behind the other (bounds: begin of each, and the end): first
    start, last start, hash of the anchor, and the anchor's offset in the run with 128 added if the
    run has several."""
    none = (np.empty(0, np.int64),) * 2 + (np.empty(0, U64), np.empty(0, np.uint8))
    n = int(bounds[-1]) - p.depth + 1
    if n <= 0:
        return none
    gram = hashed(loads(np.concatenate([buf, np.zeros(8, np.uint8)])), slice(None), p.anchor)[: int(bounds[-1]) - p.anchor + 1]
    at = sliding_argmin(gram, p.depth - p.anchor + 1, p.bits)
    least = gram[at]
    valid = np.ones(n, bool)
    for e in bounds[1:-1].tolist():
        valid[max(0, e - p.depth + 1) : e] = False
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    heads = np.flatnonzero(new)
    ok = valid[heads]
    first, last = heads[ok], np.append(heads[1:], n)[ok] - 1
    several = at[first] != at[last]
    return first, last, least[first], ((at[first] - first) + 128 * several).astype(np.uint8)


def _sizes(b: pa.RecordBatch, p: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a chunk's runs, and their bytes."""
    raws = [(t.as_py() or "").encode() for t in b.column("text")]
    first, last, anchor, _ = cut(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]), p)
    return anchor, last - first + p.depth


def _send(batches: Iterable[pa.RecordBatch], p: Suffixes, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in common.chunks(batches, p.chunk):
        id_ = ranges.ids(b.column("doc_id"))
        raws = [(t.as_py() or "").encode() for t in b.column("text")]
        keys = np.array([ranges.text_key(r) for r in raws], U64)
        order = np.lexsort((keys, id_))
        _, once = np.unique(np.stack([id_[order], keys[order].view(np.int64)]), axis=1, return_index=True)
        order = order[np.sort(once)]
        raws, id_, keys = [raws[i] for i in order.tolist()], id_[order], keys[order]
        for group in ranges.parts([len(r) for r in raws], p.chunk, p.depth - 1):
            own, at, _ = (np.array(c, np.int64) for c in zip(*group))
            yield from _cut_and_pack([raws[i][x:y] for i, x, y in group], id_[own], keys[own], at, p, n_buckets, hot)


def _cut_and_pack(texts: list[bytes], id_: np.ndarray, keys: np.ndarray, offset: np.ndarray, p: Suffixes, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for texts, or pieces of them that begin at `offset`, in order of position."""
    text, bounds = b"".join(texts), np.cumsum([0, *map(len, texts)])
    first, last, anchor, off = cut(np.frombuffer(text, np.uint8), bounds, p)
    if not len(first):
        return
    rows = []
    if (burning := np.isin(anchor, hot)).any():
        many = (last - first + 1)[burning]
        at = np.arange(many.sum()) + np.repeat(first[burning] - (np.cumsum(many) - many), many)
        x = loads(np.frombuffer(text + bytes(8), np.uint8))
        one, two, own = hashed(x, at, p.depth), hashed(x ^ U64(0x5851F42D4C957F2D), at, p.depth), np.searchsorted(bounds, at, "right") - 1
        order = np.lexsort((at, two, one))  # texts lie in order of position
        gone = np.empty(len(at), bool)
        gone[order] = ranges.groups(one[order], two[order]) != np.arange(len(at))
        place = at - bounds[own] + offset[own]
        run, count = ranges.joined_runs(gone, at, own)
        rows += ranges.packed(id_[own][run], keys[own][run], place[run], count, n_buckets)
        rows += ranges.windows(one[~gone], two[~gone], id_[own][~gone], keys[own][~gone], place[~gone], n_buckets)
        first, last, anchor, off = (c[~burning] for c in (first, last, anchor, off))
    d = np.searchsorted(bounds, first, "right") - 1
    strings = [text[x:y] for x, y in zip(first.tolist(), (last + p.depth).tolist())]
    seen: dict[bytes, int] = {}
    gone = np.fromiter(map(seen.setdefault, strings, range(len(strings))), np.int64, len(strings)) != np.arange(len(strings))
    start = first - bounds[d] + offset[d]
    rows += ranges.packed(id_[d][gone], keys[d][gone], start[gone], (last - first + 1)[gone], n_buckets)
    bucket = (common.mix(anchor) % U64(n_buckets)).astype(np.int32)
    stay = np.flatnonzero(~gone)
    stay = stay[np.argsort(bucket[stay], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[stay])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(stay)]):
        if lo == hi:
            continue
        own = stay[lo:hi]
        meta = common.pack(id_[d[own]], keys[d[own]], start[own].astype(np.int32), (last - first + p.depth)[own].astype(np.int32), off[own])
        rows.append((ranges.STRINGS, int(bucket[own[0]]), len(own), len(meta).to_bytes(4, "little") + meta + common.zip_bytes(b"".join([strings[i] for i in own.tolist()]))))
    yield ranges.batch(rows)


def suffix_array(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in `starts` (ascending; each start has `depth` bytes) in suffix order, to depth bytes and then
    by position; and the number of bytes, depth at most, that each suffix shares with the one before."""
    n = len(buf)
    word = loads(np.concatenate([buf, np.zeros(8, np.uint8)])).byteswap()[:n]
    rank, have = np.unique(word, return_inverse=True)[1], 8
    while have < depth:
        step = min(have, depth - have)
        rank = np.unique(rank[: n - step] * np.int64(n + 1) + rank[step:], return_inverse=True)[1]
        n, have = n - step, have + step
    r = rank[starts]
    order = np.argsort(r, kind="stable")
    at, shared = starts[order], np.full(len(order), depth, np.int32)
    if len(order):
        shared[0] = 0
    open_ = 1 + np.flatnonzero(r[order[1:]] != r[order[:-1]])  # pairs that differ somewhere: eight bytes at a time
    for o in range(0, depth, 8):
        x = word[np.minimum(at[open_] + o, len(buf) - 1)] ^ word[np.minimum(at[open_ - 1] + o, len(buf) - 1)]
        apart = x != 0
        lead = (x[apart].byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(1)  # words hold the first byte highest
        shared[open_[apart]] = np.minimum(depth, o + lead)
        open_ = open_[~apart]
    return order, shared


def nearest_smaller(a: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a the place of the nearest smaller one before it, -1 if there is none, and the least
    of `shared` on the way there (shared[i] lies between i - 1 and i).

    All entries look at once: one whose candidate isn't smaller goes on to that one's candidate, which
    skips only larger entries."""
    to, least = np.arange(-1, len(a) - 1), shared.copy()
    go = np.flatnonzero((to >= 0) & (a[to] > a))
    while len(go):
        via = to[go]
        least[go] = np.minimum(least[go], least[via])
        to[go] = to[via]
        go = go[(to[go] >= 0) & (a[to[go]] > a[go])]
    least[to < 0] = 0
    return to, least


def longest_previous_factors(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffix at each start (ascending; each has `depth` bytes) how many bytes, depth at most, it shares
    with one that starts earlier, and the place in `starts` of such a one (-1 if it shares none).  The longest
    is shared with the nearest suffix of a smaller position before or after it in suffix order."""
    order, shared = suffix_array(buf, starts, depth)
    length, source = np.zeros(len(starts), np.int32), np.full(len(starts), -1, np.int64)
    before, common_before = nearest_smaller(order, shared)
    back = np.concatenate([[0], shared[:0:-1]]).astype(np.int32) if len(shared) else shared
    after, common_after = (x[::-1] for x in nearest_smaller(order[::-1], back))
    after = np.where(after >= 0, len(order) - 1 - after, -1)
    best = np.where(common_before >= common_after, before, after)
    length[order] = np.maximum(common_before, common_after)
    source[order] = np.where(length[order] > 0, order[best], -1)
    return length, source


def _sort(t: pa.Table, p: Suffixes, n_buckets: int) -> pa.Table:
    """One bucket: ranges pass; what its strings repeat of earlier ones becomes ranges."""
    meta, texts, out, single = [], [], [], []
    for kind, bucket, n, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "n", "blob"))):
        if kind == ranges.RANGES:
            out.append((kind, bucket, n, blob))
            continue
        if kind == ranges.WINDOWS:
            single.append((n, blob))
            continue
        size = int.from_bytes(blob[:4], "little")
        meta.append(common.unpack(blob[4 : 4 + size], n, "i8", "u8", "i4", "i4", "u1"))
        texts.append(common.unzip_bytes(blob[4 + size :]))
    if single:
        one, two, id_, key, start = ranges.unpacked_windows(single)
        gone = ranges.groups(one, two) != np.arange(len(one))
        out += ranges.packed(id_[gone], key[gone], start[gone], np.ones(int(gone.sum()), np.int64), n_buckets)
    if meta:
        id_, key, start, length, off = (np.concatenate(c) for c in zip(*meta))
        text = b"".join(texts)
        del texts, meta
        end = np.cumsum(length, dtype=np.int64)
        order = np.lexsort((start, key, id_))
        id_, key, start, length, off, begin = id_[order], key[order], start[order], length[order], off[order], (end - length)[order]
        again = np.zeros(len(id_), bool)
        again[1:] = (id_[1:] == id_[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1])
        strings = [text[x:y] for x, y in zip(begin.tolist(), (begin + length).tolist())]
        seen: dict[bytes, int] = {}
        copy = np.fromiter(map(seen.setdefault, strings, range(len(strings))), np.int64, len(strings)) != np.arange(len(strings))
        gone = copy & ~again
        out += ranges.packed(id_[gone], key[gone], start[gone], (length - p.depth + 1)[gone], n_buckets)
        left = np.flatnonzero(~copy & ~again)
        left = left[_shared(text, begin[left], length[left], off[left], p)]
        if len(left):
            buf = np.frombuffer(b"".join([strings[i] for i in left.tolist()]), np.uint8)
            del strings, text
            size = length[left].astype(np.int64)
            begin = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(left)), size - p.depth + 1)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size - p.depth + 1) - (size - p.depth + 1), size - p.depth + 1)
            longest, _ = longest_previous_factors(buf, begin[owner] + place, p.depth)
            at, count = ranges.runs(longest >= p.depth, owner)
            s = left[owner[at]]
            out += ranges.packed(id_[s], key[s], start[s] + place[at], count, n_buckets)
    return pa.Table.from_batches([ranges.batch(out)])


def _shared(text: bytes, begin: np.ndarray, length: np.ndarray, off: np.ndarray, p: Suffixes) -> np.ndarray:
    """Which strings may share `depth` bytes with another one: the anchor with its right half or with
    its left half occurs twice, or the anchor also stands in a string that has it several times."""
    x = loads(np.frombuffer(text + bytes(8), np.uint8))
    at = begin + (off & 127)
    keep = np.zeros(len(begin), bool)
    side = p.half - p.anchor
    for has, a in ((at + p.half <= begin + length, at), (at - side >= begin, at - side)):
        i = np.flatnonzero(has)
        h = hashed(x, a[i], p.half)
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        keep[i] |= n[inverse] > 1
    if (several := off > 127).any():
        h = hashed(x, at, p.anchor)
        keep |= np.isin(h, h[several])
    return keep


def removals(docs: DataFrame, p: Suffixes = Suffixes()) -> tuple[DataFrame, int]:
    """Packed ranges of starts to remove, by document bucket; and the number of buckets."""
    n = common.bucket_count(docs, p.buckets, p.bucket)
    hot = ranges.heavy(docs, lambda b: _sizes(b, p), p.chunk, p.hot)
    sent = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _send(it, p, n, hot), ranges.DDL)
    return common.by_bucket(sent, n).applyInArrow(lambda t: _sort(t, p, n), ranges.DDL), n


def deduplicate(docs: DataFrame, p: Suffixes = Suffixes(), kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, the
    bytes that stay as `kept`."""
    found, n = removals(docs, p)

    def make(raw: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple:
        spans, left = 0, raw
        if len(starts):
            d = np.zeros(len(raw) + 1, np.int32)
            np.add.at(d, starts, 1)
            np.add.at(d, starts + counts + p.depth - 1, -1)
            stay = np.cumsum(d[:-1]) == 0
            spans = int((~stay[1:] & stay[:-1]).sum()) + int(not stay[0])
            left = np.frombuffer(raw, np.uint8)[stay].tobytes()
        return len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), *([left] * kept)

    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] * kept)]
    return ranges.apply(docs, found, n, make, fields)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"), kept=False)
