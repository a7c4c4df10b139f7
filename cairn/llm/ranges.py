"""Ranges to remove, on their way back to their documents: packed by document bucket, and applied
there to the whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of packed ranges, of either kind of shuffle: what bucket they go to, how many entries, the blob.
DDL = "kind int, bucket int, n int, blob binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
#: Rows that carry strings, ranges, whole texts, and hashes of windows.
STRINGS, RANGES, TEXTS, WINDOWS = 0, 1, 2, 3
#: Stands for a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def text_key(raw: bytes) -> int:
    """Tells the rows of one doc_id apart: 64 bits."""
    return xxhash.xxh3_64_intdigest(raw)


def bucket_of(doc_id: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Rows of one doc_id, or without one, are spread by their text."""
    return (common.mix(common.mix(doc_id.astype(np.int64).view(np.uint64) + common.U64(0x51ED27)) + key) % common.U64(n)).astype(np.int32)


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def packed(doc: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Ranges [start, start + count) of documents as rows of DDL, one per document bucket."""
    b = bucket_of(doc, key, n_buckets)
    order = np.lexsort((start, doc, b))
    b, doc, key, start, count = b[order], doc[order], key[order], start[order], count[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
        if lo < hi:
            yield RANGES, int(b[lo]), hi - lo, common.pack(doc[lo:hi], key[lo:hi].astype(np.uint64), start[lo:hi].astype(np.int32), count[lo:hi].astype(np.int32))


def unpacked(n: int, blob: bytes) -> list[np.ndarray]:
    return common.unpack(blob, n, "i8", "u8", "i4", "i4")


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def windows(one: np.ndarray, two: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Windows that go by 128 bits of their own as rows of DDL, one per bucket of these."""
    b = (common.mix(one ^ two) % common.U64(n_buckets)).astype(np.int32)
    order = np.lexsort((one, b))
    b, cols = b[order], [c[order] for c in (one, two, doc, key.astype(np.uint64), start.astype(np.int32))]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
        if lo < hi:
            yield WINDOWS, int(b[lo]), hi - lo, common.pack(*(c[lo:hi] for c in cols))


def unpacked_windows(blobs: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Of rows (n, blob): one, two, doc, key, start, sorted in this order, each window of a document once."""
    cols = [np.concatenate(c) for c in zip(*(common.unpack(blob, n, "u8", "u8", "i8", "u8", "i4") for n, blob in blobs))]
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [c[new] for c in cols]


def groups(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of sorted windows the place of the first equal one of each."""
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))


def heavy(docs: DataFrame, sizes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], chunk: int, hot: int) -> np.ndarray:
    """Sorted 64-bit keys for which `sizes` (keys and bytes of a chunk's strings) sums up to `hot` bytes or more
    over all documents.  Tasks add up a million strings at a time and tell the sums of `hot` / 4096 or more, so
    what a key has beyond its sum is less than that for each million.  At most MOST keys come back; were there more, the bound
    would be raised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in common.chunks(batches, chunk):
            held.append(sizes(b))
            n += len(held[-1][0])
            if n > 1 << 20:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, size = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        total = np.add.reduceat(size[order], head).astype(np.int64) if len(head) else np.empty(0, np.int64)
        ok = total >= max(1, hot // 4096)
        return pa.record_batch([pa.array(keys[head][ok].view(np.int64)), pa.array(total[ok])], names=["key", "size"])

    told = docs.select("doc_id", "text").mapInArrow(run, "key long, size long").groupBy("key").agg(F.sum("size").alias("size"))
    sums = common.stored(told.where(F.col("size") >= hot))
    while sums.count() > MOST:
        hot *= 2
        sums = sums.where(F.col("size") >= hot)
    return np.sort(np.array([r["key"] for r in sums.select("key").collect()], np.int64).view(np.uint64))


#: Keys of 8 bytes that the driver holds and sends to all tasks.
MOST = 1 << 20


def parts(lengths: list[int], size: int, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of about `size` entries of rows, as (row, begin, end): short rows together, long ones in pieces that
    overlap, so that what is looked at together is bounded whatever the length of a row."""
    group, held = [], 0
    for i, n in enumerate(lengths):
        for at in range(0, max(1, n - overlap), size):
            end = min(n, at + size + overlap)
            group.append((i, at, end))
            held += end - at
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def joined_runs(flags: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `runs`, of places `at` (ascending), which need not follow one another."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (group[1:] != group[:-1])
    return runs(flags, np.cumsum(new))


def runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of true flags that lie in one group."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (group[at[1:]] != group[at[:-1]])])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def apply(docs: DataFrame, found: DataFrame, n_buckets: int, make: Callable[[bytes, np.ndarray, np.ndarray], tuple], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Brings each text together with its ranges (starts, counts) and calls make(utf-8 text, starts,
    counts) for the values of `fields`; the result has doc_id and these.  A bucket holds an even share
    of the documents, so a task's memory is the input over the number of buckets."""
    schema = pa.schema([("doc_id", pa.int64()), *fields])
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    ddl = "doc_id long, " + ", ".join(f"{n} {kinds[t]}" for n, t in fields)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of a chunk by bucket, compressed together: far smaller on the way than row by row."""
        for b in common.chunks(batches, 16 << 20):
            d = ids(b.column("doc_id"))
            raws = [(t.as_py() or "").encode() for t in b.column("text")]
            key = np.array([text_key(r) for r in raws], np.uint64)
            size, bucket, rows = np.array([len(r) for r in raws], np.int32), bucket_of(d, key, n_buckets), []
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
                own = order[lo:hi]
                meta = common.pack(d[own], key[own], size[own])
                rows.append((TEXTS, int(bucket[own[0]]), hi - lo, len(meta).to_bytes(4, "little") + meta + common.zip_bytes(b"".join([raws[i] for i in own.tolist()]), 3)))
            yield batch(rows)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpacked(n, blob) for n, blob in zip(right.column("n").to_pylist(), right.column("blob").to_pylist())]
        none = np.empty(0, np.int64)
        doc, key, start, count = (np.concatenate(c) for c in zip(*parts)) if parts else (none, none.view(np.uint64), none, none)
        order = np.lexsort((start, key, doc))
        doc, key, start, count = doc[order], key[order], start[order], count[order]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.empty(0, np.int64)
        own_ranges = dict(zip(zip(doc[head].tolist(), key[head].tolist()), zip(head.tolist(), [*head[1:].tolist(), len(doc)])))
        out_ids, rows = [], []
        for n, blob in zip(left.column("n").to_pylist(), left.column("blob").to_pylist()):
            m = int.from_bytes(blob[:4], "little")
            d, k, size = common.unpack(blob[4 : 4 + m], n, "i8", "u8", "i4")
            texts, end = common.unzip_bytes(blob[4 + m :]), np.cumsum(size, dtype=np.int64)
            out_ids.append(d)
            for i, who in enumerate(zip(d.tolist(), k.tolist())):
                lo, hi = own_ranges.get(who, (0, 0))
                rows.append(make(texts[end[i] - size[i] : end[i]], start[lo:hi], count[lo:hi]))
        cols = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(list(schema)[1:])]
        d = np.concatenate(out_ids) if out_ids else np.empty(0, np.int64)
        return pa.table([pa.array(d, mask=d == LAST), *cols], schema=schema)

    a = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(keyed, DDL)
    return common.by_bucket(a, n_buckets).cogroup(common.by_bucket(found, n_buckets)).applyInArrow(merge, ddl)
