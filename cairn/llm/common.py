"""What the training-data operators share: tables, stored intermediates, text kernels and packed blobs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from cairn.session import scratch, stored

__all__ = ["scratch", "stored"]
U64 = np.uint64
word_hash = xxhash.xxh3_64_intdigest

#: Odd 64-bit multipliers (fixed values) for the linear part of window hashes; one for each place.
_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) % 2**64 for i in range(64)], dtype=U64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of linear hashes."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), U64, len(words))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries of h (empty when there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    x = h[:n] * _MULT[0]
    for i in range(1, k):
        x += h[i : i + n] * _MULT[i]
    return mix(x)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n places that lie in [s, s + width) of some start s."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0


def crc_mod(col: str, m: int):
    """crc32 of the column's value as text, modulo m."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m))


_LEVELS = {n: zstandard.ZstdCompressor(level=n) for n in (1, 2, 3)}
_C = _LEVELS[1]
_D = zstandard.ZstdDecompressor()


def pack(*cols: np.ndarray) -> bytes:
    """Columns of one length as one compressed blob, byte plane by byte plane: the high bytes of
    sorted keys repeat and so nearly vanish."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in cols]
    return _C.compress(b"".join(planes))


def unpack(blob: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(_D.decompress(blob), np.uint8), 0, []
    for t in map(np.dtype, dtypes):
        size = n * t.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += size
    return out


def zip_bytes(b: bytes, level: int = 2) -> bytes:
    return _LEVELS[level].compress(b)


def unzip_bytes(b: bytes) -> bytes:
    return _D.decompress(b)


def chunks(batches: Iterable[pa.RecordBatch], size: int, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches cut or joined to about `size` bytes of the named column: memory stays bounded
    whatever the length of rows.  A single longer row makes a chunk of its own."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        k = max(1, int(b.num_rows * size / max(1, b.column(col).nbytes)))
        for i in range(0, b.num_rows, k):
            part = b.slice(i, k)
            held.append(part)
            n += part.column(col).nbytes
            if n >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(docs: DataFrame, per_partition: int, size: int) -> int:
    """How many buckets the texts of docs are dealt to: so many per shuffle partition, and more where a bucket
    would hold over `size` bytes of text.  Sums lengths over all rows."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(per_partition * shuffle_count(docs.sparkSession), -(-total // size))


def by_bucket(rows: DataFrame, n: int) -> GroupedData:
    """rows grouped by their column `bucket` (0 to n - 1), in as many partitions as there are buckets and, up to
    16,384 of them, one in each: what a task reads doesn't grow with the input."""
    at = F.col("bucket")
    if n <= 1 << 14:
        at = F.get(F.expr(f"array({', '.join(map(str, spread(n).tolist()))})"), at)
    return rows.withColumn("at", at).repartition(n, "at").groupBy("at")


def spread(n: int) -> np.ndarray:
    """n ints that hash partitioning puts in n different partitions of n."""
    found, tried = np.full(n, -1, np.int32), 0
    while (found < 0).any():
        v = np.arange(tried, tried + 8 * n, dtype=np.uint32)
        tried += 8 * n
        x = v * np.uint32(0xCC9E2D51)
        x = (x << np.uint32(15) | x >> np.uint32(17)) * np.uint32(0x1B873593) ^ np.uint32(42)
        x = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        at, first = np.unique((x ^ x >> np.uint32(16)).view(np.int32).astype(np.int64) % n, return_index=True)
        new = found[at] < 0
        found[at[new]] = v[first[new]].astype(np.int32)
    return found
