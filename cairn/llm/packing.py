"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Documents are tokenised once (one row per piece).  Groups of pieces are packed best-fit decreasing where
they lie; full and nearly full bins are emitted.  What lies in underfull bins is merged to new groups of
bounded size, and packed again, until one group is left or a round saves next to nothing; no underfull
bin is emitted before.  Every round reads a stored table, so its outcome doesn't depend on
which executor runs it or runs it again.

Defined cases: null or empty text is a document of the end id alone; null ids and repeated rows are
packed row by row, and dealt to groups row by row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Packing:
    """capacity: tokens in a sequence.  group: pieces that a task packs at once in the first round; merged: of
    underfull bins in the later ones.  nearly_full: a bin at least so full is emitted.  gain: another
    round follows one that has saved so large a share of its bins."""

    capacity: int = 1024
    end_id: int = 2
    group: int = 100_000
    merged: int = 400_000
    nearly_full: float = 0.995
    gain: float = 0.001


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file, as little-endian uint32 bytes.

    Where the file's merges are in the order of their ids, the ids are ranks, and a rank-based BPE
    gives the same ids several times faster.  Texts with characters beyond Latin letters, on whose
    classes regex engines may disagree, and those that spell a special token go to the tokenizer
    that the file describes, as does everything if the file is of another kind, and a text that the
    faster one's regex engine gives up on (about a million blanks in a row).
    """

    #: The pattern of the byte-level pre-tokenizer (fixed value).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ODD = re.compile(r"[^\t\n\r\x20-\x7e\xc0-ɏ]|<\|")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        ranks = self._ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return None
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids):
            return None
        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        return {bytes(of[c] for c in t): model["vocab"][t] for t in [*of, *merged]}

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not self.ODD.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its regex engine is out of stack
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; where it is cut, the first takes the remainder."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, p: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with_ids the ids themselves
    as little-endian uint32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer_path), np.array([p.end_id], "<u4").tobytes()
        for b in common.chunks(batches, 8 << 20):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.encode(t.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, p.capacity)):
                    part = ids[4 * s : 4 * (s + n)]
                    rows.append((d, k, s, n, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_DDL + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: for each bin the places of its items.  Bins wait by residual space; the
    set bits of one integer say which residuals occur, so the tightest fit is its lowest bit."""
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    occur = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := occur >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                occur &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        if room - n:
            waiting[room - n].append(b)
            occur |= 1 << (room - n)
    return bins


def _packed(p: Packing, level: int, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    seq, off, under = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.empty(len(pdf), bool)
    base = (level << 58) + (int(pdf["g"].iloc[0]) << 24) if len(pdf) else 0
    for k, b in enumerate(best_fit(lengths, p.capacity)):
        ends = np.cumsum(lengths[b])
        seq[b], off[b], under[b] = base + k, ends - lengths[b], ends[-1] < p.nearly_full * p.capacity
    return pdf.assign(sequence_id=seq, offset=off, under=under)


def _packer(p: Packing, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _packed(p, level, pdf)

    return run


def pack(items: DataFrame, p: Packing = Packing()) -> DataFrame:
    """items (columns of `pieces`) with sequence_id and offset.  A sequence's pieces lie gapless from
    offset 0.  Rows are numbered when they are stored, and dealt to groups by their number and the round, so
    equal rows are spread, and groups are even samples of what is left."""
    rest, level, done = common.stored(items.withColumn("row", F.monotonically_increasing_id())), 0, []
    n, before, was = rest.count(), None, None
    while n:
        groups = -(-n // (p.merged if level else p.group))
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("long"))
        schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", sequence_id long, offset long, under boolean"
        at = common.stored(dealt.groupBy("g").applyInPandas(_packer(p, level), schema))
        bins, open_bins, n = at.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("under")), F.count_if("under")).first()
        if before is not None and bins > before:
            done.append(was)  # the bins as they were are fewer
            break
        if groups == 1 or (before is not None and bins > before * (1 - p.gain)):
            done.append(at)
            break
        done.append(at.where("not under"))
        was, before, level = at.where("under"), open_bins, level + 1
        rest = was.drop("g", "sequence_id", "offset", "under")
    if not done:
        return items.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("g", "row", "under")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from pieces that carry ids: sequence_id, length, ids binary."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pieces(common.table(spark, sf_dir, "documents"), default_tokenizer())
    return pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
