"""N-gram Jaccard join by token-combination prefixes.

Tokens are hashes of 5-word shingles.  All documents with equal sets form a class.  Tokens are ordered
from rare to frequent (by the number of classes that hold them; from `frequent` on they are one class
of tokens, ordered by hash).  If two sets are similar enough, the prefixes of both in that order share
a signature: a single rare token, or two tokens of one part of the frequent class.  A prefix is
extended until it would still share one after losing all tokens that a similar set may lack: a rare
token counts one, the tokens of a part of the frequent class count one less than there are.

Stages:
1. Tasks hash texts and send (token, class) packed and sorted to token buckets.  What is frequent in
   one chunk already is sent on without its classes, so a token in a third of all documents costs
   one entry per chunk.
2. Token buckets count classes per token, and send the tokens of two classes or more back to the
   classes' buckets.  A token of one class can't be shared, so what comes back is all that any
   intersection consists of.
3. Classes select their prefixes; most have enough tokens of their own to have no partner.
4. Classes of one signature are candidates, and links are verified on exact intersections.
   `join` wants all links: each pair of a list that is in reach is a candidate, and a long list is split
   into blocks of which every two meet in a task of their own.  A group of n near copies has up to
   n * (n - 1) / 2 links, and costs as many.
   `connected` wants components only: first each class with the smallest and the next smaller one of its
   list, or of its part of a long list; once these links are known, a few of each component in a list with
   those of the others; at last each pair of a list that is not connected yet and still in reach, long
   lists in blocks again.  So a group of n near copies costs about n candidates.
   Near copies share most of their lists.  A class carries its least signatures, and a list leaves a pair to
   the list of a lesser one that both carry; the least that two share has none, so no pair is lost.
5. Components, by small and large stars.

Defined cases: null texts and texts without words have an empty set and link with nothing; a null doc_id
takes no part in links and has a null component; rows that share an id are documents of their own; extra
columns are ignored by the join and kept by `keep_one`; an empty table gives an empty result.
Sets are told apart by 128 bits: classes go by 64 of them, and where two sets agree on these, a check by the
others finds it and all is done again with other bits for them.  Tokens are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph, ranges
from .common import U64


@dataclass(frozen=True)
class Join:
    """width: words of a shingle.  percent: least Jaccard similarity.  frequent: a token of so many classes
    or more is frequent.  chunk: bytes of text that a task hashes at once.  buckets: of tokens and of
    classes, per shuffle partition at least; bucket: bytes of text for each at most, on average.  part: a document of
    2**b to 2**(b+1) tokens splits the frequent class into 2**b / part parts.  members: in the rounds after
    the first, how many of each component that a list holds are compared; a last round compares all
    that is not connected by then, unless no component had more.  walk: classes of a list that one task
    walks in the first round.  block: classes of a list that one task compares with as many others.  least: how
    many of its least signatures a class carries, so that a pair is not made in each list that has it.  bits: of a
    fingerprint by which classes go."""

    width: int = 5
    percent: int = 75
    frequent: int = 64
    chunk: int = 4 << 20
    buckets: int = 2
    bucket: int = 16 << 20
    part: int = 16
    members: tuple[int, ...] = (2, 16)
    walk: int = 1024
    block: int = 512
    least: int = 16
    bits: int = 64

    def missing(self, n: int) -> int:
        """How many of n tokens a similar set may lack."""
        return n - -(-n * self.percent // 100)


#: Rows on their way: tokens to their bucket; to the bucket of a class its smallest document of a chunk, and its shared
#: tokens; and to any bucket the documents of a chunk, since a class may have a third of all.
TOKENS, HEADS, SHARED, DOCUMENTS = 0, 1, 2, 3
ALL = np.uint16(65535)


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, U64)
    h = common.hash_words(words)
    if len(h) < width:
        return common.mix(common.window_hash(h, len(h)) + U64(len(h)))  # the whole sequence is no window of another text
    return np.unique(common.window_hash(h, width))


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in two halves."""
    return divmod(xxhash.xxh3_128_intdigest(tokens.tobytes()), 1 << 64)


def _by_bucket(bucket: np.ndarray, kind: int, *cols: np.ndarray) -> Iterator[tuple]:
    """Rows of packed columns, one per bucket; bucket is ascending."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if lo < hi:
            yield kind, int(bucket[lo]), hi - lo, common.pack(*(c[lo:hi] for c in cols))


def _class_bucket(sig: np.ndarray, n: int) -> np.ndarray:
    return (common.mix(sig) % U64(n)).astype(np.int32)


def _shared(sig: np.ndarray, token: np.ndarray, df: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    b = _class_bucket(sig, n_buckets)
    order = np.lexsort((token, sig, b))
    yield from _by_bucket(b[order], SHARED, sig[order], token[order], df[order])


def _send(batches: Iterable[pa.RecordBatch], p: Join, n_buckets: int, collided: list[int]) -> Iterator[pa.RecordBatch]:
    for b in common.chunks(batches, p.chunk):
        doc = ranges.ids(b.column("doc_id"))
        sets = [shingles((t.as_py() or "").encode(), p.width) for t in b.column("text")]
        check, sig = (np.array(x, U64) for x in zip(*map(fingerprint, sets)))
        sig &= U64((1 << p.bits) - 1)
        if collided:
            sig = np.where(np.isin(sig, np.array(collided, U64)), common.mix(check), sig)
        size = np.array([len(s) for s in sets], np.int32)
        able = (size > 0) & (doc != ranges.LAST)
        order = np.lexsort((doc, sig))
        rows = [(DOCUMENTS, int(common.mix(sig[:1] ^ doc[:1].view(U64))[0] % U64(n_buckets)), len(doc), common.pack(doc[order], sig[order], size[order], able[order].astype(np.uint8)))]
        able = np.flatnonzero(able)
        able = able[np.lexsort((doc[able], check[able], sig[able]))]
        head = np.ones(len(able), bool)
        head[1:] = (sig[able][1:] != sig[able][:-1]) | (check[able][1:] != check[able][:-1])
        able = able[head]
        cb = _class_bucket(sig[able], n_buckets)
        order = able[np.argsort(cb, kind="stable")]
        rows += _by_bucket(np.sort(cb), HEADS, doc[order], sig[order], size[order], check[order])
        once = able[np.unique(sig[able], return_index=True)[1]]
        if len(once):
            token = np.concatenate([sets[i] for i in once.tolist()])
            of = np.repeat(np.arange(len(once), dtype=np.int32), size[once])
            order = np.argsort(token, kind="stable")
            token, of = token[order], of[order]
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(head, len(token)))
            hot = np.repeat(count >= p.frequent, count)
            rows += _shared(sig[once][of[hot]], token[hot], np.full(int(hot.sum()), ALL), n_buckets)
            lone = head[count >= p.frequent]
            keep = ~hot
            keep[lone] = True  # one entry says that the token is frequent
            of[lone] = -1
            token, of = token[keep], of[keep]
            # token buckets are ranges of hashes: sorted tokens are sorted by bucket
            tb = (token >> U64(32)) * U64(n_buckets) >> U64(32)
            cuts = np.flatnonzero(np.diff(tb)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tb)]):
                u, at = np.unique(of[lo:hi], return_inverse=True)
                known = np.where(u >= 0, sig[once][u], U64(0))
                table = common.pack(known, (u < 0).astype(np.uint8))
                rows.append((TOKENS, int(tb[lo]), hi - lo, len(table).to_bytes(4, "little") + len(u).to_bytes(4, "little") + table + common.pack(token[lo:hi], at.astype(np.uint32))))
        yield ranges.batch(rows)


def _count(t: pa.Table, p: Join, n_buckets: int) -> pa.Table:
    """One token bucket: tokens of two classes or more go to their classes; other rows pass."""
    out, tokens, sigs, hots = [], [], [], []
    for kind, bucket, n, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "n", "blob"))):
        if kind != TOKENS:
            out.append((kind, bucket, n, blob))
            continue
        size, m = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
        known, hot = common.unpack(blob[8 : 8 + size], m, "u8", "u1")
        token, at = common.unpack(blob[8 + size :], n, "u8", "u4")
        tokens.append(token)
        sigs.append(known[at])
        hots.append(hot[at] > 0)
    if tokens:
        token, sig, hot = np.concatenate(tokens), np.concatenate(sigs), np.concatenate(hots)
        del tokens, sigs, hots
        order = np.argsort(token, kind="stable")
        token = token[order]
        twice = np.zeros(len(token), bool)
        twice[1:] = token[1:] == token[:-1]
        twice[:-1] |= twice[1:].copy()
        order, token = order[twice], token[twice]
        sig, hot = sig[order], hot[order]
        order = np.lexsort((sig, token))
        token, sig, hot = token[order], sig[order], hot[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]) | hot[1:] | hot[:-1]
        token, sig, hot = token[new], sig[new], hot[new]
        if len(token):
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(head, len(token)))
            df = np.where(np.maximum.reduceat(hot, head) | (count >= p.frequent), ALL, np.minimum(count, 65534)).astype(np.uint16)
            df = np.repeat(df, count)
            keep = ~hot & (df > 1)
            out += _shared(sig[keep], token[keep], df[keep], n_buckets)
    return pa.Table.from_batches([ranges.batch(out)])


def signatures(n: int, own: int, token: np.ndarray, df: np.ndarray, p: Join) -> np.ndarray:
    """Signature hashes of a set of n tokens, `own` of which no other class holds; the others are given
    with their class counts.  Empty if the set can't have a partner."""
    need = p.missing(n) + 1 - own
    if need <= 0 or n < 2:
        return np.empty(0, U64)
    rare = df != ALL
    r = token[rare][np.lexsort((token[rare], df[rare]))]
    if len(r) >= need:
        return common.mix(r[:need])
    keys, need = [common.mix(r)], need - len(r)
    often = np.sort(token[~rare])
    for band in sorted({n.bit_length() - 1, (n * 100 // p.percent).bit_length() - 1}):
        parts = max(1, (1 << band) // p.part)
        part = (often * U64(0x9E3779B97F4A7C15) >> U64(32)) % U64(parts)
        again = np.ones(len(often), bool)
        again[np.unique(part, return_index=True)[1]] = False
        end = int(np.searchsorted(np.cumsum(again), need)) + 1
        t, q = often[:end], part[:end]
        for x in np.unique(q).tolist():
            g = t[q == U64(x)]
            i, j = np.triu_indices(len(g), 1)
            keys.append(common.mix(common.mix(g[i]) + g[j] * common._MULT[1] + U64(band)))
    return np.unique(np.concatenate(keys))


CLASS_DDL = "kind int, sig long, cid long, n int, r int, doc_id long, key long, blob binary, bits binary"
_CLASS = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("r", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("blob", pa.binary()), ("bits", pa.binary())])
#: Bits of a set's sketch; a token sets one.
SKETCH = 512


def sketch(tokens: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH, np.uint8)
    bits[(common.mix(tokens) % U64(SKETCH)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


MEMBER, SET, KEY, COLLIDED, CLASS = 0, 1, 2, 3, 4


def _classes(t: pa.Table, p: Join) -> pa.Table:
    """One class bucket: a MEMBER row for each document that came by (without sig if it has no class), a CLASS row for
    each class (cid is its smallest id), and for classes that may have partners a SET row with their shared
    tokens and KEY rows; COLLIDED rows tell which fingerprints stand for several sets."""
    heads, shared, out, void = [], [], [], pa.nulls

    def put(kind: int, **cols: pa.Array) -> None:
        n = len(next(iter(cols.values())))
        if n:
            out.append(pa.record_batch([pa.array(np.full(n, kind, np.int32)), *(cols.get(f.name, void(n, f.type)) for f in list(_CLASS)[1:])], schema=_CLASS))

    for kind, n, blob in zip(*(t.column(c).to_pylist() for c in ("kind", "n", "blob"))):
        if kind == HEADS:
            heads.append(common.unpack(blob, n, "i8", "u8", "i4", "u8"))
        elif kind == SHARED:
            shared.append(common.unpack(blob, n, "u8", "u8", "u2"))
        else:
            doc, sig, size, able = common.unpack(blob, n, "i8", "u8", "i4", "u1")
            put(MEMBER, sig=pa.array(sig.view(np.int64), mask=able == 0), n=pa.array(size), doc_id=pa.array(doc, mask=doc == ranges.LAST))
    doc, sig, n, check = (np.concatenate(c) for c in zip(*heads)) if heads else (np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int32), np.empty(0, U64))
    order = np.lexsort((check, sig))
    one, two = sig[order], check[order]
    put(COLLIDED, sig=pa.array(np.unique(one[1:][(one[1:] == one[:-1]) & (two[1:] != two[:-1])]).view(np.int64)))
    order = np.lexsort((doc, sig))
    doc, sig, n = doc[order], sig[order], n[order]
    usig, head = np.unique(sig, return_index=True)
    put(CLASS, sig=pa.array(usig.view(np.int64)), cid=pa.array(doc[head]), n=pa.array(n[head]))
    if shared:
        s, token, df = (np.concatenate(c) for c in zip(*shared))
        order = np.lexsort((token, s))
        s, token, df = s[order], token[order], df[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (token[1:] != token[:-1])
        s, token, df = s[new], token[new], df[new]
        us, first = np.unique(s, return_index=True)
        last = np.append(first[1:], len(s))
        at = head[np.searchsorted(usig, us)]
        sets, keys, owner = [], [], []
        for sg, lo, hi, size, c in zip(us.tolist(), first.tolist(), last.tolist(), n[at].tolist(), doc[at].tolist()):
            got = signatures(size, size - (hi - lo), token[lo:hi], df[lo:hi], p)
            if len(got):
                sets.append((sg, c, size, hi - lo, token[lo:hi].tobytes(), sketch(token[lo:hi])))
                keys.append(got)
        if sets:
            sg, c, size, r, blob, bits = zip(*sets)
            per = [len(x) for x in keys]
            sg, c, size, r = np.array(sg, U64).view(np.int64), np.array(c, np.int64), np.array(size, np.int32), np.array(r, np.int32)
            put(SET, sig=pa.array(sg), cid=pa.array(c), n=pa.array(size), r=pa.array(r), blob=pa.array(blob, pa.binary()), bits=pa.array(bits, pa.binary()))
            put(KEY, sig=pa.array(np.repeat(sg, per)), cid=pa.array(np.repeat(c, per)), n=pa.array(np.repeat(size, per)), r=pa.array(np.repeat(r, per)), key=pa.array(np.concatenate(keys).view(np.int64)))
    return pa.Table.from_batches(out, schema=_CLASS)


def classes(docs: DataFrame, p: Join = Join(), collided: tuple[int, ...] = ()) -> DataFrame:
    """The stored MEMBER, CLASS, SET and KEY rows of docs.  What collided is expected to be nothing up to 10**9 sets, and
    some pairs beyond."""
    n, known = common.bucket_count(docs, p.buckets, p.bucket), [c % 2**64 for c in collided]
    sent = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _send(it, p, n, known), ranges.DDL)
    shared = common.by_bucket(sent, n).applyInArrow(lambda t: _count(t, p, n), ranges.DDL)
    rows = common.stored(common.by_bucket(shared, n).applyInArrow(lambda t: _classes(t, p), CLASS_DDL))
    more = [r["sig"] for r in rows.where(F.col("kind") == COLLIDED).select("sig").collect()]
    return classes(docs, p, (*collided, *more)) if more else rows


PAIR_DDL = "a long, b long"


def _reach(p: Join, n: int, r: int, m: int, q: int) -> bool:
    """Whether sets of n and m tokens, of which r and q are in other sets too, may be similar enough."""
    return (100 + p.percent) * min(r, q) >= p.percent * (n + m)


def _first_pairs(batches: Iterable[pa.RecordBatch], p: Join) -> Iterator[pa.RecordBatch]:
    """Lists, as rows (key, g, n, r, sig) sorted by key, g and n, give pairs (a, b) with the first of the part (the
    first in reach by size) and with the one before.  Lists are walked, not gathered."""
    key, lead, prev = None, None, None
    for b in batches:
        out = []
        for k, g, *me in zip(*(b.column(c).to_pylist() for c in ("key", "g", "n", "r", "sig"))):
            if (k, g) != key:
                key, lead, prev = (k, g), me, me
                continue
            if 100 * lead[0] < p.percent * me[0]:
                lead = prev if 100 * prev[0] >= p.percent * me[0] else me
            out += [(o[2], me[2]) for o in ((lead,) if lead is prev else (lead, prev)) if o[2] != me[2] and _reach(p, me[0], me[1], o[0], o[1])]
            prev = me
        yield _unique(out)


def _unique(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*set(pairs)) if pairs else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Long lists are made known to all tasks up to so many of them; more are joined by shuffle.
BROADCAST_LISTS = 1 << 20


def _sized(lists: DataFrame) -> DataFrame:
    """A stored table with a row for some lists, to be joined by key."""
    return F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists


def in_parts(keys: DataFrame, most: int) -> DataFrame:
    """keys with `parts`, one for each `most` classes of a list, and `g`, the class's own.  Lists of one part are all
    but a few, so only the few long ones are joined."""
    long = common.stored(keys.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > most))
    if long.isEmpty():
        return keys.withColumns({"parts": F.lit(1), "g": F.lit(0)})
    parts = F.ceil(F.coalesce("k", F.lit(1)) / most).cast("int")
    return keys.join(_sized(long), "key", "left").withColumn("parts", parts).withColumn("g", F.pmod(F.xxhash64("sig"), "parts").cast("int")).drop("k")


def first_candidates(keys: DataFrame, p: Join) -> DataFrame:
    """Distinct pairs of classes that stand beside each other in a list, or at its head.  A list of more than
    `walk` classes is walked in parts."""
    dealt = in_parts(keys.select("key", "n", "r", "sig"), p.walk)
    return dealt.repartition("key", "g").sortWithinPartitions("key", "g", "n", "sig").mapInArrow(lambda it: _first_pairs(it, p), PAIR_DDL).distinct()


def verified(pairs: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """Of candidate pairs those that are similar enough: cid of either class and the size of their
    intersection.  The joins are plain ones, so Spark can split a class that has many candidates."""
    one = sets.select(F.col("sig").alias("a"), F.col("cid").alias("ca"), F.col("n").alias("na"), F.col("blob").alias("ta"))
    two = sets.select(F.col("sig").alias("b"), F.col("cid").alias("cb"), F.col("n").alias("nb"), F.col("blob").alias("tb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for ca, na, ta, cb, nb, tb in zip(*(x.column(c) for c in ("ca", "na", "ta", "cb", "nb", "tb"))):
                s, t = np.frombuffer(ta.as_buffer(), U64), np.frombuffer(tb.as_buffer(), U64)
                if len(s) > len(t):
                    s, t = t, s
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if 100 * both >= p.percent * (na.as_py() + nb.as_py() - both):
                    rows.append((ca.as_py(), cb.as_py(), both))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["ca", "cb", "both"])

    joined = pairs.join(one, "a").join(two, "b").select("ca", "na", "ta", "cb", "nb", "tb")
    return joined.mapInArrow(run, "ca long, cb long, both long")


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Roots after further links: only the roots that these connect are looked at."""
    of = roots.select("node", "root")
    ends = more
    for c in ("ca", "cb"):
        ends = ends.join(of.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), c, "left").withColumn(f"r_{c}", F.coalesce(f"r_{c}", c))
    top = graph.components(ends.select("r_ca", "r_cb"))
    up = top.select(F.col("node").alias("root"), F.col("root").alias("up"))
    moved = of.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return common.stored(moved.unionByName(top.join(of.select("node"), "node", "left_anti").select("node", "root")))


def _least(keys: DataFrame, p: Join) -> DataFrame:
    """sig and the `least` least keys of each class."""
    ranked = keys.select("sig", "key").withColumn("at", F.row_number().over(Window.partitionBy("sig").orderBy("key"))).where(F.col("at") <= p.least)
    return ranked.groupBy("sig").agg(F.collect_list("key").alias("least"))


def blocks(keys: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """Lists as rows (key, i, j, g, n, r, sig, root, bits, least): of a list split into blocks, each pair (i, j) of blocks,
    with the own one of each class as g, and the least of the keys that the class has here."""
    own = in_parts(keys.select("key", "n", "r", "sig", "root"), p.block)
    each = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("key", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "n", "r", "sig", "root").join(sets.select("sig", "bits"), "sig").join(_least(keys, p), "sig")


#: Pairs that are looked at together, by sketches and by least keys.
_PAIRS, _FEWER = 1 << 20, 1 << 16


def _elsewhere(key: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows a and b, two of one key each, a list of a lesser key has too, by the least keys of both."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), _FEWER):
        x, y = a[lo : lo + _FEWER], least[b[lo : lo + _FEWER]]
        for c in range(least.shape[1]):
            v = least[x, c]
            out[lo : lo + _FEWER] |= (v < key[x]) & (y == v[:, None]).any(1)
    return out


def _in_reach(t: pa.Table, p: Join) -> Iterator[pa.RecordBatch]:
    """Of whole blocks, rows as `blocks` has them and sorted by key, i, j and n, the pairs (a, b) of different
    roots that may be similar enough by size, shared tokens and sketches, without those that a list of a lesser key
    has.  A bit that one sketch has and the other lacks is a token that the other set lacks, so sketches bound the
    intersection from above.  All of this but the last is the same in each list that has the pair."""
    key, i, j, g, n, r, sig, root = (t.column(c).to_numpy() for c in ("key", "i", "j", "g", "n", "r", "sig", "root"))
    n, r = n.astype(np.int64), r.astype(np.int64)
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), U64).reshape(-1, SKETCH // 64)
    held = t.column("least").combine_chunks()
    count = held.value_lengths().to_numpy()
    least = np.full((len(key), p.least), np.iinfo(np.int64).max)  # no key is greater
    least[np.arange(p.least) < count[:, None]] = held.flatten().to_numpy()
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    size = np.diff(np.append(head, len(key)))
    after = np.repeat(head + size, size) - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS, "right")) - 1)
        a = np.repeat(np.arange(lo, hi), after[lo:hi])
        b = a + 1 + np.arange(len(a)) - (total[a] - total[lo])
        lo = hi
        ok = (root[a] != root[b]) & ((g[a] != g[b]) | (i[a] == j[a])) & ((100 + p.percent) * np.minimum(r[a], r[b]) >= p.percent * (n[a] + n[b]))
        a, b = a[ok], b[ok]
        x, y = bits[a], bits[b]
        one, two = r[a] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), r[b] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
        ok = (100 + p.percent) * np.minimum(one, two) >= p.percent * (n[a] + n[b])
        a, b = a[ok], b[ok]
        ok = ~_elsewhere(key, least, a, b)
        yield pa.record_batch([pa.array(sig[a[ok]]), pa.array(sig[b[ok]])], names=["a", "b"])


def _block_pairs(batches: Iterable[pa.RecordBatch], p: Join) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        last = np.ones(held.num_rows, bool)
        for c in ("key", "i", "j"):
            v = held.column(c).to_numpy()
            last &= v == v[-1]
        whole = int(np.argmax(last))  # the last block may go on in the next batch
        if whole:
            yield from _in_reach(held.slice(0, whole), p)
            held = held.slice(whole)
    if held is not None:
        yield from _in_reach(held, p)


def all_candidates(keys: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """Distinct pairs (a, b) of classes of different roots that share a signature and may be similar enough."""
    dealt = blocks(keys, sets, p).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "sig")
    return dealt.mapInArrow(lambda it: _block_pairs(it, p), PAIR_DDL).distinct()


def all_verified(pairs: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """Links (a, b, ca, cb, both) among candidate pairs.  Pairs lie in the cells of a grid by the hashes of
    their classes, and a set goes once to each cell that has pairs of it: a class with many
    candidates is spread over a row and a column of cells and doesn't travel once per pair."""
    side = max(1, round((4 * common.shuffle_count(pairs.sparkSession)) ** 0.5))
    cell = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    put = pairs.select(cell.alias("cell"), "a", "b")
    wanted = put.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("sig")).distinct()
    there = wanted.join(sets.select("sig", "cid", "n", "blob"), "sig").select("at", "sig", "cid", "n", "blob")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sig = right.column("sig").to_numpy()
        order = np.argsort(sig)
        sig, cid, n = sig[order], right.column("cid").to_numpy()[order], right.column("n").to_numpy().astype(np.int64)[order]
        held = right.column("blob").to_pylist()
        tokens = [np.frombuffer(held[x], U64) for x in order.tolist()]
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        one, two = np.searchsorted(sig, a), np.searchsorted(sig, b)
        both = np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(one.tolist(), two.tolist())):
            s, t = tokens[x], tokens[y]
            if len(s) > len(t):
                s, t = t, s
            both[k] = np.count_nonzero(t[np.minimum(t.searchsorted(s), len(t) - 1)] == s)
        ok = 100 * both >= p.percent * (n[one] + n[two] - both) if len(a) else np.zeros(0, bool)
        return pa.table([pa.array(c) for c in (a[ok], b[ok], cid[one[ok]], cid[two[ok]], both[ok])], names=["a", "b", "ca", "cb", "both"])

    return put.groupBy("cell").cogroup(there.groupBy("at")).applyInArrow(run, "a long, b long, ca long, cb long, both long")


def join(docs: DataFrame, p: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, cid, component_id, n_links), one row per row of docs, and all links
    between classes (a, b: fingerprints of the sets; ca, cb, both).  n_links is the number of other rows
    with an id that are similar enough, those of the same class included."""
    rows = classes(docs, p)
    sets, keys = rows.where(F.col("kind") == SET), rows.where(F.col("kind") == KEY)
    links = common.stored(all_verified(common.stored(all_candidates(keys.withColumn("root", F.col("sig")), sets, p)), sets, p))
    sizes = rows.where((F.col("kind") == MEMBER) & F.col("sig").isNotNull()).groupBy("sig").agg(F.count("*").alias("own"))
    ends = links.select(F.col("a").alias("sig"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("sig"), F.col("a").alias("other")))
    beside = ends.join(sizes.select(F.col("sig").alias("other"), "own"), "other").groupBy("sig").agg(F.sum("own").alias("beside"))
    per = sizes.join(beside, "sig", "left").select("sig", (F.col("own") - 1 + F.coalesce("beside", F.lit(0))).cast("long").alias("n_links"))
    return membership(rows, graph.components(links.select("ca", "cb")), per), links


def membership(rows: DataFrame, roots: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, cid, component_id, one row per document, and a column of `more` by sig (0 where there is no
    class).  Classes meet their roots first, one row each, so only one join sees all documents; those without a
    class stay out of it."""
    known = rows.where(F.col("kind") == CLASS).select("sig", "cid").join(roots, F.col("cid") == F.col("node"), "left").select("sig", "cid", F.coalesce("root", "cid").alias("component_id"))
    own = [] if more is None else [c for c in more.columns if c != "sig"]
    if more is not None:
        known = known.join(more, "sig", "left")
    docs = rows.where(F.col("kind") == MEMBER).select("sig", "doc_id", F.col("n").cast("long").alias("n_shingles"))
    there = docs.where("sig is not null").join(known, "sig").select("doc_id", "n_shingles", "cid", "component_id", *own)
    alone = docs.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("cid"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in own])
    return there.unionByName(alone)


def connected(docs: DataFrame, p: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, cid, component_id), one row per row of docs, and so many links
    between classes (ca, cb, both) as connect each component."""
    rows = classes(docs, p)
    sets, keys = rows.where(F.col("kind") == SET), rows.where(F.col("kind") == KEY)
    tried = common.stored(first_candidates(keys, p))
    links = common.stored(verified(tried, sets, p))
    roots = graph.components(links)
    for most in (*p.members, None):
        labelled = keys.join(roots, F.col("cid") == F.col("node"), "left").select("key", "n", "r", "sig", F.coalesce("root", "cid").alias("root"))
        per = labelled.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("k").alias("k"), F.max("k").alias("largest"))
        open_ = common.stored(per.where("roots > 1 and k > 2").select("key", "largest"))
        largest = open_.agg(F.max("largest")).first()[0]
        if largest is None:
            break
        some = labelled.join(_sized(open_.select("key")), "key")
        if most is not None:  # which ones, the hash of key and set says, so that lists of the same sets try different ones
            some = some.withColumn("i", F.row_number().over(Window.partitionBy("key", "root").orderBy(F.xxhash64("key", "sig"), "sig"))).where(F.col("i") <= most).drop("i")
        now = common.stored(all_candidates(common.stored(some), sets, p).join(tried, ["a", "b"], "left_anti"))
        more = common.stored(verified(now, sets, p))
        tried = tried.unionByName(now)
        if not more.isEmpty():
            links, roots = links.unionByName(more), _merged(roots, more)
        if most is None or largest <= most:
            break
    return membership(rows, roots), links


def keep_one(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """docs without the rows that are linked to a document with a smaller id; all columns stay.  Rows with a
    null id stay; of rows that share the id that a component keeps, all stay."""
    gone = connected(docs, p)[0].where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.select(F.struct("*").alias("row"), "doc_id").join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select("row.*")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected(common.table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_ngram_jaccard and, of all links, the number of each document."""
    return join(common.table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id", "n_links")
