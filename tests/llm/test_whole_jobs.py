"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, licenses, neardup, packing, quality, ranges, substrings, suffixes, toxicity


def near_copies():
    """One text of 200 words and copies with up to three words changed, some twice, and rows that link with nothing."""
    g = random.Random(11)
    base = [f"v{g.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in g.sample(range(200), i % 4):
            w[at] = f"x{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    other = [" ".join(f"o{g.randrange(10**6)}" for _ in range(30)) for _ in range(5)]
    return [*rows, (100, rows[7][1]), (100, rows[9][1]), (None, rows[7][1]), (101, None), (102, ""), *((110 + i, t) for i, t in enumerate(other))]


@pytest.mark.parametrize("p", [neardup.Join(), neardup.Join(block=7), neardup.Join(frequent=3, part=4, chunk=3000, block=5)])
def test_join_finds_all_links(spark, p):
    rows = near_copies()
    sets = [brute.shingles(t) for _, t in rows]
    able = [bool(s) and d is not None for s, (d, _) in zip(sets, rows)]
    similar = lambda i, j: i != j and able[i] and able[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    plain = [(d, len(sets[i]), sum(similar(i, j) for j in range(len(rows)))) for i, (d, _) in enumerate(rows)]
    out, links = neardup.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p)
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "n_links").collect()), key=repr) == sorted(plain, key=repr)
    distinct = {sets[i]: i for i in range(len(rows)) if able[i]}
    assert links.count() == sum(similar(i, j) for i in distinct.values() for j in distinct.values()) // 2


@pytest.mark.parametrize("p", [neardup.Join(), neardup.Join(walk=5, block=7), neardup.Join(walk=2, block=3, members=(1,), frequent=3, part=4, chunk=3000), neardup.Join(bits=4), neardup.Join(bits=3, chunk=2000, bucket=500)])
def test_components_of_long_lists_and_equal_fingerprints(spark, p):
    """Lists in parts and blocks, many small buckets, and fingerprints of so few bits that most sets share one."""
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = neardup.connected(docs, p)[0].select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute.jaccard(rows), key=repr)


@pytest.mark.parametrize("p", [neardup.Join(), neardup.Join(block=7), neardup.Join(frequent=3, part=4)])
def test_a_pair_is_not_made_in_every_list_that_has_it(spark, p):
    """Near copies share some thirty lists and more; the pairs that leave the lists are those in reach, few of them twice."""
    g = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if at != i + 20 else f"x{g.randrange(10**6)}" for at, w in enumerate(base))) for i in range(40)]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p)
    sets, keys = found.where(F.col("kind") == neardup.SET), found.where(F.col("kind") == neardup.KEY).withColumn("root", F.col("sig"))
    dealt = neardup.blocks(keys, sets, p).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "sig")
    made = [tuple(sorted(r)) for r in dealt.mapInArrow(lambda it: neardup._block_pairs(it, p), neardup.PAIR_DDL).collect()]
    by_key = {}
    for r in keys.collect():
        by_key.setdefault(r.key, set()).add(r.sig)
    meet = {(a, b) for sigs in by_key.values() for a in sigs for b in sigs if a < b}
    assert set(made) == meet and len(meet) == 40 * 39 // 2
    assert len(made) <= 1.1 * len(meet)


@pytest.mark.parametrize("op", ["bytes", "words"])
def test_places_across_blocks(spark, op):
    """Texts longer than the places that fit beside a hash, with repeats on both sides of the borders."""
    g = random.Random(5)
    shared = [" ".join(f"s{g.randrange(10**4)}" for _ in range(60)) for _ in range(4)]
    rows = [(i, " ".join(t for s in g.sample(shared, 3) for t in (s, " ".join(f"u{g.randrange(10**6)}" for _ in range(g.randrange(5, 90)))))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    if op == "bytes":
        out, plain = suffixes.deduplicate(docs, suffixes.Suffixes(bits=7)), brute.byte_strings(rows)
        cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    else:
        out, plain = substrings.deduplicate(docs, substrings.SuperKmers(bits=4)), brute.word_windows(rows)
        cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(plain)


@pytest.mark.parametrize("hot", [1, 1000, 3000])
@pytest.mark.parametrize("op", ["bytes", "words"])
def test_hot_passages_are_dealt_by_windows(spark, op, hot):
    """A passage in every document, with other words on both sides, repeated rows, a null id, and strings that repeat
    inside a document; all, some or a few of the keys are dealt one by one."""
    g = random.Random(12)
    w = lambda n: " ".join(f"u{g.randrange(10**5)}" for _ in range(n))
    shared, other = w(40), w(25)
    rows = [(i, f"{w(g.randrange(30))} {shared} {w(g.randrange(30))} {other if i % 3 == 0 else ''} {shared[:150] if i % 5 == 0 else ''}") for i in range(60)]
    rows += [(None, rows[4][1] + " x"), (70, "= " * 200), (71, "= " * 90), (72, None), (73, "")]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string").repartition(3)
    if op == "bytes":
        p = suffixes.Suffixes(hot=hot, chunk=3000, bucket=4000)
        out, plain = suffixes.deduplicate(docs, p), brute.byte_strings([(10**9 if d is None else d, t) for d, t in rows])
        cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        found = ranges.heavy(docs, lambda b: suffixes._sizes(b, p), p.chunk, p.hot)
    else:
        p = substrings.SuperKmers(hot=hot, chunk=3000, bucket=4000)
        out, plain = substrings.deduplicate(docs, p), brute.word_windows(rows)
        cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        found = ranges.heavy(docs, lambda b: substrings._sizes(b, p), p.chunk, p.hot)
    assert len(found) == len(set(found.tolist())) > 0 and (hot == 1) == (len(found) > 200)
    plain = [(None if r[0] == 10**9 else r[0], *r[1:]) for r in plain]
    assert sorted(map(tuple, out.select(*cols).collect()), key=repr) == sorted([*plain, plain[7]], key=repr)


def test_parts_overlap():
    for lengths, size, overlap in (([], 5, 2), ([0, 3, 12, 1], 5, 2), ([30], 7, 4), ([4, 4, 4], 5, 0)):
        groups = list(ranges.parts(lengths, size, overlap))
        seen = [(i, s) for g in groups for i, x, y in g for s in range(x, y - overlap)]
        assert sorted(seen) == [(i, s) for i, n in enumerate(lengths) for s in range(n - overlap)] and {i for g in groups for i, *_ in g} == set(range(len(lengths)))
        assert all(sum(y - x for _, x, y in g) <= 2 * size + overlap for g in groups)


@pytest.fixture(scope="module")
def long_rows():
    """A text of 20 MB with one string three times, the last beyond 2**24, another text of blanks and lines alone, and a
    short one with the string."""
    g = np.random.default_rng(3)
    words = [f"{x:07x}" for x in g.integers(0, 1 << 28, 2_500_000).tolist()]
    planted = " ".join(f"p{i:06x}" for i in range(40))
    text = " ".join(words)
    for at in (8 * 1000, 8 * 25_000, 8 * 2_200_000):
        text = text[:at] + planted + " " + text[at:]
    return planted, [(1, text), (2, " " * 3_000_000), (3, f"before {planted} after"), (4, "-" * 2_000_000), (5, None)]


def test_long_texts(spark, long_rows):
    planted, rows = long_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(rows[0][1]) > 20_000_000 and rows[0][1].rfind(planted) > 1 << 24
    n = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.deduplicate(docs, kept=False).collect()}
    size = len(planted) + 1  # and the blank on one side, where the neighbours' characters differ
    assert n[1][0] == len(rows[0][1]) and n[1][2] == 2 and 2 * len(planted) <= n[1][1] <= 2 * (size + 3)
    assert n[2] == (3_000_000, 3_000_000 - 1, 1) and n[4] == (2_000_000, 2_000_000 - 1, 1) and n[5] == (0, 0, 0)
    assert len(planted) <= n[3][1] <= size + 2
    w = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.deduplicate(docs, text=False).collect()}
    assert w == {1: (2_500_000 + 120, 0), 2: (0, 0), 3: (42, 40), 4: (1, 0), 5: (0, 0)}
    links = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.connected(docs)[0].collect()}
    assert links[1][0] > 2_400_000 and links[3] == (38, 3) and links[5] == (0, 5)


def test_long_texts_of_all_other_operators(spark, long_rows):
    planted, rows = long_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, planted)], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.report(docs, items).collect()}
    assert hits == {1: (2_500_120, 120), 2: (0, 0), 3: (42, 40), 4: (0, 0), 5: (0, 0)}
    led = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.ledger(docs).collect()}
    assert led[1] == (2_500_120, 120) and led[2] == (0, 0)
    parts = packing.pieces(docs, packing.default_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert len(parts) == 5 and all(r.most <= 1024 for r in parts) and max(r.n for r in parts) > 5_000_000
    tongues = {"a": langid.counts("the cat sat on the mat")[0], "b": langid.counts("le chat dort")[0]}
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, tongues).collect()}[2] == "und"
    whole = langid.counted(langid.grams(rows[2][1] * 50))
    cut = [langid.counted(np.concatenate([langid.grams(x) for x in langid.slices(rows[2][1] * 50, size)])) for size in (1, 7, 100)]
    assert all((whole[0] == u).all() and (whole[1] == n).all() for u, n in cut)
    assert {r.n_words for r in licenses.detect(docs).collect()} == {2_500_120, 0, 42}
    assert toxicity.score(docs, toxicity.train([("bad", 1), ("good", 0)] * 50)).count() == 5


def test_argmin_has_no_limit_of_places():
    a = np.random.default_rng(1).integers(0, 1 << 63, 3000, np.int64).astype(np.uint64)
    for bits in (5, 8, 24):
        top = (a >> np.uint64(bits)).tolist()
        assert substrings.sliding_argmin(a, 20, bits).tolist() == [min(range(i, i + 20), key=lambda j: (top[j], j)) for i in range(len(a) - 19)]


def test_proximity_tries_every_window(spark):
    g = random.Random(3)
    filler = lambda n: [g.choice("pqrs") for _ in range(n)]
    rows = [(1, " ".join([*"xxxxxxxxx", "b", "a", "x", "b", "x", "c"]))]  # b at 9 is the nearest to a at 10, but 12 is the one that fits
    rows += [(2 + i, " ".join(g.choice(["b", "c", "b", "c", "d", *filler(4)]) if g.random() < 0.9 else "a" for _ in range(40))) for i in range(40)]
    terms = ["a", "b", "c"]
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    per = {t: sum(x.split().count(t) for _, x in rows) for t in terms}
    assert min(per, key=per.get) == "a"
    for within in (3, 5):
        plain = []
        for d, text in rows:
            w = text.split()
            for at in (i for i, x in enumerate(w) if x == "a"):
                spans = [(e - s, s, e) for s in range(max(0, at - within + 1), at + 1) for e in range(at + 1, min(len(w), s + within) + 1) if set(terms) <= set(w[s:e])]
                plain += [(d, *min(spans)[1:])] if spans else []
        out = decontaminate.proximity(index, terms, within)
        assert sorted(map(tuple, out.select("doc_id", "start", "end").collect())) == sorted(plain)
    assert (1, 10, 15) in plain


def test_rows_of_one_id_are_told_apart(spark):
    """Two different texts that agree on the low 32 bits of their hash, under one id: each keeps its own ranges."""
    one, two, seen = None, None, {}
    tail = " ".join(f"t{i}" for i in range(40))
    for i in range(10**6):
        text = f"n{i} {tail[: 120 + i % 90]}"
        if (other := seen.setdefault(xxhash.xxh3_64_intdigest(text.encode()) & 0xFFFFFFFF, text)) != text and len(other) != len(text):
            one, two = other, text
            break
    assert one and two
    rows = [(1, tail), (None, one), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = brute.word_windows(rows)
    assert sorted(map(tuple, substrings.deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == sorted(plain, key=repr)
    bytes_ = brute.byte_strings([(d or 2, t) for d, t in rows])
    # the order of rows of one id is that of their hashes, so only sizes are held against the plain version
    got = suffixes.deduplicate(docs).select("n_bytes", "n_removed").collect()
    assert sorted(r.n_bytes for r in got) == sorted(b[1] for b in bytes_) and all(r.n_removed > 0 for r in got if r.n_bytes != len(tail))
    buckets = ranges.bucket_of(np.full(1000, ranges.LAST), np.arange(1000, dtype=np.uint64), 8)
    assert len(set(buckets.tolist())) == 8


def test_decontamination_tells_rows_of_one_id_apart(spark):
    """Two texts of one id with one 32-bit hash (F.hash): only the one with the passages goes."""
    passages = ["alpha beta gamma", "delta epsilon zeta"]
    dirty = spark.range(300_000).select(F.concat(F.lit(" ".join(passages) + " "), F.col("id").cast("string")).alias("dirty"))
    clean = spark.range(300_000).select(F.concat(F.lit("nothing of the kind "), F.col("id").cast("string")).alias("clean"))
    met = dirty.join(clean, F.hash("dirty") == F.hash("clean")).first()
    docs = spark.createDataFrame([(1, met.dirty), (1, met.clean)], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(passages)], "item_id long, text string")
    assert [r.text for r in decontaminate.clean(docs, items).collect()] == [met.clean]
    assert sorted(r.n_items for r in decontaminate.report(docs, items).collect()) == [0, 2]
