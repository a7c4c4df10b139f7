"""Every registered query of the training-data operators over a whole small table: against its SQL, or against a
plain version where SQL can't say it."""

from __future__ import annotations

import zlib

import brute
import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SF

from cairn.llm import common, packing, registry, toxicity

TABLES = ("documents", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in common.table(spark, SF, "documents").collect()]


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got(df, *cols) == sorted(cur.fetchall(), key=repr)


def test_language_id_is_its_plain_version(spark, rows):
    out = got(registry.QUERIES["op3_language_id"](spark, SF), "doc_id", "held_out", "lang_pred", "score")
    plain = sorted(brute.languages(rows), key=repr)
    assert [r[:3] for r in out] == [r[:3] for r in plain]
    assert all(abs(x[3] - y[3]) < 1e-12 for x, y in zip(out, plain))


def test_links_are_their_plain_version(spark, rows):
    sets = [brute.shingles(t) for _, t, _ in rows]
    n = [sum(i != j and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)]
    parts = {d: (k, c) for d, k, c in brute.jaccard([r[:2] for r in rows])}
    plain = sorted(((d, *parts[d], x) for (d, *_), x in zip(rows, n)), key=repr)
    assert got(registry.QUERIES["op1_ngram_jaccard_links"](spark, SF), "doc_id", "n_shingles", "component_id", "n_links") == plain


def test_byte_strings_are_their_plain_version(spark, rows):
    assert got(registry.QUERIES["op6_suffix_array_dedup"](spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.byte_strings([r[:2] for r in rows]), key=repr)


def test_packing_is_whole_and_tight(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in rows}
    out = registry.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    per, bins = {}, {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        per.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        assert sorted(per[d]) == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(x), 1024))]
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024
    # best-fit decreasing as it is told: each piece, longest first, to the fullest bin that holds it
    rest: list[int] = []
    for n in sorted((n for x in per.values() for *_, n in x), reverse=True):
        fit = [b for b in rest if b >= n]
        if fit:
            rest.remove(min(fit))
        rest.append((min(fit) if fit else 1024) - n)
    assert len(bins) <= len(rest)


def test_toxicity_is_its_plain_version(spark, rows):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fitted(docs, labels.where(common.crc_mod("doc_id", 3) != 1))
    again = toxicity.fitted(docs.repartition(5), labels.where(common.crc_mod("doc_id", 3) != 1))
    assert (model.index == again.index).all() and (model.weight == again.weight).all() and model.bias == again.bias
    weight = dict(zip(model.index.tolist(), model.weight.tolist()))
    number = lambda w: xxhash.xxh3_64_intdigest(w) & (1 << model.bits) - 1
    out = {r.doc_id: r for r in registry.QUERIES["op9_toxicity"](spark, SF).collect()}
    assert len(out) == len(rows)
    for d, t, _ in rows:
        s = brute.toxic_score(t, weight, model.bias, number)
        assert abs(out[d].score - s) < 1e-6 and out[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and out[d].predicted == int(out[d].score >= 0.7)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i % 7)) for i in range(2000)] + [(5000, "x" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(2000), 5000]], "doc_id long, toxic int")
    fit = toxicity.Fit(rows=400, bytes=9000, longest=2000)
    got_ = toxicity.sample(docs, labels, fit).collect()
    assert 50 < len(got_) <= 480 and sum(len(r.text) for r in got_) <= 11_000 and all(r.doc_id != 5000 for r in got_)
    assert toxicity.sample(docs, labels, toxicity.Fit()).count() == 2001
    assert toxicity.fitted(docs.where("false"), labels).bias < -10
