"""Every stage of the pipeline against a plain version of it, over a whole small table."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F

from cairn.llm import common, packing, quality, secrets


def test_stages_and_result(spark):
    docs = common.table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_redaction", "best_fit_packing"]
    step, had = docs, plain
    for name, stage in corpus_pipeline.STAGES:
        step = common.stored(stage(spark, step, SF))
        if name == "quality_rules":
            bits = {r.doc_id: r.failed & quality.V1.mask() for r in quality.ledger(docs).collect()}
            assert all(not failed or bits[d] & quality.BASE.mask() for d, *_, failed in brute.quality(had))
            had = [(d, t) for d, t in had if not bits[d]]
        elif name == "near_duplicates":
            keep = {c for _, _, c in brute.jaccard(had)}
            had = [(d, t) for d, t in had if d in keep]
        elif name == "benchmark_decontamination":
            keep = {r[0] for r in brute.benchmark(had, items) if not r[3]}
            had = [(d, t) for d, t in had if d in keep]
        elif name == "secret_redaction":
            dirty = {r[0] for r in brute.secrets(had) if sum(r[1:4])}
            now = {r.doc_id: r.text for r in step.collect()}
            assert not any(sum(r[1:4]) for r in brute.secrets(list(now.items())))
            assert all(now[d] == t for d, t in had if d not in dirty and "://" not in t)
            had = [(d, now[d]) for d, _ in had]
        if name != "best_fit_packing":
            assert step.columns == docs.columns
            assert sorted((r.doc_id, r.text) for r in step.collect()) == sorted(had), name
    enc = packing.Encoder(packing.default_tokenizer())
    n = {d: len(enc.encode(t)) // 4 + 1 for d, t in had}
    whole = {r.doc_id: r.n for r in step.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert whole == n and secrets.RULES
    last = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, last.select(*cols).collect())) == sorted(map(tuple, step.select(*cols).collect()))


def test_one_passage_of_one_item_is_enough(spark):
    """Eight words of one item, in any case and punctuation, in otherwise clean documents."""
    g = random.Random(2)
    docs = common.table(spark, SF, "documents")
    items = [brute.letters(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    mine = lambda n: " ".join(f"q{g.randrange(10**6)}" for _ in range(n))
    planted = [(10**6 + i, f"{mine(30)} {', '.join(x.upper() if x.isascii() else x for x in w[3:11])}. {mine(30)}") for i, w in enumerate(items) if len(w) >= 11]
    near = [(2 * 10**6 + i, f"{mine(30)} {' '.join(w[3:10])} {mine(30)}") for i, w in enumerate(items) if len(w) >= 11]
    more = spark.createDataFrame([(d, t, "en", "here", len(t)) for d, t in [*planted, *near]], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs.unionByName(more), SF).collect()}
    assert planted and not kept & {d for d, _ in planted} and kept >= {d for d, _ in near}


def test_awkward_tables(spark):
    """Empty tables pass all stages; nulls, repeated rows and columns of other names come through."""
    docs = common.table(spark, SF, "documents")
    text = " ".join(f"word{i} of" for i in range(40))
    odd = spark.createDataFrame([(None, text, None, None, None), (None, None, "en", "s", 1), (7, text + " more", "en", "s", 1), (7, text + " more", "en", "s", 1), (8, "", None, None, 0)], docs.schema)
    for given, n in ((docs.where("false"), 0), (odd, 3)):
        step = given.withColumns({"found": F.lit("x"), "h": F.lit(1), "__t": F.lit(2), "row": F.lit(3), "a.b": F.lit(4), "failed": F.lit(5), "n_words": F.lit("y")})
        for name, stage in corpus_pipeline.STAGES:
            step = common.stored(stage(spark, step, SF))
            if name != "best_fit_packing":
                assert step.columns == [*docs.columns, "found", "h", "__t", "row", "a.b", "failed", "n_words"] and step.count() == n, name
        assert step.select("doc_id").distinct().count() == min(n, 2)
