"""Benchmark decontamination by a distributed positional inverted index.

Postings of the training texts (term, document, place) are stored for every term that a test item
holds; terms are pairs of neighbouring words.  A test phrase is looked up from its rarest terms: the postings of the rarest, shifted by its
offset in the phrase, give places where the phrase may start; the second rarest, shifted likewise,
is intersected with them; what is left is checked against the postings of all other terms.  Only
the postings of rare terms and the few survivors move.

All of it is DataFrame and SQL.

Defined cases: null text has no words; items with a null id are left out; a null doc_id passes
through; rows of the same id and text get the same result each; items repeated under one id count
once; extra columns are ignored; without documents or items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .text_sql import LOWER, UPPER, count_words, leading, split_words

WINDOW = 8
#: Tables of test terms and windows up to this many bytes are broadcast, larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: Stands behind a text's last word in the index, so that a document's length is a posting too.
_END = "\n"
_KEY = ["doc_id", "h"]


def _bytes(terms: DataFrame) -> int:
    """What a table with a column `term` takes: its terms, and 64 bytes a row for the other columns."""
    return terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0


def _sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (w: id, words) of the items, and which items hold them (w, item_id).  A phrase
    is `size` consecutive words, or all words of a shorter item."""
    words = F.expr("filter(parts, x -> x <> '')")
    per = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), split_words(_lower(F.col("text"))).alias("parts")).select("item_id", words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    got = common.stored(per.select("item_id", F.explode(starts).alias("at"), "words").select("item_id", F.slice("words", F.col("at"), size).alias("words")).distinct())
    ids = common.stored(got.select("words").distinct().withColumn("w", F.monotonically_increasing_id()))
    return ids, got.join(ids, "words").select("w", "item_id")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings: term, doc_id, h (64 bits of a hash of the text, which tell rows of one id apart) and
    pos, for the given terms, and for _END with the number of words as pos.

    A term is a word, or two words with a blank between them, which stands where the first one does:
    pairs of words are far rarer than words, so phrases are looked up by pairs.  Terms meet by a hash of
    their full lower case, which equal terms share, before A-Z alone is lowered and compared."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("h"), split_words(F.coalesce("text", F.lit(""))).alias("parts"))
    flat = parts.select("doc_id", "h", leading(F.col("parts")).alias("lead"), count_words(F.col("parts")).cast("int").alias("n"), F.concat("parts", F.array(F.lit(_END))).alias("parts"))
    beside = F.arrays_zip(F.col("parts").alias("a"), F.slice("parts", F.lit(2), F.size("parts")).alias("b"))
    words = flat.select("doc_id", "h", "lead", "n", F.posexplode(beside).alias("pos", "x")).select("doc_id", "h", "lead", "n", "pos", F.col("x.a").alias("a"), F.coalesce("x.b", F.lit("")).alias("b"))
    known = terms.select("term", F.split("term", " ").alias("t")).select("term", F.get("t", F.lit(0)).alias("t1"), F.get("t", F.lit(1)).alias("t2"))
    ends = terms.sparkSession.range(1).select(F.lit(_END).alias("term"), F.lit(_END).alias("t1"), F.lit("").alias("t2"))
    size = _bytes(terms)
    key = lambda *cols: F.xxhash64(*[F.lower(c) for c in cols])
    pairs = known.where("t2 is not null").unionByName(ends).withColumn("key", key("t1", "t2"))
    met = words.join(_sized(pairs, size), (key("a", "b") == F.col("key")) & (_lower(F.col("a")) == F.col("t1")) & (_lower(F.col("b")) == F.col("t2")))
    pos = F.when(F.col("term") == _END, F.col("n")).otherwise(F.col("pos") - F.col("lead")).cast("int").alias("pos")
    out = met.select("term", "doc_id", "h", pos)
    single = known.where("t2 is null").drop("t2").withColumn("key", key("t1"))
    if not single.isEmpty():
        met = words.join(_sized(single, size), (key("a") == F.col("key")) & (_lower(F.col("a")) == F.col("t1")))
        out = out.unionByName(met.select("term", "doc_id", "h", pos))
    return common.stored(out)


def terms_of(ids: DataFrame) -> DataFrame:
    """w, n (words), k (terms), off, term: the pairs of neighbours of each phrase, or its only word."""
    pairs = F.expr("if(size(words) = 1, words, transform(slice(words, 1, size(words) - 1), (x, i) -> concat(x, ' ', words[i + 1])))")
    return ids.select("w", F.size("words").alias("n"), pairs.alias("terms")).select("w", "n", F.size("terms").alias("k"), F.posexplode("terms").alias("off", "term"))


def phrases(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Exact matches: doc_id, h, start (in words), w, n (words of the phrase); one row per place."""
    places = terms_of(ids)
    size = _bytes(places)
    freq = index.where(F.col("term") != _END).groupBy("term").agg(F.count("*").alias("df"))
    order, whole = Window.partitionBy("w").orderBy("df", "off"), Window.partitionBy("w")
    # a phrase with a term that no document holds has no place in it
    ranked = places.join(freq, "term").withColumn("rank", F.row_number().over(order)).withColumn("found", F.count("*").over(whole)).where("found = k")
    ranked = common.stored(ranked.select("w", "n", "k", "off", "term", "rank"))

    def shifted(rank: int) -> DataFrame:
        of = _sized(ranked.where(F.col("rank") == rank).select("term", "w", "n", "k", "off"), size)
        return index.join(of, "term").select("doc_id", "h", (F.col("pos") - F.col("off")).alias("start"), "w", "n", "k").where("start >= 0").distinct()

    first = shifted(1)
    both = _semi(first.where("k > 1"), shifted(2), ["start", "w"])
    left = common.stored(first.where("k = 1").unionByName(both))
    need = left.where("k > 2").join(_sized(ranked.where("rank > 2").select("w", "off", "term"), size), "w")
    need = need.select("doc_id", "h", "start", "w", "n", "k", (F.col("start") + F.col("off")).alias("pos"), "term")
    full = _inner(need, index.where(F.col("term") != _END), ["pos", "term"]).distinct().groupBy("doc_id", "h", "start", "w", "n", "k").agg(F.count("*").alias("there")).where("there = k - 2")
    return left.where("k <= 2").drop("k").unionByName(full.drop("k", "there"))


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    other = b.select(*[F.col(c).alias(f"__{c}") for c in [*_KEY, *keys]])
    cond = F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    for c in ["h", *keys]:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    return other, cond


def _semi(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    other, cond = _on(a, b, keys)
    return a.join(other, cond, "left_semi")


def _inner(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    other, cond = _on(a, b, keys)
    return a.join(other, cond).select(*a.columns)


def proximity(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Documents with all terms inside a stretch of `within` words: doc_id, h, start, end (exclusive),
    one row for each place of the rarest term, with the shortest stretch around it, the first of equal
    ones.  Every begin that lies less than `within` words before the place is tried, with the next
    place of every other term.

    Defined cases: a term that no document holds gives an empty result, as does an empty index; a term that is
    given twice counts once; repeated rows of one id and text give the same rows once; a null doc_id is an id
    like any other."""
    freq = {r["term"]: r["n"] for r in index.where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}
    if len(freq) < len(set(terms)):
        return index.select("doc_id", "h", F.col("pos").alias("start"), F.col("pos").alias("end")).limit(0)
    first, *rest = sorted(freq, key=lambda t: (freq[t], t))
    at = index.where(F.col("term") == first).distinct().select("doc_id", "h", F.col("pos").alias("at"))
    out = at.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - (within - 1)), F.col("at"))).alias("s"), F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    for t in rest:
        # places within reach share a block of `within` words with the begin or lie in the next one
        near = index.where(F.col("term") == t).distinct().select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("p"), F.explode(F.array(*[(F.floor(F.col("pos") / within) + i).alias("b") for i in (-1, 0)])).alias("b"))
        met = out.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.floor(F.col("s") / within) == F.col("b")) & (F.col("p") >= F.col("s")) & (F.col("p") < F.col("s") + within))
        next_ = met.groupBy("doc_id", "h", "at", "s", "start", "end").agg(F.min("p").alias("p"))
        out = next_.select("doc_id", "h", "at", "s", F.least("start", "p").alias("start"), F.greatest("end", F.col("p") + 1).alias("end"))
    best = F.min_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), "start")).alias("x")
    return out.where(F.col("end") - F.col("start") <= within).groupBy("doc_id", "h", "at").agg(best).select("doc_id", "h", "x.start", "x.end")


def report(docs: DataFrame, items: DataFrame, least_items: int = 2) -> DataFrame:
    """For each row of docs: doc_id, h, n_words, n_hit (words inside a matched phrase), n_items,
    items_sha256 and contaminated (`least_items` items or more)."""
    ids, holds = windows(items)
    terms = common.stored(terms_of(ids).select("term").distinct())
    index = build_index(docs, terms)
    places = common.stored(phrases(index, ids))
    hit = places.select(*_KEY, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy(*_KEY).agg(F.count("*").alias("n_hit"))
    found = places.select(*_KEY, "w").distinct().join(holds, "w").select(*_KEY, "item_id").distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    rows = index.where(F.col("term") == _END).groupBy(*_KEY, F.col("pos").cast("long").alias("n_words")).agg(F.count("*").cast("int").alias("copies"))
    out = rows
    for part, col in ((hit, "n_hit"), (found, "items")):
        part = part.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), col)
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left").drop("__d", "__h")
    out = out.select(*_KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select(*_KEY, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, least_items: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, in which fewer than `least_items` items occur: one window of
    one item is enough for a document to go.  Rows with null or empty texts stay, as does every row
    where there are no items; of repeated rows all go or all stay."""
    bad = report(docs, items, least_items).where("contaminated").select("doc_id", "h").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__doc_id"), F.xxhash64("text").alias("__h"))
    return keyed.join(bad, F.col("__doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("h")), "left_anti").select("row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("h")


def oracle() -> str:
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: f"list_filter(string_split_regex(translate({t}, '{UPPER}', '{LOWER}'), '{sep}'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({words("text")}, []) AS ws FROM documents),
b AS (SELECT item_id, {words("text")} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, ws[i:i + {WINDOW - 1}] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(w) AS n FROM bw),
dw AS (SELECT k, i, n, ws[i:i + n - 1] AS w FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (w)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM m) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)"""
