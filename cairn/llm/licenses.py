"""License scans by ordered signature rules.

Texts are normalised to words; a signature is a regex over words, written by hand in `license_rules`.  A rule
is tried only where its keyword stands, and texts without any keyword are not normalised at all.
Detections that overlap are resolved by containment and priority: one that lies within another of the
same or a stronger class goes.  All of it happens in the document's own row: no shuffle, no Python.

Defined cases: null text counts as empty; null doc_id passes through; repeated rows are scanned one by
one; columns beside doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_rules import RULES
from .text_sql import LOWER, UPPER, ascii_lower, count_words, let, plus, running, split_words

#: The phrases that every scan must find, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Confidence of a detection by class.
CONFIDENCE = (1.0, 0.8, 0.6)


@dataclass(frozen=True)
class Signature:
    """pattern is over texts of the form ' w1  w2  w3 ': each word with a blank on either side; every match holds
    `keyword` as a word."""

    order: int
    priority: int
    label: str
    keyword: str
    pattern: str
    base: bool


def _pattern(words: str) -> str:
    """The regex of words: x? may be missing, x/y is either, x* begins with x."""
    out = []
    for w in words.split():
        one = w.removesuffix("?")
        ways = "|".join(x.replace("*", "[^ ]*") for x in one.split("/"))
        out.append(f"(?: (?:{ways}) )" + "?" * w.endswith("?") if "/" in one or w.endswith("?") else f" {ways} ")
    return "".join(out)


def signatures() -> tuple[Signature, ...]:
    """The base phrases and the rules, in order of class; of rules with one pattern the first counts."""
    rows, priority = [(2, label, max(phrase.split(), key=len) if label == "gpl" else phrase.split()[0], phrase, True) for phrase, label in BASE], 0
    for line in RULES.strip().splitlines():
        if line.startswith("["):
            priority = int(line.strip("[]"))
        else:
            rows.append((priority, *(x.strip() for x in line.split("|")), False))
    out: dict[str, Signature] = {}
    for priority, label, keyword, words, base in rows:
        p = _pattern(words)
        out.setdefault(p, Signature(len(out), priority, label, keyword, p, base))
    return tuple(out.values())


HIT = "struct<s:int,e:int,priority:int,ord:int,label:string,base:boolean>"


_BLANKS = "x -> length(x) - length(replace(x, ' ', ''))"


def _matches(s: Signature) -> str:
    """SQL: of a rule that matches, itself and how many blanks are in each stretch between matches and in each match;
    else null.  A word has two blanks, so these count words."""
    return f"""if(norm rlike '{s.pattern}', named_struct('ord', {s.order}, 'priority', {s.priority}, 'label', '{s.label}', 'base', {str(s.base).lower()},
        'gaps', transform(split(norm, '{s.pattern}', -1), {_BLANKS}), 'hits', transform(regexp_extract_all(norm, '{s.pattern}', 0), {_BLANKS})), null)"""


def _places(r: Column) -> Column:
    ends = running(F.zip_with(F.slice(r["gaps"], F.lit(1), F.size(r["hits"])), r["hits"], plus), plus)
    place = lambda e, h: F.struct(((e - h) / 2).cast("int").alias("s"), (e / 2).cast("int").alias("e"), r["priority"].alias("priority"), r["ord"].alias("ord"), r["label"].alias("label"), r["base"].alias("base"))
    return F.zip_with(ends, r["hits"], place)


def _kept(hits: Column) -> Column:
    """By place, longer first, stronger first, what contains a detection comes before it, so the farthest end of each
    class so far tells whether one of the same or a stronger class does."""
    far = F.struct(*[_far(hits, c).alias(f"c{c}") for c in range(3)])
    return let(far, lambda m: F.filter(hits, lambda x, i: (i == 0) | (x["e"] > F.when(x["priority"] == 0, F.get(m["c0"], i - 1)).when(x["priority"] == 1, F.get(m["c1"], i - 1)).otherwise(F.get(m["c2"], i - 1)))))


def _far(hits: Column, least: int) -> Column:
    return running(F.transform(hits, lambda x: F.when(x["priority"] <= least, x["e"]).otherwise(-1)), F.greatest)


def _by_place(x: Column, y: Column) -> Column:
    return F.when(x["s"] != y["s"], x["s"] - y["s"]).when(x["e"] != y["e"], y["e"] - x["e"]).when(x["priority"] != y["priority"], x["priority"] - y["priority"]).otherwise(x["ord"] - y["ord"])


def detect(docs: DataFrame, sigs: tuple[Signature, ...] | None = None) -> DataFrame:
    """doc_id, n_words and two arrays of struct<s, e, priority, ord, label, base> with places in words
    (e exclusive), by place: `all_hits`, every detection, and `hits`, those that no other suppresses."""
    sigs = signatures() if sigs is None else sigs
    by_keyword: dict[str, list[str]] = {}
    for x in sigs:
        by_keyword.setdefault(x.keyword, []).append(_matches(x))
    words = docs.select("doc_id", split_words(ascii_lower(F.coalesce("text", F.lit("")))).alias("parts"))
    # keywords of a text by one pass over its words
    gated = words.select("doc_id", "parts", F.array_intersect(F.lit(list(by_keyword)), "parts").alias("present"))
    norm = F.concat(F.lit(" "), F.array_join(F.filter("parts", lambda w: w != ""), "  "), F.lit(" "))
    ready = gated.select("doc_id", count_words(F.col("parts")).alias("n_words"), "present", F.when(F.size("present") > 0, norm).alias("norm"))
    tried = ", ".join(f"if(array_contains(present, '{k}'), array({', '.join(rules)}), null)" for k, rules in by_keyword.items())
    rules = F.expr(f"if(size(present) > 0, array_compact(flatten(array_compact(array({tried})))), null)")
    matched = ready.select("doc_id", "n_words", rules.alias("rules"))
    none = F.array().cast(f"array<{HIT}>")
    hits = matched.select("doc_id", "n_words", F.when(F.size("rules") > 0, F.array_sort(F.flatten(F.transform("rules", _places)), _by_place)).otherwise(none).alias("all_hits"))
    return hits.select("doc_id", "n_words", "all_hits", F.when(F.size("all_hits") > 0, _kept(F.col("all_hits"))).otherwise(none).alias("hits"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents"))
    base = F.expr("filter(all_hits, x -> x.base)")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    score = F.expr(f"coalesce(array_max(transform(hits, x -> case x.priority when 0 then {CONFIDENCE[0]}D when 1 then {CONFIDENCE[1]}D else {CONFIDENCE[2]}D end)), 0.0D)")
    return found.withColumn("b", base).select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda x: x["s"])).cast("long").alias("first_word"), F.array_max(F.transform("b", lambda x: x["s"])).cast("long").alias("last_word"),
        labels(F.col("b")).alias("base_labels"), labels(F.concat("hits", "b")).alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    rules = ", ".join(f"({s.order}, {s.priority}, '{s.label}', ' {s.keyword} ', '{s.pattern}', {str(s.base).lower()})" for s in signatures())
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    return f"""
WITH r(ord, priority, label, keyword, pattern, base) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
n AS (SELECT k, ' ' || array_to_string(ws, '  ') || ' ' AS norm FROM d),
m AS (SELECT k, r.*, string_split_regex(norm, pattern) AS gaps, regexp_extract_all(norm, pattern) AS hits FROM n, r WHERE contains(norm, keyword) AND regexp_matches(norm, pattern)),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM m),
h AS (SELECT k, priority, ord, label, base, {blanks("array_to_string(gaps[:j], '') || array_to_string(hits[:j - 1], '')")} // 2 AS s,
  {blanks("array_to_string(gaps[:j], '') || array_to_string(hits[:j], '')")} // 2 AS e FROM i),
x AS (SELECT *, coalesce(CASE priority WHEN 0 THEN max(e) FILTER (priority = 0) OVER w WHEN 1 THEN max(e) FILTER (priority <= 1) OVER w ELSE max(e) OVER w END, -1) AS far FROM h
  WINDOW w AS (PARTITION BY k ORDER BY s, e DESC, priority, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT k, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR e > far) AS labels,
  max(CASE priority WHEN 0 THEN {CONFIDENCE[0]} WHEN 1 THEN {CONFIDENCE[1]} ELSE {CONFIDENCE[2]} END) FILTER (e > far) AS score FROM x GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (k)"""
