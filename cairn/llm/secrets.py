"""Secret scans with a trigram inverted index.

Each rule's regex is compiled to a Boolean query over trigrams that any match must contain.  The
index has a list of documents for each trigram, in shards of documents, so that no list outgrows a
shard.  In each shard a rule's query is looked up by its trigrams, and their lists are intersected and
united to the rule's candidates; only those are searched by the regex itself.  A rule whose regex has
no mandatory trigram is searched in every document.

Documents go by a 64-bit key; two that share one are candidates together, and the regex decides.

Everything that touches rows is DataFrame and SQL; Python only compiles the rules.

Defined cases: null text counts as empty (no span); null doc_id passes through; rows of the same id
and text give the same result each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .text_sql import SPANS, between, cut_text, let, match_spans, running


@dataclass(frozen=True)
class SecretRule:
    """A match counts if `group` has `least` characters or more; base rules are the contract's."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Public formats of credentials.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("openai", r"sk-[A-Za-z0-9]{48}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]{1,64}:[^@/\x20\x09-\x0D]{3,64}@"),
)

#: A literal set larger than this is turned into trigrams and a new one is begun.
_SET = 16
ALWAYS = ("and",)
#: Documents of a shard, on average.
SHARD = 4096
#: Candidates are broadcast up to this many bytes; beyond it the texts that may hold a secret go to them.
BROADCAST_BYTES = 32 << 20


def _grams(strings: set[str]) -> tuple:
    """Any of the strings: all trigrams of it."""
    if any(len(s) < 3 for s in strings):
        return ALWAYS
    return ("or", *sorted({("and", *sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in strings}))


def _walk(seq) -> tuple[set[str] | None, list[tuple]]:  # noqa: ANN001
    """The exact strings of a parsed sequence if they are few, else None and queries that must hold."""
    run, parts, exact = {""}, [], True

    def put(strings: set[str]) -> None:
        nonlocal run, exact
        joined = {a + b for a, b in product(run, strings)}
        if len(joined) > _SET:
            parts.append(_grams(run))
            exact, joined = False, strings
        run = joined

    def gap(queries: list[tuple]) -> None:
        nonlocal run, exact
        parts.append(_grams(run))
        parts.extend(queries)
        run, exact = {""}, False

    for op, arg in seq:
        name = str(op)
        if name == "LITERAL":
            put({chr(arg).lower()})
        elif name == "IN" and (few := _class(arg)):
            put(few)
        elif name == "SUBPATTERN":
            got, sub = _walk(arg[-1])
            put(got) if got is not None else gap(sub)
        elif name == "BRANCH":
            ways = [_walk(x) for x in arg[1]]
            if all(w[0] is not None for w in ways) and len(few := set().union(*(w[0] for w in ways))) <= _SET:
                put(few)
            else:
                gap([("or", *(("and", *(w[1] or [_grams(w[0])])) for w in ways))])
        elif name == "MAX_REPEAT":
            low, high, body = arg
            got, sub = _walk(body)
            if got is not None and high == 1 and low == 0:
                put(got | {""})
            elif got is not None and low == int(high) and low <= 4:
                for _ in range(low):
                    put(got)
            elif low == 0:
                gap([])
            else:
                gap(sub if got is None else [_grams(got)])
        else:
            gap([])
    if exact:
        return run, []
    return None, [*parts, _grams(run)]


def _class(items) -> set[str] | None:  # noqa: ANN001
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < _SET:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def trigram_query(pattern: str) -> tuple:
    """('and', q...) or ('or', q...) over trigrams of the lower-cased text; ('and',) always holds."""
    exact, parts = _walk(parser.parse(pattern))
    return _simple(("and", *([_grams(exact)] if exact is not None else parts)))


def _simple(q: tuple | str) -> tuple | str:
    if isinstance(q, str):
        return q
    subs = [_simple(x) for x in q[1:]]
    if q[0] == "or":
        return ALWAYS if not subs or ALWAYS in subs else subs[0] if len(subs) == 1 and isinstance(subs[0], tuple) else ("or", *subs)
    flat = [y for x in subs if x != ALWAYS for y in (x[1:] if isinstance(x, tuple) and x[0] == "and" else (x,))]
    return ("and", *dict.fromkeys(flat))


def trigrams(q: tuple | str) -> set[str]:
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1:]))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The stored index: shard, trigram and `postings`, the sorted keys of the shard's documents that hold it,
    for the given trigrams of the lower-cased texts."""
    shards = max(1, -(-docs.count() // SHARD))
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    each = low.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.explode(held).alias("trigram"), "key")
    return common.stored(each.groupBy("shard", "trigram").agg(F.array_sort(F.collect_set("key")).alias("postings")))


def candidates(index: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """key and `kinds`: the rules whose trigram query the document satisfies."""
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    named = lambda q, kind: F.transform(_holders(q), lambda x: F.struct(x.alias("key"), F.lit(kind).alias("kind")))
    found = [named(q, r.kind) for r in rules if (q := trigram_query(r.pattern)) != ALWAYS]
    return lists.select(F.explode(F.concat(*found)).alias("x")).groupBy("x.key").agg(F.collect_set("x.kind").alias("kinds"))


def _holders(q: tuple | str) -> Column:
    """The documents of a shard that satisfy a query."""
    if isinstance(q, str):
        return F.coalesce(F.try_element_at("lists", F.lit(q)), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if q[0] == "and" else F.array_union, map(_holders, q[1:]))


def _may_hold(low: Column, q: tuple | str) -> Column:
    """Whether one text satisfies a query."""
    if isinstance(q, str):
        return low.contains(q)
    return reduce(Column.__and__ if q[0] == "and" else Column.__or__, [_may_hold(low, x) for x in q[1:]])


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """All columns of docs (but one called `found`) and `found`: array<struct<s, k, kind, e>> of every rule's spans, by start and
    then by the order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(trigrams, queries.values())))
    keyed = docs.drop("found").select(F.struct("*").alias("row"), "text", _key().alias("own"))
    if not grams:
        return _searched(keyed.withColumn("kinds", F.array().cast("array<string>")), rules, queries)
    hits = common.stored(candidates(build_index(docs, grams), rules))
    size = hits.agg(F.sum(F.octet_length(F.array_join("kinds", ",")) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return _searched(keyed.join(F.broadcast(hits), F.col("own") == F.col("key"), "left"), rules, queries)
    # too many candidates to send everywhere: their texts go to them, all others stay where they are
    may = F.coalesce(reduce(Column.__or__, [_may_hold(F.lower("text"), q) for q in queries.values() if q != ALWAYS]), F.lit(False))
    joined_ = _searched(keyed.where(may).join(hits, F.col("own") == F.col("key"), "left"), rules, queries)
    return joined_.unionByName(_searched(keyed.where(~may).withColumn("kinds", F.array().cast("array<string>")), rules, queries))


def _searched(keyed: DataFrame, rules: tuple[SecretRule, ...], queries: dict[str, tuple]) -> DataFrame:
    text, none, spans = F.coalesce(F.col("text"), F.lit("")), F.array().cast(SPANS), []
    for k, r in enumerate(rules):
        at = match_spans(text, r.pattern, r.kind, k, r.group, r.least)
        spans.append(at if queries[r.kind] == ALWAYS else F.when(F.array_contains("kinds", r.kind), at).otherwise(none))
    return keyed.select("row", F.array_sort(F.concat(*spans)).alias("found")).select("row.*", "found")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by [REDACTED:kind]; where spans overlap, what the first covers
    goes with it.  All columns and rows stay."""
    found = scan(docs.select("doc_id", "text", F.struct("*").alias("__row")), rules)

    def clean(pieces: Column) -> Column:
        """The text's parts between spans, each with the label that follows; `ends` tells how far the spans up to
        each one reach."""

        def parts(ends: Column) -> Column:
            begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            label = lambda x: F.concat(F.lit("[REDACTED:"), x["kind"], F.lit("]"))
            each = F.transform("found", lambda x, i: F.when(x["s"] >= begin(i), F.concat(between(pieces, begin(i), x["s"]), label(x))).otherwise(""))
            return F.concat(F.array_join(each, ""), between(pieces, F.element_at(ends, -1), F.length("text")))

        return let(running(F.transform("found", lambda x: x["e"]), F.greatest), parts)

    text = F.when(F.size("found") > 0, let(cut_text(F.col("text")), clean)).otherwise(F.col("text"))
    return found.select(*[(text if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    n = [F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in base]
    digest = F.sha2(joined(F.filter("found", lambda x: x["k"] < len(base))), 256)
    return found.select("doc_id", *n, digest.alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle() -> str:
    """The same rows by DuckDB: every rule over every text, without an index."""
    def spans(r: SecretRule, k: int) -> str:
        p = r.pattern.replace("'", "''")
        hit, val, gap = f"regexp_extract_all(t, '{p}', 0)", f"regexp_extract_all(t, '{p}', {r.group})", f"string_split_regex(t, '{p}')"
        ends = f"list_transform(range(1, len({hit}) + 1), lambda i: list_sum(list_transform(({gap})[:i], lambda g: length(g))) + list_sum(list_transform(({hit})[:i], lambda g: length(g))))"
        return f"list_filter(list_transform(range(1, len({hit}) + 1), lambda i: {{'s': (({ends})[i] - length(({hit})[i]))::BIGINT, 'k': {k}, 'kind': '{r.kind}', 'e': ({ends})[i]::BIGINT, 'n': length(({val})[i])}}), lambda x: x.n >= {r.least})"

    parts = " || ".join(f"CASE WHEN regexp_matches(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {spans(r, k)} ELSE [] END" for k, r in enumerate(RULES))
    text = lambda f: f"coalesce(array_to_string(list_transform({f}, lambda x: x.kind || ':' || x.s || ':' || x.e), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort({parts}) AS f FROM d)
SELECT doc_id, len(list_filter(f, lambda x: x.kind = 'assign')) AS n_assign, len(list_filter(f, lambda x: x.kind = 'access')) AS n_access,
  len(list_filter(f, lambda x: x.kind = 'hex')) AS n_hex, sha256({text("list_filter(f, lambda x: x.k < 3)")}) AS base_sha256, {text("f")} AS spans
FROM f"""
