"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the measurements and one failure
bit per rule; a policy is a version and a set of rules whose failure rejects.  Applying a policy,
comparing versions and computing ablations are then bitwise operations on one long column, without
a second look at any text.

Defined cases: null text counts as empty (no words, so it fails `few_words`); null doc_id passes
through; repeated rows are judged one by one; an empty table gives an empty ledger; columns beside
doc_id and text are neither read nor returned by the ledger, and `filter_documents` keeps them all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values.
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_wordlike")


@dataclass(frozen=True)
class Rule:
    """`fails` is an SQL condition over the measurements; `bit` is its place in the ledger."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "4 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "n_words >= 20 and n_upper > 3 * n_lower"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "not_words", "2 * n_wordlike < n_words"),
    Rule(7, "symbols_strict", "10 * n_symbols > n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rejecting: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[n] for n in self.rejecting)


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", (*BASE.rejecting, "symbols", "duplicate_lines", "shouting", "long_words", "not_words"))
POLICIES = (BASE, V1, Policy("strict", (*V1.rejecting, "symbols_strict")))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    n_bytes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    # code points are the bytes that don't continue one
    chars = len(raw) - int(n_bytes[128:192].sum()) - int(n_bytes[list(BLANKS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    h = common.hash_words(words)
    w, repeated = common.window_hash(h, 5), 0
    s = np.sort(w)
    if (same := s[1:] == s[:-1]).any():
        repeated = int(common.covered(np.flatnonzero(np.isin(w, s[1:][same])), 5, n).sum())
    wordlike = sum(map(_wordlike, words))
    return (n, chars, int(n_bytes[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated, len(lines), int(n_bytes[65:91].sum()), int(n_bytes[97:123].sum()), wordlike)


def _wordlike(w: bytes) -> bool:
    return not w[:3].isdigit() and (w[:1].isalnum() or w[0] > 127 or w[1:2].isalpha())


def _measures(texts: pa.Array) -> pa.Array:
    """The measurements of each text; one text at a time is a Python string."""
    rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(MEASURES))], list(MEASURES))


def _judged(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """docs (columns `row` and `text`) as row, the measurements, and `failed`."""
    measured = F.arrow_udf(_measures, ", ".join(f"{m} long" for m in MEASURES))(F.col("text"))
    failed = F.lit(0).cast("long")
    for r in rules:
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return docs.select("row", measured.alias("m")).select("row", "m.*").withColumn("failed", failed)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements, and `failed`: bit r.bit is set where rule r fails."""
    return _judged(docs.select(F.col("doc_id").cast("long").alias("row"), "text"), rules).withColumnRenamed("row", "doc_id")


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with `kept`: no rule that the policy rejects by has failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablations(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: n_failed, n_alone (documents that only this rule rejects, which
    come back without it) and n_rejected by the whole policy.  One pass, partial sums per task."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))
    of = [r for r in rules if r.name in policy.rejecting]
    sums = [F.count_if(hit != 0).alias("n_rejected")]
    for r in of:
        one = F.lit(1 << r.bit).cast("long")
        sums += [F.count_if(hit.bitwiseAND(one) != 0).alias(f"f{r.bit}"), F.count_if(hit == one).alias(f"a{r.bit}")]
    rows = F.explode(F.array(*[F.struct(F.lit(policy.version).alias("version"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"a{r.bit}").alias("n_alone"), "n_rejected") for r in of]))
    return led.agg(*sums).select(rows.alias("x")).select("x.*")


def filter_documents(docs: DataFrame, policy: Policy = V1, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the policy keeps by their ledger, with all their columns.  The ledger's entry is
    made beside the row (no join), so repeated or null ids don't matter."""
    led = _judged(docs.select(F.struct("*").alias("row"), "text"), rules)
    return apply_policy(led, policy, rules).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(common.table(spark, sf_dir, "documents")), V1)
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE.mask()).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "failed")
