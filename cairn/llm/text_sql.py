"""Text expressions that stay in the JVM: lower-casing of A-Z, words, and the places of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters, digits and characters beyond ASCII (fixed value; upper-case
#: letters are no separators, so case may be folded before or after the split).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  `lower` does just that unless the text holds other upper-case letters,
    which only then cost the slower translation."""
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """The words of text, with an empty string before the first if text starts with a separator and
    after the last if it ends with one."""
    return F.split(text, SEPARATORS, -1)


def leading(parts: Column) -> Column:
    """1 if split_words put an empty string in front of words, else 0."""
    return (F.get(parts, F.lit(0)) == "").cast("int")


def count_words(parts: Column) -> Column:
    last = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    return (F.size(parts) - leading(parts) - last.cast("int")).cast("long")


#: Values that are folded one after the other; arrays are copied at each step, so longer ones are folded in blocks.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For an array of ints the results of op over its first entry, its first two, and so on; op is associative.
    Blocks are folded, then the blocks' last results, so the cost is the length times the block's."""
    last = lambda a: F.element_at(a, -1)
    none = F.array().cast("array<int>")
    more = lambda a, v: F.concat(a, F.array(F.when(F.size(a) > 0, op(last(a), v)).otherwise(v)))

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))
        inner = F.transform(blocks, lambda b: F.aggregate(b, none, more))

        def joined(parts: Column) -> Column:
            ends = F.aggregate(parts, none, lambda a, b: more(a, last(b)))
            return let(ends, lambda e: F.flatten(F.transform(parts, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: op(F.get(e, i - 1), v))))))

        return F.when(F.size(x) > 0, let(inner, joined)).otherwise(none)

    return let(values, of)


def plus(a: Column, b: Column) -> Column:
    return a + b


SPANS = "array<struct<s:int,k:int,kind:string,e:int>>"


def match_spans(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 1) -> Column:
    """array<struct<s, k, kind, e>>: start and exclusive end, in code points, of each leftmost
    non-overlapping match of pattern whose `group` has `least` characters or more.

    The text between matches and the matches alternate, so running sums of lengths give places."""
    lengths = lambda parts: F.transform(parts, F.length)
    hits, values = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    gaps = lengths(F.split(text, pattern, -1))

    def placed(h: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, plus), plus)
        rows = F.filter(F.arrays_zip(h.alias("h"), values.alias("v"), ends.alias("e")), lambda x: x["v"] >= least)
        return F.transform(rows, lambda x: F.struct((x["e"] - x["h"]).alias("s"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    return F.when(text.rlike(pattern), let(hits, placed)).otherwise(F.array()).cast(SPANS)


#: Code points of the pieces that a text is cut into when many places of it are read.
_PIECE = 4096


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text given as `cut_text` has it; costs their number
    and two pieces."""
    first = (start / _PIECE).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, (end / _PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * _PIECE + 1, end - start)).otherwise("")


def cut_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
