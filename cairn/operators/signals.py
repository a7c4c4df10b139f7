"""Detectors over ordered signals: double bursts and endpoints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Burst:
    """A burst begins at `threshold` after a dip below half of it; two of them `least` to `most` seconds
    apart are a double one.  A burst is forgotten `most` seconds after, at the next dip."""

    threshold: float = 0.25
    least: float = 0.12
    most: float = 0.8


def fold(state: tuple[bool, float | None], t: float, peak: float, p: Burst) -> tuple[tuple[bool, float | None], bool]:
    """One step: (armed, time of the last burst) and a peak at t give the next state and whether a double
    burst ends here."""
    armed, last = state
    if peak >= p.threshold and armed:
        if last is not None and p.least <= t - last <= p.most:
            return (False, None), True
        return (False, t), False
    if peak < p.threshold * 0.5:
        return (True, None if last is not None and t - last > p.most else last), False
    return state, False


def double_bursts(peaks: DataFrame, key: str, order: str, time: str, peak: str, p: Burst = Burst()) -> DataFrame:
    """key and fired_at of each stream's first double burst, null if it has none.  Streams are walked in sorted
    partitions, with two values of state, so a stream of any length is never gathered."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, fired, any_ = None, (True, None), None, False
        for b in batches:
            out = []
            for k, t, x in zip(*(b.column(c).to_pylist() for c in (key, "t", "p"))):
                if not any_ or k != now:
                    out += [(now, fired)] * any_
                    now, state, fired, any_ = k, (True, None), None, True
                if fired is None and t is not None and x is not None:
                    state, hit = fold(state, t, x, p)
                    fired = t if hit else None
            yield batch(out, b.schema.field(key).type)
        if any_:
            yield batch([(now, fired)], b.schema.field(key).type)

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.float64())], names=[key, "fired_at"])

    rows = peaks.select(key, F.col(order).alias("o"), F.col(time).cast("double").alias("t"), F.col(peak).cast("double").alias("p"))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, fired_at double"
    return rows.repartition(key).sortWithinPartitions(key, "o").mapInArrow(walk, schema)


@dataclass(frozen=True)
class Endpoint:
    """A block is loud from `threshold` on.  What is recorded begins with the first loud block, if it comes within
    `start` blocks, and ends with the `trailing`-th silent one in a row; `most` blocks are looked at."""

    threshold: float = 0.012
    trailing: int = 10
    start: int = 50
    most: int = 50


def endpoint_step(state: tuple[int, int, int, int, bool], level: float, p: Endpoint) -> tuple[int, int, int, int, bool]:
    """One block: (begin or -1, length, silent blocks in a row, blocks seen, over) after it."""
    begin, n, quiet, i, over = state
    if over:
        return state
    loud, begun = level >= p.threshold, begin >= 0
    quiet = 0 if loud else quiet + 1
    over = not loud and (quiet >= p.trailing if begun else i >= p.start)
    return (i if loud and not begun else begin, n + (loud or begun), quiet, i + 1, over or i + 1 >= p.most)


def endpoints(blocks: DataFrame, key: str, order: str, rms: str, threshold: float = 0.012, trailing: int = 10, start_blocks: int = 50, max_blocks: int = 50) -> DataFrame:
    """key, begin and length (in blocks) of what each stream records: from the first block at the threshold
    to the `trailing`-th silent one in a row; nothing if it doesn't begin in time.  Only a stream's first
    `max_blocks` blocks leave their partitions."""
    first = blocks.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__i") <= max_blocks)
    x = F.sort_array(F.collect_list(F.struct(F.col("__i").alias("o"), F.col(rms).cast("double").alias("r"))))
    zero = F.struct(F.lit(-1).alias("begin"), F.lit(0).alias("n"), F.lit(0).alias("quiet"), F.lit(0).alias("i"), F.lit(False).alias("over"))

    def step(a, x):  # noqa: ANN001, ANN202
        loud, begun = x["r"] >= threshold, a["begin"] >= 0
        quiet = F.when(loud, 0).otherwise(a["quiet"] + 1)
        end = ~loud & F.when(begun, quiet >= trailing).otherwise(a["i"] >= start_blocks)
        return F.when(a["over"], a).otherwise(F.struct(F.when(begun | ~loud, a["begin"]).otherwise(a["i"]).alias("begin"), (a["n"] + F.when(loud | begun, 1).otherwise(0)).alias("n"), quiet.alias("quiet"), (a["i"] + 1).alias("i"), end.alias("over")))

    return first.groupBy(key).agg(x.alias("x")).select(key, F.aggregate("x", zero, step).alias("a")).select(key, F.col("a.begin").alias("begin"), F.col("a.n").alias("length"))


def levels(samples: DataFrame, key: str, value: str) -> DataFrame:
    """peak (largest magnitude) and rms of each block."""
    v = F.col(value).cast("double")
    return samples.groupBy(key).agg(F.max(F.abs(v)).alias("peak"), F.sqrt(F.avg(v * v)).alias("rms"))
