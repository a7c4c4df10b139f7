"""The same detectors and ingestion on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.signals import Burst, Endpoint, endpoint_step, fold
from cairn.operators.store import SEGMENT_ROWS


#: How long the state of a stream that sends nothing is kept, in milliseconds.
IDLE = 600_000


def double_bursts(peaks: DataFrame, p: Burst = Burst(), idle: int = IDLE) -> DataFrame:
    """Rows (stream_id, i, t, peak) give (stream_id, fired_at) for every double burst; the state of a stream is
    whether it is armed and when its last burst was, and goes when the stream is idle.  Rows of one trigger
    are put in order by i."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        armed, last = state.get if state.exists else (True, None)
        rows, fired = pd.concat(list(frames)).sort_values("i"), []
        for t, peak in zip(rows["t"].tolist(), rows["peak"].tolist()):
            (armed, last), hit = fold((armed, last), t, peak, p)
            fired += [t] * hit
        state.update((armed, last))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame({"stream_id": [key[0]] * len(fired), "fired_at": fired})

    return peaks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, fired_at double", "armed boolean, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def endpoints(blocks: DataFrame, p: Endpoint = Endpoint(), idle: int = IDLE) -> DataFrame:
    """Rows (stream_id, i, rms) give (stream_id, begin, length) once, when a stream's recording ends: by silence, by
    its length, or because the stream is idle.  Rows of one trigger are put in order by i."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else (-1, 0, 0, 0, False)
        was = at[4]
        if state.hasTimedOut:
            state.remove()
            at = (*at[:4], True)
        else:
            for x in pd.concat(list(frames)).sort_values("i")["rms"].tolist():
                at = endpoint_step(at, x, p)
            state.update(at)
            state.setTimeoutDuration(idle)
        ended = [(key[0], at[0], at[1])] * (at[4] and not was)
        yield pd.DataFrame(ended, columns=["stream_id", "begin", "length"]).astype({"stream_id": str, "begin": "int32", "length": "int32"})

    state = "begin int, n int, quiet int, seen int, over boolean"
    return blocks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, begin int, length int", state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(files: DataFrame, path: str, checkpoint: str, key: str = "path", hash_: str = "hash"):  # noqa: ANN201
    """Appends what a stream of (path, hash, ...) brings that the table at `path` doesn't hold yet.  A batch
    that runs again after a failure finds its rows there and adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates([key, hash_])
        try:
            known = spark.read.parquet(path).select(key, hash_)
        except AnalysisException as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = fresh.join(known, [key, hash_], "left_anti")
        fresh.write.option("maxRecordsPerFile", SEGMENT_ROWS).mode("append").parquet(path)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def token_stream(lines: DataFrame) -> DataFrame:
    """NDJSON lines (answer_id, i, value) of a model: answer_id, answer.  Malformed lines are skipped, lines
    after the one that says done are not read, and the whole is trimmed."""
    got = lines.select("answer_id", "i", F.from_json("value", "struct<message:struct<content:string>,response:string,done:boolean>", {"mode": "PERMISSIVE"}).alias("j"))
    x = F.sort_array(F.collect_list(F.struct("i", F.coalesce("j.message.content", "j.response", F.lit("")).alias("s"), F.coalesce("j.done", F.lit(False)).alias("done"))))
    zero = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))
    joined = F.aggregate("x", zero, lambda a, r: F.when(a["done"], a).otherwise(F.struct(F.concat(a["s"], r["s"]).alias("s"), r["done"].alias("done"))), lambda a: F.trim(a["s"]))
    return got.groupBy("answer_id").agg(x.alias("x")).select("answer_id", joined.alias("answer"))
