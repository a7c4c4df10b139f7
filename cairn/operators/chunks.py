"""Overlapping word chunks with line provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import BLANKS
from cairn.session import spread

WORDS, OVERLAP = 500, 80


def chunk(docs: DataFrame, key: str, text: str = "text", size: int = WORDS, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_no, start_line, end_line, text, chunk_id, content_hash: windows of `size` words that begin
    every size - overlap words (1 if that is less), up to the first one that reaches the end.

    chunk_id is a hash of key and lines, so chunks of one long line share it; (key, chunk_no) is unique."""
    step = max(1, size - overlap)
    lines = F.split(F.col(text), "\n", -1)
    entries = F.flatten(F.transform(lines, lambda line, i: F.transform(F.filter(F.split(line, BLANKS), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("ln")))))
    n = F.size("entries")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(float(step)))).cast("int")
    # windows are cut before they are exploded: a row carries its own words alone
    each = F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(c.alias("chunk_no"), F.slice("entries", c * step + 1, F.lit(size)).alias("part")))
    cut = spread(docs.select(key, text)).select(key, entries.alias("entries")).where(n > 0).select(key, F.explode(each).alias("x")).select(key, "x.chunk_no", "x.part")
    start, end = F.element_at("part", 1)["ln"], F.element_at("part", -1)["ln"]
    body = cut.select(key, "chunk_no", start.alias("start_line"), end.alias("end_line"), F.array_join(F.transform("part", lambda x: x["w"]), " ").alias("text"))
    return body.select("*", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("start_line").cast("string"), F.col("end_line").cast("string")), 256).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
