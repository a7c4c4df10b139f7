"""Incremental ingestion: what happens to each file, what changed, and what is counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import privacy

EVENTS = (
    "indexed skipped_denylist skipped_secret skipped_not_allowed skipped_unchanged skipped_binary skipped_too_large "
    "skipped_depth skipped_symlink skipped_timeout error query cloud_send"
).split()


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and state (new, changed, unchanged, deleted) between two snapshots of (path, hash)."""
    a, b = before.select("path", F.col("hash").alias("h0")), now.select("path", F.col("hash").alias("h1"))
    state = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "deleted").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def decide(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """files (path, size, depth, is_symlink, inside, hash, and content or the `secrets` in it) with `event`: guards
    first, then the comparison with the snapshot, then the secret scan; `secrets` are the names found."""
    known = snapshot.select("path", "hash").distinct().withColumn("__known", F.lit(True))
    at = files.withColumn("__guard", privacy.file_event(F.col("path"), F.col("size"), F.col("depth"), F.col("is_symlink"), F.col("inside"))).join(known, ["path", "hash"], "left")
    if "secrets" not in files.columns:
        at = at.withColumn("secrets", F.when(F.col("__guard").isNull() & F.col("__known").isNull(), privacy.secret_names(F.col("content"))))
    event = F.when(F.col("__guard").isNotNull(), F.col("__guard")).when(F.col("__known"), "skipped_unchanged").when(F.size("secrets") > 0, "skipped_secret").otherwise("indexed")
    return at.withColumn("event", event).drop("__guard", "__known")


def counters(decided: DataFrame) -> DataFrame:
    """total, indexed, skipped, skipped_secret, skipped_denied of decided files.  Only supported files that
    pass depth, link and type guards count in total; what is unchanged or too large is only skipped."""
    e = F.col("event")
    skips = ("skipped_too_large", "skipped_not_allowed", "skipped_denylist", "skipped_unchanged", "skipped_secret")
    return decided.agg(
        F.count_if(e.isin("indexed", *skips)).alias("total"), F.count_if(e == "indexed").alias("indexed"), F.count_if(e.isin(*skips)).alias("skipped"),
        F.count_if(e == "skipped_secret").alias("skipped_secret"), F.count_if(e.isin("skipped_not_allowed", "skipped_denylist")).alias("skipped_denied"),
    )


def audit_rows(decided: DataFrame) -> DataFrame:
    """Metadata alone: ts, event, path, reason.  No content has a column here."""
    return decided.where("event <> 'ignored'").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "event", "path", F.when(F.col("event") == "skipped_secret", F.concat(F.lit("possible secret: "), F.array_join("secrets", ", "))).alias("reason"))


def cloud_send(sent: DataFrame, provider: str) -> DataFrame:
    """The audit row of chunks (path, text, ...) that leave the machine: where to, which files, how many."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return sent.agg(F.sort_array(F.collect_set("path")).alias("file_paths"), F.count("*").cast("int").alias("chunk_count")).select(stamp.alias("ts"), F.lit("cloud_send").alias("event"), F.lit(provider).alias("provider"), "file_paths", "chunk_count")


def append_audit(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; fields that are null are left out, and there is none for content."""
    rows.select(*[c for c in ("ts", "event", "path", "reason", "mode", "top_sources", "provider", "file_paths", "chunk_count") if c in rows.columns]).write.mode("append").json(path)
