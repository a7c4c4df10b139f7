"""The commands as whole plans: index a folder, ask a question, scan mails, today's agenda, a briefing.

Models are callables given from outside: an embedder turns a text column into a vector column, a
model answers a prompt, an extractor turns frames of mails into frames of replies.  Without one, the
hash-seeded embedder and the prompt itself stand in, and mails have the candidates of the cache alone."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import answers, assistant, embed, privacy
from cairn.operators import chunks, events, ingest, search, store
from cairn.session import local_session, stored
from cairn.sources import extract, files, mail

Embedder = Callable[[Column], Column]
SNAPSHOT = "path string, hash string"
CHUNKS = "id long, path string, chunk_no int, start_line int, end_line int, text string, chunk_id string, content_hash string, vector array<double>"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, home: str) -> str | None:
    """The newest complete version of the store: each has its own folder, so readers never see half of one."""
    path = f"{home}/current"
    try:
        got = spark.read.text(path).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return got["value"] if got else None


def index(spark: SparkSession, folder: str, home: str, allowed: list[str] | None = None, embedder: Embedder = embed.hashed_udf) -> DataFrame:
    """Indexes what changed below a folder and returns the counters.  Chunks of changed files replace the old
    ones, and the snapshot is part of the version that holds the vectors, so a failure leaves the version
    before in place and the files are taken up again.

    Guards come before any content: what they stop is not opened.  Files that pass are hashed, and only
    those that changed are read for secrets and text."""
    with store.writer_lock(spark, f"{home}/store"):
        now = versions(spark, home)
        snapshot = read_or_empty(spark, f"{home}/{now}/files", SNAPSHOT)
        had = read_or_empty(spark, f"{home}/{now}/chunks", CHUNKS)
        decided = _decided(spark, folder, allowed, snapshot)
        fresh = decided.where("event = 'indexed'")
        cut = chunks.chunk(fresh.select("path", "text"), "path").withColumn("vector", embedder(F.col("text")))
        version = f"v{int((now or 'v0')[1:]) + 1}"
        new = store.numbered(cut, store.next_id(had))
        kept = had.join(fresh.select("path"), "path", "left_anti").unionByName(new.select(*had.columns))
        kept.select(*[f.split()[0] for f in CHUNKS.split(", ")]).sortWithinPartitions("id").write.option("maxRecordsPerFile", store.segment_rows(new)).parquet(f"{home}/{version}/chunks")
        done = fresh.select("path", "hash")
        snapshot.join(done.select("path"), "path", "left_anti").unionByName(done).write.parquet(f"{home}/{version}/files")
        ingest.append_audit(ingest.audit_rows(decided), f"{home}/audit")
        counts = ingest.counters(decided).collect()
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{home}/current")
    return spark.createDataFrame(counts)


def guarded(spark: SparkSession, folder: str, allowed: list[str] | None) -> DataFrame:
    """The listed files with `guard`, the event of what keeps a file from being opened, else null."""
    ignored = files.ignore_patterns(folder)
    listed = files.listing(spark, folder, allowed, [*privacy.DENY_FOLDERS, *(p.rstrip("/") for p in ignored if p.endswith("/"))])
    own = [p for p in ignored if not p.endswith("/")]
    extra = F.when(privacy.denied(F.col("path"), own, ()), "skipped_denylist") if own else F.lit(None).cast("string")
    return listed.withColumn("guard", F.coalesce(privacy.file_event(F.col("path"), F.col("size"), F.col("depth"), F.col("is_symlink"), F.col("inside")), extra))


def _decided(spark: SparkSession, folder: str, allowed: list[str] | None, snapshot: DataFrame) -> DataFrame:
    """Stored: path, event, hash, secrets and text of all listed files, the last two of changed ones alone."""
    at = guarded(spark, folder, allowed)
    open_ = [r["path"] for r in at.where("guard is null").select("path").collect()]  # the driver has listed them
    hashed = stored(files.contents(spark, open_).select("path", "hash").join(snapshot.select("path", "hash").distinct().withColumn("known", F.lit(True)), ["path", "hash"], "left"))
    changed = [r["path"] for r in hashed.where("known is null").select("path").collect()]
    read = extract.with_text(files.contents(spark, changed).select("path", "content", privacy.secret_names(F.col("content").cast("string")).alias("secrets")))
    read = read.select("path", "secrets", F.when(F.size("secrets") == 0, F.col("text")).alias("text"))
    event = F.when(F.col("guard").isNotNull(), F.col("guard")).when(F.col("hash").isNull(), "error").when(F.col("known"), "skipped_unchanged").when(F.size("secrets") > 0, "skipped_secret").otherwise("indexed")
    return stored(at.join(hashed, "path", "left").join(read, "path", "left").select("path", event.alias("event"), "hash", "secrets", "text"))


def nearest(spark: SparkSession, question: str, home: str, k: int = search.DEFAULT_K, embedder: Embedder = embed.hashed_udf) -> DataFrame:
    """rank, path, text and score of the k nearest chunks; an embedder that gives no vector is an error."""
    rows = read_or_empty(spark, f"{home}/{versions(spark, home)}/chunks", CHUNKS)
    vector = spark.createDataFrame([(question,)], "q string").select(embedder(F.col("q")).alias("v")).first()["v"]
    if not vector:
        raise embed.EmbeddingError("no vector for the question")
    return search.top_k(rows, vector, k, "id", "vector").select("rank", "path", "text", "score")


def ask(spark: SparkSession, question: str, home: str, k: int = search.DEFAULT_K, embedder: Embedder = embed.hashed_udf, model: Callable[[str], str] | None = None) -> dict:
    """The k nearest chunks, the prompt made of them, the answer if there is a model, and the sources that it
    cites."""
    near = nearest(spark, question, home, k, embedder).orderBy("rank").collect()
    if not near:
        return {"prompt": "", "answer": "", "sources": [], "scores": []}
    one = spark.createDataFrame([(question, [(r.path, r.text) for r in near])], "q string, c array<struct<path:string,text:string>>")
    prompt = one.select(answers.prompt(F.col("q"), F.col("c")).alias("p")).first()["p"]
    said = model(prompt).strip() if model else ""
    cited = one.select(answers.sources(F.col("c.path"), answers.citations(F.lit(said), F.size("c"))).alias("s")).first()["s"]
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("query").alias("event"), F.array(*map(F.lit, cited)).alias("top_sources"))
    stamp.write.mode("append").json(f"{home}/audit")
    return {"prompt": prompt, "answer": said, "sources": cited, "scores": [r.score for r in near]}


def cloud_preview(question: str, chunk_rows: DataFrame) -> DataFrame:
    """What would leave the machine: path and the redacted text's first bytes, and nothing else."""
    from cairn.functions.text import preview

    return chunk_rows.select("path", privacy.redact(F.col("text")).alias("text")).withColumn("preview", preview(F.col("text"))).withColumn("question", F.lit(question))


def scan_mail(mails: DataFrame, calendar: DataFrame, cache: DataFrame, model: Callable | None, prefilter: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidates with reject_reason and the events that they may repeat, cache rows to upsert); without the
    prefilter the model sees every mail."""
    worthy = mails.where(assistant.worthy(assistant.mail_text(F.col("subject"), F.col("snippet"), F.col("body")))) if prefilter else mails
    replies = events.with_cache(worthy, cache, model)
    found = events.validated(events.parse(replies)).withColumn("candidate_id", F.xxhash64("source_email_id", "title", "date", "start_time"))
    same = events.duplicates(found.where("reject_reason is null"), calendar).groupBy("candidate_id").agg(F.sort_array(F.collect_set("event_id")).alias("possible_duplicates"))
    fresh = replies.where("not hit").join(worthy.select(F.col("id").alias("email_id"), events.content_hash().alias("snippet_hash")), "email_id")
    return found.join(same, "candidate_id", "left"), fresh.select(F.col("email_id").alias("message_id"), "snippet_hash", F.col("raw_json").alias("extracted_json")).where("message_id <> ''")


def numbered_candidates(candidates: DataFrame) -> DataFrame:
    """The accepted candidates with `no`, from 1, by mail and title."""
    return store.numbered(candidates.where("reject_reason is null").orderBy("source_email_id", "title", "candidate_id"), 1, "no")


def listing(candidates: DataFrame) -> DataFrame:
    """no and what is shown of each accepted candidate."""
    shown = numbered_candidates(candidates).withColumn("duplicates", F.coalesce(F.col("possible_duplicates").cast("array<string>"), F.array().cast("array<string>")))
    return shown.select("no", events.listing(shown).alias("text")).orderBy("no")


def approved(candidates: DataFrame, answer: str) -> DataFrame:
    """The calendar rows of the accepted candidates that an answer such as 'all' or '1,3' chooses, numbered as
    they were shown."""
    shown = numbered_candidates(candidates)
    picked = shown.where(F.array_contains(assistant.selected(F.lit(answer), F.lit(2**31 - 1)), F.col("no").cast("int"))) if answer.strip().lower() not in ("all", "a", "yes", "y") else shown
    c = F.col
    return picked.select("source_email_id", assistant.calendar_row(c("title"), c("date"), c("start_time"), c("end_time"), c("all_day")).alias("e")).select("source_email_id", "e.*")


def today(calendar: DataFrame, mails: DataFrame, now: str) -> DataFrame:
    """section, rank, text: the timed events of two days, the deadlines of two weeks, the mails that matter among the
    newest five, and what may be done about them."""
    plan = events.agenda(calendar, now)
    when = F.when(F.col("start").contains("T"), F.substring("start", 12, 5)).otherwise(F.col("start"))
    rows = plan.select("section", "rank", F.concat(when, F.lit(" "), "summary").alias("text"))
    rows = rows.unionByName(events.important(mails, now).select(F.lit("mail").alias("section"), "rank", F.col("subject").alias("text")))
    first = plan.where("section = 'calendar'").agg(F.min_by("summary", "rank").alias("s"))
    hints = F.array(F.coalesce(F.concat(F.lit("Get ready for "), "s"), F.lit("Nothing is fixed: a day for long work")), F.lit("Go through the mails above"), F.lit("Look at the calendar again tonight"))
    return rows.unionByName(first.select(F.posexplode(hints).alias("rank", "text")).select(F.lit("suggestion").alias("section"), (F.col("rank") + 1).alias("rank"), "text"))


def brief(calendar: DataFrame, mails: DataFrame, now: str, model: Callable[[str], str] | None = None) -> str:
    """A short spoken briefing by the model from today's facts alone, or without one the prompt."""
    facts = {s: [r["text"] for r in rows] for s, rows in _by_section(today(calendar, mails, now)).items()}
    lines = [f"{name}:\n" + ("\n".join(f"- {t}" for t in facts.get(s, [])) or "- none") for s, name in (("calendar", "Events"), ("deadline", "Deadlines"), ("mail", "Mails"))]
    prompt = "Say in at most four plain sentences, to be read aloud, what this day holds.  Use these facts and no others.\n\n" + "\n\n".join(lines)
    return model(prompt).strip() if model else prompt


def _by_section(rows: DataFrame) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["section"], r["rank"])):  # a screenful
        out.setdefault(r["section"], []).append(r)
    return out


def draft(replies: DataFrame) -> DataFrame:
    """subject and body of a model's JSON replies; a reply that is no object is the body, without a subject."""
    j, e = F.from_json("raw", "struct<subject:string,body:string>"), F.lit("")
    good = F.trim("raw").startswith("{") & F.get_json_object("raw", "$").isNotNull()
    subject = F.when(good, F.nullif(F.trim(F.coalesce(j["subject"], e)), e))
    return replies.select("id", F.coalesce(subject, F.lit("(no subject)")).alias("subject"), F.when(good, F.trim(F.coalesce(j["body"], e))).otherwise(F.trim("raw")).alias("body"))


CONFIG = {"allowed": [], "k": search.DEFAULT_K, "days": 10, "limit": 15, "folders": list(assistant.FOLDERS), "apps": list(assistant.APPS)}


def config(home: str) -> dict:
    try:
        return CONFIG | json.loads(Path(home, "config.json").read_text())
    except FileNotFoundError:
        return dict(CONFIG)


def init(home: str) -> dict:
    """Makes the home folder and its configuration; one that is there stays."""
    Path(home).mkdir(parents=True, exist_ok=True)
    now = config(home)
    Path(home, "config.json").write_text(json.dumps(now, indent=1))
    return now


def loaded(name: str | None) -> Callable | None:
    """The callable that `module:function` names; its module goes to workers by value, so it need not be installed
    there."""
    if not name:
        return None
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("--home", default="cairn-data")
    p.add_argument("--model", help="module:function, which answers a prompt, or for scan-mail turns frames of mails into replies")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("init")
    v = sub.add_parser("index")
    v.add_argument("folder")
    v.add_argument("--confirm", action="store_true", help="list what would be read and do nothing")
    sub.add_parser("ask").add_argument("question", nargs="+")
    v = sub.add_parser("preview")
    v.add_argument("question", nargs="+")
    v.add_argument("--yes", action="store_true", help="send it, and record that")
    sub.add_parser("stats")
    sub.add_parser("route").add_argument("command", nargs="+")
    for verb in ("scan-mail", "today-fast", "brief", "full-run"):
        v = sub.add_parser(verb)
        v.add_argument("--mails", required=True, help="raw messages, one JSON document a line")
        v.add_argument("--calendar", required=True, help="raw events, one JSON document a line")
        v.add_argument("--now", required=True, help="such as 2024-01-05T08:00:00")
        if verb in ("scan-mail", "full-run"):
            v.add_argument("--deep", action="store_true", help="without the filter by words")
            v.add_argument("--answer", default="none", help="all, none or numbers such as 1,3")
        if verb == "full-run":
            v.add_argument("--speaker", help="module:function, which answers the prompt of the briefing")
    a = p.parse_args(argv)
    if a.verb == "init":
        print(json.dumps(init(a.home)))
        return 0
    spark, known, model = spark or local_session(), config(a.home), loaded(a.model)
    if a.verb == "index" and a.confirm:
        for r in guarded(spark, a.folder, known["allowed"] or None).where("guard is null").orderBy("path").select("path").toLocalIterator():
            print(r["path"])
    elif a.verb == "index":
        print(json.dumps(index(spark, a.folder, a.home, known["allowed"] or None).first().asDict()))
    elif a.verb == "ask":
        got = ask(spark, " ".join(a.question), a.home, known["k"], model=model)
        print(got["answer"] or got["prompt"], *(f"{i}. {s}" for i, s in enumerate(got["sources"], 1)), sep="\n")
    elif a.verb == "preview":
        rows = nearest(spark, " ".join(a.question), a.home, known["k"])
        for r in cloud_preview(" ".join(a.question), rows).collect():
            print(r["path"], r["preview"], sep="\n")
        if a.yes:
            ingest.append_audit(ingest.cloud_send(rows, a.model or "none"), f"{a.home}/audit")
            print(model(" ".join(a.question)) if model else "")
    elif a.verb == "route":
        said = spark.createDataFrame([(" ".join(a.command),)], "t string")
        print(json.dumps(said.select(assistant.intent(F.col("t"), tuple(known["folders"]), tuple(known["apps"])).alias("i")).select("i.*").first().asDict()))
    elif a.verb == "stats":
        at = versions(spark, a.home)
        print(json.dumps({"version": at, "files": read_or_empty(spark, f"{a.home}/{at}/files", SNAPSHOT).count(), "chunks": read_or_empty(spark, f"{a.home}/{at}/chunks", CHUNKS).count()}))
    else:
        mails, calendar = mail.messages(spark.read.text(a.mails)), mail.calendar(spark.read.text(a.calendar))
        if a.verb == "today-fast":
            for section, rows in _by_section(today(calendar, mails, a.now)).items():
                print(f"{section}:", *(f"{r['rank']}. {r['text']}" for r in rows), sep="\n")
        elif a.verb == "brief":
            print(brief(calendar, mails, a.now, model))
        else:
            cache = read_or_empty(spark, f"{a.home}/cache", "message_id string, snippet_hash string, extracted_json string")
            found, fresh = scan_mail(events.recent(mails, a.now, known["days"], known["limit"]), calendar, cache, model, not a.deep)
            found = stored(found)
            if model:
                stored(fresh).write.mode("append").parquet(f"{a.home}/cache")
            print(*(r["text"] for r in listing(found).collect()), sep="\n")
            for r in approved(found, a.answer).toLocalIterator():
                print(json.dumps(r.asDict()))
            if a.verb == "full-run":
                print(brief(calendar, mails, a.now, loaded(a.speaker)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
