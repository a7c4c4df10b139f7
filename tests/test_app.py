"""The commands end to end."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn import app
from cairn.functions import embed
from cairn.operators import ingest

WORDS = ["tide", "harbour", "sail", "anchor", "dough", "oven", "yeast", "loaf", "flour"]


def by_keyword(text):
    return embed.keywords(text, WORDS)


def test_index_and_ask(spark, tmp_path, monkeypatch):
    notes, home = tmp_path / "notes", str(tmp_path / "home")
    notes.mkdir()
    (notes / "sea.md").write_text("At high tide we sail out of the harbour and lift the anchor.")
    (notes / "bread.md").write_text("The dough needs yeast and flour before the oven.")
    (notes / "private-notes.md").write_text("harbour tide")
    (notes / "photo.png").write_bytes(b"never read")
    (notes / ".indexignore").write_text("# mine\nprivate-notes.md\n")
    opened = []
    read = app.files.contents
    monkeypatch.setattr(app.files, "contents", lambda s, where: opened.extend(where) or read(s, where))
    first = app.index(spark, str(notes), home, embedder=by_keyword).first()
    assert (first.total, first.indexed, first.skipped_denied) == (3, 2, 1)
    assert {p.rsplit("/", 1)[1] for p in opened} == {"sea.md", "bread.md"}  # guards come before contents
    got = app.ask(spark, "harbour tide", home, embedder=by_keyword, model=lambda p: "yes [1], see [9]")
    assert [s.rsplit("/", 1)[1] for s in got["sources"]] == ["sea.md"] and got["answer"] == "yes [1], see [9]" and "harbour tide" in got["prompt"]
    second = app.index(spark, str(notes), home, embedder=by_keyword).first()
    assert (second.indexed, second.skipped) == (0, 3)
    (notes / "sea.md").write_text("The loaf now goes into the oven, and another loaf.")
    (notes / "keys [1].md").write_text("sk-" + "X" * 48)
    third = app.index(spark, str(notes), home, embedder=by_keyword).first()
    assert (third.indexed, third.skipped_secret) == (1, 1)
    rows = app.read_or_empty(spark, f"{home}/{app.versions(spark, home)}/chunks", app.CHUNKS)
    assert rows.count() == 2 and rows.where("text like '%harbour%'").count() == 0
    assert 2 in {r.id for r in rows.collect()}
    log = spark.read.json(f"{home}/audit")
    assert log.where("event = 'query'").count() == 1 and "text" not in log.columns
    assert log.where("event = 'skipped_secret' and reason like '%OpenAI%'").count() == 1
    assert app.ask(spark, "zebra", home, embedder=by_keyword) == {"prompt": "", "answer": "", "sources": [], "scores": []}
    with pytest.raises(embed.EmbeddingError):
        app.ask(spark, "x", home, embedder=lambda c: F.lit(None).cast("array<double>"))


def test_ask_without_an_index(spark, tmp_path):
    assert app.ask(spark, "x", str(tmp_path / "none"))["sources"] == []


def test_scan_mail(spark):
    mails = spark.createDataFrame([("1", "Interview", "monday", "at 10:00"), ("2", "Big sale", "", ""), ("3", "Team meeting", "", "")], "id string, subject string, snippet string, body string")
    calendar = spark.createDataFrame([(9, "team meeting", "2024-01-02T10:30:00Z", "2024-01-02T11:30:00Z")], "id long, summary string, start string, end string")
    cache = spark.createDataFrame([], "message_id string, snippet_hash string, extracted_json string")

    def model(frames):
        for f in frames:
            raw = [f'{{"candidates": [{{"title": "{s}", "category": "meeting", "date": "2024-01-02", "start_time": "11:00", "confidence": 0.9}}, {{"title": "?"}}]}}' for s in f["subject"]]
            yield pd.DataFrame({"email_id": f["id"], "subject": f["subject"], "raw_json": raw})

    found, fresh = app.scan_mail(mails, calendar, cache, model)
    got = {(r.title, r.reject_reason, tuple(r.possible_duplicates or ())) for r in found.collect()}
    assert got == {("Interview", None, ()), ("Team meeting", None, (9,)), ("?", "no date", ())}
    assert {r.message_id for r in fresh.collect()} == {"1", "3"}
    assert {r.summary for r in app.approved(found, "2").collect()} == {"Team meeting"} and app.approved(found, "all").count() == 2 and app.approved(found, "none").count() == 0
    assert {r.end for r in app.approved(found, "1").collect()} == {"2024-01-02T12:00:00"}


def test_preview_and_draft(spark):
    rows = spark.createDataFrame([("a.md", "key sk-" + "X" * 48 + " " + "y" * 400, "secret column")], "path string, text string, other string")
    r = app.cloud_preview("q", rows).first()
    assert "sk-X" not in r.text and r.preview.endswith(" …") and "other" not in r.asDict()
    sent = ingest.cloud_send(rows, "some provider").first()
    assert (sent.event, sent.file_paths, sent.chunk_count) == ("cloud_send", ["a.md"], 1) and "text" not in sent.asDict()
    d = app.draft(spark.createDataFrame([(1, '{"subject": "s", "body": "b"}'), (2, "plain"), (3, '{"body": "b"}'), (4, '{"subject": "s2"}'), (5, "[1]"), (6, "{broken")], "id int, raw string"))
    assert [(x.subject, x.body) for x in d.orderBy("id").collect()] == [("s", "b"), ("(no subject)", "plain"), ("(no subject)", "b"), ("s2", ""), ("(no subject)", "[1]"), ("(no subject)", "{broken")]
    assert d.where(F.col("subject") == "s").count() == 1


def replies(frames):
    for f in frames:
        raw = [json.dumps([{"title": s, "category": "meeting", "date": "2024-01-06", "start_time": "11:00", "confidence": "0.9", "location": "room 4"}]) for s in f["subject"]]
        yield pd.DataFrame({"email_id": f["id"], "subject": f["subject"], "raw_json": raw})


def said(prompt):
    return f" a day with {prompt.count('- ')} lines "


def test_verbs(spark, tmp_path, capsys):
    home, notes = str(tmp_path / "home"), tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("one two")
    (notes / ".env").write_text("x")
    ms = lambda d, h: str(int(pd.Timestamp(f"2024-01-{d:02d}T{h:02d}:00:00Z").timestamp() * 1000))
    letter = lambda i, subject, d: json.dumps({"id": str(i), "internalDate": ms(d, 8), "payload": {"headers": [{"name": "Subject", "value": subject}]}})
    (tmp_path / "mails").write_text("\n".join([letter(1, "old meeting", 1), letter(2, "Interview with Ines", 5), letter(3, "holiday photos", 4), *(letter(4 + i, f"photo {i}", 3) for i in range(9))]))
    (tmp_path / "calendar").write_text("\n".join(json.dumps(e) for e in [{"id": "a", "summary": "Interview with Ines", "start": {"dateTime": "2024-01-06T10:30:00Z"}, "end": {"dateTime": "2024-01-06T11:30:00Z"}}, {"id": "b", "summary": "tax", "start": {"date": "2024-01-09"}, "end": {"date": "2024-01-10"}}]))
    sources = ["--mails", str(tmp_path / "mails"), "--calendar", str(tmp_path / "calendar"), "--now", "2024-01-05T09:00:00"]

    def run(*words):
        assert app.main(["--home", home, *words], spark) == 0
        return capsys.readouterr().out

    assert json.loads(run("init"))["k"] == 5 and run("index", str(notes), "--confirm").split("/")[-1] == "a.md\n"
    assert json.loads(run("index", str(notes)))["indexed"] == 1 and json.loads(run("stats")) == {"version": "v1", "files": 1, "chunks": 1}
    assert "a.md" in run("ask", "one") and "one two" in run("preview", "one") and spark.read.json(f"{home}/audit").where("event = 'cloud_send'").count() == 0
    run("preview", "one", "--yes")
    assert spark.read.json(f"{home}/audit").where("event = 'cloud_send'").first().chunk_count == 1
    out = run("today-fast", *sources)
    assert "1. 10:30 Interview with Ines" in out and "1. 2024-01-09 tax" in out and "mail:\n1. Interview with Ines\n" in out and "holiday" not in out and "Get ready for Interview" in out
    assert run("--model", "test_app:said", "brief", *sources) == "a day with 3 lines\n"
    assert run("scan-mail", *sources) == "\n"  # nothing is cached, and there is no model
    got = run("--model", "test_app:replies", "scan-mail", *sources, "--answer", "2")
    assert "2. Interview with Ines  (meeting, confidence 0.90)\n    When: 2024-01-06 11:00-12:00\n    Where: room 4" in got and "May repeat: a" in got
    assert json.loads(got.strip().splitlines()[-1])["end"] == "2024-01-06T12:00:00" and "old meeting" in got
    assert run("--model", "test_app:replies", "scan-mail", *sources, "--deep").count("When:") == 12
    assert "Interview" in run("scan-mail", *sources)  # from the cache
    full = run("full-run", *sources, "--speaker", "test_app:said")
    assert "2. Interview with Ines" in full and full.endswith("a day with 3 lines\n")
    assert json.loads(run("route", "open", "the", "editor")) == {"name": "open_app", "arg": "editor", "recipient": None, "message": None}
