"""Queries that once ran over less than their tables, held against plain versions over whole ones."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from conftest import SF
from pyspark.sql import functions as F

from cairn.functions import ratio
from cairn.operators import events
from cairn.plans import QUERIES
from cairn.plans.catalog import candidates


def test_truncate_all_takes_every_document(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert any(not (r.text or "")[:200].isascii() for r in rows)
    head = lambda t: None if t is None else hashlib.sha256(t.encode()[:200].decode(errors="ignore").encode()).hexdigest()
    assert sorted(map(tuple, QUERIES["truncate_all"](spark, SF).collect())) == sorted((r.doc_id, head(r.text)) for r in rows)


def test_event_dedupe_takes_every_candidate(spark):
    by_date = defaultdict(list)
    for r in candidates(spark, SF).where("date is not null").collect():
        by_date[r.date].append((r.event_id, " ".join(r.title.lower().split()), r.start_time or "", r.end_time or r.start_time or ""))
    plain, known = set(), {}
    for rows in by_date.values():
        for i, t, start, end in rows:
            for j, u, at, _ in rows:
                at = at or "09:00"
                if i != j and (start == "" or (start < at < end)):
                    if (t, u) not in known:
                        known[t, u] = SequenceMatcher(None, t, u).ratio()
                    if known[t, u] >= 0.6:
                        plain.add((i, j))
    got = [(r.candidate_id, r.event_id) for r in QUERIES["event_dedupe"](spark, SF).collect()]
    assert len(got) == len(plain) and set(got) == plain


def test_a_busy_day_of_events_is_whole_and_soon_done(spark):
    """6000 candidates without a time and as many events of one date: 36 million pairs of titles, in tasks for all cores."""
    title = F.concat(F.element_at(F.array(*map(F.lit, ("view", "click", "signup"))), (F.col("id") % 3 + 1).cast("int")), F.lit(" "), F.col("id").cast("string"))
    rows = spark.range(6000).select("id", title.alias("summary"))
    c = rows.select(F.col("id").alias("candidate_id"), F.col("summary").alias("title"), F.lit("2024-01-01").alias("date"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("end_time"))
    e = rows.select("id", "summary", F.lit("2024-01-01T09:00:00Z").alias("start"), F.lit("").alias("end"))
    began = time.monotonic()
    got = {r.candidate_id: r.n for r in events.duplicates(c, e).groupBy("candidate_id").agg(F.count("*").alias("n")).collect()}
    assert time.monotonic() - began < 20
    names = [r.summary for r in rows.orderBy("id").collect()]
    for i in (0, 1, 2, 3000, 4001, 5999):
        assert got[i] == sum(SequenceMatcher(None, names[i], u).ratio() >= 0.6 for u in names), i


def test_duplicates_of_odd_rows(spark):
    """Missing titles, times and ends, events over midnight, all day or before their start, ids that are strings or occur again."""
    rnd = random.Random(3)
    some = lambda *x: rnd.choice(x)
    word = lambda: some(None, "", "  ", "Team  Meeting", "team meeting!", "Tëam 会議", "x" * 250, "x" * 249 + "y", "ab" * 60, "review of " + str(rnd.randrange(40)))
    clock = lambda: some("00:00", "09:30", "9:30", "15:00", "23:59")
    day = lambda: some("2024-01-01", "2024-01-02", "2024-01-03")
    c = [(i // 2, word(), some(None, "", day(), day()), some(None, "", clock(), clock()), some(None, "", clock())) for i in range(300)]
    at = lambda: some(f"{day()}T{clock()}:00Z", f"{day()}T{clock()}:00Z", day())
    e = [(f"e{i // 3}", word(), some(None, "", at(), at(), at()), some(None, "", at())) for i in range(300)]
    when = lambda x: x[11:16] if x and "T" in x else ""
    plain = Counter()
    for i, t, date, s, z in c:
        for j, u, start, end in e:
            a, b, es, ee = s or "", z or s or "", when(start), when(end) or when(start)
            if date and (start or "")[:10] == date and (not a or not es or (a < ee and es < b)):
                r = SequenceMatcher(None, *(" ".join((x or "").lower().split()) for x in (t, u))).ratio()
                if r >= 0.6:
                    plain[i, j, r] += 1
    got = events.duplicates(
        spark.createDataFrame(c, "candidate_id int, title string, date string, start_time string, end_time string"), spark.createDataFrame(e, "id string, summary string, start string, end string")
    )
    assert got.columns == ["candidate_id", "event_id", "similarity"] and Counter(map(tuple, got.collect())) == plain
    assert {r for _, _, r in plain} > {1.0} and len(plain) > 1000


def test_ratios_of_many_titles_are_difflibs():
    rnd = random.Random(5)
    for letters, longest, n in (("ab", 8, 60), ("abc ", 40, 40), ("ab é😀", 199, 12), ("abcdefgh", 260, 12), ("0123456789", 14, 60)):
        a, b = (["", *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n))] for _ in range(2))
        for least in (0.6, 0.2, 0.0, 1.0):
            got = ratio.matched(a, b, least)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    m = SequenceMatcher(None, x, y)
                    assert got[i, j] == (sum(k.size for k in m.get_matching_blocks()) + 1 if m.ratio() >= least else 0), (x, y, least)


def test_html_text_has_the_words_of_every_page(spark):
    """Comments, heads, scripts and styles go, tags part words, entities are read: by regex, on all pages."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in QUERIES["html_text"](spark, SF).collect()}
    for r in pages:
        raw = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", r.html or "")
        raw = re.sub(r"(?is)<head\b.*?(</head>|(?=<body\b))", " ", raw)
        assert got[r.page_id].split() == html.unescape(re.sub(r"(?s)<[^>]*>", " ", raw)).split(), r.page_id
