"""Mail, calendar and contacts from the raw JSON of their services, one document a row."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairn.operators import store

BODY_CHARS = 3000
_PART = "struct<mimeType:string,body:struct<data:string>>"
_MESSAGE = f"struct<id:string,snippet:string,internalDate:string,payload:struct<headers:array<struct<name:string,value:string>>,body:struct<data:string>,parts:array<{_PART}>>>"
_TIME = "struct<dateTime:string,date:string>"
_EVENT = f"struct<id:string,summary:string,start:{_TIME},end:{_TIME},location:string>"
#: Actions that need a typed yes.
CONFIRMED = ("send_email", "delete_email", "archive_email", "create_calendar_event", "delete_calendar_event", "move_file", "delete_file", "run_terminal_command")


@F.pandas_udf(StringType())
def decoded(data: pd.Series) -> pd.Series:
    """urlsafe base64 as UTF-8, without the bytes that aren't."""

    def one(x: str | None) -> str:
        try:
            return base64.urlsafe_b64decode(x or "").decode("utf-8", "ignore")
        except binascii.Error:
            return ""

    return data.map(one)


def header(name: str) -> Column:
    """A header's last value by its lower-cased name, or empty."""
    named = F.filter(F.col("m.payload.headers"), lambda h: F.lower(h["name"]) == name)
    return F.coalesce(F.try_element_at(F.transform(named, lambda h: h["value"]), F.lit(-1)), F.lit(""))


def messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """id, from, subject, date, received, snippet, body of raw messages; the body is the first plain part that has
    data, else the message's own, cut at 3000 characters; received comes from the service's milliseconds.
    What is no message gives no row."""
    m = raw.select(F.from_json(column, _MESSAGE).alias("m")).where("m.id is not null")
    plain = F.filter(F.col("m.payload.parts"), lambda p: (p["mimeType"] == "text/plain") & (F.coalesce(p["body"]["data"], F.lit("")) != ""))
    data = F.coalesce(F.try_element_at(F.transform(plain, lambda p: p["body"]["data"]), F.lit(1)), F.col("m.payload.body.data"))
    return m.select(
        F.col("m.id").alias("id"), header("from").alias("from"), header("subject").alias("subject"), header("date").alias("date"),
        F.timestamp_millis(F.col("m.internalDate").try_cast("long")).alias("received"),
        F.coalesce("m.snippet", F.lit("")).alias("snippet"), F.left(decoded(data), F.lit(BODY_CHARS)).alias("body"),
    )


def calendar(raw: DataFrame, column: str = "value") -> DataFrame:
    """id, summary, start, end, location of raw events; a time where there is one, else a date."""
    e = raw.select(F.from_json(column, _EVENT).alias("e")).where("e.start is not null")
    return e.select(F.col("e.id").alias("id"), F.coalesce("e.summary", F.lit("Untitled")).alias("summary"), F.coalesce("e.start.dateTime", "e.start.date").alias("start"), F.coalesce("e.end.dateTime", "e.end.date").alias("end"), F.coalesce("e.location", F.lit("")).alias("location"))


def upcoming(events: DataFrame, now: str, until: str, limit: int = 20) -> DataFrame:
    """The first `limit` events by start that begin from `now` to `until`."""
    return events.where(F.col("start").between(now, until)).orderBy("start", "id").limit(limit)


def contact_key(name: Column) -> Column:
    return F.trim(F.lower(name))


def saved(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """contacts (name, email, saved_at) with new ones; the last saved of a name counts."""
    both = contacts.unionByName(new).withColumn("name", contact_key(F.col("name"))).withColumn("email", F.trim("email"))
    return store.latest(both, "name", "saved_at")


def resolved(names: DataFrame, contacts: DataFrame, column: str = "recipient") -> DataFrame:
    """names with `email`, null where nobody is known by the name."""
    known = contacts.select(F.col("name").alias("__name"), "email")
    return names.join(known, contact_key(F.col(column)) == F.col("__name"), "left").drop("__name")


def needs_confirmation(action: Column) -> Column:
    return action.isin(*CONFIRMED)


def spoken(title: Column, date: Column, start: Column) -> Column:
    """Title, date and start in a sentence that can be read out, as far as they are known."""
    e = F.lit("")
    at = F.when(F.coalesce(start, e) != "", F.concat(F.lit(" at "), start)).otherwise("")
    return F.concat(title, F.when(F.coalesce(date, e) != "", F.concat(F.lit(" on "), date, at)).otherwise(""))


def listed(parts: Column) -> Column:
    """'A', 'A and b', 'A, b, and c'."""
    n = F.size(parts)
    head, last = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "), F.element_at(parts, -1)
    text = F.when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))
    return F.when(n > 0, F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2))))
