"""Text of HTML, DOCX, PDF and plain files, from their bytes."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements without text of their own, and elements that end a line.
NO_TEXT = {"script", "style", "head"}
BLOCKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.open, self.run = [], 0, [], []

    def _text(self) -> None:
        if s := "".join(self.run).strip():
            self.out.append(s + " ")
        self.run = []

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.run.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._text()
        if tag in BLOCKS - {"br"}:  # a block that begins ends an open paragraph; an item or row ends its like
            self._close("p" if tag not in ("li", "tr") else tag)
        if tag == "body":
            self._close("head")
        if tag in VOID:
            if tag in BLOCKS and not self.skip:
                self.out.append("\n")
            return
        self.open.append(tag)
        self.skip += tag in NO_TEXT

    def handle_endtag(self, tag: str) -> None:
        self._text()
        self._close(tag)

    def _close(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.skip -= last in NO_TEXT
            if last in BLOCKS and not self.skip:
                self.out.append("\n")
            if last == tag:
                return

    def finish(self) -> str:
        self.close()
        self._text()
        while self.open:
            self._close(self.open[-1])
        return "".join(self.out).strip()


def html_text(page: str | None) -> str | None:
    """The visible text: each stretch trimmed and followed by a blank, a line end after blocks."""
    if page is None:
        return None
    parser = _Html()
    parser.feed(page)
    return parser.finish()


def docx_text(data: bytes) -> str | None:
    """Text runs of word/document.xml, a line end after each paragraph; null if there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml")
    except (KeyError, zipfile.BadZipFile):
        return None
    out: list[str] = []
    for event, e in ElementTree.iterparse(io.BytesIO(xml), events=("start", "end")):
        name = e.tag.rpartition("}")[2]
        if event == "end" and name == "t":
            out.append("".join(e.itertext()))
        elif event == "end" and name == "p":
            out.append("\n")
    return "".join(out).strip()


def pdf_text(data: bytes) -> str | None:
    """Literals between BT and ET of an uncompressed PDF; null for anything else.  A backslash shields the
    next byte from ending the literal and stays; only printable ASCII is kept."""
    if data[:5] != b"%PDF-":
        return None
    out, inside, i, n = [], False, 0, len(data)
    while i < n:
        if data[i : i + 2] in (b"BT", b"ET"):
            inside = data[i : i + 2] == b"BT"
            out += [] if inside else ["\n"]
            i += 2
        elif inside and data[i] == 40:
            j = i + 1
            while j < n and data[j] != 41:
                j += 2 if data[j] == 92 else 1
            if j < n:
                out.append("".join(chr(c) for c in data[i + 1 : j] if 32 <= c < 127) + " ")
            i = j + 1
        else:
            i += 1
    return "".join(out).strip()


def text_of(path: str, data: bytes) -> str | None:
    """The text of a file by its extension; null for other kinds and for files that can't be read."""
    ext = "." + path.lower().rpartition(".")[2]
    if ext in (".html", ".htm"):
        return html_text(data.decode("utf-8", "replace"))
    if ext == ".docx":
        return docx_text(data)
    if ext == ".pdf":
        return pdf_text(data)
    return data.decode("utf-8", "replace") if ext in (".txt", ".md", ".go", ".py", ".js", ".ts") else None


@F.pandas_udf(StringType())
def html_udf(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


@F.pandas_udf(StringType())
def file_udf(paths: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([text_of(p, bytes(d)) for p, d in zip(paths, data)], dtype=object)


def with_text(files: DataFrame) -> DataFrame:
    """files (path, content) with `text`."""
    return files.withColumn("text", file_udf("path", "content"))
