"""Web chapters to typed blocks: one small parser state a row, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "array<struct<t:string,text:string,level:int,marker:string,src:string,ids:array<string>,cls:string>>"
_TYPE = pa.list_(
    pa.struct([("t", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("marker", pa.string()), ("src", pa.string()), ("ids", pa.list_(pa.string())), ("cls", pa.string())])
)
_HIDDEN = {"script", "style", "head", "template"}
_BREAKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "body", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "form"}
_VOID = {"img", "br", "hr", "meta", "link", "input", "image"}
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Blocks(HTMLParser):
    """Collects blocks; a tag that can't hold paragraphs ends the open one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.ids, self.hidden = [], [], [], 0
        self.kind, self.level, self.marker, self.cls = "p", 0, None, None
        self.lists, self.quotes, self.notes, self.cells, self.pre = [], 0, [], None, 0

    def flush(self) -> None:
        raw = "".join(self.text)
        text = raw.strip("\n") if self.pre else _SPACE.sub(" ", raw).strip(" ")
        self.text = []
        if not text.strip():
            return
        if self.cells is not None:
            self.cells.append(text)
            return
        kind = "li" if self.lists and self.kind == "p" else "quote" if self.quotes and self.kind == "p" else self.kind
        level = len(self.lists) - 1 if kind == "li" else self.level
        self.put(kind, text, level=level, marker=self.marker if kind == "li" else None, cls="footnote" if self.notes else self.cls)
        self.marker = None

    def put(self, t, text="", level=0, marker=None, src=None, cls=None) -> None:
        self.out.append({"t": t, "text": text, "level": level, "marker": marker, "src": src, "ids": self.ids, "cls": cls})
        self.ids = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        heading = re.fullmatch("h[1-6]", tag)
        if heading or tag in _BREAKS or tag in ("ul", "ol", "li", "blockquote", "pre", "tr", "td", "th", "hr"):
            self.flush()
        if a.get("id"):
            self.ids.append(a["id"])
        if heading:
            self.kind, self.level = "h", int(tag[1]) - 1
        elif tag == "hr":
            self.put("hr")
        elif tag in ("img", "image"):
            src = a.get("src") or a.get("href") or a.get("xlink:href")
            if src:
                self.flush()
                self.put("img", a.get("alt") or "", src=src)
        elif tag == "pre":
            self.kind, self.pre = "pre", self.pre + 1
        elif tag in ("ul", "ol"):
            start = a.get("start") or "1"
            self.lists.append(int(start) if tag == "ol" and start.lstrip("-").isdigit() else 1 if tag == "ol" else None)
        elif tag == "li" and self.lists:
            n = self.lists[-1]
            self.marker = "•" if n is None else f"{n}."
            if n is not None:
                self.lists[-1] = n + 1
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "tr":
            self.cells = []
        elif tag == "br":
            self.text.append("\n" if self.pre else " ")
        if re.search(r"footnote|endnote|rearnote", a.get("epub:type") or "") or tag == "aside":
            self.notes.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "p", 0
        elif tag == "pre":
            self.flush()
            self.kind, self.pre = "p", max(0, self.pre - 1)
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag == "tr":
            self.flush()
            cells, self.cells = self.cells or [], None
            if cells:
                self.put("p", " | ".join(cells), cls="table-row")
        elif tag in _BREAKS or tag in ("li", "td", "th", "blockquote"):
            self.flush()
            if tag == "blockquote":
                self.quotes = max(0, self.quotes - 1)
        if self.notes and self.notes[-1] == tag:
            self.notes.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def blocks_of(html: str | None) -> list[dict]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def _convert(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([blocks_of(h) for h in b.column("html").to_pylist()], _TYPE)], names=["key", "blocks"])


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, block and the block's fields, a row for each block."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(_convert, f"key {kind}, blocks {BLOCK_SCHEMA}")
    return rows.select(F.col("key").alias(key), F.posexplode("blocks").alias("block", "b")).select(key, "block", "b.*")


def anchors(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, id, block: the last block of each id, and of the page itself (id '') the first."""
    ids = blocks.select(key, "block", F.explode("ids").alias("id")).groupBy(key, "id").agg(F.max("block").alias("block"))
    return ids.union(blocks.groupBy(key).agg(F.min("block").alias("block")).select(key, F.lit("").alias("id"), "block"))
