"""E-book archives as a Spark source: chapters in reading order, then the web blocks.

One row an archive comes from ``binaryFile``; a small reader of the package file
lists its chapters; everything after is relational.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The encryption methods that only obfuscate fonts.
FONT_METHODS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
SCHEMA = "path string, title string, author string, lang string, spine int, href string, html string, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _chapters(path: str, content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "META-INF/rights.xml" in names:
            raise ValueError("protected")
        if "META-INF/encryption.xml" in names:
            for e in ElementTree.fromstring(z.read("META-INF/encryption.xml")).iter():
                if _local(e.tag) == "EncryptionMethod" and e.get("Algorithm") not in FONT_METHODS:
                    raise ValueError("protected")
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if _local(e.tag) == "rootfile")
        root = ElementTree.fromstring(z.read(opf))
        meta = {_local(e.tag): (e.text or "").strip() for e in reversed(list(root.iter())) if _local(e.tag) in ("title", "creator", "language")}
        items = {e.get("id"): e for e in root.iter() if _local(e.tag) == "item"}
        refs = [items[e.get("idref")] for e in root.iter() if _local(e.tag) == "itemref" and e.get("idref") in items]
        refs = [e for e in refs if "html" in (e.get("media-type") or "") or "xml" in (e.get("media-type") or "")]
        for k, e in enumerate(refs):
            href = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(e.get("href") or "")))
            if href in names:
                yield path, meta.get("title"), meta.get("creator"), meta.get("language"), k, href, z.read(href).decode("utf-8", "replace"), None


def _read(batches):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows += list(_chapters(path, content))
            except Exception as e:  # noqa: BLE001  a broken archive is a row that says so, not a failed job
                rows.append((path, None, None, None, None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=columns)


def chapters(files: DataFrame) -> DataFrame:
    """A row for each chapter of each archive, or one with ``error``."""
    return files.select("path", "content").mapInPandas(_read, SCHEMA)


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    return chapters(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(folder))


def sniff(files: DataFrame) -> DataFrame:
    """Adds ``kind`` by extension, whatever its case."""
    low = F.lower("path")
    return files.withColumn("kind", F.when(low.endswith(".epub"), "epub").when(low.endswith(".pdf"), "pdf").otherwise("other"))
