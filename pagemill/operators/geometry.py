"""Positioned fragments and transcriptions to lines; outlines to blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T
from pagemill.operators.places import first_after


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The bounds of each list among the values of all, and these; a null list is empty."""
    sizes = np.zeros(len(lists) + 1, np.int64)
    sizes[1:] = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return sizes.cumsum(), lists.flatten()


def _lists(bounds: np.ndarray, values: pa.Array, missing: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=missing if missing is not None and missing.true_count else None)


def _cut_at_baselines(pages: pa.Array) -> pa.Array:
    """Pages of fragments, by their base, cut into lines: a walk that keeps a line's first baseline and largest size."""
    bounds, fs = _flat(pages)
    bases, sizes = (fs.field(fs.type.get_field_index(n)).to_pylist() for n in ("base", "size"))
    starts, lines = [], [0]
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        base = None
        for i in range(at, end):
            if base is None or abs(bases[i] - base) >= 0.45 * max(size, sizes[i]):
                starts.append(i)
                base, size = bases[i], sizes[i]
            elif sizes[i] > size:
                size = sizes[i]
        lines.append(len(starts))
    return _lists(np.array(lines), _lists(np.array([*starts, len(fs)]), fs))


def sums_before(values: Column) -> Column:
    """An array of arrays of whole numbers: the running sums of each, every one without its own value."""

    def run(lists: pa.Array) -> pa.Array:
        outer, inner = _flat(lists)
        bounds, v = _flat(inner)
        v = v.to_numpy(zero_copy_only=False).astype(np.int64)
        before = v.cumsum() - v
        sizes = np.diff(bounds)
        first = np.repeat(before[bounds[:-1][sizes > 0]], sizes[sizes > 0])
        return _lists(outer, _lists(bounds, pa.array(before - first)), lists.is_null())

    return F.arrow_udf(run, "array<array<bigint>>")(values)


def assemble_lines(fragments: DataFrame) -> DataFrame:
    """book, page, line_no, text, x, y, w, size from positioned fragments.

    ``fragments`` has book, page, seq, str, transform (six numbers), width and
    page_height; they are gathered by page, see ``assemble_pages``.
    """
    each = F.struct("seq", "str", "transform", "width", "page_height")
    return assemble_pages(fragments.groupBy("book", "page").agg(F.collect_list(each).alias("fragments")))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """book, page, line_no, text, x, y, w, size from pages (book, page) with an array of fragments each, as ``assemble_lines`` has them.

    A fragment joins the line whose *first* baseline is within 0.45 of the
    larger size, so drifting baselines don't chain; the fold over a page's
    fragments keeps that first baseline.  All within a row, so nothing is shuffled.
    """

    def placed(f: Column) -> Column:
        t = f["transform"]
        size = T.or_default(F.hypot(t[2], t[3]), T.or_default(F.hypot(t[0], t[1]), 10.0))
        return F.struct((f["page_height"] - t[5]).alias("base"), t[4].alias("x"), f["seq"].alias("seq"), size.alias("size"), f["str"].alias("s"), f["width"].alias("width"))

    some = F.filter("fragments", lambda f: T.trim(f["str"]) != "")
    per = pages.select("book", "page", F.sort_array(F.transform(some, placed)).alias("fs"))
    one = per.schema["fs"].dataType.simpleString()
    lines = F.arrow_udf(_cut_at_baselines, f"array<{one}>")("fs")
    flat = per.select("book", "page", F.posexplode(lines).alias("line_no", "fs"))
    along = F.transform("fs", lambda f: F.struct(f["x"].alias("x"), f["seq"].alias("seq"), f["width"].alias("width"), f["base"].alias("base"), f["size"].alias("size"), f["s"].alias("s")))
    flat = flat.select("book", "page", "line_no", F.sort_array(along).alias("fs"))

    def piece(f: Column, i: Column) -> Column:
        last = F.get("fs", i - 1)
        apart = (f["x"] - (last["x"] + last["width"]) > 0.12 * f["size"]) & ~last["s"].rlike(r"\s$") & ~f["s"].rlike(r"^\s")
        return F.concat(F.when(apart, " ").otherwise(""), f["s"])

    total = lambda of: F.aggregate("fs", F.lit(0.0), lambda a, f: a + of(f))
    weight = lambda f: F.greatest(F.length(f["s"]), F.lit(1))
    out = flat.select(
        "book", "page", "line_no", F.array_join(F.transform("fs", piece), "").alias("text"), F.get("fs", F.lit(0))["x"].alias("x"), F.array_max(F.transform("fs", lambda f: f["x"] + f["width"])).alias("end"),
        (total(lambda f: f["base"]) / F.size("fs")).alias("base"), (total(lambda f: f["size"] * weight(f)) / total(weight)).alias("size"),
    )
    text = T.trim(F.regexp_replace("text", T.SPACE + "+", " "))
    return out.select("book", "page", "line_no", text.alias("text"), "x", (F.col("base") - 0.8 * F.col("size")).alias("y"), (F.col("end") - F.col("x")).alias("w"), "size")


def page_state(text: Column, least: int = 40) -> Column:
    """'text', or 'pending' for a page with under ``least`` characters beside white space: its lines don't count."""
    return F.when(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), T.WS, "")) < least, "pending").otherwise("text")


def json_in(answer: Column) -> Column:
    """The JSON in a model's answer: what a fence holds, else from the first brace to the last, else all of it."""
    fenced = F.regexp_extract(answer, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(answer.rlike(r"(?is)```(?:json)?.*?```"), fenced).when(braced != "", braced).otherwise(answer)


def transcribed_lines(pages: DataFrame, page_width: float = 600.0) -> DataFrame:
    """book, page, line_no, text, x, y, w, size, kind from transcription JSON (blocks of type and text)."""
    parsed = F.from_json("json", "struct<blocks:array<struct<type:string,text:string>>>")["blocks"]
    rows = pages.select("book", "page", F.posexplode(parsed).alias("line_no", "b"))
    text = F.trim(F.regexp_replace(F.coalesce("b.text", F.lit("")), "[ \t]+", " "))
    rows = rows.select("book", "page", "line_no", F.col("b.type").alias("type"), text.alias("t")).where("type = 'scene_break' OR t <> ''")
    size = F.when(F.col("type") == "heading", 16.0).otherwise(11.0)
    step = F.when(F.col("type") == "scene_break", 30.0).when(F.col("type") == "heading", 32.0).otherwise(11.0 * F.greatest(F.lit(2), F.ceil(F.length("t") / 70)))
    before = F.coalesce(F.sum(step).over(Window.partitionBy("book", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select(
        "book", "page", "line_no", F.when(F.col("type") == "scene_break", "* * *").otherwise(F.col("t")).alias("text"), F.lit(54.0).alias("x"), (40.0 + before).alias("y"),
        F.lit(max(100.0, page_width - 108.0)).alias("w"), size.alias("size"), F.when(F.col("type") == "scene_break", "hr").when(F.col("type") == "heading", "h").otherwise("p").alias("kind"),
    )


def outline_toc(blocks: DataFrame, outline: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, ord, title, block, level: outline entries at the first block from their page, or that page's first heading.

    An outline of fewer than ``least`` entries with a page says nothing.

    ``blocks`` has doc_id, block, t, page; ``outline`` has doc_id, ord, title, page, level.
    """
    asked = outline.where("page >= 1").select("doc_id", "ord", "title", "level", F.col("page").alias("want"))
    asked = asked.withColumn("usable", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("usable") >= least).drop("usable")
    pages = blocks.groupBy("doc_id", "page").agg(F.min("block").alias("first"), F.min(F.when(F.col("t") == "h", F.col("block"))).alias("head"))
    hit = first_after(pages, asked, ["doc_id"], F.col("page"), F.col("want") - 1).where("found IS NOT NULL")
    return hit.select("doc_id", "ord", "title", F.coalesce("found.head", "found.first").alias("block"), "level")
