"""Lines, repeated lines, paragraphs, headings, sections and positions.

A document is a page of its source and, for what is ordered, a book of its own:
aggregates run over sources, windows over one document at a time, so no window
grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T

PER_SECTION = 300
CHARS_PER_PAGE = 1500
#: Geometry of a text line that has none: left margin, line pitch, width of a character, type size.
LEFT, PITCH, ADVANCE, SIZE = 50.0, 15.0, 6.0, 11.0


def lines(docs: DataFrame) -> DataFrame:
    """source, doc_id, line_no, text, x, y, w, size of every line that isn't blank."""
    out = docs.select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    lead = F.length(F.regexp_extract("raw", r"^( *)", 1))
    text = T.trim(F.col("raw"))
    return out.select(
        "source", "doc_id", "line_no", text.alias("text"), (LEFT + ADVANCE * lead).alias("x"), (PITCH * F.col("line_no")).alias("y"),
        (ADVANCE * F.length(text)).alias("w"), F.lit(SIZE).alias("size"),
    ).where("text <> ''")


def edge_lines(of: DataFrame, edge: int = 2) -> DataFrame:
    """The first and last ``edge`` lines of each page, with their key."""
    up, down = Window.partitionBy("doc_id").orderBy("line_no"), Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    out = of.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down))
    return out.where((F.col("_a") <= edge) | (F.col("_b") <= edge)).drop("_a", "_b").withColumn("key", T.running_key(F.col("text")))


def running_keys(of: DataFrame) -> DataFrame:
    """Per source and key the pages whose edge lines have it, and whether it counts as running."""
    keys = edge_lines(of).where(F.length("key") >= 2).select("source", "key", "doc_id").distinct()
    counts = keys.groupBy("source", "key").agg(F.count("*").alias("pages"))
    size = of.select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("of_pages"))
    least = F.greatest(F.lit(3), F.ceil(F.col("of_pages") * 0.15))
    return counts.join(size, "source").select("source", "key", "pages", (F.col("pages") >= least).alias("running"))


def drop_running(of: DataFrame) -> DataFrame:
    """The lines without page numbers and running lines at the edges of pages."""
    edges = edge_lines(of)
    running = running_keys(of).where("running").select("source", "key")
    numbers = edges.where(T.is_page_number(F.col("text"))).select("doc_id", "line_no")
    heads = edges.join(running, ["source", "key"], "left_semi").select("doc_id", "line_no")
    return of.join(numbers.union(heads).distinct(), ["doc_id", "line_no"], "left_anti")


def blocks(of: DataFrame) -> DataFrame:
    """Paragraphs, headings and breaks of each document: doc_id, source, block, t, text.

    Islands over the ordered lines: a line starts a block if its class changes,
    if a gap is above it, or if the line before it ended a sentence and was
    short or the line is indented.
    """
    per = Window.partitionBy("doc_id").orderBy("line_no")
    wide = of.groupBy("doc_id").agg(F.sort_array(F.collect_list("w")).alias("ws")).select("doc_id", T.at_rank(F.col("ws"), 0.8).alias("width"))
    text = F.col("text")
    kind = F.when(text.rlike(T.SCENE_BREAK) & text.rlike(T.ORNAMENT), "hr").when(
        (F.length(text) < 70) & text.rlike(T.CHAPTER) & T.could_be_heading(text), "h"
    ).otherwise("p")
    out = of.join(wide, "doc_id").withColumn("t", kind)
    before = {c: F.lag(c).over(per) for c in ("t", "text", "y", "w")}
    ended = before["text"].rlike(T.ENDS_SENTENCE)
    indented = (F.col("x") > LEFT + 0.8 * SIZE) & (F.col("x") - LEFT < 0.3 * F.col("width"))
    starts = (
        before["t"].isNull() | (before["t"] != F.col("t")) | (F.col("t") != "p")
        | (F.col("y") - before["y"] > 1.45 * PITCH) | (ended & (indented | (before["w"] < 0.8 * F.col("width"))))
    )
    out = out.withColumn("new", starts.cast("int")).withColumn("block", F.sum("new").over(per) - 1)
    within = Window.partitionBy("doc_id", "block").orderBy("line_no")
    out = out.withColumn("piece", T.join_pieces(F.col("text"), F.lead("text").over(within)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda s: s["piece"]), "")
    return out.groupBy("doc_id", "source", F.col("block").cast("int").alias("block"), "t").agg(joined.alias("text")).withColumn(
        "text", F.when(F.col("t") == "hr", "").otherwise(F.col("text"))
    )


def char_index(of_blocks: DataFrame) -> DataFrame:
    """Adds ``chars_before`` (each block counts its length and one) and ``total``."""
    per = Window.partitionBy("doc_id").orderBy("block")
    step = F.length("text") + 1
    upto = F.sum(step).over(per.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(step).over(Window.partitionBy("doc_id"))
    return of_blocks.withColumn("chars_before", upto - step).withColumn("total", total)


def toc(of_blocks: DataFrame) -> DataFrame:
    """Headings as entries: doc_id, toc_no, title, block, level."""
    per = Window.partitionBy("doc_id").orderBy("block")
    return of_blocks.where("t = 'h'").select("doc_id", (F.row_number().over(per) - 1).alias("toc_no"), F.col("text").alias("title"), "block", F.lit(0).alias("level"))


def sections(of_blocks: DataFrame, per_section: int = PER_SECTION) -> DataFrame:
    """doc_id, title, start, end: cut at headings, and into pieces of ``per_section`` blocks."""
    per = Window.partitionBy("doc_id").orderBy("block")
    n = of_blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    starts = of_blocks.where("t = 'h' OR block = 0").select("doc_id", "block", F.when(F.col("t") == "h", F.col("text")).otherwise("Start").alias("title"))
    spans = starts.join(n, "doc_id").withColumn("stop", F.coalesce(F.lead("block").over(per), F.col("n")))
    cut = spans.select("doc_id", "title", "stop", F.explode(F.sequence(F.col("block"), F.col("stop") - 1, F.lit(per_section))).alias("start"))
    return cut.select("doc_id", "title", "start", F.least(F.col("start") + per_section, F.col("stop")).alias("end"))


def sizes(of_blocks: DataFrame) -> DataFrame:
    """doc_id and the number n of its blocks."""
    return of_blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


def block_at_percent(of_index: DataFrame, percents: list[float]) -> DataFrame:
    """doc_id, percent, block: the last block that begins at or before the percentage of all characters."""
    asked = of_index.select("doc_id", "block", "chars_before", "total", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    want = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("percent"))) / 100 * F.col("total")
    return asked.where(F.col("chars_before") <= want).groupBy("doc_id", "percent").agg(F.max("block").alias("block"))
