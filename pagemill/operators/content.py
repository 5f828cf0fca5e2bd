"""A library's stored content: titles, upserts and deletes, notes that belong together, places in a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T


def title_of(meta: Column, file_name: Column) -> Column:
    """The metadata title unless it is a placeholder or a file name, else the cleaned file name, else 'Untitled'."""
    good = F.nullif(T.trim(F.coalesce(meta, F.lit(""))), F.lit(""))
    good = F.when(~good.rlike(r"(?i)^(untitled|unknown|microsoft word|document\d*)|\.(pdf|docx?|indd|tex|epub)$"), good)
    name = T.trim(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.(pdf|epub)$", ""), "[_-]+", " "))
    return F.coalesce(good, F.nullif(name, F.lit("")), F.lit("Untitled"))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each row by ``keys``; both sides have the same columns."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return stored.unionByName(changes).withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")


def delete_books(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without those of the deleted books, by the whole book id: a shared prefix doesn't count."""
    return rows.join(gone.select("book_id"), "book_id", "left_anti")


def footnote_of(blocks: DataFrame, notes: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, note, block: a note's block and up to ``most`` footnote blocks behind it that have no id.

    ``blocks`` has doc_id, block, cls and ids; ``notes`` has doc_id and note (its first block).
    """
    near = notes.join(blocks, "doc_id").where((F.col("block") >= F.col("note")) & (F.col("block") <= F.col("note") + most))
    stop = (F.col("block") > F.col("note")) & (~F.coalesce(F.col("cls").contains("footnote"), F.lit(False)) | (F.coalesce(F.size("ids"), F.lit(0)) > 0))
    upto = F.max(stop.cast("int")).over(Window.partitionBy("doc_id", "note").orderBy("block"))
    return near.withColumn("_s", upto).where("_s = 0").select("doc_id", "note", "block")


def shown(chars_before: Column, section_start: Column, section_end: Column, page: Column, pages: Column) -> Column:
    """Characters before what is on screen: before its block, or, in a section of several pages, before its page."""
    return F.when(pages > 1, section_start + (section_end - section_start) * page / pages).otherwise(chars_before.cast("double"))


def minutes_left(chars_before: Column, chapter_end: Column, per_minute: int = 1500) -> Column:
    return F.greatest(F.lit(0.0), (chapter_end - chars_before) / per_minute)


def progress(chars_before: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), chars_before / T.or_default(total, 1))


def reposition(index: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, block: the place in rebuilt content that keeps each reader's share of all characters.

    ``index`` has doc_id, block, chars_before, total; ``old`` has doc_id and progress.
    """
    hit = index.join(old, "doc_id").where(F.col("chars_before") <= F.col("progress") * F.col("total"))
    return hit.groupBy("doc_id").agg(F.max("block").alias("block"))


def mend_hyphens(lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lines with words that a hyphen split over two of them put together at the end of the first.

    ``lines`` has doc_id, line_no and text.  The join must be a listed word.  A
    line of one word that moves up whole is left empty.
    """
    per = Window.partitionBy("doc_id").orderBy("line_no")
    head, tail = F.regexp_extract("text", r"(\p{L}+)[-–—]$", 1), F.regexp_extract("next", r"^(\p{Ll}+)", 1)
    rows = lines.withColumn("next", F.lead("text").over(per)).withColumn("word", F.lower(F.concat(head, F.coalesce(tail, F.lit("")))))
    rows = rows.withColumn("split", (head != "") & (F.coalesce(tail, F.lit("")) != ""))
    rows = rows.join(F.broadcast(ranks.select("word").withColumn("listed", F.lit(True))), "word", "left")
    rows = rows.withColumn("up", F.coalesce(F.col("split") & F.col("listed"), F.lit(False))).withColumn("taken", F.coalesce(F.lag("up").over(per), F.lit(False)))
    body = F.when(F.col("taken"), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
    moved = F.concat(F.regexp_replace(body, "[-–—]$", ""), F.regexp_extract("next", r"^(\S+)", 1))
    return rows.select("doc_id", "line_no", F.when(F.col("up"), moved).otherwise(body).alias("text"))


def render_scale(width: Column, height: Column, full: bool = True) -> Column:
    """About 300 dots an inch, within 8.5 (or 5) million pixels, never under 1."""
    most = 8.5e6 if full else 5.0e6
    return F.greatest(F.lit(1.0), F.least(F.lit(300 / 72), F.sqrt(F.lit(most) / (width * height))))
