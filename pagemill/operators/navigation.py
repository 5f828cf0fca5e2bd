"""Tables of contents from outlines and navigation files, and the sections of spine files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T
from pagemill.operators.layout import PER_SECTION


def outline_walk(items: DataFrame, deepest: int = 2) -> DataFrame:
    """doc_id, ord, title, page, level: a document's outline in the order it is read, down to level ``deepest``.

    ``items`` has doc_id, item, parent (null at the top), place (among
    siblings), title and page.  Items without a title are left out, what hangs on
    them isn't.  A page that is null is -1.  A level is a join: what no chain of
    parents ties to the top, loops too, is never reached.
    """
    rows = items.select("doc_id", "item", "parent", F.struct("place", "item").alias("_step"), T.trim(F.col("title")).alias("title"), F.coalesce("page", F.lit(-1)).alias("page"))
    reached = rows.where("parent IS NULL").select("doc_id", "item", "title", "page", F.lit(0).alias("level"), F.array("_step").alias("path"))
    every = reached
    for level in range(1, deepest + 1):
        above = reached.select("doc_id", F.col("item").alias("parent"), "path")
        reached = rows.join(above, ["doc_id", "parent"]).select("doc_id", "item", "title", "page", F.lit(level).alias("level"), F.concat("path", F.array("_step")).alias("path"))
        every = every.unionByName(reached)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return every.where("title <> ''").select("doc_id", order.alias("ord"), "title", "page", "level")


def anchors(blocks: DataFrame) -> DataFrame:
    """book, target, block: where a link leads; the last block of an id, and of a file the first.

    ``blocks`` has book, block, path (its file) and ids.
    """
    ids = blocks.select("book", "block", F.explode("ids").alias("id"), "path").groupBy("book", F.concat_ws("#", "path", "id").alias("target")).agg(F.max("block").alias("block"))
    files = blocks.groupBy("book", F.col("path").alias("target")).agg(F.min("block").alias("block"))
    return ids.unionByName(files)


def toc_of_links(links: DataFrame, to: DataFrame, deepest: int = 2) -> DataFrame:
    """book, toc_no, title, block, level: links (book, ord, label, href, level) that lead somewhere, by ``anchors``.

    A link leads to its fragment's block, else to its file's; links without a label say nothing.
    """
    label = T.trim(F.regexp_replace("label", T.WS + "+", " "))
    rows = links.select("book", "ord", label.alias("title"), "href", F.split("href", "#")[0].alias("file"), F.least("level", F.lit(deepest)).alias("level")).where("title <> ''")
    exact, file = to.select("book", F.col("target").alias("href"), F.col("block").alias("_exact")), to.select("book", F.col("target").alias("file"), F.col("block").alias("_file"))
    rows = rows.join(exact, ["book", "href"], "left").join(file, ["book", "file"], "left").withColumn("block", F.coalesce("_exact", "_file")).where("block IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("book").orderBy("ord")) - 1
    return rows.select("book", number.alias("toc_no"), "title", "block", "level")


def spine_sections(blocks: DataFrame, toc: DataFrame, per_section: int = PER_SECTION) -> DataFrame:
    """book, title, start, end: a section for each spine file, in pieces of ``per_section`` blocks.

    It bears the title of the entry that comes last in ``toc`` (book, toc_no,
    title, block) of those that lead to its start or before; else its first
    heading's, else 'Start'.  ``blocks`` has book, block, path, t and text.
    """
    files = blocks.groupBy("book", "path").agg(F.min("block").alias("block"), F.min_by("text", F.when(F.col("t") == "h", F.col("block"))).alias("head"))
    n = blocks.groupBy("book").agg((F.max("block") + 1).alias("n"))
    entries = toc.select("book", "block", F.lit(0).alias("_k"), F.struct("toc_no", "title").alias("_e"))
    starts = files.select("book", "block", F.lit(1).alias("_k"), "head")
    upto = Window.partitionBy("book").orderBy("block", "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.unionByName(starts, allowMissingColumns=True).withColumn("last", F.max("_e").over(upto)).where("_k = 1").join(n, "book")
    stop = F.coalesce(F.lead("block").over(Window.partitionBy("book").orderBy("block")), F.col("n"))
    rows = rows.withColumn("stop", stop).select("book", F.coalesce("last.title", "head", F.lit("Start")).alias("title"), "stop", F.explode(F.sequence(F.col("block"), F.col("stop") - 1, F.lit(per_section))).alias("start"))
    return rows.select("book", "title", "start", F.least(F.col("start") + per_section, F.col("stop")).alias("end"))
