"""Places in a book: sentences, chapters and sections around them, where to open and where speech goes on.

Each is a walk along one document's ordered entries, so entries and places are
put in one order and read off a window: no pair of the two is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _merged(entries: DataFrame, places: DataFrame, keys: list[str], at: Column, place: Column) -> DataFrame:
    """Entries and places in one table; of equal places entries come first, the later one last."""
    left = entries.select(*keys, at.alias("_at"), F.lit(0).alias("_k"), F.struct(*[c for c in entries.columns if c not in keys]).alias("_e"))
    right = places.select(*keys, place.alias("_at"), F.lit(1).alias("_k"), F.struct(*[c for c in places.columns if c not in keys]).alias("_p"))
    return left.unionByName(right, allowMissingColumns=True)


def last_upto(entries: DataFrame, places: DataFrame, keys: list[str], at: str, place: str) -> DataFrame:
    """``places`` with ``found``, the last entry at or before each."""
    rows = _merged(entries, places, keys, F.col(at), F.col(place))
    upto = Window.partitionBy(*keys).orderBy("_at", "_k", "_e").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("_e", ignorenulls=True).over(upto)).where("_k = 1").select(*keys, "_p.*", "found")


def first_after(entries: DataFrame, places: DataFrame, keys: list[str], at: Column, place: Column) -> DataFrame:
    """``places`` with ``found``, the first entry behind each."""
    rows = _merged(entries, places, keys, at, place)
    # Backwards, so that each row adds to what the row behind it has seen.
    rest = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_k"), F.desc("_e")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("found", F.last("_e", ignorenulls=True).over(rest)).where("_k = 1").select(*keys, "_p.*", "found")


def sentence_at(spans: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, place, sentence_no, start, end: the sentence that holds each place, if one does."""
    hit = last_upto(spans.select("doc_id", "sentence_no", "start", "end"), places, ["doc_id"], "start", "place")
    return hit.where(F.col("place") < F.col("found.end")).select("doc_id", "place", "found.*")


def speech_from(spans: DataFrame, places: DataFrame) -> DataFrame:
    """What is read aloud first from a place on: doc_id, block, offset, said (its block), start, end.

    ``spans`` are sentences by doc_id and block; a place inside a sentence begins
    there, and past the last sentence of a block speech goes on in the next.
    """
    where = lambda block, char: F.struct(F.col(block).alias("block"), F.col(char).cast("long").alias("char"))
    entries = spans.select("doc_id", "start", "end", F.col("block").alias("said"))
    hit = first_after(entries, places, ["doc_id"], where("said", "end"), where("block", "offset")).where("found IS NOT NULL")
    inside = (F.col("found.said") == F.col("block")) & (F.col("offset") > F.col("found.start"))
    return hit.select("doc_id", "block", "offset", "found.said", F.when(inside, F.col("offset")).otherwise(F.col("found.start")).alias("start"), "found.end")


#: Entries of a table of contents lie on the levels 0 to 2.
LEVELS = 3


def chapter_at(entries: DataFrame, sizes: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, block and the chapter there: title of the last entry at or before it, and where the chapter ends.

    ``entries`` (doc_id, toc_no, title, block, level) stand in the order of their
    blocks; ``sizes`` has doc_id and n blocks.  The next entry of the same or a
    shallower level ends a chapter.
    """
    rows = _merged(entries.select("doc_id", "toc_no", "title", "level", F.col("block").alias("at")), positions, ["doc_id"], F.col("at"), F.col("block"))
    order = Window.partitionBy("doc_id").orderBy("_at")
    rows = rows.withColumn("found", F.max("_e").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    rest = Window.partitionBy("doc_id").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)  # what lies behind, seen from the end
    ends = [F.min(F.when(F.col("_e.level") <= k, F.col("_e.at"))).over(rest) for k in range(LEVELS)]
    rows = rows.withColumn("next", F.array(*ends)).where("_k = 1").select("doc_id", "_p.block", "found", "next").join(sizes, "doc_id")
    end = F.coalesce(F.get("next", F.coalesce(F.col("found.level"), F.lit(LEVELS - 1))), F.col("n")).cast("int")
    return rows.select("doc_id", "block", F.coalesce("found.title", F.lit("")).alias("title"), end.alias("end"))


def section_at(sections: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, block and its section: title, start, end."""
    return last_upto(sections, positions, ["doc_id"], "start", "block").select("doc_id", "block", "found.*")


def toc_once(entries: DataFrame) -> DataFrame:
    """The first of the entries that agree in block and title."""
    per = Window.partitionBy("doc_id", "block", "title").orderBy("toc_no")
    return entries.withColumn("_k", F.row_number().over(per)).where("_k = 1").drop("_k")


def open_position(marker: Column, position: Column, n: Column) -> Column:
    """The block to open a book at: its marker, if it lies in the book, else the saved position, within the book."""
    return F.least(F.coalesce(F.when(marker < n, marker), position), F.greatest(n - 1, F.lit(0)))
