"""A library's stored content in versions.

The table is a log of epochs: a folder for each, and in it what the epoch put
and which books it removed.  Writing an epoch replaces that folder and no other,
so a job that runs twice changes nothing, and readers of older epochs aren't
disturbed.  A book is what the last epoch that names it says: all its rows of
that epoch, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators.places import last_upto


def _write(rows: DataFrame, path: str, epoch: int, gone: bool) -> None:
    out = rows.withColumn("epoch", F.lit(epoch).cast("long")).withColumn("gone", F.lit(gone))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "gone").parquet(path)


def put(rows: DataFrame, path: str, epoch: int) -> None:
    """Store whole books (``rows`` have ``book``) as of ``epoch``; each replaces what is there of it."""
    _write(rows, path, epoch, False)


def remove(books: DataFrame, path: str, epoch: int) -> None:
    """Remove the books as of ``epoch``; a book that the same epoch puts is removed, too."""
    _write(books.select("book").distinct(), path, epoch, True)


def current(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """The library's rows with the ``epoch`` they are from, as of the last epoch or of ``upto``; ``schema`` is that of the rows put."""
    log = spark.read.schema(f"{schema}, epoch long, gone boolean").parquet(path)
    if upto is not None:
        log = log.where(F.col("epoch") <= upto)
    last = log.groupBy("book").agg(F.max(F.struct("epoch", "gone")).alias("l")).where("NOT l.gone").select("book", F.col("l.epoch").alias("epoch"))
    return log.join(last, ["book", "epoch"], "left_semi").drop("gone")


def char_index(rows: DataFrame) -> DataFrame:
    """book, block, chars_before and total; each block counts its length and one."""
    per, step = Window.partitionBy("book").orderBy("block"), F.length("text") + 1
    return rows.select("book", "block", (F.sum(step).over(per) - step).alias("chars_before"), F.sum(step).over(Window.partitionBy("book")).alias("total"))


def places_kept(old: DataFrame, new: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (book, block, and more) in rebuilt content: the block with the same share of all characters before it.

    ``old`` and ``new`` are the books' ``char_index``.  Who had read to the end begins anew.
    """
    share = places.join(old, ["book", "block"]).withColumn("share", F.col("chars_before") / F.col("total")).drop("block", "chars_before", "total")
    asked = share.join(new.select("book", "total").distinct(), "book").withColumn("want", F.col("share") * F.col("total"))
    hit = last_upto(new.select("book", "chars_before", F.col("block").alias("to")), asked, ["book"], "chars_before", "want")
    kept = F.when(F.col("want") >= F.col("total"), 0).otherwise(F.coalesce("found.to", F.lit(0)))
    return hit.withColumn("block", kept).drop("share", "total", "want", "found")
