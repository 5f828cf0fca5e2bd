"""Accent-insensitive search with exact offsets, snippets, sentences and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T


def offsets(text: Column, literal: Column) -> Column:
    """The places (from 0) of all non-overlapping occurrences of a literal."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), literal, F.lit(r"\E")), -1)
    state = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p) + F.length(literal)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")
        ),
    )
    return state["out"]


def search(texts: DataFrame, queries: list[str], limit: int = 300) -> DataFrame:
    """doc_id, block, query, start, end: the first ``limit`` hits of each query in a document.

    ``texts`` has doc_id, block, text.  The limit is the feature: a reader's hit list.
    """
    asked = [q.strip() for q in queries]
    rows = texts.select("doc_id", "block", "text", T.fold(F.col("text")).alias("folded")).select("*", F.explode(F.array(*map(F.lit, asked))).alias("query"))
    q = T.fold(F.col("query"))
    hits = rows.where((F.length(q) >= 2) & F.contains("folded", q))
    hits = hits.select("doc_id", "block", "query", F.length("text").alias("n"), F.explode(offsets(F.col("folded"), q)).alias("at"))
    hits = hits.select("doc_id", "block", "query", F.least("at", "n").alias("start"), F.least(F.col("at") + F.length("query"), F.col("n")).alias("end"))
    first = Window.partitionBy("doc_id", "query").orderBy("block", "start")
    return hits.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= limit).drop("_k")


def snippet(text: Column, start: Column, end: Column) -> Column:
    """40 characters before a hit and 60 behind it, with ellipses where text is cut."""
    lo, hi = F.greatest(start - 40, F.lit(0)), end + 60
    cut = F.substr(text, lo + 1, hi - lo)
    return F.concat(F.when(lo > 0, "…").otherwise(""), cut, F.when(hi < F.length(text), "…").otherwise(""))


_CLOSERS = r"[\"'”’»)\]]"
_OPENER = r"^[\p{Lu}\p{N}\"'“‘«(\\\[]"


def sentences(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, sentence_no, start, end, text: sentences of each text with their places; in ``text`` white space is collapsed.

    Only a word's end can end a sentence.  A word does if it has a run of
    terminators and closers behind it and the next word begins a sentence,
    unless the run begins with a dot behind an abbreviation or initials.
    """
    pieces = F.arrays_zip(F.split("text", T.WS + "+").alias("w"), F.regexp_extract_all("text", F.lit(f"({T.WS}+)"), F.lit(1)).alias("gap"))
    words = texts.select(*keys, F.posexplode(pieces).alias("i", "p")).select(*keys, "i", "p.w", "p.gap")
    per = Window.partitionBy(*keys).orderBy("i")
    step = F.length("w") + F.coalesce(F.length("gap"), F.lit(0))
    # White space at the ends has an empty word beside it.
    words = words.withColumn("start", F.sum(step).over(per.rowsBetween(Window.unboundedPreceding, 0)) - step).where("w <> ''")
    stop = F.regexp_extract("w", rf"([.!?…]+){_CLOSERS}*$", 1)
    before = F.regexp_extract("w", rf"([\p{{L}}.]*?)[.!?…]+{_CLOSERS}*$", 1)
    plain = F.lower(F.replace(before, F.lit("."), F.lit("")))
    short = plain.isin(T.ABBREVIATIONS) | plain.rlike(r"^\p{L}$") | before.rlike(r"^(\p{L}\.)+\p{L}$")
    ends = (stop != "") & F.lead("w").over(per).rlike(_OPENER) & ~(stop.startswith(".") & short)
    words = words.withColumn("ends", F.coalesce(ends, F.lit(False)).cast("int"))
    no = F.coalesce(F.sum("ends").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = words.withColumn("sentence_no", no)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]), " ")
    return words.groupBy(*keys, "sentence_no").agg(F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.length("w")).cast("long").alias("end"), text.alias("text"))


def word_at(text: Column, offset: Column) -> Column:
    """The word around a place: letters, digits, apostrophes and hyphens, the last two not at its edges."""
    word = r"[\p{L}\p{N}'’-]"
    at = F.greatest(F.lit(0), F.least(offset, F.length(text)))
    inside = F.substr(text, at + 1, F.lit(1)).rlike(word)
    at = F.when(~inside & F.substr(text, at, F.lit(1)).rlike(word) & (at > 0), at - 1).otherwise(at)
    # Read backwards: "$" would match before a line's end, too, and is tried behind every word.
    left = F.reverse(F.regexp_extract(F.reverse(F.substr(text, F.lit(1), at)), rf"^({word}*)", 1))
    right = F.regexp_extract(F.substr(text, at + 1, F.length(text)), rf"^({word}*)", 1)
    found = F.regexp_replace(F.concat(left, right), r"^['’-]+|['’-]+$", "")
    return F.when((right != "") & (found != ""), found)
