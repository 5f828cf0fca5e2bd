"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Every text is reduced to a template: runs of digits become ``#``, a unit behind
a number ``~``, a name ``@``; the rest is lower-cased and stripped of
punctuation.  Names of the benchmark are the words that stand capitalised inside
a sentence anywhere in it; they are names wherever they stand and whatever their
case.  In a document, a capitalised word inside a sentence is a name, and so is
every word that no item has as a plain one, for only a name slot can match it.  Windows of ``width`` template words
are hashed on both sides and hash-joined.  A document and an item that share
windows are then compared slot by slot in each alignment.  Numbers may change
each by itself.  One name or unit of the item must always meet one of the
document's: the most frequent there, of equals the item's own, then the first;
windows where it meets another don't count.  An item is leaked where the other
windows cover ``min_cover`` of it: verbatim if all slot values are the item's
own, else re-parameterised.  Besides, ``run_words`` words in a row that are the
item's own leak it whatever their share (partial, if below ``min_cover``).

Placeholders alone are no evidence: a window with fewer than ``literals`` literal
words meets only windows with the same words, so that a row of figures is not
taken for a re-parameterised sum, and such a window is no hot key, either.

The texts are read and canonicalised once for windows of all lengths.  A window
is hashed only where its first words are those of some item's window, which a
table of bytes answers (two megabytes at most, a bit of chance lets others
through).  The benchmark's windows go to the tasks only if their number is at
most ``broadcast_windows`` and their words take at most ``broadcast_bytes``, its
plain words if they are at most ``broadcast_words`` of as many bytes; beyond that
both sides are shuffled by their hash or word.

Defined cases: a very long text is compared whole, in windows like any other, and a
window that both sides repeat meets as often as it stands on both; ties of slot
values are settled as said above; null and empty texts share nothing; items shorter than ``width``
are compared as one window of their length, items under ``min_words`` template
words can't be told from chance inside a text and match only documents that are
the same words as a whole; repeated rows of an id count
as one document; rows without an id are never reported by ``leaks`` and kept by
``drop_leaks``; extra columns are ignored or, in ``drop_leaks``, kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import SPACE, materialize, within

_UNITS = (
    "kilometers|kilometres|kilometer|kilometre|centimeters|centimetres|meters|metres|meter|metre|kilograms|kilogram|grams|gram|"
    "litres|liters|litre|liter|miles|mile|pounds|pound|inches|inch|feet|foot|yards|yard|hours|hour|minutes|minute|seconds|second|"
    "days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|percent|degrees|degree|km|cm|mm|kg|mg|lbs|lb|oz|ml|mph"
)


def template(text: Column) -> Column:
    """The text with typed placeholders; words stay apart and in place."""
    t = F.regexp_replace(text, r"[0-9]++(?:[.,:][0-9]++)*+", "#")
    t = F.regexp_replace(t, rf"(?i)(#[\x20-]?)(?:{_UNITS})(?![A-Za-z])", "$1~")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;#~][\x20])([\"“‘'(\[]?)\p{Lu}\p{Ll}++", "$1@")
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}#~@\x20\x09-\x0D]++", "")


def worded(df: DataFrame) -> DataFrame:
    """Adds ``raw`` and ``words``: the words of the text and, one for one, of its template.

    Words of punctuation alone are left out of both.
    """
    marks = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{M}0-9\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
    clean = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), marks, " "), F.lit(" \t\n\x0b\f\r"))
    df = df.withColumn("_clean", clean)
    raw, words = F.split("_clean", SPACE), F.split(template(F.col("_clean")), SPACE)
    return df.withColumn("raw", raw).withColumn("words", words).drop("_clean")


def _plain(word: Column) -> Column:
    """A word's letters, lower-cased and without a possessive's end: what names are known by."""
    return F.regexp_replace(F.lower(F.regexp_replace(word, r"['’]s(?![\p{L}\p{M}])", "")), r"[^\p{L}\p{M}]++", "")


def _named(benchmark: DataFrame) -> DataFrame:
    """The worded items, every word that is a name anywhere in the benchmark as ``@``."""
    items = materialize(worded(benchmark), "items")
    at = items.select(F.explode(F.arrays_zip("raw", "words")).alias("z")).select(_plain(F.col("z.raw")).alias("name"), "z.words")
    names = at.where(F.contains("words", F.lit("@")) & (F.col("name") != "")).select("name").distinct()
    at = items.select("item_id", "text", F.posexplode(F.arrays_zip("raw", "words")).alias("i", "z"))
    at = at.select("item_id", "text", "i", "z.raw", "z.words", _plain(F.col("z.raw")).alias("name")).join(names.withColumn("is", F.lit(True)), "name", "left")
    word = F.when(F.contains("words", F.lit("@")) | (F.col("is") & ~F.col("words").rlike("[#~]")), "@").otherwise(F.col("words"))
    rows = at.groupBy("item_id", "text").agg(F.array_sort(F.collect_list(F.struct("i", "raw", word.alias("words")))).alias("z"))
    return rows.select("item_id", "text", F.col("z.raw").alias("raw"), F.col("z.words").alias("words"))


def _code(word: Column, slot: Column) -> Column:
    """A number for a word; it is odd for a slot and even for a literal word."""
    return F.xxhash64(word).bitwiseAND(-2).bitwiseOR(slot.cast("long"))


def _bare(words: Column) -> Column:
    """Words as they are compared: lower-cased, without punctuation at their ends."""
    return F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")))


def _coded(texts: DataFrame, items: DataFrame, broadcast_words: int, broadcast_bytes: int) -> DataFrame:
    """``texts`` with ``codes``, a number for each word of the template: names and words that no item has are alike.

    The benchmark's plain words go to the tasks, in many small groups that a
    hash picks from, if they are at most ``broadcast_words`` words of
    ``broadcast_bytes`` bytes; beyond that the words of both sides are joined.
    """
    found = items.select(F.explode("iwords").alias("w")).distinct().where(~F.col("w").rlike("[#~@]"))
    n_words, n_bytes = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("w") + 1), F.lit(0))).first()
    typed = lambda w: w.rlike("[#~]") & ~F.contains(w, F.lit("@"))
    code = lambda w, known: F.when(known, _code(w, F.lit(False))).when(typed(w), _code(w, F.lit(True))).otherwise(_code(F.lit("@"), F.lit(True)))
    if n_words <= broadcast_words and n_bytes <= broadcast_bytes:
        n = max(1, n_words)
        rows = found.groupBy(F.pmod(F.xxhash64("w"), F.lit(n)).alias("k")).agg(F.concat_ws(" ", F.array_sort(F.collect_list("w"))).alias("v")).collect()
        by = {r["k"]: f" {r['v']} " for r in rows}
        groups = F.split(F.lit("\n".join(by.get(k, "") for k in range(n))), "\n")
        known = lambda w: F.contains(F.get(groups, F.pmod(F.xxhash64(w), F.lit(n)).cast("int")), F.concat(F.lit(" "), w, F.lit(" ")))
        return texts.withColumn("codes", F.transform("words", lambda w: code(w, known(w))))
    at = texts.select("doc_id", F.xxhash64("raw").alias("text"), F.posexplode(F.arrays_zip("raw", "words")).alias("i", "z"))
    at = at.select("doc_id", "text", "i", "z.raw", F.col("z.words").alias("w")).join(found.withColumn("known", F.lit(True)), "w", "left")
    at = at.withColumn("code", code(F.col("w"), F.coalesce("known", F.lit(False))))
    rows = at.groupBy("doc_id", "text").agg(F.array_sort(F.collect_set(F.struct("i", "raw", "code"))).alias("z"))
    return rows.select("doc_id", F.col("z.raw").alias("raw"), F.col("z.code").alias("codes"))


#: Words at the start of a window that are looked up before the whole of it is hashed.
GRAM = 3


def _window(n: int | Column, i: Column, literals: int) -> Column:
    """The key of the window of ``n`` words at ``i``: of its codes or, with fewer than ``literals`` literal words, of the words themselves."""
    codes = F.slice("codes", i, n)
    enough = F.size(F.filter(codes, lambda c: c.bitwiseAND(1) == 0)) >= literals
    return F.when(enough, F.xxhash64(codes)).otherwise(F.xxhash64(F.lit("own"), _bare(F.slice("raw", i, n))))


def _gram(n: int, i: Column) -> Column:
    """A number for the ``n`` codes at ``i``."""
    return F.xxhash64(*[F.get("codes", i + (j - 1)) for j in range(n)])


def _begins(items: DataFrame, gram: int, n_windows: int) -> Callable[[Column], Column]:
    """Whether a window of ``items`` may begin at a place: looks its first ``gram`` words up in a table of bytes."""
    size = 1 << min(21, max(10, (8 * n_windows).bit_length()))
    codes = items.select(F.transform("iwords", lambda w: _code(w, w.rlike("[#~@]"))).alias("codes"))
    table = bytearray(size)
    for r in codes.select(F.pmod(_gram(gram, F.lit(1)), F.lit(size)).cast("int").alias("k")).distinct().collect():  # at most ``size`` rows
        table[r["k"]] = 1
    return lambda i: F.substr(F.lit(bytes(table)), F.pmod(_gram(gram, i), F.lit(size)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def _items(benchmark: DataFrame) -> DataFrame:
    """The items with ``n``, their number of template words; those without a word are left out."""
    items = _named(benchmark.where("item_id IS NOT NULL").select("item_id", "text").distinct())
    return materialize(items.withColumn("n", F.size("words")).where(F.element_at("words", 1) != ""), "items")


def _item_windows(items: DataFrame, width: int, literals: int) -> DataFrame:
    items = items.withColumn("len", F.least("n", F.lit(width))).withColumn("codes", F.transform("words", lambda w: _code(w, w.rlike("[#~@]"))))
    places = F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)
    windows = F.transform(places, lambda i: F.struct(_window(F.col("len"), i, literals).alias("h"), i.alias("pos")))
    return materialize(
        items.select("item_id", "len", (F.col("n") - F.col("len") + 1).alias("windows"), "raw", "words", F.explode(windows).alias("w")).select(
            "item_id", "len", "windows", F.col("w.h").alias("h"), F.col("w.pos").alias("ipos"),
            F.expr("slice(raw, w.pos, len)").alias("iraw"), F.expr("slice(words, w.pos, len)").alias("iwords"),
        ),
        "windows",
    )


def _whole(texts: DataFrame, short: DataFrame, min_words: int, broadcast_rows: int) -> DataFrame:
    """doc_id, item_id, cover, kind of the documents that are, as a whole, an item under ``min_words`` words."""
    key = F.xxhash64(_bare(F.col("raw"))).alias("h")
    here = texts.where((F.size("raw") < min_words) & (F.element_at("raw", 1) != "")).select("doc_id", key)
    found = here.join(within(short.select("item_id", key), broadcast_rows), "h").select("doc_id", "item_id").distinct()
    return found.select("doc_id", "item_id", F.lit(1.0).alias("cover"), F.lit("verbatim").alias("kind"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, width: int = 8, min_words: int = 5, min_cover: float = 0.5, run_words: int = 13, literals: int = 3,
    broadcast_windows: int = 200_000, broadcast_words: int = 200_000, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row for each leaked item in a document: doc_id, item_id, cover, kind."""
    items = _items(benchmark)
    texts = worded(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    short = items.where(F.col("n") < min_words)
    found = _whole(texts, short, min_words, broadcast_windows) if short.limit(1).count() else None

    items = _item_windows(items.where(F.col("n") >= min_words), width, literals)
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # at most ``width`` values
    if not lengths:
        return found if found is not None else docs.select("doc_id").limit(0).crossJoin(benchmark.select("item_id").limit(0)).selectExpr("*", "0D AS cover", "'' AS kind")
    n_windows, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "iraw", "iwords"))), F.lit(0))).first()

    # One pass over the texts serves the windows of all lengths.
    texts = _coded(texts, items, broadcast_words, broadcast_bytes)
    gram = min(GRAM, lengths[0])
    begins = _begins(items, gram, n_windows)
    places = F.when(F.size("codes") >= gram, F.filter(F.sequence(F.lit(1), F.size("codes") - (gram - 1)), begins)).otherwise(F.array().cast("array<int>"))
    of = lambda n, at: F.transform(
        F.filter(at, lambda i: i <= F.size("codes") - (n - 1)), lambda i: F.struct(_window(n, i, literals).alias("h"), i.alias("pos"), F.lit(n).alias("len"))
    )
    # One expression: a filter on a column of its own would be pushed below the codes and work them out at each place.
    windows = F.flatten(F.transform(F.array(places), lambda at: F.concat(*[of(n, at) for n in lengths])))
    here = texts.select("doc_id", "raw", F.explode(windows).alias("w"))
    here = here.select("doc_id", "raw", "w.*")
    small = n_windows <= broadcast_windows and n_bytes <= broadcast_bytes
    draw = F.expr("slice(raw, pos, len)").alias("draw")
    # A small side goes to the words as they are; words are cut out before they are shuffled.
    met = here.join(F.broadcast(items), ["h", "len"]).withColumn("draw", draw) if small else here.select("doc_id", "h", "len", "pos", draw).join(items, ["h", "len"])
    hit = met.select("doc_id", "item_id", "windows", "pos", "ipos", "iraw", "iwords", "draw")

    hit = hit.withColumn("iraw", _bare(F.col("iraw"))).withColumn("draw", _bare(F.col("draw")))
    pair = F.transform(
        F.arrays_zip("iraw", "draw", "iwords"),
        lambda z, k: F.struct(
            (F.col("ipos") + k).alias("at"), (~F.contains(z["iwords"], F.lit("#"))).alias("fixed"), z["iwords"].rlike("[#~@]").alias("slot"),
            z["iraw"].alias("i"), z["draw"].alias("d"),
        ),
    )
    aligned = (
        hit.withColumn("pairs", F.filter(pair, lambda p: p["slot"]))
        .groupBy("doc_id", "item_id", "windows", (F.col("pos") - F.col("ipos")).alias("shift"))
        .agg(F.collect_set(F.struct("ipos", "pairs", F.size("iraw").alias("len"))).alias("found"))
        .withColumn("fixed", F.filter(F.array_distinct(F.flatten(F.transform("found", lambda w: w["pairs"]))), lambda p: p["fixed"]))
        .withColumn("ranked", F.expr("array_sort(transform(fixed, p -> struct(-size(filter(fixed, q -> q.i = p.i AND q.d = p.d)) AS n, p.i <> p.d AS other, p.at AS at, p.i AS i, p.d AS d)))"))
        .withColumn("good", F.expr("filter(found, w -> forall(w.pairs, p -> NOT p.fixed OR p.d = filter(ranked, r -> r.i = p.i)[0].d))"))
        .withColumn("own", F.expr("array_sort(transform(filter(found, w -> forall(w.pairs, p -> p.i = p.d)), w -> struct(w.ipos AS ipos, w.len AS len)))"))
    )
    # Windows in a row: of sorted distinct places, the one so many further on is so many further in the text.
    ahead = f"greatest({run_words} - w.len, 0)"
    run = F.expr(f"array_contains(transform(own, (w, k) -> coalesce(get(own, k + {ahead}).ipos = w.ipos + {ahead}, false)), true)")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("good", lambda w: w["ipos"])))))
    out = aligned.groupBy("doc_id", "item_id", "windows").agg(
        covered.alias("n"), F.min(F.when(F.size("good") > 0, F.size("own") == F.size("found"))).alias("same"), F.max(run).alias("run")
    )
    kind = F.when(F.col("cover") < min_cover, "partial").when(F.col("same"), "verbatim").otherwise("reparameterised")
    out = out.withColumn("cover", F.col("n") / F.col("windows")).where((F.col("cover") >= min_cover) | F.col("run")).select("doc_id", "item_id", "cover", kind.alias("kind"))
    return out if found is None else out.unionByName(found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no leaked item."""
    found = leaks(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
