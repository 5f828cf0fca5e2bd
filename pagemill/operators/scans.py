"""Scanned pages: pages that a scanner has put text under, and the lines of recognition trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T
from pagemill.operators import repair
from pagemill.operators.stored import stored

# Drawing operators that matter, and the text mode that draws nothing.
IMAGES = ["paintImageXObject", "paintInlineImageXObject", "paintImageXObjectRepeat"]
INVISIBLE = 3


def has_text_layer(ops: Column, width: Column, height: Column) -> Column:
    """Whether a page's drawing (an array of op and args) looks like a scan with text under it.

    Either text is drawn invisibly, or an image covers more than half of the
    page.  Images fill a unit square under the current matrix, so the fold over a
    page's operators carries that and the stack of saved ones.
    """
    kind = "struct<m:array<double>,saved:array<array<double>>,hit:boolean>"
    unit = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)])
    start = F.struct(unit.alias("m"), F.array().cast("array<array<double>>").alias("saved"), F.lit(False).alias("hit")).cast(kind)

    def times(a: Column, b: Column) -> Column:
        g = F.get
        return F.array(
            g(a, 0) * g(b, 0) + g(a, 2) * g(b, 1), g(a, 1) * g(b, 0) + g(a, 3) * g(b, 1), g(a, 0) * g(b, 2) + g(a, 2) * g(b, 3),
            g(a, 1) * g(b, 2) + g(a, 3) * g(b, 3), g(a, 0) * g(b, 4) + g(a, 2) * g(b, 5) + g(a, 4), g(a, 1) * g(b, 4) + g(a, 3) * g(b, 5) + g(a, 5),
        )

    def step(s: Column, o: Column) -> Column:
        m, saved, op = s["m"], s["saved"], o["op"]
        area = F.abs(F.get(m, 0) * F.get(m, 3) - F.get(m, 1) * F.get(m, 2))
        hit = ((op == "setTextRenderingMode") & (F.get(o["args"], 0) == INVISIBLE)) | (op.isin(IMAGES) & (area > 0.5 * width * height))
        return F.struct(
            F.when(op == "restore", F.coalesce(F.try_element_at(saved, F.lit(-1)), unit)).when(op == "transform", times(m, o["args"])).otherwise(m).alias("m"),
            F.when(op == "save", F.concat(saved, F.array(m))).when(op == "restore", F.slice(saved, F.lit(1), F.greatest(F.size(saved) - 1, F.lit(0)))).otherwise(saved).alias("saved"),
            (s["hit"] | F.coalesce(hit, F.lit(False))).alias("hit"),
        ).cast(kind)

    return F.coalesce(F.aggregate(ops, start, step)["hit"], F.lit(False))


def _share(s: Column) -> Column:
    """Letters and digits among what isn't white space."""
    bare = F.regexp_replace(s, T.SPACE + "++", "")
    return F.when(F.length(bare) > 0, F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}]++", "")) / F.length(bare)).otherwise(0.0)


def _median(values: Column) -> Column:
    return F.coalesce(T.at_rank(F.sort_array(values), 0.5), F.lit(0.0))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column worked out once a row: a filter behind it would else be moved before it and repeat it at every use, even for each word."""
    return rows.withColumn(name, F.explode(F.array(value)))


#: Confidences up to which a token is repaired alike, and one of each kind.
CLASSES = ((75, 60), (80, 77), (90, 85), (1000, 95))


def _repaired(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """Words (text, confidence) with the text mended as far as its confidence allows."""
    kind = F.lit(0)
    for i, (top, _) in enumerate(CLASSES[:-1]):
        kind = F.when(F.col("confidence") >= top, i + 1).otherwise(kind)
    words = stored(words.withColumn("class", kind), "words")
    each = [repair.repair_tokens(words.where(F.col("class") == i).select(F.col("text").alias("token")).distinct(), ranks, conf).where("repaired <> token").withColumn("class", F.lit(i)) for i, (_, conf) in enumerate(CLASSES)]
    new = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).withColumnRenamed("token", "text")
    return words.join(new, ["text", "class"], "left").withColumn("text", F.coalesce("repaired", "text")).drop("repaired", "class")


def recognised_lines(trees: DataFrame, ranks: DataFrame | None = None, min_conf: float = 55.0) -> DataFrame:
    """book, page, line_no, text, x, y, w, size: the lines of recognition trees that are worth keeping, in points.

    ``trees`` has, a row a page, book, page, scale (pixels a point) and blocks of paragraphs of
    lines (text, confidence, bbox and words of the same).  Words under 25 percent
    stay only if mostly letters and digits.  A line whose words are 1.3 times as
    high as the page's is a heading and keeps its sure words, or goes if these
    are under half.  Another line needs ``min_conf``, or 35 if it is long and
    clean.  With a word list tokens are mended, and lines of few known words go.
    """
    high = lambda b: b["y1"] - b["y0"]
    full = lambda a: F.flatten(F.filter(a, lambda v: v.isNotNull()))

    def line_of(v: Column, b: Column, p: Column, l: Column) -> Column:  # noqa: E741
        words = F.coalesce(v["words"], F.array().cast(_words_type(trees)))
        h = F.when(F.size(words) > 0, _median(F.transform(words, lambda w: high(w["bbox"])))).otherwise(high(v["bbox"]))
        return F.struct(F.struct(b.alias("b"), p.alias("p"), l.alias("l")).alias("id"), v["text"].alias("text"), v["confidence"].alias("confidence"), v["bbox"].alias("bbox"), words.alias("words"), h.alias("h"))

    # A page is a row: its lines and the height of their words are taken inside it.
    of_paragraph = lambda v, b, p: F.transform(v["lines"], lambda x, i: line_of(x, b, p, i))
    every = full(F.transform("blocks", lambda v, b: full(F.transform(v["paragraphs"], lambda x, p: of_paragraph(x, b, p)))))
    pages = trees.select("book", "page", "scale", every.alias("v"))
    page_h = _median(F.filter(F.transform("v", lambda v: v["h"]), lambda h: h > 0))
    heights = F.when(F.exists("v", lambda v: v["h"] > 0), page_h)
    rows = pages.select("book", "page", "scale", heights.alias("page_h"), "v").select("book", "page", "scale", "page_h", F.explode_outer("v").alias("v")).where("v IS NOT NULL").select("book", "page", "scale", "page_h", "v.*")
    sound = lambda w: ((w["confidence"] >= 25) | (_share(w["text"]) > 0.6)) & ~(w["text"].rlike(T.STRAY_MARK) & (w["text"] != "..."))
    rows = _once(rows, "words", F.filter("words", lambda w: (T.trim(w["text"]) != "") & sound(w)))
    title = F.coalesce((F.col("page_h") > 0) & (F.col("h") >= 1.3 * F.col("page_h")) & F.size("words").between(1, 12), F.lit(False))
    low = (F.col("confidence") < min_conf) & ~((F.col("confidence") >= 35) & (_share(F.col("text")) > 0.9) & (F.length("text") > 20))
    rows = rows.withColumn("title", title).where(F.col("title") | ~low)

    keys = ["book", "page", "id"]
    bare = lambda text: F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    sure_of = lambda conf, core, known: (conf >= 70) & (core != "") & (core.rlike(r"^[\p{N}IVXLCivxlc.:,)(-]+$") | known)
    if ranks is None:
        kept = F.filter("words", lambda w: ~F.col("title") | sure_of(w["confidence"], bare(w["text"]), w["confidence"] >= 80))
        rows = _once(rows, "_kept", kept).where(~F.col("title") | (F.size("_kept") / F.size("words") >= 0.5))
        rows = rows.withColumn("said", F.when(F.size("_kept") > 0, F.array_join(F.transform("_kept", lambda w: w["text"]), " ")))
    else:
        words = rows.select(*keys, "title", F.size("words").alias("of"), F.posexplode("words").alias("k", "w")).select(*keys, "title", "of", "k", "w.text", "w.confidence").withColumn("core", bare(F.col("text")))
        listed = F.broadcast(ranks.select(F.col("word").alias("low"), F.lit(True).alias("listed")))  # a fixed upper size
        words = words.withColumn("low", F.lower("core")).join(listed, "low", "left")
        known = F.coalesce("listed", F.lit(False)) | (F.col("core").rlike(r"^\p{Lu}\p{Ll}+$") & (F.col("confidence") >= 85))
        words = words.where(~F.col("title") | sure_of(F.col("confidence"), F.col("core"), known)).select(*keys, "title", "of", "k", "text", "confidence")
        words = _repaired(words, ranks)
        line = words.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda w: w["text"]), " ").alias("said"), F.avg("confidence").alias("mean"), F.count("*").alias("kept"), F.first("of").alias("of"))
        rows = rows.join(line, keys, "left").where(~F.col("title") | (F.col("kept") / F.col("of") >= 0.5))
    rows = _once(rows, "text", T.trim(F.regexp_replace(F.coalesce("said", "text"), T.SPACE + "+", " "))).where((F.col("text") != "") & (_share(F.col("text")) >= 0.55) & ((F.length("text") > 1) | F.col("text").rlike("[0-9]")))
    if ranks is not None:
        rows = _worded(rows, ranks, keys)
    scale = F.col("scale")
    out = rows.select("book", "page", "id", "text", (F.col("bbox.x0") / scale).alias("x"), (F.col("bbox.y0") / scale).alias("y"), ((F.col("bbox.x1") - F.col("bbox.x0")) / scale).alias("w"), (F.col("h") / scale * 0.85).alias("size"))
    number = F.row_number().over(Window.partitionBy("book", "page").orderBy("y", "x", "id")) - 1
    return out.select("book", "page", number.alias("line_no"), "text", "x", "y", "w", "size")


def _words_type(trees: DataFrame) -> str:
    line = trees.schema["blocks"].dataType.elementType["paragraphs"].dataType.elementType["lines"].dataType.elementType
    return line["words"].dataType.simpleString()


def _worded(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The lines with enough known words among those that look like words."""
    toks = rows.select(*keys, F.explode(F.split("text", " ")).alias("tok"))
    bare = F.regexp_replace("tok", r"^[^\p{L}]+|[^\p{L}]+$", "")
    toks = toks.withColumn("bare", bare).withColumn("low", F.when((F.length("bare") >= 2) & F.col("bare").rlike(r"^\p{L}+$"), F.lower("bare")))
    toks = toks.join(F.broadcast(ranks.select(F.col("word").alias("low"), F.lit(1).alias("known"))), "low", "left")
    long = F.col("tok").rlike(r"\p{L}{3,}")
    by = toks.groupBy(*keys).agg(
        F.count("*").alias("toks"), F.count_if(F.col("tok").rlike(r"\p{L}{2,}")).alias("wordish"), F.count("low").alias("cores"), F.count("known").alias("known"),
        F.count_if(long).alias("longer"), F.count(F.when(long, F.col("low"))).alias("lwords"), F.count(F.when(long, F.col("known"))).alias("lknown"),
    )
    ratio = lambda known, words: F.when(F.col(words) > 0, F.col(known) / F.col(words)).otherwise(1.0)
    few = (F.col("wordish") >= 2) & (ratio("known", "cores") < 0.3)
    unsure = (F.coalesce("mean", "confidence") < 60) & (F.col("longer") >= 3) & (ratio("lknown", "lwords") < 0.5)
    alone = (F.col("wordish") == 1) & (F.col("toks") == 1) & (ratio("known", "cores") == 0) & (F.col("confidence") < 60)
    return rows.join(by, keys).where(~few & ~unsure & ~alone)
