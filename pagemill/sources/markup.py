"""Inline markup as a stream of events: tags and texts are rows, nesting and white space are windows over a page.

A page's html falls into tokens by one pattern.  Block tags cut it into
stretches; in a stretch inline tags are paired by name and depth, texts lose
repeated white space across tag borders, and what is left is put together twice:
as plain text, and as html of a few safe tags.  The html's text is the plain text.

Defined cases: comments, declarations, scripts, styles, head, template and svg
are no content; an inline element ends with its stretch, and an end tag without
a start is nothing; a ``>`` ends a tag even inside an attribute; unknown tags
vanish, their text stays; white space inside ``pre`` counts as everywhere; an
empty or null page has no blocks.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T
from pagemill.operators.library import escape_html, resolve_path
from pagemill.operators.stored import stored

# Inline tags as they are shown, and the tags that begin or end a block.
INLINE = {
    "em": "em", "i": "em", "strong": "strong", "b": "strong", "u": "u", "s": "s", "strike": "s", "del": "s", "ins": "u", "sup": "sup", "sub": "sub", "small": "small", "code": "code",
    "kbd": "code", "tt": "code", "q": "q", "cite": "cite", "abbr": "abbr", "dfn": "em", "var": "em", "mark": "strong", "span": "span", "big": "span", "font": "span",
}
BLOCKS = (
    "p div section article body main header footer nav aside figure figcaption h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre hr table thead tbody tfoot tr td th caption "
    "address center hgroup details summary"
).split()
HIDDEN = ["head", "template", "svg"]
TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>|</?[a-z][^>]*>|[^<]+|<"
ENTITY = r"&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"
#: Named characters; the apostrophe has a name in XML only.
NAMED = {f"&{n};": chr(c) for n, c in name2codepoint.items()} | {"&apos;": "'"}
_BLANK = r"[ \t\n\r\f\x0B\x{A0}]+"


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, decoded; null where it has none or an empty one."""
    found = [F.nullif(F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*{form}""", 1), F.lit("")) for form in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")]
    return decoded(F.coalesce(*found))


def decoded(text: Column) -> Column:
    """Character references as the characters they stand for; unknown ones stay."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # one literal, read once

    def of(code: Column) -> Column:
        sound = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    def one(piece: Column) -> Column:
        sixteen = of(F.conv(F.substr(piece, F.lit(4), F.length(piece) - 4), 16, 10).cast("long"))
        ten = of(F.substr(piece, F.lit(3), F.length(piece) - 3).try_cast("long"))
        return F.when(piece.rlike("^&#[xX]"), sixteen).when(piece.startswith("&#"), ten).when(piece == "&amp;", "&").otherwise(F.coalesce(F.try_element_at(named, piece), piece))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda p: F.when(F.length(p) > 2, F.when(p.startswith("&"), one(p)).otherwise(p)).otherwise(p))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, at, name (of a tag, or null), ends, tok: what a page shows, and run, the number of block tags before it."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("at", "tok"))
    name = F.lower(F.nullif(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9:-]*)[^>]*>$", 1), F.lit("")))
    rows = rows.withColumn("name", name).where(~F.col("tok").rlike(r"(?is)^<([!?]|(script|style)\b)")).withColumn("ends", F.col("tok").startswith("</"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hides = F.col("name").isin(HIDDEN)
    rows = rows.withColumn("run", F.count_if(F.col("name").isin(BLOCKS)).over(upto)).withColumn("depth", F.sum(F.when(hides, F.when(F.col("ends"), -1).otherwise(1)).otherwise(0)).over(upto))
    low = F.least(F.lit(0), F.min("depth").over(upto))  # end tags without a start count for nothing
    return rows.withColumn("low", low).where((F.col("depth") == F.col("low")) & ~F.coalesce(hides, F.lit(False))).drop("depth", "low")


def _paired(tags: DataFrame, key: str) -> DataFrame:
    """Inline tags with ``level``, by name, and ``start``, the place of the tag that begins the element; strays are gone."""
    per = Window.partitionBy(key, "run", "name").orderBy("at")
    rows = tags.withColumn("s", F.sum(F.when(F.col("ends"), -1).otherwise(1)).over(per))
    low = F.least(F.lit(0), F.coalesce(F.min("s").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("low", low).where("s >= low").withColumn("level", F.col("s") - F.col("low") + F.col("ends").cast("int"))
    same = Window.partitionBy(key, "run", "name", "level").orderBy("at")
    # On a level a start and its end take turns; a start without an end is ended by the stretch.
    return rows.withColumn("start", F.when(F.col("ends"), F.lag("at").over(same)).otherwise(F.col("at"))).withColumn("closed", F.lead("at").over(same).isNotNull() | F.col("ends"))


def _shown(path: Column) -> Column:
    """What a start tag becomes: tag, and its text; null for one that vanishes."""
    tok, name = F.col("tok"), F.col("name")
    quoted = lambda c: F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))
    cls, style, href = attribute(tok, "class"), F.coalesce(attribute(tok, "style"), F.lit("")), attribute(tok, "href")
    role = F.concat_ws(" ", attribute(tok, "epub:type"), attribute(tok, "role"))
    italic = style.rlike(r"(?i)font-style:\s*italic") | F.coalesce(cls.rlike(r"(?i)\b(italic|ital|emph)\b"), F.lit(False))
    bold = style.rlike(r"(?i)font-weight:\s*(bold|[6-9]00)") | F.coalesce(cls.rlike(r"(?i)\bbold\b"), F.lit(False))
    mapped = F.create_map(*[F.lit(x) for pair in INLINE.items() for x in pair])[name]
    tag = F.when((mapped == "span") & italic, "em").when((mapped == "span") & bold, "strong").otherwise(mapped)
    inline = F.concat(F.lit("<"), tag, F.coalesce(F.concat(F.lit(' class="'), quoted(cls), F.lit('"')), F.lit("")), F.lit(">"))
    inner = F.concat(F.lit('<a data-href="'), quoted(resolve_path(path, href)), F.when(role.rlike("noteref"), '" data-note="1">').otherwise('">'))
    outer = F.concat(F.lit('<a data-ext="'), quoted(href), F.lit('">'))
    link = F.when(href.isNotNull() & ~href.rlike("(?i)^[a-z]+:"), inner).when(href.rlike("(?i)^https?:"), outer)
    return F.when(name == "a", F.struct(F.lit("a").alias("tag"), link.alias("text"))).otherwise(F.struct(tag.alias("tag"), inline.alias("text")))


def inline_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", path: Column | None = None) -> DataFrame:
    """``key``, block, text, html and spans (tag, start, end in the text) of each stretch of a page that has text.

    ``path`` is the page's place in its book, which links are relative to.
    """
    rows = stored(events(pages, key, html), "events")
    paths = pages.select(key, (F.lit("") if path is None else path).alias("path"))
    tags = stored(_paired(rows.where(F.col("name").isin([*INLINE, "a"])), key).join(paths, key), "tags")
    starts = tags.where("NOT ends").withColumn("shown", _shown(F.col("path"))).where("shown.text IS NOT NULL").select(key, "run", "start", "shown", "closed")
    ends = tags.where("ends").select(key, "run", "start", "at").join(starts.select(key, "start", "shown"), [key, "start"]).select(key, "run", F.col("at").cast("long").alias("at"), F.lit(0).alias("k"), "start", F.lit(None).cast("string").alias("raw"), F.concat(F.lit("</"), F.col("shown.tag"), F.lit(">")).alias("tag"))
    last = F.lit(1 << 40)  # behind every token, the inner element first
    open_ = starts.where("NOT closed").select(key, "run", (last - F.col("start")).alias("at"), F.lit(0).alias("k"), "start", F.lit(None).cast("string").alias("raw"), F.concat(F.lit("</"), F.col("shown.tag"), F.lit(">")).alias("tag"))
    begin = starts.select(key, "run", F.col("start").cast("long").alias("at"), F.lit(0).alias("k"), "start", F.lit(None).cast("string").alias("raw"), F.col("shown.text").alias("tag"))
    none = F.lit(None).cast("string")
    breaks = rows.where("name = 'br'").select(key, "run", F.col("at").cast("long").alias("at"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(" ").alias("raw"), none.alias("tag")), F.struct(F.lit(1).alias("k"), none.alias("raw"), F.lit("<br>").alias("tag")))).alias("b"))
    breaks = breaks.select(key, "run", "at", "b.k", F.lit(None).cast("int").alias("start"), "b.raw", "b.tag")
    texts = rows.where("name IS NULL").select(key, "run", F.col("at").cast("long").alias("at"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("start"), decoded(F.col("tok")).alias("raw"), none.alias("tag"))
    parts = begin.unionByName(ends).unionByName(open_).unionByName(breaks).unionByName(texts)

    # A run of white space is one space, or one no-break space if it holds nothing else; of two in a row, over a tag, the first stays.
    flat = F.regexp_replace(F.regexp_replace("raw", r"\x{A0}*[ \t\n\r\f\x0B]" + _BLANK.replace("+", "*"), " "), r"\x{A0}+", "\u00a0")
    per = Window.partitionBy(key, "run").orderBy("at", "k")
    before = per.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("flat", flat)
    spaced = F.coalesce(F.last(F.when(F.col("flat") != "", F.col("flat").endswith(" ")), ignorenulls=True).over(before), F.lit(True))
    solid = F.coalesce((F.regexp_replace("flat", " ", "") != "").cast("int"), F.lit(0))
    behind = F.sum(solid).over(per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum(solid).over(per.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("spaced", spaced).withColumn("behind", behind)
    said = F.when(F.col("spaced"), F.regexp_replace("flat", "^ +", "")).otherwise(F.col("flat"))
    parts = parts.withColumn("said", F.when(F.col("behind") == 0, F.regexp_replace(said, " +$", "")).otherwise(said))
    parts = parts.withColumn("upto", F.coalesce(F.sum(F.length("said")).over(before), F.lit(0)))

    ordered = lambda c, only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("at", "k", c.alias("s"))))), lambda x: x["s"]), "")
    span = F.struct(F.col("start"), F.regexp_extract("tag", "^</?([a-z]+)", 1).alias("tag"), F.col("upto").cast("int").alias("place"))
    is_text = F.col("tag").isNull()
    out = parts.groupBy(key, "run").agg(
        ordered(F.col("said"), is_text).alias("text"), ordered(F.coalesce("tag", escape_html(F.col("said"))), F.lit(True)).alias("html"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), span))).alias("marks"),
    )
    # A tag's start and end are neighbours in the order of starts.
    mark = lambda i, field: F.get("marks", i)[field]
    pairs = F.transform(F.sequence(F.lit(0), F.size("marks") - 2, F.lit(2)), lambda i: F.struct(mark(i, "tag").alias("tag"), mark(i, "place").alias("start"), mark(i + 1, "place").alias("end")))
    out = out.where(T.trim(F.col("text")) != "").withColumn("spans", F.when(F.size("marks") > 1, pairs).otherwise(F.array().cast("array<struct<tag:string,start:int,end:int>>")))
    return out.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).select(key, "block", "text", "html", "spans")


def nav_links(pages: DataFrame, key: str = "page_id", html: str = "html", path: Column | None = None) -> DataFrame:
    """``key``, ord, label, href and level of the links in lists of a page's navigation.

    Of several navigations the first that is marked as a table of contents
    counts, else the first.  A level is a list around the link.
    """
    rows = events(pages, key, html)
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("ends"), -1).otherwise(1)
    is_list, starts = F.col("name").isin("ol", "ul"), ~F.coalesce("ends", F.lit(False))
    navs = (F.col("name") == "nav") & starts
    marked = F.concat_ws(" ", attribute(F.col("tok"), "epub:type"), attribute(F.col("tok"), "role")).rlike("toc")
    rows = rows.withColumn("nav", F.count_if(navs).over(upto)).withColumn("inside", F.sum(F.when(F.col("name") == "nav", step).otherwise(0)).over(upto))
    rows = rows.withColumn("lists", F.sum(F.when(is_list, step).otherwise(0)).over(upto)).withColumn("link", F.count_if((F.col("name") == "a") & starts).over(upto))
    best = F.min(F.when(navs, F.struct((~marked).alias("m"), "nav"))).over(Window.partitionBy(key))["nav"]
    rows = rows.withColumn("best", best).where("inside > 0 AND nav = best")
    link = rows.where((F.col("name") == "a") & starts).select(key, "link", attribute(F.col("tok"), "href").alias("href"), (F.col("lists") - 1).alias("level"))
    ended = rows.where("name = 'a' AND ends").groupBy(key, "link").agg(F.min("at").alias("end"))
    label = rows.where("name IS NULL").join(ended, [key, "link"], "left").where("end IS NULL OR at < end").groupBy(key, "link").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "tok"))), lambda t: decoded(t["tok"])), "").alias("label"))
    out = link.where("href IS NOT NULL AND level >= 0").join(label, [key, "link"]).join(pages.select(key, (F.lit("") if path is None else path).alias("path")), key)
    return out.select(key, F.col("link").alias("ord"), "label", resolve_path(F.col("path"), F.col("href")).alias("href"), "level")
