"""Library views, reading statistics and job control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import textsem as T


def status_of(status: Column, progress: Column, last_read: Column) -> Column:
    """An explicit status, else read from 98 percent on, reading once opened, else none."""
    return F.coalesce(status, F.when(progress >= 0.98, "read").when(F.coalesce(last_read, F.lit(0)) != 0, "reading").otherwise("none"))


def library_filter(books: DataFrame, *, favorites: bool = False, status: str = "all", collection: str = "", query: str = "") -> DataFrame:
    q = query.strip().lower()
    out = books.where("favorite") if favorites else books
    if status != "all":
        out = out.where(status_of(F.col("reading_status"), F.col("progress"), F.col("last_read")) == status)
    if collection:
        out = out.where(F.array_contains("collections", collection))
    if q:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", F.coalesce("author", F.lit("")), "file_name")), F.lit(q)))
    return out


#: Book ids that are numbered in one task of ``by_author``.
SHELF = 100_000


def by_author(books: DataFrame) -> DataFrame:
    """author, n, place, book_id, title: each author's books in the order of their ids; blank authors are 'Unknown author'.

    Places are counted in stretches of ids, so an author of very many books
    doesn't meet in one task.
    """
    author = F.coalesce(F.nullif(T.trim(F.col("author")), F.lit("")), F.lit("Unknown author"))
    rows = books.select(author.alias("author"), "book_id", "title", F.floor(F.col("book_id") / SHELF).alias("shelf"))
    shelves = rows.groupBy("author", "shelf").agg(F.count("*").alias("held"))
    per = Window.partitionBy("author")
    shelves = shelves.withColumn("before", F.sum("held").over(per.orderBy("shelf")) - F.col("held")).withColumn("n", F.sum("held").over(per))
    within = F.row_number().over(Window.partitionBy("author", "shelf").orderBy("book_id", "title"))
    return rows.withColumn("k", within).join(shelves, ["author", "shelf"]).select("author", "n", (F.col("before") + F.col("k")).alias("place"), "book_id", "title")


def sorts() -> dict[str, list[Column]]:
    """The orders of a library; ties keep the order of ids."""
    title, author = (T.fold(F.col(c)) for c in ("title", "author"))
    orders = {
        "recent": [F.greatest("last_read", "added").desc()], "added": [F.desc("added")], "title": [title.asc()],
        "author": [F.coalesce(author, F.lit("~")).asc(), title.asc()], "progress": [F.desc("progress")],
    }
    return {name: [*by, F.asc("book_id")] for name, by in orders.items()}


def shelf_places(books: DataFrame, owner: str) -> DataFrame:
    """book_id and its place in its owner's library under each order."""
    return books.select("book_id", *[F.row_number().over(Window.partitionBy(owner).orderBy(*by)).alias(name) for name, by in sorts().items()])


def toggled(held: Column, one: Column) -> Column:
    """A set with an element added, or removed if it was there."""
    return F.when(F.array_contains(held, one), F.array_remove(held, one)).otherwise(F.array_append(held, one))


def collection_names(used: DataFrame, stored: DataFrame) -> DataFrame:
    """name: the collections that books are in and those that are kept without books, once each."""
    return used.select(F.explode("collections").alias("name")).union(stored.select("name")).distinct()


def status_after_reading(status: Column) -> Column:
    """Reading, unless another status than 'to-read' and 'none' was set."""
    return F.when(F.coalesce(status, F.lit("none")).isin("to-read", "none", ""), "reading").otherwise(status)


def is_english(ocr_lang: Column, lang: Column) -> Column:
    """By the language that was recognised with, else the book's own."""
    return F.coalesce(F.when(ocr_lang.isNotNull(), ocr_lang == "eng").otherwise(lang == "en"), F.lit(False))


def retryable(status: Column, blocks: Column) -> Column:
    """Whether a recognition call is worth another try: no answer, too many calls, server errors, an answer without blocks."""
    return status.isNull() | (status == 429) | (status >= 500) | ((status < 400) & blocks.isNull())


def cancelled(pages: DataFrame) -> DataFrame:
    """Pages of a cancelled job: what is pending is skipped."""
    return pages.withColumn("state", F.when(F.col("state") == "pending", "skipped").otherwise(F.col("state")))


def resumable(books: DataFrame) -> DataFrame:
    """The jobs that go on by themselves: running, not paused, not waiting for consent."""
    return books.where((F.col("state") == "ocr") & ~F.coalesce("paused", F.lit(False)) & (F.coalesce("needs_consent", F.lit(0)) == 0))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _uri_part(text: Column) -> Column:
    """Percent-encoded as a part of an address; marks that need no code stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def lookup_url(selection: Column, lang: Column) -> Column:
    """Where a selected text is looked up: one word in a dictionary, more by a search."""
    q = F.substr(T.trim(selection), F.lit(1), F.lit(200))
    word = F.concat(F.lit("https://"), F.substr(F.coalesce(lang, F.lit("en")), F.lit(1), F.lit(2)), F.lit(".wiktionary.org/wiki/"), _uri_part(F.lower(q)))
    search = F.concat(F.lit("https://www.google.com/search?q="), _uri_part(F.concat(F.lit("define "), q)))
    return F.when(q.rlike(T.WS), search).otherwise(word)


def reading_days(events: DataFrame, idle: int = 120, jump: float = 20_000) -> DataFrame:
    """user_id, day, seconds, chars: gaps under ``idle`` seconds count, and forward moves under ``jump``.

    ``events`` has user_id, ts, event_id and position.
    """
    per = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(per).cast("timestamp"))
    move = F.col("position") - F.lag("position").over(per)
    rows = events.withColumn("gap", gap).withColumn("move", move)
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.coalesce(F.sum(F.when(F.col("gap") < idle * 1_000_000, F.col("gap"))), F.lit(0)).alias("micros"),
        F.coalesce(F.sum(F.when((F.col("move") > 0) & (F.col("move") < jump), F.col("move"))), F.lit(0)).alias("chars"),
    )


def stats_view(days: DataFrame) -> DataFrame:
    """user_id, days_read, chars, pages_per_day, chars_per_minute, last7 (seconds of the last seven days)."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("day"))
    rows = days.withColumn("k", F.row_number().over(latest)).withColumn("seconds", F.col("micros") / 1_000_000)
    out = rows.groupBy("user_id").agg(
        F.count("*").alias("days_read"), F.sum("chars").alias("chars"), F.sum("micros").alias("micros"),
        F.sum(F.when(F.col("k") <= 7, F.col("micros")).otherwise(0)).alias("last7_micros"),
    )
    seconds = F.col("micros") / 1_000_000
    return out.select(
        "user_id", "days_read", "chars", "micros", "last7_micros",
        T.round_half_up(T.round_half_up(F.col("chars") / 1500) / F.col("days_read")).alias("pages_per_day"),
        F.when(seconds > 60, F.col("chars") / (seconds / 60)).otherwise(0.0).alias("chars_per_minute"),
    )


def failure_streaks(calls: DataFrame, limit: int = 4) -> DataFrame:
    """Adds ``streak`` (failures in a row up to each call) and ``open`` (the breaker once ``limit`` were reached).

    ``calls`` has key, seq and ok.
    """
    per = Window.partitionBy("key").orderBy("seq")
    calls = calls.withColumn("_run", F.sum(F.col("ok").cast("int")).over(per))
    # The first run has no success before it; each later one begins with its success.
    streak = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("key", "_run").orderBy("seq"))
    calls = calls.withColumn("streak", streak)
    return calls.withColumn("open", F.max((F.col("streak") >= limit).cast("int")).over(per) == 1).drop("_run")


def page_outcome(first_chars: Column, second_chars: Column, scanner_chars: Column, consent: Column) -> Column:
    """Which reading of a page stands: first provider, second, the scanner's own text, or on-device if allowed.

    Null characters: that reading failed.  A provider with under 30 percent of
    the scanner's characters loses to the scanner.
    """
    scanner = F.coalesce(scanner_chars, F.lit(0))

    def beats(chars):
        return (scanner > 0) & (chars < scanner * 0.3)

    return (
        F.when(first_chars.isNotNull(), F.when(beats(first_chars), "kept-scanner-text").otherwise("first"))
        .when(second_chars.isNotNull(), F.when(beats(second_chars), "kept-scanner-text").otherwise("second"))
        .when(scanner > 0, "kept-scanner-text")
        .when(consent, "on-device")
        .otherwise("needs-consent")
    )


def ewma_of(rows: DataFrame, keep: float = 0.85) -> DataFrame:
    """key, ewma of rows (key, seq, value): each value's weight follows from its place from the end, so the mean is a sum."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))) - 1
    n = F.count("*").over(Window.partitionBy("key"))
    weight = F.pow(F.lit(keep), F.col("k")) * F.when(F.col("k") == F.col("n") - 1, 1.0).otherwise(1 - keep)
    return rows.withColumn("k", last).withColumn("n", n).groupBy("key").agg(F.sum(F.col("value") * weight).alias("ewma"))


def ewma(values: Column, keep: float = 0.85) -> Column:
    """Weighted mean over an ordered array: the first value, then 0.85 old and 0.15 new."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.try_element_at(values, F.lit(1)), lambda a, v: a * keep + v * (1 - keep))


def bold_starts(html: Column) -> Column:
    """Wraps the first half of each word outside tags; the text stays."""
    parts = F.regexp_extract_all(html, F.lit(r"<[^>]*>|\p{L}+|[^<\p{L}]+|<"), F.lit(0))
    half = F.ceil

    def mark(p):
        n = half(F.length(p) / 2).cast("int")
        bold = F.concat(F.lit('<b class="bs">'), F.substr(p, F.lit(1), n), F.lit("</b>"), F.substr(p, n + 1, F.length(p)))
        return F.when(p.rlike(r"^\p{L}{2,}$"), bold).otherwise(p)

    return F.array_join(F.transform(parts, mark), "")


def contrast_ratio(a: Column, b: Column) -> Column:
    """WCAG ratio of two #rrggbb colours; anything else counts as black."""

    def luminance(c):
        hex_ = F.regexp_extract(F.trim(c), r"(?i)^#?([0-9a-f]{6})$", 1)
        total = F.lit(0.0)
        for at, weight in ((1, 0.2126), (3, 0.7152), (5, 0.0722)):
            v = F.conv(F.substring(hex_, at, 2), 16, 10).cast("double") / 255
            total = total + weight * F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
        return F.when(hex_ == "", 0.0).otherwise(total)

    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def cover_hue(title: Column) -> Column:
    return F.aggregate(F.split(title, ""), F.lit(0), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % 360))


def format_minutes(m: Column) -> Column:
    whole, rest = F.floor(m / 60), T.round_half_up(m % 60)
    long_ = F.when(rest != 0, F.concat(whole, F.lit(" h "), rest, F.lit(" min"))).otherwise(F.concat(whole, F.lit(" h")))
    return F.when(m < 1, "less than a minute").when(m < 60, F.concat(T.round_half_up(m), F.lit(" min"))).otherwise(long_)


def time_ago(seconds: Column) -> Column:
    """A span in words; null: never started."""
    days = F.floor(seconds / 86400)
    return (
        F.when(seconds.isNull(), "Not started").when(seconds < 60, "Just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit(" h ago")))
        .when(days == 1, "Yesterday").otherwise(F.concat(days, F.lit(" days ago")))
    )


def resolve_path(base: Column, href: Column) -> Column:
    """A link relative to the folder of ``base``: escapes decoded, dots resolved, the fragment kept."""
    path, frag = F.split(href, "#", 2)[0], F.try_element_at(F.split(href, "#", 2), F.lit(2))
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    tail = F.when(frag.isNotNull(), F.concat(F.lit("#"), frag)).otherwise("")
    start = F.when(path.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1))
    parts = F.aggregate(
        F.split(path, "/"),
        start,
        lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.when(path == "", F.concat(base, F.when(F.coalesce(frag, F.lit("")) != "", tail).otherwise(""))).otherwise(F.concat(F.array_join(parts, "/"), tail))


#: The first pages of a book are shown one by one, the others by fours.
FIRST_PAGES, PAGES_AT_ONCE = 3, 4


def rebuild_triggers(steps: DataFrame) -> DataFrame:
    """key, seq, done, rebuild: whether a book is built anew after each step of its reading.

    ``steps`` has key, seq and kind: 'page' for a page read; anything else ends a
    run (paused, cancelled, waiting or finished) and always rebuilds.  Pages
    rebuild while ``FIRST_PAGES`` aren't passed, then each time that
    ``PAGES_AT_ONCE`` have come since the last rebuild or the run's start.
    """
    per = Window.partitionBy("key").orderBy("seq")
    page = (F.col("kind") == "page").cast("int")
    rows = steps.withColumn("page", page).withColumn("done", F.sum("page").over(per)).withColumn("run", F.sum(1 - F.col("page")).over(per) - (1 - F.col("page")))
    late = F.sum(((F.col("page") == 1) & (F.col("done") > FIRST_PAGES)).cast("int")).over(Window.partitionBy("key", "run").orderBy("seq"))
    due = (F.col("done") <= FIRST_PAGES) | (late % PAGES_AT_ONCE == 0)
    return rows.withColumn("rebuild", (F.col("page") == 0) | due).select("key", "seq", F.col("done").cast("long"), "rebuild")
