"""Line dedup by site-relative frequency (DataFrame functions only).

A page's lines are the texts between its block tags.  For each host, the pages
that hold a line are divided by the host's pages; lines above ``ratio`` that at
least two pages hold are boilerplate of that site and go from all its pages.
One rule holds for hosts of every size; a host's only page stays whole.

Lines are counted by their digest and each page counts once, combined before
the shuffle, so a host or line that holds a third of all rows is counted in
parallel.  Only digests are shuffled, never texts but for the final join.

Defined cases: a very long page is one page like others, parsed whole; a line at
the ratio stays; null or empty html has no lines and keeps an empty text; a null
url, or one without a host, is the host ''; rows that repeat a page_id with one
html count as one page each; blank lines are no lines; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialize

HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>"
BLOCK = r"(?i)</?(p|div|li|ul|ol|nav|h[1-6]|title|head|body|html|article|section|footer|header|table|tr|td|th|blockquote|pre|br|hr)\b[^>]*>"
TAG = r"<[^>]*>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def page_lines(html: Column) -> Column:
    """The lines of a page in order; tags gone, the common entities decoded, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), r"[\x20\x09-\x0D]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), TAG, "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, *, ratio: float = 0.3, least: int = 2) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text (the kept lines) of every row."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    sized = rows.withColumn("digests", F.transform("lines", F.md5))
    seen = materialize(sized.select("page_id", "host", F.array_distinct("digests").alias("digests")), "lines")
    n_pages = seen.groupBy("host").agg(F.count("*").alias("pages"))
    n_lines = seen.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    common = n_lines.join(n_pages, "host").where((F.col("n") >= least) & (F.col("n") > F.lit(ratio) * F.col("pages"))).select("host", "digest")
    common = materialize(common, "boilerplate")
    hits = seen.select("page_id", "host", F.explode("digests").alias("digest")).join(common, ["host", "digest"])
    gone = hits.groupBy("page_id", "host").agg(F.collect_set("digest").alias("gone"))
    both = sized.join(gone.withColumnRenamed("page_id", "_id").withColumnRenamed("host", "_host"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")), "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("gone", F.md5(x)), F.lit(False)))
    out = both.withColumn("kept", kept)
    return out.select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


#: DuckDB's form of ``drop_boilerplate`` over the table ``pages``; the digest stands for the text.
ORACLE = rf"""
WITH rows AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM pages),
cut AS (
  SELECT page_id, host, list_filter(list_transform(string_split(
    replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(t, '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM rows),
hosts AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
seen AS (SELECT host, unnest(list_distinct(lines)) AS line FROM cut),
common AS (
  SELECT host, list(line) AS gone FROM (
    SELECT s.host, s.line FROM seen s JOIN hosts h USING (host) GROUP BY s.host, s.line, h.pages HAVING count(*) >= 2 AND count(*) > 0.3 * h.pages) GROUP BY host),
kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept
  FROM cut LEFT JOIN common USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  md5(array_to_string(kept, chr(10))) AS text_md5
FROM kept
"""
