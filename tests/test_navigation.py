"""Outlines, navigation files and sections of spine files."""

from pyspark.sql import functions as F

from pagemill.operators import navigation
from pagemill.sources import markup

ITEMS = "doc_id long, item int, parent int, place int, title string, page int"


def test_outline_order_levels_and_gaps(spark):
    rows = [
        (1, 1, None, 1, " One ", 3), (1, 2, None, 0, "Zero", None), (1, 3, 1, 1, "One b", 5), (1, 4, 1, 0, " ", 4), (1, 5, 4, 0, "below a blank", 4), (1, 6, 5, 0, "too deep", 4),
        (1, 7, 8, 0, "loop", 1), (1, 8, 7, 0, "loop", 1), (1, 9, 99, 0, "orphan", 1), (2, 1, None, 0, None, 1),
    ]
    out = navigation.outline_walk(spark.createDataFrame(rows, ITEMS)).orderBy("doc_id", "ord").collect()
    assert [(r.title, r.page, r.level) for r in out] == [("Zero", -1, 0), ("One", 3, 0), ("below a blank", 4, 2), ("One b", 5, 1)]
    assert [r.ord for r in out] == [0, 1, 2, 3]
    assert navigation.outline_walk(spark.createDataFrame([], ITEMS)).collect() == []


BLOCKS = [(1, 0, "a", "h", "Front", ["x"]), (1, 1, "a", "p", "text", ["y", "x"]), (1, 2, "b", "p", "more", None), (1, 3, "b", "h", "Head b", ["z"]), (1, 4, "c", "p", "end", None), (1, 5, "d", "p", "last", None)]


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "book long, block int, path string, t string, text string, ids array<string>")


def test_links_fall_back_to_their_file(spark):
    to = navigation.anchors(blocks(spark))
    assert {r.target: r.block for r in to.collect()} == {"a": 0, "b": 2, "c": 4, "d": 5, "a#x": 1, "a#y": 1, "b#z": 3}
    rows = [(1, 0, "To  x", "a#x", 0), (1, 1, "no such place", "b#q", 1), (1, 2, "no such file", "e#z", 0), (1, 3, " ", "a", 0), (1, 4, "deep", "b#z", 7), (2, 0, "other book", "a", 0)]
    links = spark.createDataFrame(rows, "book long, ord long, label string, href string, level int")
    got = navigation.toc_of_links(links, to).orderBy("toc_no").collect()
    assert [(r.toc_no, r.title, r.block, r.level) for r in got] == [(0, "To x", 1, 0), (1, "no such place", 2, 1), (2, "deep", 3, 2)]


def test_sections_are_named_by_the_last_entry(spark):
    toc = spark.createDataFrame([(1, 0, "late", 4), (1, 1, "early", 2)], "book long, toc_no int, title string, block int")
    got = navigation.spine_sections(blocks(spark), toc).orderBy("start").collect()
    # The last entry in the order of the table, not of the blocks.
    assert [(r.title, r.start, r.end) for r in got] == [("Front", 0, 2), ("early", 2, 4), ("early", 4, 5), ("early", 5, 6)]
    got = navigation.spine_sections(blocks(spark), toc.where("false"), per_section=1).orderBy("start").collect()
    assert [(r.title, r.start) for r in got] == [("Front", 0), ("Front", 1), ("Head b", 2), ("Head b", 3), ("Start", 4), ("Start", 5)]


def test_navigation_links(spark):
    html = """<nav><ul><li><a href="no">no</a></ul></nav><nav epub:type="toc"><h1>Contents</h1><ol><li><a href="c1.xhtml">One &amp; <i>only</i></a>
      <ol><li><a href="../c2.xhtml#f">Sub</a></li></ol></li><li><span>plain</span></li><li><a>no link</a></li></ol></nav><a href="out">out</a>"""
    df = spark.createDataFrame([(1, html), (2, "<nav><ol><li><a href='x'>x</ol></nav>"), (3, ""), (4, None)], "page_id long, html string")
    got = [(r.page_id, r.label, r.href, r.level) for r in markup.nav_links(df, path=F.lit("OEBPS/nav.xhtml")).orderBy("page_id", "ord").collect()]
    assert got == [(1, "One & only", "OEBPS/c1.xhtml", 0), (1, "Sub", "c2.xhtml#f", 1), (2, "x", "OEBPS/x", 0)]
