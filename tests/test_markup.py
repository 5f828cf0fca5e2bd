"""Inline markup: its text is the text of its html, whatever the tags do."""

import html as H
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagemill.sources import markup


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.open, self.sound = [], [], True

    def handle_data(self, data):
        self.text.append(data)


def text_of(html):
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.text)


def blocks(spark, html, path="OEBPS/text/ch1.xhtml"):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [(r.text, r.html, [tuple(s) for s in r.spans]) for r in markup.inline_blocks(df, path=F.lit(path)).orderBy("block").collect()]


CASES = [
    ("<p>By <i>morning</i>\n the  <b>sea</b> </p>", [("By morning the sea", "By <em>morning</em> the <strong>sea</strong>", [("em", 3, 10), ("strong", 15, 18)])]),
    ("<p>one <b> two</b><i> </i> three</p>", [("one two three", "one <strong>two</strong><em> </em>three", [("strong", 4, 7), ("em", 7, 8)])]),
    ("a<br/>b<p> <br> </p>", [("a b", "a <br>b", [])]),
    ('<p>see <a href="ch2.xhtml#fn1" epub:type="noteref">1</a> <a href="HTTP://x.y/?a=1&amp;b">out</a> <a href="mailto:z">mail</a></p>',
     [("see 1 out mail", 'see <a data-href="OEBPS/text/ch2.xhtml#fn1" data-note="1">1</a> <a data-ext="HTTP://x.y/?a=1&amp;b">out</a> mail', [("a", 4, 5), ("a", 6, 9)])]),
    ("<p>x<span style='font-style: italic'>i</span><span class=\"bold x\">b</span><span>s</span></p>",
     [("xibs", 'x<em>i</em><strong class="bold x">b</strong><span>s</span>', [("em", 1, 2), ("strong", 2, 3), ("span", 3, 4)])]),
    ("<p>a</b>c<b>d<p>e</b>f", [("acd", "ac<strong>d</strong>", [("strong", 2, 3)]), ("ef", "ef", [])]),
    ("<head><title>t</title></head><body>x<!-- <b> --><script>'</p>'</script>y<style>p{}</style><svg>z</svg>", [("xy", "xy", [])]),
    ("<p>&lt;b&gt; &amp;amp; &copy;&#65;&#x1F600;&nosuch; & &nbsp;&nbsp;</p>", [("<b> &amp; ©A😀&nosuch; &", "&lt;b&gt; &amp;amp; ©A😀&amp;nosuch; &amp;", [])]),
    ("<p>a&nbsp;&nbsp;b &nbsp; c</p>", [("a b c", "a b c", [])]),
    ("<b><b>x</b>y</b>", [("xy", "<strong><strong>x</strong>y</strong>", [("strong", 0, 2), ("strong", 0, 1)])]),
    ("<i>a<b>c", [("ac", "<em>a<strong>c</strong></em>", [("em", 0, 2), ("strong", 1, 2)])]),
    ("", []), (None, []), ("<p> \n </p>", []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page_id long, html string")
    got = {}
    for r in markup.inline_blocks(df, path=F.lit("OEBPS/text/ch1.xhtml")).orderBy("page_id", "block").collect():
        got.setdefault(r.page_id, []).append((r.text, r.html, [tuple(s) for s in r.spans]))
    for i, (h, want) in enumerate(CASES):
        assert got.get(i, []) == want, h


def test_html_and_text_agree_on_any_tag_soup(spark):
    r = random.Random(11)
    pool = ["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href='x#y'>", "</a>", "<br>", " ", "\n", "word", "&amp;", "&nbsp;", "<div>", "<u class='k'>", "</u>", "é", "<x>", "</x>"]
    df = spark.createDataFrame([(i, "".join(r.choice(pool) for _ in range(r.randint(0, 40)))) for i in range(500)], "page_id long, html string")
    out = markup.inline_blocks(df).collect()
    assert len(out) > 400
    for x in out:
        assert text_of(x.html) == x.text and not x.text.startswith(" ") and not x.text.endswith(" ") and "  " not in x.text
        for tag in ("strong", "em", "u", "a"):
            assert x.html.count(f"<{tag}") - (x.html.count("<abbr") if tag == "a" else 0) == x.html.count(f"</{tag}>") == sum(s.tag == tag for s in x.spans)
        assert all(0 <= s.start <= s.end <= len(x.text) for s in x.spans)


def test_references(spark):
    some = ["&amp;", "&eacute;", "&#233;", "&#xE9;", "&hellip;", "&#128512;", "x", "&", ";", "&amp", "&#;", "&apos;"]
    r = random.Random(4)
    rows = [("".join(r.choice(some) for _ in range(6)),) for _ in range(200)]
    for x in spark.createDataFrame(rows, "t string").select("t", markup.decoded(F.col("t")).alias("d")).collect():
        if not any(bad in x.t for bad in ("&amp&", "&ampx", "&#;")) and not x.t.endswith("&amp"):
            assert x.d == H.unescape(x.t), x.t


