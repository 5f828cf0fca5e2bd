"""Pages that look like scans, and recognition trees, against plain walks."""

import random
import re

import regex
from pyspark.sql import functions as F

from pagemill.functions import textsem as T
from pagemill.operators import scans

OPS = "page long, ops array<struct<op:string,args:array<double>>>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TREES = f"book long, page long, scale double, blocks array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,bbox:{BOX},words:array<struct<text:string,confidence:double,bbox:{BOX}>>>>>>>>"
RANK = {w: i for i, w in enumerate("the of and to in it was house garden water night little morning".split())}


def layered(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), OPS)
    return {r.page: r.x for r in df.select("page", scans.has_text_layer(F.col("ops"), F.lit(20.0), F.lit(30.0)).alias("x")).collect()}


def walk(ops):
    m, saved, hit = [1, 0, 0, 1, 0, 0], [], False
    for op, a in ops or []:
        if op == "save":
            saved.append(m)
        elif op == "restore":
            m = saved.pop() if saved else [1, 0, 0, 1, 0, 0]
        elif op == "transform":
            b = m
            m = [b[0] * a[0] + b[2] * a[1], b[1] * a[0] + b[3] * a[1], b[0] * a[2] + b[2] * a[3], b[1] * a[2] + b[3] * a[3], b[0] * a[4] + b[2] * a[5] + b[4], b[1] * a[4] + b[3] * a[5] + b[5]]
        elif op == "setTextRenderingMode":
            hit |= bool(a) and a[0] == 3
        elif op in scans.IMAGES:
            hit |= abs(m[0] * m[3] - m[1] * m[2]) > 300
    return hit


def test_layers_equal_a_walk(spark):
    r = random.Random(3)

    def some():
        op = r.choice(["save", "restore", "transform", "transform", "setTextRenderingMode", "showText", *scans.IMAGES])
        args = [float(r.choice([-4, 0, 1, 2, 5])) for _ in range(6)] if op == "transform" else [float(r.choice([0, 1, 2]))] if op == "setTextRenderingMode" else []
        return (op, args)

    pages = [[some() for _ in range(r.randint(0, 14))] for _ in range(400)]
    pages += [None, [], [("setTextRenderingMode", [])], [("setTextRenderingMode", [3.0])], [("save", []), ("transform", [20.0, 0.0, 0.0, 30.0, 0.0, 0.0]), ("restore", []), ("paintImageXObject", [])]]
    pages += [[("transform", [15.0, 0.0, 0.0, 20.0, 0.0, 0.0]), ("paintImageXObject", [])], [("transform", [15.0, 0.0, 0.0, 20.1, 0.0, 0.0]), ("paintImageXObject", [])]]
    got = layered(spark, pages)
    assert got == {i: walk(p) for i, p in enumerate(pages)}
    assert got[len(pages) - 1] and not got[len(pages) - 2]


def share(s):
    bare = re.sub(r"\s", "", s)
    return len(regex.findall(r"[\p{L}\p{N}]", bare)) / len(bare) if bare else 0


def median(v):
    return sorted(v)[len(v) // 2] if v else 0


def plain_lines(lines, scale, known=None):
    """Reads one page's lines in turn; tokens are taken as they are."""

    def high(line):
        return median([w[2][3] - w[2][1] for w in line[3] or []] or [line[2][3] - line[2][1]])

    def ratio(toks):
        cores = [c for c in (regex.sub(r"^[^\p{L}]+|[^\p{L}]+$", "", t) for t in toks) if len(c) > 1 and regex.fullmatch(r"\p{L}+", c)]
        return sum(c.lower() in known for c in cores) / len(cores) if cores else 1

    page = median([h for h in map(high, lines) if h > 0])
    out = []
    for text, conf, box, words in lines:
        ws = [w for w in words or [] if w[0].strip() and (w[1] >= 25 or share(w[0]) > 0.6) and not (regex.match(T.STRAY_MARK, w[0]) and w[0] != "...")]
        h = high((text, conf, box, words))
        if page > 0 and h >= page * 1.3 and 0 < len(ws) <= 12:
            good = []
            for w in ws:
                core = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w[0])
                plain = regex.fullmatch(r"[\p{N}IVXLCivxlc.:,)(-]+", core)
                sure = w[1] >= 80 if known is None else core.lower() in known or (regex.fullmatch(r"\p{Lu}\p{Ll}+", core) and w[1] >= 85)
                if w[1] >= 70 and core and (plain or sure):
                    good.append(w)
            if len(good) / len(ws) < 0.5:
                continue
            ws = good
        elif conf < 55 and not (conf >= 35 and share(text) > 0.9 and len(text) > 20):
            continue
        said = " ".join((" ".join(w[0] for w in ws) if ws else text).split())
        if not said or share(said) < 0.55 or (len(said) < 2 and not re.search(r"\d", said)):
            continue
        if known is not None:
            toks = said.split(" ")
            wordish, longer = sum(bool(regex.search(r"\p{L}{2,}", t)) for t in toks), [t for t in toks if regex.search(r"\p{L}{3,}", t)]
            mean = sum(w[1] for w in ws) / len(ws) if ws else conf
            if (wordish >= 2 and ratio(toks) < 0.3) or (mean < 60 and len(longer) >= 3 and ratio(longer) < 0.5) or (wordish == 1 and len(toks) == 1 and ratio(toks) == 0 and conf < 60):
                continue
        out.append((said, box[0] / scale, box[1] / scale, (box[2] - box[0]) / scale, round(h / scale * 0.85, 9)))
    return sorted(out, key=lambda x: (x[2], x[1]))


def some_page(r, pool):
    lines = []
    for n in range(r.randint(0, 9)):
        tall = r.choice([10.0, 10.0, 11.0, 16.0])
        ws = [(r.choice(pool), float(r.randint(0, 100)), (k * 50.0, n * 20.0, k * 50.0 + 40, n * 20.0 + tall)) for k in range(r.randint(0, 14))]
        lines.append((" ".join(w[0] for w in ws) or "only this line", float(r.randint(20, 100)), (5.0, n * 20.0, 300.0, n * 20.0 + tall), ws or None))
    return lines


def got_lines(spark, pages, ranks=None):
    trees = spark.createDataFrame([(1, i, 2.0, [([(p,)],)]) for i, p in enumerate(pages)], TREES)
    out = {}
    for x in scans.recognised_lines(trees, ranks).orderBy("page", "line_no").collect():
        out.setdefault(x.page, []).append((x.text, x.x, x.y, x.w, round(x.size, 9)))
    return out


def test_trees_equal_a_walk(spark):
    r = random.Random(5)
    pages = [some_page(r, ["The", "house", "II", "12", "~", "|", "...", "x", "#$%", "I)C)P", "garden,", " "]) for _ in range(150)]
    got = got_lines(spark, pages)
    assert sum(map(len, got.values())) > 150
    for i, p in enumerate(pages):
        assert got.get(i, []) == plain_lines(p, 2.0), p


def test_trees_with_a_word_list(spark):
    r = random.Random(6)
    # Capitals, names and listed words: nothing that a repair would touch.
    pages = [some_page(r, ["the", "house", "GARDEN", "XQZW", "QQQQ", "Mara", "12", "water.", "~"]) for _ in range(100)]
    got = got_lines(spark, pages, spark.createDataFrame(list(RANK.items()), "word string, rank long"))
    assert sum(map(len, got.values())) > 80
    for i, p in enumerate(pages):
        assert got.get(i, []) == plain_lines(p, 2.0, RANK), p


def test_tokens_are_mended_as_far_as_they_are_unsure(spark):
    def word(t, c, k):
        return (t, c, (k * 50.0, 0.0, k * 50.0 + 40, 10.0))

    line = ("x", 90.0, (0.0, 0.0, 300.0, 10.0), [word("thc", 40.0, 0), word("gardcn", 50.0, 1), word("gardcn", 85.0, 2), word("Ofthe", 95.0, 3), word("the", 95.0, 4)])
    got = got_lines(spark, [[line]], spark.createDataFrame(list(RANK.items()), "word string, rank long"))
    assert [x[0] for x in got[0]] == ["the garden gardcn Of the the"]


def test_recognised_lines_shuffle_once(spark):
    """Words and heights are looked at inside a page; only the numbers of the lines that are left need the page's lines together."""
    word = lambda t, c=90.0, h=20.0: (t, c, (0.0, 0.0, 50.0, h))
    line = lambda y, *words: (" ".join(w[0] for w in words), 90.0, (0.0, y, 100.0, y + 20.0), list(words))
    lines = [line(60.0, word("second"), word("of"), word("two")), line(30.0, word("first"), word("line")), line(0.0, word("Title", 95.0, 40.0), word("unsure", 72.0, 40.0)), line(90.0, word("Lost", 72.0, 40.0), word("title", 72.0, 40.0)), line(120.0, word("third"), word("here"))]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    kind = f"array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,bbox:{box},words:array<struct<text:string,confidence:double,bbox:{box}>>>>>>>>"
    rows = [(1, 1, 2.0, [([(lines[:2],), (None,)],), (None,), ([(lines[2:],)],)]), (1, 2, 2.0, None)]
    got = scans.recognised_lines(spark.createDataFrame(rows, f"book int, page int, scale double, blocks {kind}"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(x.line_no, x.text, x.size) for x in got.orderBy("line_no").collect()] == [(0, "Title", 17.0), (1, "first line", 8.5), (2, "second of two", 8.5), (3, "third here", 8.5)]
