"""Expected results of the reading operators on small inputs."""

import io
import math
import os
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import textsem as T
from pagemill.operators import dictionary, geometry, image, layout, library, places, repair, search, typeset
from pagemill.sources import epub, web
from pagemill.streaming import activity


def col(spark, values, fn, kind="string"):
    """fn over a column of values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_page_numbers_and_keys(spark):
    assert col(spark, ["12", " - 7 -", "Page 3 of 10", "xiv", "hal. 4", "[3]", "Chapter 1", "12345"], T.is_page_number) == [True] * 6 + [False] * 2
    assert col(spark, ["The Title 12", "the title xiv", "él iv ivé"], T.running_key) == ["thetitle#", "thetitle#", "é###é"]


def test_could_be_heading(spark):
    texts = ["The Long Way Home", "CHAPTER ONE", "Part 2", "we went to the shop and came back again", "It ended com-", "He left. She stayed behind on the old farm"]
    assert col(spark, texts, T.could_be_heading) == [True] * 3 + [False] * 3


def test_index_statistics_and_rounding(spark):
    v = [list(map(float, range(10))), [], [3.0]]
    assert col(spark, v, lambda c: T.at_rank(c, 0.8), "array<double>") == [8.0, None, 3.0]
    assert col(spark, v, lambda c: T.at_rank(c, 0.5), "array<double>") == [5.0, None, 3.0]
    assert col(spark, [-2.5, 2.5, 0.4], T.round_half_up, "double") == [-2, 3, 0]
    assert col(spark, ["Été À La", "ñandú"], T.fold) == ["ete a la", "nandu"]


def test_joined_lines(spark):
    d = docs(spark, ["a com-\nmit here\nold­\nland\nwell-\nKnown way", None, "", "   "])
    got = layout.blocks(layout.lines(d)).orderBy("doc_id", "block").collect()
    assert [r.text for r in got] == ["a commit here oldland well-Known way"]
    assert layout.char_index(layout.blocks(layout.lines(d))).first()["total"] == len(got[0].text) + 1


def test_running_lines_go(spark):
    d = docs(spark, [f"MY BOOK {i}\nbody text of page number {chr(97 + i)}\n{i}" for i in range(6)])
    kept = layout.drop_running(layout.lines(d)).collect()
    assert len(kept) == 6 and all(r.text.startswith("body") for r in kept)


def test_blocks_sections_positions(spark):
    d = docs(spark, ["Intro line ends here and is long enough.\nChapter One\nfirst words.\n* * *\nlast words.\nChapter Two\nend."])
    b = layout.blocks(layout.lines(d)).cache()
    assert [(r.t) for r in b.orderBy("block").collect()] == ["p", "h", "p", "hr", "p", "h", "p"]
    s = layout.sections(b).orderBy("start").collect()
    assert [(r.title, r.start, r.end) for r in s] == [("Start", 0, 1), ("Chapter One", 1, 5), ("Chapter Two", 5, 7)]
    at = spark.createDataFrame([(0, 0), (0, 3), (0, 6)], "doc_id long, block int")
    got = {r.block: (r.title, r.end) for r in places.chapter_at(layout.toc(b), layout.sizes(b), at).collect()}
    assert got == {0: ("", 1), 3: ("Chapter One", 5), 6: ("Chapter Two", 7)}
    p = {r.percent: r.block for r in layout.block_at_percent(layout.char_index(b), [0.0, 100.0]).collect()}
    assert p == {0.0: 0, 100.0: 6}
    many = spark.createDataFrame([(0, i, "p", "x") for i in range(7)], "doc_id long, block int, t string, text string")
    assert [(r.start, r.end) for r in layout.sections(many, 3).orderBy("start").collect()] == [(0, 3), (3, 6), (6, 7)]


def test_search(spark):
    d = spark.createDataFrame([(1, 0, "Été et été. ETE"), (1, 1, "rien"), (2, 0, "aaaa")], "doc_id long, block int, text string")
    hits = search.search(d, ["ete", "aa", "a"]).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.query, r.start, r.end) for r in hits] == [(1, "ete", 0, 3), (1, "ete", 7, 10), (1, "ete", 12, 15), (2, "aa", 0, 2), (2, "aa", 2, 4)]
    assert search.search(d, ["ete"], limit=2).count() == 2


SENTENCES = [
    ("Hello there. How are you?", 2), ("Mr. Smith went home. He slept.", 2), ("J. R. R. Tolkien wrote. Books came.", 2), ("It cost 3.50 today. Fine.", 2),
    ("Wait... what? Yes!", 2), ("“Go.” She left.", 2), ("e.g. This stays whole.", 1), ("no end", 1), ("In the U.S. Army he rose. So.", 2),
]


@pytest.mark.parametrize(("text", "n"), SENTENCES)
def test_sentences(spark, text, n):
    got = search.sentences(docs(spark, [text])).orderBy("sentence_no").collect()
    assert len(got) == n and " ".join(r.text for r in got) == text


def test_word_at(spark):
    rows = spark.createDataFrame([("don't stop", 2), ("'Hello' you", 7), ("a  b", 2), ("well-known", 0), ("x", 99)], "t string, k int")
    assert [r[0] for r in rows.select(search.word_at(F.col("t"), F.col("k"))).collect()] == ["don't", "Hello", None, "well-known", "x"]


def test_word_at_a_line_start(spark):
    """A word behind a line's end begins there."""
    rows = spark.createDataFrame([(t,) for t in ("of\nAnreti de", "of\r\nAnreti", "of\u2028Anreti", "of Anreti", "ofAnreti")], "t string").select("t", F.instr("t", "A").alias("k"))
    assert [r[0] for r in rows.select(search.word_at(F.col("t"), F.col("k") - 1)).collect()] == ["Anreti"] * 4 + ["ofAnreti"]


def ranks(spark):
    words = "the of and to in a i is it for you was on he as with they that have if this not are at by fool commit anyone do judgment attention parliament little title from home way".split()
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, rank int")


def slow_cost(a, b):
    """The same distance, straight from its definition."""
    from functools import cache

    @cache
    def d(i, j):
        if not i or not j:
            return float(i + j)
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (0 if a[i - 1] == b[j - 1] else 0.4 if a[i - 1] + b[j - 1] in repair._PAIRS else 1))
        for f, t in repair.GROUPS:
            if a[:i].endswith(f) and b[:j].endswith(t):
                best = min(best, d(i - len(f), j - len(t)) + 0.4)
        return best

    return math.inf if abs(len(a) - len(b)) > 2 else d(len(a), len(b))


def test_look_alike_costs():
    r = np.random.default_rng(1)
    letters = list("rnmcldhiuvwfteao")
    pairs = [("".join(r.choice(letters, r.integers(0, 8))), "".join(r.choice(letters, r.integers(0, 8)))) for _ in range(400)] + [("rnan", "man"), ("commil", "commit"), ("house", "table")]
    got = repair.look_alike_costs([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([slow_cost(a, b) for a, b in pairs])
    assert got[-3] == pytest.approx(0.4) and got[-2] == pytest.approx(0.4) and got[-1] >= 2


def listed(spark, text):
    return spark.createDataFrame([(w, i) for i, w in enumerate(text.split())], "word string, rank int")


def test_respelling_is_exact(spark, monkeypatch):
    """Against all pairs, with frequent and rare words."""
    monkeypatch.setattr(repair, "FREQUENT", 60)
    r = random.Random(5)
    known = sorted({"".join(r.choice("rnmcldhiuvwfteaosg") for _ in range(r.randint(1, 8))) for _ in range(400)})
    r.shuffle(known)
    damage = lambda w: w.replace("m", "rn", 1) if r.random() < 0.5 else w[:-1] + r.choice("aeiltcs")
    words = sorted({damage(w) for w in known if r.random() < 0.5} - set(known))
    want = {}
    for w in words:
        if len(w) < 3:
            continue
        most = 0.4 if len(w) <= 3 else 1.5 if len(w) <= 5 else 2.0
        firsts = repair._first_letters()[w[0]]
        costs = repair.look_alike_costs([w] * len(known), known)
        found = [(c + 0.5 * math.log10(k + 1), len(t), k, t, c) for k, (t, c) in enumerate(zip(known, costs)) if t[0] in firsts and c <= most + 1 and (c <= 1 or k <= 60)]
        found.sort()
        if found and found[0][4] <= most and (len(found) == 1 or found[1][0] - found[0][0] >= 0.4):
            want[w] = found[0][3]
    ranks = spark.createDataFrame([(w, i) for i, w in enumerate(known)], "word string, rank int")
    got = {x.word: x.fixed for x in repair.respell(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()}
    assert got == want and len(want) > 10


def test_segmentation_is_the_cheapest(spark):
    known = "the a i an he then hen on one no note to tone stone is this his hi at that hat cat catch ch"
    ranks = listed(spark, known)
    price = {w: 1 + 0.6 * math.log10(i + 1) for i, w in enumerate(known.split())}
    r = random.Random(2)
    runs = sorted({"".join(r.choice(known.split()) for _ in range(r.randint(1, 4))) for _ in range(60)} | {"xq", "z", "TheNote", "b" * 81})

    def cuts(w):
        """All cuts of a word into listed words."""
        if not w:
            return [[]]
        return [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k].lower() in price for rest in cuts(w[k:])]

    got = {x.word: x.cut for x in repair.segment_words(spark.createDataFrame([(w,) for w in runs], "word string"), ranks).collect()}
    assert set(got) == set(runs)
    for w in runs:
        ways = cuts(w) if len(w) <= 80 else []
        if not ways:
            assert got[w] is None
        else:
            assert got[w].replace(" ", "") == w
            assert sum(price[x.lower()] for x in got[w].split()) == pytest.approx(min(sum(price[x.lower()] for x in c) for c in ways))
    assert got["TheNote"] == "The Note" and got["xq"] is None


def test_letter_spacing(spark):
    ranks = listed(spark, "the ship came in on time a i harbour light at last")
    lines = ["H A R BO UR", "T H E SH I P came in", "in 1 9 0 4, they came", "I am a man", "s h i p. T H E light", "x q z w", "x qq z w", "plain", "4 2", "o n e 7 l i g h t"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, line_no int, text string")
    got = [r.repaired for r in repair.collapse_letter_spacing(rows, ranks).orderBy("line_no").collect()]
    assert got == ["HARBOUR", "THE SHIP came in", "in 1904, they came", "I am a man", "ship. THE light", "xqzw", "x qq z w", "plain", "42", "one 7 light"]
    bare = [r.repaired for r in repair.collapse_letter_spacing(rows, None).orderBy("line_no").collect()]
    assert bare == ["H A R BO UR", "T H E SH I P came in", "in 1904, they came", "I am a man", "ship. THE light", "xqzw", "x qq z w", "plain", "42", "one 7 light"]


def test_letter_spacing_stays_in_its_line(spark):
    """No token travels, and runs are cut as ``segment_words`` cuts them."""
    ranks = listed(spark, "the a i an he then hen on one no note to tone stone is this his hi at that hat cat catch ch")
    r = random.Random(8)
    words = sorted({"".join(r.choice(["the", "one", "stone", "note", "cat", "ch", "q", "This"]) for _ in range(r.randint(1, 5))) for _ in range(80)})
    cut = {x.word: x.cut for x in repair.segment_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()}
    rows = spark.createDataFrame([(1, i, f"Behold  {' '.join(w)}, I see") for i, w in enumerate(words)], "doc_id long, line_no int, text string")
    fixed = repair.collapse_letter_spacing(rows, ranks)
    assert "Exchange" not in fixed._jdf.queryExecution().executedPlan().toString()
    got = {words[x.line_no]: x.repaired for x in fixed.collect()}
    few = lambda w: sum(c not in "aAI" for c in w) < 2 or len(w) < 3
    assert got == {w: f"Behold  {' '.join(w) if few(w) else cut[w] or w}, I see" for w in words} and sum(v is not None for v in cut.values()) > 20


def test_trim_reads_the_ends_only():
    assert all(re.fullmatch(r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", c) for c in T.BLANKS) and len(T.BLANKS) == len(set(T.BLANKS)) == 25


def test_pages_of_fragments_stay_in_their_rows(spark):
    """Lines longer than a stretch, drifting baselines, and no shuffle."""
    r = random.Random(4)
    said = [(base + r.uniform(-2, 2), [f"w{k}" for k in range(n)]) for base, n in ((100.0, 300), (120.0, 1), (140.0, 128), (160.0, 257))]
    each = [(n * 1000 + k, w, [11.0, 0.0, 0.0, 11.0, 10.0 * k, 500.0 - base + r.uniform(-1, 1)], 4.0, 500.0) for n, (base, words) in enumerate(said) for k, w in enumerate(words)]
    r.shuffle(each)
    kind = "array<struct<seq:long,str:string,transform:array<double>,width:double,page_height:double>>"
    pages = spark.createDataFrame([(1, 1, each), (1, 2, []), (1, 3, None)], f"book int, page int, fragments {kind}")
    lines = geometry.assemble_pages(pages)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [(x.page, x.line_no, x.text) for x in lines.orderBy("page", "line_no").collect()] == [(1, n, " ".join(words)) for n, (_, words) in enumerate(said)]
    rows = [[list(range(1, 400)), [], [5]], [], None, [[7, 1]]]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<array<int>>").select("i", geometry.sums_before(F.col("v")).alias("s")).orderBy("i").collect()
    assert [x.s for x in got] == [v and [[sum(w[:k]) for k in range(len(w))] for w in v] for v in rows]


def test_text_quality_reads_a_text_once(spark):
    """Words between white space of all kinds, marks at their edges only; one shuffle, of counts."""
    known = listed(spark, "the cat sat")
    texts = ["(the) CAT\u00a0sat\u3000zzz don't \u200athe2 --the-- ((((", None, "", "a b c dd", "a b c dd\nt, h: e. xyz\n\u2003a\u2003b c", "#### ab #"]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    quality = dictionary.text_quality(rows, known, keep=("source",))
    assert quality._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.doc_id: (r.words, round(r.unknown_ratio, 3), r.letter_spaced, round(r.junk_ratio, 3), r.source) for r in quality.collect()}
    whole = "".join(texts[0].split(" "))
    assert got[0] == (6, 0.167, 0, round((whole.count("\u00a0") + whole.count("\u3000") + whole.count("\u200a")) / len(whole), 3), "s")
    assert got[1] == got[2] == (0, 0.0, 0, 0.0, "s") and got[3][:3] == (0, 0.0, 1) and got[4][:3] == (1, 1.0, 3) and got[5] == (0, 0.0, 0, round(5 / 7, 3), "s")


def test_glued_and_broken(spark):
    known = listed(spark, "the of a to if you not are bell tower carpet car pet her stone")
    words = spark.createDataFrame([(x,) for x in ("thebell", "Ifyou", "Thetower", "qqq")], "word string")
    got = {r.word: r.split for r in dictionary.split_glued(words, known).collect()}
    assert got == {"thebell": "the bell", "Ifyou": "If you", "Thetower": "The tower"}
    joined = dictionary.join_broken(docs(spark, ["the Car pet of her", "bell tow er her"]), known).collect()
    assert sorted(r.joined for r in joined) == ["tower"]


def test_tokens_repaired(spark):
    known = listed(spark, "the of bell harbour tower lantern to")
    toks = spark.createDataFrame([(t,) for t in ["(thebell,", "harhour;", "tower.", "NASAX", "Qwerty", "x1y2", "ab", "lanlern", "--"]], "token string")
    got = {r.token: r.repaired for r in repair.repair_tokens(toks, known).collect()}
    assert got == {"(thebell,": "(the bell,", "harhour;": "harbour;", "tower.": "tower.", "NASAX": "NASAX", "Qwerty": "Qwerty", "x1y2": "x1y2", "ab": "ab", "lanlern": "lantern", "--": "--"}
    sure = {r.token: r.repaired for r in repair.repair_tokens(toks, known, conf=85).collect()}
    assert sure["harhour;"] == "harhour;" and sure["(thebell,"] == "(the bell,"
    assert [repair_case[0] for repair_case in spark.createDataFrame([("ABC", "def"), ("Abc", "def"), ("abc", "def"), ("A", "x")], "a string, b string").select(repair.match_case(F.col("a"), F.col("b"))).collect()] == ["DEF", "Def", "def", "X"]


def test_places(spark):
    entries = spark.createDataFrame([(1, 0, "One", 2, 0), (1, 1, "One a", 4, 1), (1, 2, "One b", 6, 1), (1, 3, "Two", 9, 0)], "doc_id long, toc_no int, title string, block int, level int")
    size = spark.createDataFrame([(1, 12), (2, 3)], "doc_id long, n int")
    at = spark.createDataFrame([(1, b) for b in (0, 2, 3, 5, 6, 9, 11)] + [(2, 1)], "doc_id long, block int")
    got = {(r.doc_id, r.block): (r.title, r.end) for r in places.chapter_at(entries, size, at).collect()}
    assert got == {(1, 0): ("", 2), (1, 2): ("One", 9), (1, 3): ("One", 9), (1, 5): ("One a", 6), (1, 6): ("One b", 9), (1, 9): ("Two", 12), (1, 11): ("Two", 12), (2, 1): ("", 3)}
    text = "  First one. Then  a second!\nNo stop"
    spans = search.sentences(docs(spark, [text])).orderBy("sentence_no").collect()
    assert [(s.start, s.end, text[s.start : s.end]) for s in spans] == [(2, 12, "First one."), (13, 28, "Then  a second!"), (29, 36, "No stop")]
    asked = spark.createDataFrame([(0, k) for k in (0, 2, 12, 20, 35, 99)], "doc_id long, place long")
    assert {r.place: r.sentence_no for r in places.sentence_at(search.sentences(docs(spark, [text])), asked).collect()} == {2: 0, 20: 1, 35: 2}
    rows = spark.createDataFrame([(0, 0, "Go on. Stop."), (0, 1, ""), (0, 2, "Last.")], "doc_id long, block int, text string")
    cursor = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 0, 6), (0, 0, 12), (0, 2, 5)], "doc_id long, block int, offset long")
    said = places.speech_from(search.sentences(rows, ("doc_id", "block")), cursor).collect()
    assert {(r.block, r.offset): (r.said, r.start, r.end) for r in said} == {(0, 0): (0, 0, 6), (0, 3): (0, 3, 6), (0, 6): (0, 7, 12), (0, 12): (2, 0, 5)}
    opened = spark.createDataFrame([(3, 1, 5), (9, 1, 5), (None, 7, 5), (None, 0, 0)], "m int, p int, n int")
    assert [r[0] for r in opened.select(places.open_position(F.col("m"), F.col("p"), F.col("n"))).collect()] == [3, 1, 4, 0]


def test_more_library_rules(spark):
    assert col(spark, [["a", "en"], ["a"]], lambda c: library.toggled(c, F.lit("en")), "array<string>") == [["a"], ["a", "en"]]
    assert col(spark, [None, "to-read", "none", "read"], library.status_after_reading) == ["reading", "reading", "reading", "read"]
    calls = spark.createDataFrame([(None, None), (429, None), (503, None), (404, None), (200, None), (200, 3)], "s int, b int")
    assert [r[0] for r in calls.select(library.retryable(F.col("s"), F.col("b"))).collect()] == [True, True, True, False, True, False]
    assert col(spark, ["sí", "one two"], lambda c: library.lookup_url(c, F.lit("es-MX"))) == ["https://es.wiktionary.org/wiki/s%C3%AD", "https://www.google.com/search?q=define%20one%20two"]
    assert col(spark, ['x ```json\n{"a":1}\n``` y', 'so {"a":{}} it', "none"], lambda c: T.trim(geometry.json_in(c))) == ['{"a":1}', '{"a":{}}', "none"]
    assert col(spark, ["a" * 39, "a " * 40, None], geometry.page_state) == ["pending", "text", "pending"]
    shelves = spark.createDataFrame([(b, f"t{b}", "x" if b % 2 else " ") for b in (1, 3, 99_999, 100_001, 4)], "book_id long, title string, author string")
    got = {r.book_id: (r.author, r.place, r.n) for r in library.by_author(shelves).collect()}
    assert got == {1: ("x", 1, 4), 3: ("x", 2, 4), 99_999: ("x", 3, 4), 100_001: ("x", 4, 4), 4: ("Unknown author", 1, 1)}


def test_library_rules(spark):
    rows = spark.createDataFrame([(None, 0.99, 5), (None, 0.5, 5), (None, 0.5, 0), ("to-read", 1.0, 5)], "s string, p double, l long")
    assert [r[0] for r in rows.select(library.status_of(F.col("s"), F.col("p"), F.col("l"))).collect()] == ["read", "reading", "none", "to-read"]
    calls = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([False] * 3 + [True] + [False] * 4 + [True])], "key long, seq long, ok boolean")
    got = library.failure_streaks(calls).orderBy("seq").collect()
    assert [r.streak for r in got] == [1, 2, 3, 0, 1, 2, 3, 4, 0] and [r.open for r in got] == [False] * 7 + [True] * 2
    assert col(spark, [0.5, 5.4, 60.0, 125.0], library.format_minutes, "double") == ["less than a minute", "5 min", "1 h", "2 h 5 min"]
    assert col(spark, [None, 5.0, 120.0, 7300.0, 90000.0, 200000.0], library.time_ago, "double") == ["Not started", "Just now", "2 min ago", "2 h ago", "Yesterday", "2 days ago"]
    base = F.lit("OEBPS/text/a.xhtml")
    assert col(spark, ["../img/x.png", "b%20c.xhtml#n", "#f", "/top.html", "a+b"], lambda c: library.resolve_path(base, c)) == ["OEBPS/img/x.png", "OEBPS/text/b c.xhtml#n", "OEBPS/text/a.xhtml#f", "top.html", "OEBPS/text/a+b"]
    assert col(spark, ["#ffffff"], lambda c: F.round(library.contrast_ratio(c, F.lit("#000000")), 2)) == [21.0]
    assert col(spark, ["<i>Hello a</i>"], library.bold_starts) == ['<i><b class="bs">Hel</b>lo a</i>']
    assert col(spark, [[1.0, 2.0], [], [4.0]], library.ewma, "array<double>") == [pytest.approx(1.15), None, 4.0]
    outcome = spark.createDataFrame([(90, None, 100, True), (10, None, 100, True), (None, 50, 0, True), (None, None, 9, True), (None, None, None, False), (None, None, None, True)], "a int, b int, s int, c boolean")
    assert [r[0] for r in outcome.select(library.page_outcome(*map(F.col, "absc"))).collect()] == ["first", "kept-scanner-text", "second", "kept-scanner-text", "needs-consent", "on-device"]


def test_web_blocks(spark):
    html = '<html><head><title>x</title></head><body><h1 id="t">A &amp; B</h1><p>one<br>two<p>three</p><ol start="3"><li>x</li><li>y</li></ol><table><tr><td>a</td><td>b</td></tr></table><script>var t="</p>";</script><blockquote><p>q</p></blockquote><hr/><img src="i.png" alt="z"><pre> k\n  l</pre></body></html>'
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = [(r.t, r.text, r.level, r.marker) for r in web.html_blocks(rows).orderBy("block").collect()]
    assert got == [("h", "A & B", 0, None), ("p", "one two", 0, None), ("p", "three", 0, None), ("li", "x", 0, "3."), ("li", "y", 0, "4."), ("p", "a | b", 0, None), ("quote", "q", 0, None), ("hr", "", 0, None), ("img", "z", 0, None), ("pre", " k\n  l", 0, None)]
    assert {(r.id, r.block) for r in web.anchors(web.html_blocks(rows)).collect()} == {("t", 0), ("", 0)}


def archive(extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/c.opf",
            '<package xmlns="u" xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="o%20ne.xhtml" media-type="application/xhtml+xml"/><item id="c" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>',
        )
        z.writestr("OEBPS/o ne.xhtml", "<body><p>first</p></body>")
        z.writestr("OEBPS/two.xhtml", "<body><p>second</p></body>")
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def test_epub_source(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(archive())
    (tmp_path / "b.epub").write_bytes(archive({"META-INF/rights.xml": "<r/>"}))
    (tmp_path / "c.epub").write_bytes(b"broken")
    rows = {(os.path.basename(r.path), r.spine): r for r in epub.read_epubs(spark, str(tmp_path)).collect()}
    assert rows[("a.epub", 0)].html.startswith("<body><p>first") and rows[("a.epub", 1)].title == "T" and len(rows) == 4
    assert rows[("b.epub", None)].error == "protected" and rows[("c.epub", None)].error


def test_geometry(spark):
    m = lambda x, y: [11.0, 0.0, 0.0, 11.0, x, y]
    f = spark.createDataFrame(
        [("b", 1, 0, "Hello", m(50.0, 500.0), 30.0, 600.0), ("b", 1, 1, "world", m(84.0, 500.5), 30.0, 600.0), ("b", 1, 2, "next", m(50.0, 485.0), 24.0, 600.0)],
        "book string, page int, seq int, str string, transform array<double>, width double, page_height double",
    )
    got = geometry.assemble_lines(f).orderBy("line_no").collect()
    assert [r.text for r in got] == ["Hello world", "next"] and got[0].w == pytest.approx(64.0)
    lines = spark.createDataFrame([("b", 1, f"some words {i}", 50.0, 100.0 + 15 * i, 300.0, 11.0) for i in range(6)] + [("b", 2, "Few", 150.0, 60.0, 100.0, 18.0)], "book string, page int, text string, x double, y double, w double, size double")
    lines = lines.selectExpr("*", "'text' AS origin", "400.0D AS page_width", "int(y) AS line_no")
    stats = {r.page: r for r in typeset.page_stats(lines).collect()}
    assert (stats[1].body, stats[1].left, stats[1].width, stats[1].spacing) == (11.0, 50.0, 300.0, 15.0) and stats[2].left == 50.0
    j = spark.createDataFrame([("b", 1, '{"blocks":[{"type":"heading","text":"T"},{"type":"scene_break"},{"type":"paragraph","text":"p  q"},{"type":"paragraph","text":" "}]}')], "book string, page int, json string")
    t = geometry.transcribed_lines(j).orderBy("line_no").collect()
    assert [(r.text, r.y, r.kind) for r in t] == [("T", 40.0, "h"), ("* * *", 72.0, "hr"), ("p q", 102.0, "p")]


def picture(angle):
    g = np.full((800, 600), 200, np.uint8)
    for y in range(60, 740, 30):
        g[y : y + 8, 60:540] = 90
    return image.rotate(g, -angle) if angle else g


@pytest.mark.parametrize("angle", [-3.0, -1.2, 0.0, 2.0])
def test_skew(angle):
    flat = picture(angle)
    flat = np.where(flat == 255, 200, flat).astype(np.uint8)
    assert abs(abs(image.skew(image.stretch(flat))) - abs(angle)) <= 0.3


def test_image_chain(spark):
    g = picture(0)
    assert set(np.unique(image.stretch(g))) == {0, 255}
    rows = spark.createDataFrame([(bytearray(g.tobytes()), 600, 800)], "data binary, width int, height int")
    out = image.preprocess(rows).select("cleaned.data", "cleaned.angle").first()
    black = np.frombuffer(bytes(out[0]), np.uint8).reshape(800, 600) == 0
    assert abs(out[1]) <= 0.1 and black[62, 300] and not black[45, 300]
    assert (image.to_gray(np.full((2, 2, 4), 255, np.uint8)) == 255).all()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 1L AS key, id AS seq, id NOT IN (1, 2, 3, 4) AS ok FROM range(6)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key long, seq long, ok boolean").parquet(src)
    q = activity.breaker(stream).writeStream.format("memory").queryName("calls").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.streak, r.open) for r in spark.table("calls").orderBy("seq").collect()] == [(0, False), (1, False), (2, False), (3, False), (4, True), (0, True)]
    ev = str(tmp_path / "ev")
    spark.sql("SELECT 7L AS user_id, timestamp_seconds(1700000000 + t) AS ts FROM VALUES (0), (60), (100), (1000), (1030), (99999) AS v(t)").coalesce(1).write.parquet(ev)
    s = activity.reading_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(ev))
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seconds for r in spark.table("sessions").collect()) == [30, 100]
    pg = str(tmp_path / "pages")
    spark.sql("SELECT 'b' AS book, 1 AS page, 'old' AS text UNION ALL SELECT 'b', 2, 'two'").coalesce(1).write.parquet(pg)
    built = []
    q = activity.rebuild_on_arrival(spark.readStream.schema("book string, page int, text string").parquet(pg), str(tmp_path / "store"), lambda df: built.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert built == [2]


def test_content(spark):
    from pagemill.operators import content

    rows = spark.createDataFrame([("Real Title", "a.pdf"), ("untitled", "my_book-2.PDF"), ("x.indd", ".pdf"), (None, "b.epub")], "m string, f string")
    assert [r[0] for r in rows.select(content.title_of(F.col("m"), F.col("f"))).collect()] == ["Real Title", "my book 2", "Untitled", "b"]
    old = spark.createDataFrame([("a", 1, "x"), ("ab", 1, "y")], "book_id string, v int, t string")
    new = content.upsert(old, spark.createDataFrame([("a", 2, "z")], old.schema), ["book_id"], "v")
    assert sorted((r.book_id, r.t) for r in new.collect()) == [("a", "z"), ("ab", "y")]
    assert [r.book_id for r in content.delete_books(new, spark.createDataFrame([("a",)], "book_id string")).collect()] == ["ab"]
    blocks = spark.createDataFrame([(0, 0, "footnote", ["n1"]), (0, 1, "footnote", []), (0, 2, "footnote", ["n2"]), (0, 3, "footnote", [])], "doc_id long, block int, cls string, ids array<string>")
    notes = spark.createDataFrame([(0, 0), (0, 2)], "doc_id long, note int")
    assert sorted((r.note, r.block) for r in content.footnote_of(blocks, notes).collect()) == [(0, 0), (0, 1), (2, 2), (2, 3)]
    lines = spark.createDataFrame([(0, 0, "we com-"), (0, 1, "mit to it"), (0, 2, "well-"), (0, 3, "xq z")], "doc_id long, line_no int, text string")
    assert [r.text for r in content.mend_hyphens(lines, ranks(spark)).orderBy("line_no").collect()] == ["we commit", "to it", "well-", "xq z"]
    index = spark.createDataFrame([(0, 0, 0, 100), (0, 1, 40, 100), (0, 2, 80, 100)], "doc_id long, block int, chars_before long, total long")
    assert content.reposition(index, spark.createDataFrame([(0, 0.5)], "doc_id long, progress double")).first()["block"] == 1
