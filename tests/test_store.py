"""Stored books in versions, places kept over a rebuild, and rebuild triggers."""

import os
import random

from pagemill.operators import library
from pagemill.sources import library_store
from pagemill.streaming import activity

SCHEMA = "book long, block int, text string"


def rows(spark, books):
    return spark.createDataFrame([(b, i, t) for b, texts in books.items() for i, t in enumerate(texts)], SCHEMA)


def now(spark, path, upto=None):
    out = {}
    for r in library_store.current(spark, path, SCHEMA, upto).orderBy("book", "block").collect():
        out.setdefault((r.book, r.epoch), []).append(r.text)
    return out


def test_versions_and_reruns(spark, tmp_path):
    path = str(tmp_path / "library")
    library_store.put(rows(spark, {1: ["a", "b"], 2: ["c"], 3: ["d"]}), path, 1)
    library_store.put(rows(spark, {1: ["x"], 4: ["new"]}), path, 2)
    library_store.remove(rows(spark, {2: ["c"], 9: ["never there"]}), path, 2)
    want = {(1, 2): ["x"], (3, 1): ["d"], (4, 2): ["new"]}
    assert now(spark, path) == want
    assert now(spark, path, upto=1) == {(1, 1): ["a", "b"], (2, 1): ["c"], (3, 1): ["d"]}
    for _ in range(2):
        library_store.put(rows(spark, {1: ["x"], 4: ["new"]}), path, 2)
        library_store.remove(rows(spark, {2: ["c"]}), path, 2)
    assert now(spark, path) == want
    library_store.put(rows(spark, {2: ["back"]}), path, 3)
    assert now(spark, path) == want | {(2, 3): ["back"]}
    library_store.remove(rows(spark, {2: ["c"]}), path, 3)
    assert now(spark, path) == want


def test_places_keep_their_share(spark):
    old = {1: ["aaaa", "bbbb", "cccc", "dddd"], 2: ["one", "two"], 3: ["x"]}
    new = {1: ["aaaa bbbb", "cccc dddd"], 2: ["one", "and a half", "two"]}
    places = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (1, 2, "r"), (1, 3, "s"), (2, 1, "t"), (3, 0, "gone")], "book long, block int, reader string")
    index = [library_store.char_index(rows(spark, x)) for x in (old, new)]
    got = {r.reader: r.block for r in library_store.places_kept(*index, places).collect()}
    assert got == {"p": 0, "q": 0, "r": 1, "s": 1, "t": 1}


def plain(steps):
    state, out = {}, []
    for key, seq, kind in sorted(steps):
        done, since = state.get(key, (0, 0))
        page = kind == "page"
        done, since = done + page, since + page
        rebuild = not page or done <= 3 or since >= 4
        state[key] = (done, 0 if rebuild else since)
        out.append((key, seq, done, rebuild))
    return out


def steps(seed=2):
    r = random.Random(seed)
    return [(k, s, "page" if r.random() < 0.85 else r.choice(["paused", "cancelled", "finished"])) for k in range(6) for s in range(r.choice([1, 3, 40]))]


def test_triggers_equal_a_walk(spark):
    got = library.rebuild_triggers(spark.createDataFrame(steps(), "key long, seq long, kind string")).collect()
    assert sorted(map(tuple, got)) == plain(steps())
    assert [s for _, s, _, b in plain([(0, s, "page") for s in range(1, 16)]) if b] == [1, 2, 3, 7, 11, 15]


def test_triggers_as_a_stream(spark, tmp_path):
    every = steps(3)
    for n in range(4):
        part = [x for x in every if x[1] // 10 == n]
        spark.createDataFrame(part, "key long, seq long, kind string").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        for f in (tmp_path / f"w{n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
            f.rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema("key long, seq long, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = activity.rebuilds(stream).writeStream.format("memory").queryName("rebuilds").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("rebuilds").collect())) == plain(every)


def test_what_is_shown_of_a_book(spark):
    from pyspark.sql import functions as F

    from pagemill.operators import content

    df = spark.createDataFrame([(50, 40, 80, 1, 4, 100), (50, 40, 80, 3, 4, 100), (50, 40, 80, 0, 1, 100), (0, 0, 0, 0, 1, 0)], "c long, a long, b long, page int, pages int, total long")
    here = content.shown(*[F.col(x) for x in ("c", "a", "b", "page", "pages")])
    got = df.select(here.alias("here"), content.progress(here, F.col("total")).alias("p"), content.minutes_left(here, F.lit(3000)).alias("m")).collect()
    assert [tuple(r) for r in got] == [(50.0, 0.5, 2950 / 1500), (70.0, 0.7, 2930 / 1500), (50.0, 0.5, 2950 / 1500), (0.0, 0.0, 2.0)]
    scale = df.limit(1).select(content.render_scale(F.lit(612.0), F.lit(792.0)).alias("a"), content.render_scale(F.lit(3000.0), F.lit(4000.0)).alias("b"), content.render_scale(F.lit(900.0), F.lit(1200.0), False).alias("c")).first()
    assert abs(scale.a - (8.5e6 / (612 * 792)) ** 0.5) < 1e-12 or scale.a == 300 / 72
    assert scale.b == 1.0 and abs(scale.c - (5e6 / 1.08e6) ** 0.5) < 1e-12
