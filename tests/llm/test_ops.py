"""Each operator on small tables: defined edge cases, and brute force where SQL has no form."""

import collections
import itertools
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pagemill.llm import common, decontaminate, embeddings, linededup, lmscore, minhash, mixing, pii, token_counts, token_files, toxicity  # noqa: E402
from pagemill.llm.tokens import Encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n string, keys string"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "x", "y") for i, t, s in rows], SCHEMA)


def sample(n=60, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), f"s{i % 4}") for i in range(n)]
    for i in range(0, n, 6):  # near copies
        w = rows[i][1].split()
        if len(w) > 20:
            w[r.randrange(len(w))] = "changed"
            rows.append((1000 + i, " ".join(w), "s1"))
            rows.append((2000 + i, rows[i][1], "s2"))
    return rows + [(9001, None, "s1"), (9002, "", None), (9003, " \n\t ", "s3"), (9004, "one", None), (9005, "long " * 20000, "s0"), (9006, "one", "s0"), (9006, "one", "s0"), (None, "a b c d e f", "s0")]


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    got = common.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    want = groups({x for p in pairs for x in p}, pairs)
    got = {x.node: x.component for x in got.collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_minhash_is_exact(spark):
    rows = sample()
    out = minhash.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(sets, linked)
    for x in out:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
        else:
            assert x.component_id is None and not x.kept
    kept = [x.doc_id for x in minhash.keep_first(documents(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(i for i, _, _ in rows if i is not None and want[i] == i)
    assert None in kept
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_sketch_agrees_as_jaccard():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)]))
    same = np.mean(minhash.sketch(a, 2000) == minhash.sketch(b, 2000))
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05
    few = minhash.sketch(a[:1], 220)  # one element fills all coordinates
    assert (few != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (few == minhash.sketch(a[:1], 220)).all()


def test_toxicity(spark):
    r = random.Random(5)
    plain = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        sents = [" ".join(r.choice(plain) for _ in range(6)) for _ in range(r.randint(1, 8))]
        bad = i % 4 == 0
        if bad:
            sents[r.randrange(len(sents))] += " " + r.choice(["vile", "scum"])
        rows.append((i, ". ".join(sents) + ".", "s"))
        labels.append((i, int(bad)))
    rows += [(9001, None, "s"), (9002, "", "s"), (None, "vile", "s"), (9005, "clean word. " * 20000, "s"), (5, rows[5][1], "s")]
    lab = spark.createDataFrame([*labels, (None, 1), (77777, 1), (6, None)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, lab)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    wrong = [x.doc_id for x in out if x.doc_id in truth and (x.score >= 0.5) != bool(truth[x.doc_id])]
    assert not wrong
    for x in out:
        assert 0 <= x.score <= 1
        if x.doc_id in truth and truth[x.doc_id]:
            assert any(re.search("vile|scum", x.text[s.start : s.end]) for s in x.offending)
        if x.doc_id in (9001, 9002, 9005):
            assert x.score < 0.5
    # the score is the noisy-or of its sentences
    t = rows[4][1]
    p = [model.document(s)[0] for s in re.split(r"[.!?\n]+", t) if s]
    assert model.document(t)[0] == pytest.approx(1 - np.prod([(1 - q) / (1 - model.leak) for q in p]) * (1 - model.leak), abs=1e-9)
    kept = toxicity.filter_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(x.score < 0.5 for x in out)
    nothing = toxicity.train(docs, lab.limit(0))
    assert {x.score for x in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_mixing(spark):
    rows = sample(200)
    out = mixing.mix(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    size = collections.Counter()
    for i, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(size.values())), set(order)
    while left > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(free):
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                free.discard(s)
    for s in order:
        mine = out[out.source.isna()] if s is None else out[out.source == s]
        assert set(mine.source_size) == {size[s]}
        assert mine.target.iloc[0] == pytest.approx(target[s])
        if s == "s0":  # one document exceeds the target: the nearest sum is all the others
            assert mine["size"].max() > target[s] and mine.taken.sum() == size[s] - mine["size"].max()
        else:
            assert abs(mine.taken.sum() - target[s]) <= max(3, 0.02 * target[s])
        assert (mine.taken <= 3 * mine["size"]).all()
    again = mixing.mix(documents(spark, rows[::-1])).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, out[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))
    mixed = mixing.mixed(documents(spark, rows))
    assert mixed.columns == documents(spark, rows).columns and mixed.count() == out.copies.sum()
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).toPandas().taken.sum() == 0


def test_knapsack_closes_the_gap():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = r.integers(1, 12)
        sizes = np.unique(r.integers(1, 60, n))
        counts = r.integers(1, 30, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(r.integers(0, 3 * total + 1))
        passes, extra = mixing.fit(sizes, counts, budget)
        assert (extra >= 0).all() and (extra <= counts).all()
        got = passes * total + int((extra * sizes).sum())
        assert got <= budget and (passes < 3 or not extra.any())
        if 1 in sizes and counts[0] > 60:
            assert got == budget


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    r = random.Random(7)
    parts = ["a", "The", "hello,", "'s", "don't", "  ", " ", "\n", "\n\n", "\t", "\xa0", "é", "Éé", "ß", "İ", "Σ", "ΑΣ", "日本", "😀", "é", " ́", "12", "3.5", "<|endoftext|>", "<|startoftext|>", "...", "\x1c", "\x85", "\r\n", "'LL", "\x00", "’s"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", "x" * 3000, "word " * 5000]
    full = Tokenizer.from_file(public_tokenizers.path(name))
    for memo in (700_000, 50):
        enc = Encoder(public_tokenizers.path(name), memo=memo)
        want = [np.array(e.ids, enc.dtype).tobytes() for e in full.encode_batch(texts, add_special_tokens=False)]
        assert enc.encode(texts) == want


def test_token_files_round_trip(spark):
    rows = [(i, t, s) for i, t, s in sample()]
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = common.new_folder(spark, "t")
    manifest = token_files.write(documents(spark, rows), folder, public_tokenizers.path("word_bpe_49k.json"), length=64)
    got = [tuple(x) for x in token_files.read(spark, folder).collect()]
    want, start, flat = [], 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat.append(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    shards = sorted(manifest.collect())
    assert sum(s.n_tokens for s in shards) == start
    first = token_files.Sequences(f"{folder}/shards/{shards[0].file}")
    ids, mask = first[0]
    n = min(64, shards[0].n_tokens)
    assert ids[:n].tolist() == [x for d in flat for x in d][:n] and sum(mask.to_pylist()) == n
    empty = common.new_folder(spark, "t")
    token_files.write(documents(spark, []), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read(spark, empty).count() == 0


def test_token_writer_takes_bounded_pieces(spark, monkeypatch):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), common.new_folder(spark, "t")

    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"shard": [0], "file": [""], "n_docs": [b.num_rows], "n_tokens": [b.nbytes], "n_sequences": [0]}, schema=token_files._MANIFEST)

        return run

    with monkeypatch.context() as m:
        m.setattr(token_files, "_writer", sizes)
        docs = spark.range(16000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1000).alias("text"))
        sent = token_files.write(docs, folder, path).collect()  # 48 MB
    assert sum(x.n_docs for x in sent) == 16000 and max(x.n_tokens for x in sent) <= 1.1 * common.BATCH

    encoder, seen = Encoder(path), []
    plain = encoder.ids
    encoder.ids = lambda texts: seen.append(texts.nbytes) or plain(texts)
    monkeypatch.setattr(token_files, "shared", lambda _, memo: seen.append(memo) or encoder)
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["ab " * 1000] * 1000})
    row = next(token_files._writer(f"{folder}/one", path, 1, 64)([batch]))
    assert row.column("n_docs").to_pylist() == [1000] and row.column("n_tokens").to_pylist() == [1001 * 1000]
    assert max(seen) <= 1.1 * (1 << 20)  # bytes of text, and pieces remembered


def test_token_cache(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), common.new_folder(spark, "c")
    rows = sample()
    full = Tokenizer.from_file(path)
    for _ in range(2):
        out = token_counts.count_tokens(documents(spark, rows), path, cache).collect()
        assert sorted((x.doc_id or -1, x.n_bytes, x.n_tokens) for x in out) == sorted((i or -1, len((t or "").encode()), len(full.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    stored = spark.read.parquet(f"{cache}/{token_counts.tokenizer_digest(path)}")
    assert stored.count() == len({t or "" for _, t, _ in rows})  # the second run appended nothing
    assert token_counts.count_tokens(documents(spark, []), path, cache).count() == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_pii(spark):
    r = random.Random(3)
    parts = ["a@b.co", "x.y+z@m.example.com", "@", ".", "1.2.3.4", "300.1.1.1", "001.02.3.4", "4539 1488 0343 6467", "4539148803436467", "+1 (988) 555-2485", "+", "(", "12", "-", " ", "é", "😀", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "(988) 555-2485", "joe (at) example (dot) com", "\n", "9" * 25, "a@b.c%x@d.ee"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 7))), "s") for i in range(800)]
    rows += [(-1, None, "s"), (-2, "", "s"), (None, "a@b.co", "s"), (-3, "1" * 20000, "s"), (-4, "a" * 20000 + "@", "s"), (5, rows[5][1], "s")]
    found = pii.find(documents(spark, rows))
    from pyspark.sql import functions as F

    out = found.select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    assert len(out) == len(rows)
    text = {i: t for i, t, _ in rows}
    for x in out:
        base = [f"{k}:{m.start()}:{m.end()}" for k, p, f in PII for m in re.finditer(p, text[x.doc_id] or "") if f(m[0])]
        assert x.b == ",".join(base)
        assert set(base) <= set(x.s.split(",")) or not base
    red = spark.createDataFrame([("mail a@b.co now", [(0, 5, 11)])], "t string, s array<struct<kind:int,start:int,end:int>>")
    assert red.select(pii.redact(F.col("t"), F.col("s"))).first()[0] == "mail [email] now"
    assert pii.find(documents(spark, [])).count() == 0


def test_decontamination(spark):
    item = "Alice walks with Bob 5 miles and then Bob walks 7 miles more in 2 hours, how far"
    rows = [
        (1, "Before. " + item + " After.", "s"), (2, "nothing here to see at all my dear friend of the house", "s"), (3, item.replace("Bob", "Dan").replace("5", "6").replace("7", "8"), "s"),
        (4, "Carol walks with Dan 6 miles and then Eve walks 8 miles more in 6 hours, how far", "s"), (5, None, "s"), (6, "", "s"), (None, item, "s"), (7, "x " * 30000, "s"), (1, item, "s"), (8, " ".join(item.split()[:6]), "s"),
    ]
    bench = spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "too short", 1), (None, item, 1), (12, "", 1)], "item_id long, text string, pos int")
    docs = documents(spark, rows)
    for limit in (200_000, 0):
        got = {(x.doc_id, x.item_id): x.kind for x in decontaminate.leaks(docs, bench, broadcast_windows=limit).collect()}
        assert got == {(1, 9): "verbatim", (3, 9): "reparameterised"}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 2, 4, 5, 6, 7, 8]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_line_dedup(spark):
    page = "<html><body><ul><li>Menu</li></ul><p>Own text {i}</p><p>Twice &amp; more</p></body></html>"
    rows = [(i, "http://A.example.com/x", page.format(i=i), "z") for i in range(6)] + [(10, "http://b.example.com/", page.format(i=10), "z"), (11, None, None, "z"), (12, "nonsense", "", "z"), (0, "http://A.example.com/x", page.format(i=0), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    out = linededup.drop_boilerplate(pages).collect()
    assert len(out) == len(rows)
    by = {x.page_id: x for x in out}
    assert by[3].host == "a.example.com" and (by[3].n_lines, by[3].n_dropped, by[3].text) == (3, 2, "Own text 3")
    assert by[10].n_dropped == 0 and by[10].text == "Menu\nOwn text 10\nTwice & more"
    assert by[11].host == "" and by[11].n_lines == 0 and by[12].text == ""
    assert linededup.drop_boilerplate(pages.limit(0)).count() == 0
    # Small hosts, a line at the ratio, and a very long page.
    few = [(i, "http://c.example.com/", f"<p>own {i}</p>" + ("<p>both</p>" if i < 2 else ""), "z") for i in range(3)]
    tie = [(100 + i, "http://d.example.com/", f"<p>own {i}</p>" + ("<p>three of ten</p>" if i < 3 else "") + ("<p>four of ten</p>" if i < 4 else ""), "z") for i in range(10)]
    long = [(200, "http://e.example.com/", "".join(f"<p>line {k}</p>" for k in range(30_000)), "z")]
    pages = spark.createDataFrame(few + tie + long, "page_id long, url string, html string, lines string")
    by = {x.page_id: x for x in linededup.drop_boilerplate(pages).collect()}
    assert [by[i].text for i in range(3)] == ["own 0", "own 1", "own 2"]
    assert by[100].text == "own 0\nthree of ten" and by[103].text == "own 3"
    assert (by[200].n_lines, by[200].n_dropped) == (30_000, 0)


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * r.standard_normal((20, 16)), base[:10], 2 * base[10:15]]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "k") for i, v in enumerate(x)]
    odd = [(900, None, 0, "k"), (901, [], 0, "k"), (902, [0.0] * 16, 0, "k"), (903, [float("nan")] + [1.0] * 15, 0, "k"), (904, [None] + [1.0] * 15, 0, "k"), (905, [1.0, 2.0], 0, "k"), (None, x[0].tolist(), 0, "k"), (906, [float("inf")] * 16, 0, "k")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, key string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    u = np.concatenate([u, u[:1]])  # the vector without an id
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = groups(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(links)) if a < len(x) and b < len(x)])
    for options in ({}, {"cell_rows": 10, "block": 7}):
        out = embeddings.near_duplicates(df, **options).collect()
        assert len(out) == len(rows) + len(odd)
        got = {y.vec_id: y for y in out}
        right = sum((got[i].n_links, got[i].component_id) == (links[i].sum(), want[i]) for i in range(len(x)))
        assert right >= (0.9 if options else 1.0) * len(x)
        assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_lm_scores(spark):
    r = random.Random(8)
    rows = [(i, " ".join(("ab cd ef gh" if r.random() < 0.5 else "ij kl mn op") for _ in range(r.randint(0, 30))), "s") for i in range(200)]
    rows += [(9001, None, "s"), (9002, "", "s"), (None, "ab cd", "s"), (9003, "zz " * 30000, "s"), (1, rows[1][1], "s")]
    shape = lmscore.Shape(buckets=256, width=8, hidden=8, classes=16)
    docs = documents(spark, rows)
    hashed = lmscore.hashed(docs, shape.buckets)
    model = lmscore.train(hashed, shape, stride=2)
    out = lmscore.score(hashed, model).collect()
    assert len(out) == len(rows)
    for x in out:
        if x.doc_id in (9001, 9002):
            assert (x.n_tokens, x.log_prob, x.mean_log_prob) == (0, 0.0, None)
    own = {x.doc_id: x.ids for x in hashed.collect()}
    got = {x.doc_id: x for x in out}
    for i in (0, 3, 7):  # brute force, token by token
        ids, p, total = own[i], model.params, 0.0
        assert len(ids) == len(rows[i][1].split())
        for k, w in enumerate(ids):
            ctx = [ids[k + o] if 0 <= k + o < len(ids) else shape.buckets for o in lmscore.OFFSETS]
            h = np.tanh(np.concatenate([p["E"][c] for c in ctx]) @ p["W"] + p["b1"][0])
            z = h @ p["U"] + p["b2"][0]
            total += z[model.of[w]] - np.log(np.exp(z).sum()) + model.inside[w]
        assert got[i].n_tokens == len(ids) and got[i].log_prob == pytest.approx(total, rel=1e-4, abs=1e-4)
    flat = lmscore.Model(shape, model.params | {"U": np.zeros_like(model.params["U"])}, model.of, model.inside)
    mean = lambda m: sum(x.log_prob for x in lmscore.score(hashed, m).collect() if x.doc_id is not None and x.doc_id < 200)
    assert mean(model) > mean(flat)
    assert lmscore.score(hashed.limit(0), model).count() == 0
    assert lmscore.train_and_score(docs, shape).count() == len(rows)
    assert lmscore.train(hashed.limit(0), shape).params["E"].shape == (257, 8)


def test_lm_training_predicts_every_position(spark, monkeypatch):
    rows = [(i, f"w{i} " * (i % 23), "s") for i in range(60)]
    shape = lmscore.Shape(buckets=256, width=4, hidden=4, classes=8)
    lists = lmscore.hashed(documents(spark, rows), shape.buckets)
    phases, plain = [], lmscore._train
    monkeypatch.setattr(lmscore, "_train", lambda *a: phases.append(a[-2:]) or plain(*a))
    for options in ({}, {"stride": 1}, {"stride": 3}):
        phases.clear()
        model = lmscore.train(lists, shape, **options)
        assert all(np.isfinite(v).all() for v in model.params.values())
        seen = [at for at in range(1000) for stride, phase in phases if at % stride == phase]
        assert seen == list(range(1000))  # each position is a target once
    assert lmscore.Shape().classes >= 128


def test_decontamination_of_names_anywhere(spark):
    item = "Anna has 5 apples. Anna buys 3 more. How many apples does Anna have now?"
    plain = "Later that day the old farmer said that Clara and Edgar would carry water to the mill before supper"
    rows = [
        (1, item.replace("Anna", "Ben"), "s"), (2, item.lower(), "s"), (3, plain.lower(), "s"), (4, plain.replace(" Clara", "\nClara").replace(" Edgar", "\n(Edgar)"), "s"),
        (5, "Ünal hat: (" + item.replace("Anna", "Zoë") + ")", "s"), (6, "Ben has 5 pears. Ben sells 3 more. How long does Ben stay now?", "s"), (7, plain.upper(), "s"),
    ]
    bench = spark.createDataFrame([(20, item), (21, plain)], "item_id long, text string")
    for limit in (200_000, 0):
        got = {(x.doc_id, x.item_id): x.kind for x in decontaminate.leaks(documents(spark, rows), bench, broadcast_windows=limit).collect()}
        assert got == {(1, 20): "reparameterised", (2, 20): "verbatim", (3, 21): "verbatim", (4, 21): "verbatim", (5, 20): "reparameterised", (7, 21): "verbatim"}


def test_decontamination_drops_only_conflicts(spark):
    item = "We saw that 2 pens cost 2 dollars while Clara and her friend Edgar paid for all of them and later Clara went home to tell her mother about this long day"
    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59))
    rows = [
        (1, item.replace("2 pens", "3 pens").replace("2 dollars", "7 dollars"), "s"), (2, item.replace("cost 2", "cost 9"), "s"), (3, item.replace("later Clara", "later Maria"), "s"),
        (4, "before " + " ".join(long.split()[10:38]) + " behind", "s"), (5, " ".join(long.split()[10:22]), "s"), (6, " ".join(long.split()[10:23]), "s"),
    ]
    bench = spark.createDataFrame([(30, item), (31, long)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.kind, x.cover) for x in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 30): "reparameterised", (2, 30): "reparameterised", (3, 30): "reparameterised", (4, 31): "partial", (6, 31): "partial"}
    assert got[1, 30][1] == 1 and 0.5 <= got[3, 30][1] < 1 and got[4, 31][1] == pytest.approx(21 / 52)


def test_minhash_of_one_id_with_two_texts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    core = [word() for _ in range(60)]
    near = lambda w, at: " ".join([*w[:at], word(), *w[at + 1 :]])
    two = core[:44] + [word() for _ in range(16)]  # shares buckets with the others, but is under the threshold
    rows = [(5, near(core, 3), "s"), (5, " ".join(two), "s"), (6, near(core, 57), "s"), (7, near(two, 55), "s"), (3, " ".join(word() for _ in range(30)), "s"), (3, near(core, 30), "s")]
    rows += [(20 + i, near(core[:46] + [word() for _ in range(14)], 59), "s") for i in range(12)]
    linked = []
    for a, (i, t, _) in enumerate(rows):
        for k, u, _ in rows[:a]:
            x, y = shingles(t), shingles(u)
            linked += [(i, k)] * (i != k and 100 * len(x & y) >= 75 * len(x | y))
    want = groups({i for i, _, _ in rows}, linked)
    assert want[7] == want[6] == want[5] == 3
    for order in (rows, rows[::-1]):
        out = minhash.near_duplicates(documents(spark, order)).collect()
        assert len(out) == len(rows) and all((x.component_id, x.kept) == (want[x.doc_id], want[x.doc_id] == x.doc_id) for x in out)


@pytest.mark.parametrize("max_cells", [4096, 20])
def test_embedding_recall(spark, tmp_path, max_cells):
    """Planted pairs just above the threshold among 50,000 vectors, against brute force; with few cells, each is split again."""
    r = np.random.default_rng(9)
    x = r.standard_normal((45_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.standard_normal((5_000, 64))
    z -= (z * x[:5_000]).sum(axis=1)[:, None] * x[:5_000]
    cos = r.uniform(0.9005, 0.92, 5_000)[:, None]
    x = np.concatenate([x, cos * x[:5_000] + np.sqrt(1 - cos**2) * z / np.linalg.norm(z, axis=1)[:, None]]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = sum(int((u[k : k + 2000] @ u.T >= 0.9).sum()) for k in range(0, len(u), 2000)) - len(u)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), str(tmp_path / "v.parquet"))
    df = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)
    found = embeddings.near_duplicates(df, max_cells=max_cells, cell_rows=200).agg({"n_links": "sum"}).first()[0]
    print("recall", max_cells, found / links)
    assert 0.95 * links <= found <= links


def test_decontamination_needs_literal_words(spark):
    """Placeholders alone are no evidence; the same figures and names still are, and short items count as whole documents."""
    sums = "What is 12 + 7 - 3 + 9 * 4 - 11 + 2 - 8 * 6 ?"
    names = "Said Alice, Bob, Carol, Dave, Erin, Frank, Grace"
    bench = spark.createDataFrame([(1, "1 2 3 4 5"), (2, sums), (3, names), (4, "Why not?"), (5, "So Anna, Bob, Carol, Dave met")], "item_id long, text string")
    rows = [
        (1, "Prices were 10 20 30 40 50 in the shop", "s"), (2, "9 8 7 6 5 4 3 2 1 0 11 12 13", "s"), (3, "Here: 1 2 3 4 5.", "s"), (4, "Asked: " + sums, "s"),
        (5, "Seen Hans, Ines, Jan, Karl, Lena, Max, Nils", "s"), (6, "(" + names.lower() + ")", "s"), (7, "why NOT", "s"), (8, "why not ask", "s"), (9, "1 2 3 4 6", "s"),
    ]
    for options in ({}, {"broadcast_windows": 0, "broadcast_words": 0}):
        got = {(x.doc_id, x.item_id): (x.kind, x.cover) for x in decontaminate.leaks(documents(spark, rows), bench, **options).collect()}
        assert got == {k: ("verbatim", 1.0) for k in [(3, 1), (4, 2), (6, 3), (7, 4)]}
    only = decontaminate.leaks(documents(spark, rows), bench.where("item_id = 4"))
    assert [tuple(x) for x in only.collect()] == [(7, 4, 1.0, "verbatim")]


def test_decontamination_against_windows_by_brute_force(spark):
    """Covers of random texts over few words, every alignment tried; words are literal, numbers free."""
    r = random.Random(5)
    words = "red blue green old new tall small fast slow warm cold".split()
    draw = lambda n: [r.choice(words) if r.random() < 0.8 else str(r.randint(1, 99)) for _ in range(n)]
    items = {i: draw(r.randint(5, 30)) for i in range(12)}
    rows = []
    for d in range(60):
        own = list(r.choice(list(items.values())))
        own = [str(r.randint(1, 99)) if w.isdigit() and r.random() < 0.5 else w for w in own]
        cut = r.randint(0, len(own) // 3)
        rows.append((d, " ".join(draw(r.randint(0, 9)) + own[cut:] + draw(r.randint(0, 9))), "s"))
    shape = lambda ws: ["#" if w.isdigit() else w for w in ws]
    want = {}
    for d, text, _ in rows:
        ws = text.split()
        for i, it in items.items():
            n = min(8, len(it))
            met, run = set(), 0
            for a in range(len(it) - n + 1):
                part = it[a : a + n]
                enough = sum(not w.isdigit() for w in part) >= 3
                if any((shape(ws[b : b + n]) == shape(part)) if enough else ws[b : b + n] == part for b in range(len(ws) - n + 1)):
                    met.add(a)
            for a in range(len(it) - 12):
                run |= any(ws[b : b + 13] == it[a : a + 13] for b in range(len(ws) - 12))
            cover = len(met) / (len(it) - n + 1)
            if cover >= 0.5 or run:
                want[d, i] = round(cover, 9)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    for options in ({}, {"broadcast_windows": 0, "broadcast_words": 0}):
        got = {(x.doc_id, x.item_id): round(x.cover, 9) for x in decontaminate.leaks(documents(spark, rows), bench, **options).collect()}
        assert got == want and len(got) > 30


def test_mixing_of_repeated_ids(spark):
    """Rows of one id, of none, and equal rows are taken one by one, as many as the budget asks for."""
    rows = [(i % 2, f"w{i} " * 25, "a") for i in range(150)] + [(None, "x y z", "a")] * 160 + [(7, "one two", "b")] * 2000
    docs = documents(spark, rows).repartition(5)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows)
    by = out.groupby(out["source_size"])
    assert len(by) == 2
    for _, mine in by:
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= 2 and (mine.taken <= 3 * mine["size"]).all()
    b = out[out["size"] == 2]
    assert b.copies.nunique() == 2  # equal rows, some of them once more
    got = mixing.mixed(docs)
    assert got.count() == out.copies.sum()
    assert got.where("source = 'b'").count() == b.copies.sum()
    again = mixing.mix(docs.repartition(3)).groupBy("doc_id", "size", "copies").count().collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs).groupBy("doc_id", "size", "copies").count().collect()))


def test_fit_is_the_best_subset_sum():
    """Against all subsets of small histograms."""
    r = np.random.default_rng(6)
    for _ in range(60):
        sizes = np.unique(r.integers(1, 30, r.integers(1, 5)))
        counts = r.integers(1, 4, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(r.integers(0, 3 * total + 1))
        passes, extra = mixing.fit(sizes, counts, budget)
        best = max(p * total + sum(int(s) * k for s, k in zip(sizes, ks)) for p in range(3) for ks in itertools.product(*[range(c + 1) for c in counts]) if p * total + sum(int(s) * k for s, k in zip(sizes, ks)) <= budget)
        got = passes * total + int((extra * sizes).sum())
        assert got <= budget and best - got <= sizes.max()


@pytest.mark.parametrize("high", [300, 1 << 15, 1 << 17])
def test_lm_step_is_the_plain_gradient(high):
    """Rows of one id are summed, and a step is the one that a plain version takes."""
    r = np.random.default_rng(high)
    ids, rows = r.integers(0, high, 2000), r.standard_normal((2000, 4)).astype(np.float32)
    got, sums = lmscore._summed(ids, rows)
    want = np.zeros((high, 4))
    np.add.at(want, ids, rows)
    assert got.tolist() == sorted(set(ids.tolist())) and np.allclose(sums, want[got], atol=1e-4)

    shape = lmscore.Shape(buckets=high, width=4, hidden=6, classes=8)
    of, inside = lmscore.frequency_classes(np.bincount(ids, minlength=high), shape.classes)
    flat, at, _ = lmscore.padded(pa.array([ids[:700].tolist(), [], ids[700:].tolist()], pa.list_(pa.int32())), high)
    p = lmscore.new_params(shape)
    x = p["E"][flat[at[:, None] + np.array(lmscore.OFFSETS)]].reshape(len(at), -1).astype(float)
    h = np.tanh(x @ p["W"] + p["b1"])
    z = h @ p["U"] + p["b2"]
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(lmscore.log_probs(p, of, inside, flat, at), z[np.arange(len(at)), of[flat[at]]] + inside[flat[at]], atol=1e-4)
    dz = (np.exp(z) - np.eye(shape.classes)[of[flat[at]]]) / len(at)
    step = {k: v.copy() for k, v in p.items()}
    lmscore.train_on(step, {k: np.zeros_like(v if k != "E" else v[:, :1]) for k, v in p.items()}, of, flat, at, batch=len(at))
    g = h.T @ dz
    assert np.allclose(step["U"], p["U"] - 0.1 * g / np.sqrt(g * g + 1e-8), atol=1e-3)
