"""Centroid clustering, byte-level BPE and periodic runs: edge cases and brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pagemill.llm import bytebpe, clusters, runs  # noqa: E402

SCHEMA = "doc_id long, text string, ids string, runs string, n_tokens string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n", "  a", "a  ", "a  b\n\nc", "<|endoftext|>", "don't 'S 's", "café naïve ß 中文字 日本 😀👩‍👩‍👧", " x y", "१२३ ½", "\x00\x01﻿", "a" * 5000, "long " * 30000, " " * 400 + "x"]


def texts(n, seed):
    r = random.Random(seed)
    pool = ["the", "and", "über", "ção", "中文", "😀", "x1", "'ll", "...", "\n", "  ", "\t", "Ж", "é", "é", "₂", " "]
    return ODD + ["".join(r.choice(pool) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def tiktoken_ids(text):
    import tiktoken

    ranks = bytebpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary(text), own


def test_bpe_equals_tiktoken_and_comes_back(spark):
    rows = list(enumerate(texts(150, 1)))
    rows += [(None, "no id"), (3, rows[9][1])]  # a null id, and one id with two texts
    out = bytebpe.decode(bytebpe.encode(docs(spark, rows), RANKS), RANKS).collect()
    assert len(out) == len(rows)
    _, own = tiktoken_ids("")
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in out)
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i is None, i or 0, np.array(ids, "<u4").tobytes(), len(ids), (t or "").encode()))
    assert got == sorted(want)


def test_bpe_spans_are_the_librarys(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(bytebpe.specification(RANKS))
    rows = list(enumerate(texts(60, 2)))
    out = {r.doc_id: r for r in bytebpe.encode(docs(spark, rows), RANKS, spans=True).collect()}
    for i, t in rows:
        told = own.encode(t or "", add_special_tokens=False)
        assert list(zip(out[i].starts, out[i].ends)) == [tuple(x) for x in told.offsets], t


def test_bpe_streams_hold_back_split_characters():
    ids, own = tiktoken_ids("a 🦄𓂀 b 中龘")
    assert any(len(own.decode_single_token_bytes(i)) < 3 and own.decode_single_token_bytes(i)[0] > 127 for i in ids)
    parts = list(bytebpe.decode_stream([[i] for i in ids], RANKS))
    assert "".join(parts) == "a 🦄𓂀 b 中龘" and not any("�" in p for p in parts)
    assert list(bytebpe.decode_stream([ids[:-1]], RANKS))[-1] in ("", "�")


def test_bpe_merges_need_not_be_listed_in_order(tmp_path):
    # "abc" is "a" + "bc" here: the pair that the ranks join last.
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc"]
    ranks = {t: i for i, t in enumerate(tokens)}
    assert bytebpe.last_pair(b"abc", ranks) == (b"a", b"bc")
    (tmp_path / "r.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    assert bytebpe.Codec(bytebpe.specification(str(tmp_path / "r.tiktoken"))).encode(["abcab"])[0] == np.array([258, 257], "<u4").tobytes()


def test_bpe_of_no_rows(spark):
    assert bytebpe.decode(bytebpe.encode(docs(spark, []), RANKS), RANKS).collect() == []


def plain_runs(w):
    """All runs by trying every period at every place."""
    seen, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                seen.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in seen.items())


def repetitive(seed, count):
    r, out = random.Random(seed), []
    for _ in range(count):
        k, w = r.randint(1, 4), []
        for _ in range(r.randint(0, 6)):
            piece = [r.choice("abcd"[:k]) for _ in range(r.randint(1, 12))]
            w += (piece * r.randint(1, 8))[: r.randint(1, 70)]
        out.append(" ".join(w))
    return out


def test_runs_equal_all_periods_tried(spark):
    rows = list(enumerate(repetitive(5, 300)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "a " * 40_000), (904, "a b " * 6), (905, "x y\tx\ny x y  x y"), (None, "z z z z z z"), (905, "x y\tx\ny x y  x y")]
    out = runs.periodic_runs(docs(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, [(x.start, x.period, x.length) for x in r.runs], r.collapsed, r.n_words) for r in out), key=key)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain_runs(w) if len(w) < 10_000 else [(0, 1, len(w))]
        gone = {k for s, q, n in found for k in range(s + q, s + n)}
        want.append((i, found, " ".join(x for k, x in enumerate(w) if k not in gone), len(w)))
    assert got == sorted(want, key=key)
    assert runs.periodic_runs(docs(spark, [])).collect() == []


def test_runs_of_other_lengths():
    for least, times in ((3, 3), (9, 5)):
        for t in repetitive(6, 60):
            w = np.array([ord(x) for x in t.split()], np.int64)
            got = [tuple(map(int, x)) for x in zip(*runs.find_runs(w, np.array([0, len(w)]), least=least, times=times)[1:])]
            want = {}
            for q in range(1, len(w) // times + 1):
                i = q
                while i < len(w):
                    j = i
                    while j < len(w) and w[j] == w[j - q]:
                        j += 1
                    if j - i + q >= max(least, times * q):
                        want.setdefault((i - q, j - i + q), q)
                    i = max(j, i + 1)
            assert got == sorted(((s, n, q) for (s, n), q in want.items()), key=lambda x: (x[0], x[2]))
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(4, np.int64), np.array([0, 4]), times=2)


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x) < 1e4 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    c = np.stack([v for _, v in order[:k]])
    x = np.stack([v for _, v in kept])

    def near():
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = near()
        for j in set(own.tolist()):
            c[j] = x[own == j].sum(axis=0) // (own == j).sum()
    own, d = near()
    return sorted(((i is None, i or 0, int(j), int(y)) for (i, _), j, y in zip(kept, own, d))), c


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<float>, cluster string, v string")


def test_clusters_equal_all_distances(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=5) + 3 * (i % 7)).round(2).tolist()) for i in range(400)]
    rows += [(500 + i, [0.0] * 5) for i in range(60)]  # ties and equal vectors
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, [1.0] * 5)]
    rows += [(601, None), (602, []), (603, [1.0] * 4), (604, [1.0, None, 0.0, 0.0, 0.0]), (605, [float("nan")] + [0.0] * 4), (606, [float("inf")] + [0.0] * 4), (607, [1e30] + [0.0] * 4)]
    for k in (1, 12, 600):
        out, c = clusters.cluster(vectors(spark, rows), k=k, rounds=3, dim=5, pivots=3)
        want, centroids = plain_clusters(rows, k, 3, 5)
        assert sorted((x.vec_id is None, x.vec_id or 0, x.cluster, x.distance) for x in out.collect()) == want
        assert (c == centroids).all()


def test_clusters_near_their_pivots_skip_distances():
    r = np.random.default_rng(4)
    c = (r.normal(size=(30, 8)) * 2000).astype(np.int64)
    x = c[r.integers(0, 30, 3000)] + r.integers(-50, 50, (3000, 8))
    fixed = clusters.far_apart(c, 8)
    own, d, taken = clusters.nearest(x, clusters._roots(x, fixed), c, fixed)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert taken < 0.1 * every.size


def test_clusters_of_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        out, c = clusters.cluster(vectors(spark, rows), dim=5)
        assert clusters.with_inertia(out, c).collect() == [] and len(c) == 0
