"""The pipeline against a plain version of every stage on a small corpus."""

import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from test_ops import groups, shingles  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from pagemill.llm import toxicity  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6))) for _ in range(300)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    items = [sentence(20) for _ in range(3)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(sentence(r.randint(5, 12)) for _ in range(r.randint(1, 6)))
        bad = i % 5 == 0
        if bad:
            text = text.replace(".", " vile.", 1)
        if i % 31 == 1:
            text += "\n" + items[i % 3]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, *rows[i][1:]) for i in range(1, 60, 7)] + [(5000, None, "en", "s0", 0), (5001, "", "en", None, 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def test_pipeline(spark, corpus):
    at, items = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at).persist()
        assert docs.columns == columns
        kept[name] = sorted(docs.collect(), key=lambda x: x.doc_id)

    first = sorted(spark.read.parquet(f"{at}/documents.parquet").collect(), key=lambda x: x.doc_id)
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    want = [x for x in first if model.document(x.text)[0] < 0.5]
    assert kept[names[0]] == want and not [x for x in want if "vile" in (x.text or "")] and len(want) > 150

    sets = {x.doc_id: shingles(x.text) for x in want}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = groups(sets, linked)
    want = [x for x in want if top[x.doc_id] == x.doc_id]
    assert linked and kept[names[1]] == want

    want = [x for x in want if not any(i in (x.text or "") for i in items)]
    assert kept[names[2]] == want

    mixed = kept[names[3]]
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
    total = {s: sum(size(x) for x in want if x.source == s) for s in ("s0", "s1", "s2")}
    for k, s in enumerate(("s0", "s1", "s2")):
        goal = min(3 * total[s], sum(total.values()) * (k + 1) / 6)
        assert abs(sum(size(x) for x in mixed if x.source == s) - goal) <= 0.02 * goal + 2
    assert {x.doc_id for x in mixed} <= {x.doc_id for x in want}
    assert all(sum(y == x for y in mixed) <= 3 for x in mixed)

    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, start = [], 0
    for x in sorted(mixed, key=lambda x: (x.doc_id, x.text or "")):
        ids = [*full.encode(x.text or "", add_special_tokens=False).ids, 1]
        rows.append((x.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(rows)
