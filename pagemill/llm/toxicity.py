"""Toxicity by multiple-instance learning.

Only whole documents carry a label.  A document is a bag of sentences; a
sentence has a logistic score over the words it holds, and the document's
probability is the noisy-or of its sentences and of a leak that stands for
label noise::

    P(toxic | doc) = 1 - (1 - leak) * prod_s (1 - sigmoid(bias + sum_w weight[w]))

The weights are fitted to the document labels alone; the same weights then
score each sentence, which locates the offending ones.

Learning reads at most ``sample_rows`` labelled rows (chosen by a hash of the
id).  Scoring reads every whole text and grows with the input; only the model,
at most ``max_words`` weights, is sent to the tasks.

Defined cases: a very long text is scored whole, sentence by sentence; words that
tell the classes apart equally well are taken in alphabetical order; a null or empty text has no sentence and gets the leak as its
score; a null ``doc_id`` is scored and never learnt from; repeated rows get the
same score each; labels that contradict each other for one id count as toxic;
with no labelled rows at all the score is 0.0 for every text; extra columns
are ignored by the scorer and kept by ``filter_toxic``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import held_out

_SENTENCE = re.compile(r"[^.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A word's stem is a feature too, so that an unseen form of a known stem counts.
STEM = 5

SCORES = "score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"


def features(text: str) -> set[str]:
    """The lower-case words of a text and their stems, the latter marked by ``^``."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class Model:
    bias: float = -float("inf")
    leak: float = 0.0
    weights: dict = field(default_factory=dict)

    def document(self, text: str | None) -> tuple[float, int, list[dict]]:
        """Score, number of sentences, and the sentences at or above 0.5 (code points)."""
        if not text:
            return self.leak, 0, []
        n = sum(1 for _ in _SENTENCE.finditer(text))
        plain, log_not, found = n, float(np.log1p(-self.leak)), []
        if not self.weights.keys().isdisjoint(features(text)):
            for m in _SENTENCE.finditer(text):
                ws = features(m[0]) & self.weights.keys()
                if ws:
                    z = self.bias + sum(self.weights[w] for w in sorted(ws))
                    plain -= 1
                    log_not -= float(np.logaddexp(0, z))
                    if z >= 0:
                        found.append({"start": m.start(), "end": m.end(), "score": float(1 / (1 + np.exp(-z)))})
        log_not -= max(plain, 0) * float(np.logaddexp(0, self.bias))
        return float(-np.expm1(log_not)), n, found


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` labelled rows outside the held-out fold: text, toxic."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # Bounded by sample_rows, so it can be sent to every task.
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic").distinct()


def _screen(sample: DataFrame, max_words: int, min_z: float) -> tuple[list[str], int, int]:
    """The words whose document frequencies differ between the classes."""
    n = sample.groupBy("toxic").count().collect()
    pos, neg = (sum(r["count"] for r in n if (r["toxic"] == 1) == t) for t in (True, False))
    if not pos or not neg:
        return [], pos, neg
    least = max(4, (pos + neg) // 1000)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM)))
    words = (
        sample.select("toxic", F.explode(F.array_distinct(F.concat(words, stems))).alias("word"))
        .groupBy("word")
        .agg(F.sum((F.col("toxic") == 1).cast("long")).alias("p"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .withColumn("rate", F.lit(pos / (pos + neg)))
        .withColumn("z", (F.col("p") - F.col("n") * F.col("rate")) / F.sqrt(F.col("n") * F.col("rate") * (1 - F.col("rate"))))
        .where(F.abs("z") >= min_z)
        .orderBy(F.desc(F.abs("z")), "word")
        .limit(max_words)
    )
    return [r["word"] for r in words.select("word").collect()], pos, neg


def _bags(vocabulary: dict[str, int]):
    """mapInArrow: per document its label, the number of plain sentences, and the others' words."""

    def run(batches):
        for b in batches:
            out = {"toxic": [], "plain": [], "sentences": []}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                n, bags = 0, []
                for m in _SENTENCE.finditer(text):
                    n += 1
                    if ws := sorted(vocabulary[w] for w in features(m[0]) & vocabulary.keys()):
                        bags.append(ws)
                out["toxic"].append(int(toxic == 1))
                out["plain"].append(n - len(bags))
                out["sentences"].append(bags)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("toxic", pa.int32()), ("plain", pa.int64()), ("sentences", pa.list_(pa.list_(pa.int32())))])
            )

    return run


def fit_noisy_or(labels, plain, sentences, n_words: int, steps: int = 400, rate: float = 0.15, l1: float = 2.0, prior: float = -12.0):
    """Maximise the noisy-or likelihood of document labels by proximal gradient.

    ``sentences[d]`` lists the word-id lists of document d's sentences.  The
    bias is drawn to ``prior`` so that long clean documents stay clean; ``l1``
    (in nats a unit of weight) drops words that the labels don't need.
    """
    labels = np.asarray(labels, float)
    plain = np.asarray(plain, float)
    doc = np.array([d for d, bags in enumerate(sentences) for _ in bags], np.int64)
    word = np.array([w for bags in sentences for ws in bags for w in ws], np.int64)
    sent = np.repeat(np.arange(len(doc)), [len(ws) for bags in sentences for ws in bags])
    n = len(labels)
    # Words that toxic documents favour start where one of them makes a sentence even odds:
    # from zero, a low bias would hide them and the leak would explain every label.
    held = np.unique(np.stack([doc[sent], word]), axis=1) if len(word) else np.zeros((2, 0), np.int64)
    share = np.bincount(held[1], labels[held[0]], n_words) / np.maximum(np.bincount(held[1], minlength=n_words), 1)
    w, bias, leak = np.where(share > labels.mean(), 6.0, 0.0), prior + 6.0, np.log(0.02)
    m1, m2 = np.zeros(n_words + 2), np.zeros(n_words + 2)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sent, w[word], len(doc)) if len(doc) else np.zeros(0)
        eps = 1 / (1 + np.exp(-leak))
        log_not = np.log1p(-eps) - plain * np.logaddexp(0, bias) - np.bincount(doc, np.logaddexp(0, z), n)
        log_not = np.minimum(log_not, -1e-9)
        # d loss / d log_not for loss = -log-likelihood
        g = np.where(labels > 0, np.exp(log_not) / -np.expm1(log_not), -1.0)
        sig = 1 / (1 + np.exp(-z))
        gz = -g[doc] * sig
        gw = np.bincount(word, gz[sent], n_words) if n_words else np.zeros(0)
        gb = gz.sum() - (g * plain).sum() / (1 + np.exp(-bias)) + 2.0 * (bias - prior)
        gl = -(g.sum()) * eps
        grad = np.concatenate([gw, [gb, gl]]) / max(n, 1)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        scale = rate / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        move = scale * m1 / (1 - 0.9**step)
        w -= move[:-2]
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(scale[:-2] * l1 / max(n, 1), 0.05))
        bias -= move[-2]
        leak = float(np.clip(leak - move[-1], -12, -2.2))
    return w, float(bias), float(1 / (1 + np.exp(-leak)))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, max_words: int = 2_000, min_z: float = 4.0) -> Model:
    """Fit on at most ``sample_rows`` labelled rows and ``max_words`` words."""
    sample = training_sample(docs, labels, sample_rows)
    words, pos, neg = _screen(sample, max_words, min_z)
    if not pos:
        return Model()
    vocabulary = {w: i for i, w in enumerate(words)}
    rows = sample.mapInArrow(_bags(vocabulary), "toxic int, plain long, sentences array<array<int>>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["plain"], r["sentences"]))  # the same sums whatever the row order
    w, bias, leak = fit_noisy_or([r["toxic"] for r in rows], [r["plain"] for r in rows], [r["sentences"] for r in rows], len(words))
    return Model(bias, leak, {x: float(w[i]) for x, i in vocabulary.items() if abs(w[i]) > 1e-3})


def _scorer(model: Model):
    def run(batches):
        for b in batches:
            got = [model.document(t) for t in b.column("text").to_pylist()]
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            new = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], spans)]
            kept = [c for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + new, names=[*kept, "_score", "_n_sentences", "_offending"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, score, n_sentences and the offending sentence spans of every row.

    Extra columns of ``docs`` aren't carried.
    """
    rows = docs.select("doc_id", "text")
    schema = "doc_id long, text string, _score double, _n_sentences long, _offending array<struct<start:int,end:int,score:double>>"
    return rows.mapInArrow(_scorer(model), schema).select(
        "doc_id", "text", F.col("_score").alias("score"), F.col("_n_sentences").alias("n_sentences"), F.col("_offending").alias("offending")
    )


def filter_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    keep = F.pandas_udf(lambda s: s.map(lambda t: model.document(t)[0] < threshold).astype(bool), "boolean")
    return docs.where(keep(F.col("text")))
