"""Masked pseudo-likelihood: a window network that predicts each token from both sides.

Tokens are lower-cased words hashed to ``buckets`` ids.  Corpus-wide counts of
the ids, over all documents, cut them into ``classes`` of like frequency.  For
the token at a position the network sees its two left and two right neighbours,
never the token itself::

    hidden = tanh(b1 + sum_o E[w[i+o]] @ W[o]),  o in -2 -1 1 2
    P(w[i]) = softmax(b2 + hidden @ U)[class of w[i]] * count(w[i]) / count(class)

A document's score is the sum of the log-probabilities of all its tokens.

Training predicts every position of all documents once: there are ``stride``
rounds, and in each every task starts from the same parameters, takes each
``stride``-th position of its documents (the next phase every round) by
minibatch gradient steps in numpy, and returns its parameters; they are averaged
by tokens seen, in groups of tasks first, so no group grows with the corpus.  What reaches the driver is the model, of fixed size
(``buckets * width`` floats and the counts).

Defined cases: a very long text is scored whole, its positions in chunks; ids of
equal counts are classed in their order; null, empty and blank texts have no tokens, a log-probability of
0.0 and a null mean; repeated rows get equal scores; an empty corpus scores
nothing; extra columns are ignored, null ids kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import SPACE, materialize

OFFSETS = (-2, -1, 1, 2)
REACH = 2
_AROUND = np.array(OFFSETS)
#: Rows of parameters in a block, and tasks averaged together first.
BLOCK, FANIN = 4096, 64


@dataclass
class Shape:
    buckets: int = 1 << 15
    width: int = 16
    hidden: int = 32
    classes: int = 128


def hashed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id and ids: the lower-cased words of every row as hashed ids."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE), lambda w: w != "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(buckets))).alias("ids"))


def padded(lists: pa.ListArray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in one array, ``REACH`` paddings before and behind each list; positions, and the list of each."""
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(ids)) + REACH * (doc + 1)
    flat = np.full(len(ids) + REACH * (len(n) + 1), pad, np.int32)
    flat[at] = ids
    return flat, at, doc


def new_params(s: Shape, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = np.float32
    return {
        "E": (0.1 * r.standard_normal((s.buckets + 1, s.width))).astype(f),
        "W": (r.standard_normal((len(OFFSETS) * s.width, s.hidden)) / np.sqrt(len(OFFSETS) * s.width)).astype(f),
        "b1": np.zeros((1, s.hidden), f),
        "U": (0.1 * r.standard_normal((s.hidden, s.classes))).astype(f),
        "b2": np.zeros((1, s.classes), f),
    }


def frequency_classes(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id, cut by equal sums of root frequencies, and log(count / count of class).

    Ids that the corpus lacks count as a half.
    """
    c = np.maximum(counts.astype(float), 0.5)
    order = np.argsort(-c, kind="stable")
    mass = np.cumsum(np.sqrt(c[order]))
    of = np.empty(len(c), np.int64)
    of[order] = np.minimum((mass - np.sqrt(c[order])) / mass[-1] * classes, classes - 1).astype(np.int64)
    return of, np.log(c) - np.log(np.bincount(of, c, classes))[of]


def _forward(p: dict, around: np.ndarray):
    """Inputs, hidden layer and class scores, from the ids around each position."""
    x = p["E"].take(around, axis=0).reshape(len(around), -1)
    h = x @ p["W"]
    h += p["b1"]
    np.tanh(h, out=h)
    z = h @ p["U"]
    z += p["b2"]
    z -= z.max(axis=1, keepdims=True)
    return x, h, z


def log_probs(p: dict, of: np.ndarray, inside: np.ndarray, flat: np.ndarray, at: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """The log-probability of the token at each position, given its neighbours; a chunk's scores fit a core's cache."""
    out = np.empty(len(at))
    for k in range(0, len(at), chunk):
        here = at[k : k + chunk]
        token = flat[here]
        z = _forward(p, flat[here[:, None] + _AROUND])[2]
        own = z[np.arange(len(here)), of[token]] + inside[token]
        out[k : k + chunk] = own - np.log(np.exp(z, out=z).sum(axis=1))
    return out


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the sum of each one's rows."""
    # Two bytes are sorted by radix.
    order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    return ids[first], np.add.reduceat(rows[order], first, axis=0)


def train_on(p: dict, seen: dict, of: np.ndarray, flat: np.ndarray, at: np.ndarray, rate: float = 0.1, batch: int = 2048) -> None:
    """Adagrad steps over the positions, in place."""
    for k in range(0, len(at), batch):
        here = at[k : k + batch]
        around = flat[here[:, None] + _AROUND]
        x, h, z = _forward(p, around)
        dz = np.exp(z, out=z)
        dz /= dz.sum(axis=1, keepdims=True) * len(here)
        dz[np.arange(len(here)), of[flat[here]]] -= np.float32(1 / len(here))
        dh = (dz @ p["U"].T) * (1 - h * h)
        grads = {"U": h.T @ dz, "b2": dz.sum(0, keepdims=True), "W": x.T @ dh, "b1": dh.sum(0, keepdims=True)}
        dx = (dh @ p["W"].T).reshape(-1, p["E"].shape[1])
        rows, de = _summed(around.ravel(), dx)
        for name, g in grads.items():
            seen[name] += g * g
            p[name] -= rate * g / np.sqrt(seen[name] + 1e-8)
        seen["E"][rows] += (de * de).mean(axis=1, keepdims=True)
        p["E"][rows] -= rate * de / np.sqrt(seen["E"][rows] + 1e-8)


def _count(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    return run


def _train(shape: Shape, start: dict, of: np.ndarray, stride: int, phase: int):
    def run(batches):
        rng = np.random.default_rng(phase)
        p = {k: v.copy() for k, v in start.items()}
        seen = {k: np.zeros_like(v if k != "E" else v[:, :1]) for k, v in p.items()}
        n = 0
        for b in batches:
            for k in range(0, b.num_rows, 512):
                flat, at, _ = padded(b.column(0).slice(k, 512), shape.buckets)
                at = at[(at % stride) == phase]
                n += len(at)
                train_on(p, seen, of, flat, rng.permutation(at))
        if n:
            task = TaskContext.get().partitionId()
            for name, v in p.items():
                for k in range(0, len(v), BLOCK):
                    values = pa.array([v[k : k + BLOCK].tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([k], pa.int32()), pa.array([task // FANIN], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), values],
                        names=["name", "row", "part", "task", "n", "values"],
                    )

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("task")
    n = int(pdf["n"].sum())
    total = sum(np.frombuffer(v, np.float32).astype(float) * w for v, w in zip(pdf["values"], pdf["n"])) / n
    return pdf[["name", "row", "part"]].head(1).assign(task=int(pdf["task"].iloc[0]), n=n, values=[total.astype(np.float32).tobytes()])


@dataclass
class Model:
    shape: Shape
    params: dict
    of: np.ndarray
    inside: np.ndarray


def train(ids: DataFrame, shape: Shape | None = None, *, stride: int = 2) -> Model:
    """Counts and parameters from all positions of all documents; ``ids`` comes from ``hashed``."""
    shape = shape or Shape()
    lists = ids.select("ids")
    counts = np.zeros(shape.buckets, np.int64)
    found = lists.mapInArrow(_count(shape.buckets), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    of, inside = frequency_classes(counts, shape.classes)
    p = new_params(shape)
    p["b2"][0] = np.log(np.bincount(of, np.maximum(counts, 0.5), shape.classes) / np.maximum(counts, 0.5).sum())
    schema = "name string, row int, part int, task int, n long, values binary"
    for phase in range(stride):
        parts = lists.mapInArrow(_train(shape, p, of, stride, phase), schema)
        mean = parts.groupBy("name", "row", "part").applyInPandas(_average, schema).groupBy("name", "row").applyInPandas(_average, schema)
        new = {k: v.copy() for k, v in p.items()}
        for x in mean.select("name", "row", "values").toArrow().to_pylist():  # the model: a fixed number of blocks
            v = np.frombuffer(x["values"], np.float32).reshape(-1, p[x["name"]].shape[1])
            new[x["name"]][x["row"] : x["row"] + len(v)] = v
        p = new
    return Model(shape, p, of, inside)


def _scorer(m: Model):
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                flat, at, doc = padded(part.column("ids"), m.shape.buckets)
                lp = log_probs(m.params, m.of, m.inside, flat, at)
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.bincount(doc, lp, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "log_prob"])

    return run


def score(ids: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every row of ``ids``."""
    out = ids.mapInArrow(_scorer(model), "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def train_and_score(docs: DataFrame, shape: Shape | None = None, **options) -> DataFrame:
    """Every row scored by a model of all rows; texts are split and hashed once, into the shared folder."""
    shape = shape or Shape()
    ids = materialize(hashed(docs, shape.buckets), "ids")
    return score(ids, train(ids, shape, **options))
