"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Centroids are fitted on a bounded, seeded sample (``sample_rows``); their
number grows with the table, so that cells keep about ``cell_rows`` vectors.
Every vector has a home cell, its nearest centroid, and visits the next ones; in
a cell, the home vectors are compared with each other and with the visitors.  A
pair that two cells hold is counted in one of them.  Where a table needs more
than ``max_cells`` cells, each cell is split once more by centroids of its own,
fitted on a sample of its own, so cells stay small at any size.

A pair is found if one vector visits the other's home.  More cells need more
visits for the same recall: ``visits_of`` grows with the cube root, which kept
0.96 to 0.99 of isotropic 64-dimensional pairs at a cosine of 0.905 with 16 to
4,096 cells (the README has the figures); alike vectors are found more often.

Vectors that are equal in every component collapse first and carry their
number.  A cell is dealt into blocks of ``block`` vectors and each pair of
blocks is one task group, so that neither a large cell nor a dense one meets in
one task.  Of a block pair only sums of links and the edges of its components
leave the task, never all pairs.

Links are decided on float64 products of unit vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are groups of their own; vectors of different
length never link; rows that repeat a vec_id with one vector are one vector
with as many copies; a pair at the threshold links; equally near centroids are
taken in their order; a null vec_id links as any other and names no group; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import connected_components, materialize, within

#: Cells whose numbers of blocks are sent to every task; more are shuffled.
BROADCAST_CELLS = 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell takes the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        home = s.argmax(axis=1)
        far = np.argsort(s.max(axis=1))
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        for i, j in enumerate(np.flatnonzero(np.linalg.norm(new, axis=1) < 1e-9)):
            new[j] = x[far[i]]
        c = _unit(new)
    return c


def visits_of(cells: int) -> int:
    """How many cells beside its home a vector visits."""
    return int(np.ceil(0.8 * cells ** (1 / 3)))


def _nearest(x: np.ndarray, centroids: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` nearest centroids of each unit vector, the nearest first."""
    out, step = [np.empty((0, m), np.int64)], max(1, (1 << 22) // len(centroids))
    for at in range(0, len(x), step):
        out.append(np.argsort(-(x[at : at + step] @ centroids.T), axis=1, kind="stable")[:, :m])
    return np.concatenate(out)


def _cells(centroids: dict[int, np.ndarray]):
    """mapInArrow: each vector's home and the cells that it is in, home first."""
    base, n = {}, 0
    for d in sorted(centroids):
        base[d], n = n, n + len(centroids[d])

    def run(batches):
        for b in batches:
            size = np.diff(b.column("v").offsets.to_numpy())
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                x = _unit(part.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, d))
                k = len(centroids[d])
                near = _nearest(x, centroids[d], min(visits_of(k) + 1, k)) + base[d]
                cell = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("v"), pa.array(near[:, 0]), cell], names=["rep", "copies", "v", "home", "cell"])

    return run


def _fit_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The centroids of one cell's sample, as bytes."""
    x = _unit(np.stack(pdf.sort_values("rep")["v"].to_numpy()).astype(np.float64))
    c = spherical_kmeans(x, int(pdf["parts"].iloc[0]))
    return pd.DataFrame({"at": [pdf["at"].iloc[0]], "centroids": [c.tobytes()]})


def _place_again(width: int):
    """Cogrouped rows and centroids of a cell: the finer cells of each row, padded by -1 to ``width``."""

    def run(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        out = rows[["rep", "copies", "v", "own"]].assign(cell=pd.Series(dtype=object))
        if len(rows) and len(fitted):
            x = _unit(np.stack(rows["v"].to_numpy()).astype(np.float64))
            c = np.frombuffer(fitted["centroids"].iloc[0]).reshape(-1, x.shape[1])
            near = _nearest(x, c, min(visits_of(len(c)) + 1, len(c))) + (int(rows["at"].iloc[0]) << 20)
            padded = np.full((len(near), width), -1)
            padded[:, : near.shape[1]] = near
            out["cell"] = list(padded)
        return out

    return run


def _split(placed: DataFrame, cell_rows: int, max_cells: int, sample_rows: int, vector: str) -> DataFrame:
    """``placed`` with each cell split by centroids of its own."""
    at = placed.select("rep", "copies", "v", F.explode("cell").alias("at"), "home").withColumn("own", F.col("at") == F.col("home")).drop("home")
    size = at.groupBy("at").agg(F.count("*").alias("rows"), F.sum(F.col("own").cast("long")).alias("homes"))
    parts = F.greatest(F.lit(1), F.least(F.lit(max_cells), F.round(F.col("homes") / cell_rows))).cast("int")
    size = materialize(size.where("homes > 0").withColumn("parts", parts), "cell-sizes")  # a row a cell, max_cells for each length of vector
    at = at.join(F.broadcast(size), "at")
    sample = at.where(F.col("own") & (F.pmod(F.xxhash64(F.lit(5), "rep"), F.ceil(F.col("homes") / sample_rows)) == 0))
    fitted = materialize(sample.select("at", "rep", "v", "parts").groupBy("at").applyInPandas(_fit_cell, "at long, centroids binary"), "centroids")
    shares = F.ceil(F.col("rows") / sample_rows).cast("int")
    dealt = at.withColumn("share", F.pmod(F.xxhash64("rep"), shares).cast("int")).select("at", "share", "rep", "copies", "v", "own")
    each = fitted.join(F.broadcast(size), "at").select("at", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "centroids")
    width = visits_of(max_cells) + 1
    schema = f"rep long, copies long, v {vector}, own boolean, cell array<long>"
    fine = dealt.groupBy("at", "share").cogroup(each.groupBy("at", "share")).applyInPandas(_place_again(width), schema)
    home = F.max(F.when(F.col("own"), F.get("cell", F.lit(0)))).alias("home")
    return fine.groupBy("rep").agg(F.first("copies").alias("copies"), F.first("v").alias("v"), home, F.array_sort(F.flatten(F.collect_list("cell"))).alias("cell"))


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(threshold: float):
    """applyInPandas over one pair of blocks of a cell: links of each vector, and component edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        lo, hi, cell = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), int(pdf["at"].iloc[0])
        left = pdf[pdf["block"] == lo]
        right = left if lo == hi else pdf[pdf["block"] == hi]
        empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "peer": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        a, b = (_unit(np.stack(side["v"].to_numpy()).astype(np.float64)) for side in (left, right))
        i, j = np.nonzero(a @ b.T >= threshold)
        if lo == hi:
            up = i < j
            i, j = i[up], j[up]
        ha, hb = left["home"].to_numpy()[i], right["home"].to_numpy()[j]
        # Two visitors meet elsewhere, if anywhere; a pair of two homes that both know is counted in the lower one.
        ok = (ha == cell) | (hb == cell)
        other = np.where(ha == cell, hb, ha)
        cells_a, cells_b = ([frozenset(x.tolist()) for x in side["cells"]] for side in (left, right))
        seen_a = np.fromiter((h in cells_a[k] for k, h in zip(i.tolist(), hb.tolist())), bool, len(i))
        seen_b = np.fromiter((h in cells_b[k] for k, h in zip(j.tolist(), ha.tolist())), bool, len(j))
        both = np.where(ha == cell, seen_a, seen_b)  # does the home vector visit the other's home, too?
        ok &= (other == cell) | ~both | (cell < other)
        i, j = i[ok], j[ok]
        if not len(i):
            return empty
        ra, rb = left["rep"].to_numpy(), right["rep"].to_numpy()
        ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
        links_a, links_b = np.bincount(i, cb[j], len(ra)), np.bincount(j, ca[i], len(rb))
        ids = np.unique(np.concatenate([ra, rb]))
        label = _labels(np.searchsorted(ids, ra[i]), np.searchsorted(ids, rb[j]), len(ids))
        out = pd.DataFrame({"rep": np.concatenate([ra, rb]), "links": np.concatenate([links_a, links_b]).astype("int64")})
        out["peer"] = ids[label[np.searchsorted(ids, out["rep"].to_numpy())]]
        return out[out["links"] > 0]

    return run


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.9, cell_rows: int = 400, max_cells: int = 4096, sample_rows: int = 20_000, block: int = 1024
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    v = F.col("embedding")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Whole numbers can be vectors, too; of a floating type is its own, exact and half as large.
    vector = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    # +0.0 turns -0.0 into 0.0, so that equal vectors have one digest.
    v = F.when(F.coalesce(sound, F.lit(False)), F.transform(v.cast(vector), lambda x: x + F.lit(0.0).cast(vector[6:-1])))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    key = F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256))
    rows = materialize(rows.withColumn("key", key), "vectors")
    sizes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # A class is known by its smallest id, or by a negative hash where all its ids are null.
    unnamed = -F.abs(F.shiftright(F.xxhash64("key"), 1)) - 1
    classes = materialize(sizes.withColumn("rep", F.coalesce("id", unnamed)), "classes")

    centroids, most = {}, 0
    for d, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("v")).count().collect()):  # a row for each vector length
        sample = classes.where(F.size("v") == d).orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("v").toArrow()
        x = _unit(np.array(sample.column("v").to_pylist(), np.float64))
        centroids[d], most = spherical_kmeans(x, max(1, min(max_cells, len(x), round(n / cell_rows)))), max(most, n)
    if not centroids:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    placed = classes.select("rep", "copies", "v").mapInArrow(_cells(centroids), f"rep long, copies long, v {vector}, home long, cell array<long>")
    if most > max_cells * cell_rows:
        placed = _split(placed, cell_rows, max_cells, sample_rows, vector)
    placed = materialize(placed, "cells")
    held = placed.select(F.explode("cell").alias("at")).where("at >= 0").groupBy("at").count()
    blocks = within(held.select("at", F.ceil(F.col("count") / block).cast("int").alias("blocks")), BROADCAST_CELLS)
    dealt = placed.select("rep", "copies", "v", "home", F.col("cell").alias("cells"), F.explode("cell").alias("at")).join(blocks, "at")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).drop("with", "blocks")
    found = materialize(met.groupBy("at", "lo", "hi").applyInPandas(_compare(threshold), "rep long, links long, peer long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    named = classes.select("key", "rep", "id", "copies").join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("root", F.coalesce("component", "rep"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))  # unnamed classes have no id to give
    named = named.join(least, "root").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(named, "key", "left")
    group = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(F.col("vec_id") == group, F.lit(False)).alias("kept")
    )
