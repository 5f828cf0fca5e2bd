"""Centroid clustering in whole numbers, with a pivot table against needless distances.

Components become ``floor(scale * x)``, so all sums, distances and centroids are
exact integers and a rerun, whatever its tasks, ends with the same clusters.

LAESA: the distances of every vector to ``pivots`` fixed points are taken once and
stored beside it.  In each round a centroid's own distances to these points are
known, and for every pivot their difference is at most the distance of vector
and centroid; the greatest difference bounds that from below.  The centroid with
the least bound gets its exact distance first, and then only those whose bound
lies under it (with a margin above the rounding of the square roots) get theirs.
The pivots are starting centroids, far from each other in turn.

A round is one pass over the stored table: a task adds up its vectors by cluster
and hands over ``k`` sums, which are added once more after a shuffle of ``k * dim``
keys.  The driver sees ``k`` centroids, never vectors.

Defined cases: vectors that are null, of another length, or that hold null or
non-finite components are left out, and so are those with a component of
``2**27`` or more after scaling, whose squared distance would not fit a long;
ties go to the smaller cluster; rows that repeat a vec_id each count; starting
centroids of equal digest stand in the order of their components, and a null
vec_id comes last; with fewer vectors than ``k`` each is a centroid; a cluster
without vectors keeps its centroid; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import materialize

#: Components stay under this, so that 64 squared differences fit a long.
BOUND = 1 << 27
#: Vectors that are compared at once.
STEP = 1024
#: Above the rounding of distances up to 2**31.
MARGIN = 1e-5


def whole_numbers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the components as whole numbers, of the vectors that count."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(BOUND)))
    rows = vectors.where((F.size("embedding") == dim) & usable)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<int>").alias("v"))


def starting(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the ``k`` least digests of ``salt`` and vec_id, in their order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.select(digest.alias("d"), "v").orderBy(F.asc_nulls_last("d"), "v").limit(k).select("v").toArrow()
    return np.array(first.column("v").to_pylist(), np.int64)


def _roots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all of x and y."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2).astype(np.float64))


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points, each the farthest from those before it."""
    chosen, near = [0], _roots(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _roots(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many exact distances that took."""
    known = _roots(centroids, pivots)
    low = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(to_pivots[:, p, None] - known[None, :, p]), out=low)
    rows = np.arange(len(x))
    first = low.argmin(axis=1)
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[rows, first] = ((x - centroids[first]) ** 2).sum(axis=1)
    left = low <= np.sqrt(exact[rows, first].astype(np.float64))[:, None] + MARGIN
    left[rows, first] = False
    i, c = np.nonzero(left)
    exact[i, c] = ((x[i] - centroids[c]) ** 2).sum(axis=1)
    best = exact.argmin(axis=1)
    return best, exact[rows, best], len(x) + len(i)


def _steps(batch: pa.RecordBatch, *columns: str):
    """The batch's vectors, as stretches of at most ``STEP`` rows; further columns beside them."""
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        yield part, *(part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("v", *columns))


def _with_pivots(pivots: np.ndarray):
    def run(batches):
        for b in batches:
            for part, v in _steps(b):
                d = _roots(v.astype(np.int64), pivots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), lists], names=["vec_id", "v", "to_pivots"])

    return run


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """mapInArrow: of a task's vectors the number and the sum in each cluster."""

    def run(batches):
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            for _, v, d in _steps(b, "to_pivots"):
                x = v.astype(np.int64)
                own = nearest(x, d, centroids, pivots)[0]
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(count))
        some = np.flatnonzero(count)
        lists = pa.array(total[some].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), lists], names=["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, pivots: np.ndarray):
    def run(batches):
        for b in batches:
            for part, v, d in _steps(b, "to_pivots"):
                own, distance, _ = nearest(v.astype(np.int64), d, centroids, pivots)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; those without vectors stay."""
    parts = table.mapInArrow(_sums(centroids, pivots), "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    new = centroids.copy()
    for cluster, i, x, n in each.collect():  # k * dim rows at most
        new[cluster, i] = x // n
    return new


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", pivots: int = 8) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every vector that counts, and the centroids."""
    if dim > 64:
        raise ValueError("squared distances of more than 64 components might not fit a long")
    rows = whole_numbers(vectors, dim, scale)
    centroids = starting(rows, k, salt)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    fixed = far_apart(centroids, pivots)
    table = materialize(rows.mapInArrow(_with_pivots(fixed), "vec_id long, v array<int>, to_pivots array<double>"), "pivot-table")
    for _ in range(rounds):
        centroids = moved(table, centroids, fixed)
    return materialize(table.mapInArrow(_assigned(centroids, fixed), "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of its cluster and of all, and a digest of the cluster's centroid."""
    spark = assigned.sparkSession
    named = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, centroid string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.join(F.broadcast(named), "cluster").select("cluster", "cluster_inertia", F.sha2("centroid", 256).alias("centroid_sha256"))  # k rows
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # the window sees k rows
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(r: int) -> str:
    """Centroids ``c{r + 1}`` from ``c{r}``."""
    return f"""{_nearest_sql(r)},
s{r} AS (SELECT c, i, sum(x)::BIGINT AS x, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list((x - (x % n + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""


def _nearest_sql(r: int) -> str:
    far = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"a{r} AS (SELECT vec_id, e.v, c, {far}::BIGINT AS d FROM e, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"


#: The query over ``embeddings`` with its production parameters.
ORACLE = f"""WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM e ORDER BY sha256('2:' || vec_id) LIMIT 40),
{", ".join(map(_round, range(5)))},
{_nearest_sql(5)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (c)"""
