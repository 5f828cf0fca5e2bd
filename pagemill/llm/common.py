"""Shared plumbing: table access, shared scratch storage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the word-based operators split on.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once.
SLICE = 8 << 20
#: Bytes of rows that Spark sends to a Python worker at once; a longer row goes alone.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A path without a scheme gets the cluster's own, so that other readers than
    Spark's find it, too.  Where a local session names none, as in tests, a
    temporary folder is made and set once; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(base), spark.sparkContext._jsc.hadoopConfiguration()
        base = path.getFileSystem(conf).makeQualified(path).toUri().toString()
        base = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{scratch(spark)}/pagemill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage; the files outlive any executor.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile sends at most about ``BATCH`` bytes at once to a Python worker, however long the texts are.

    Both sides hold a batch or two for each core; the session's own bound comes back afterwards.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of about ``size`` bytes of text, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def strings(column: pa.Array) -> pa.Array:
    """A text column without nulls, in memory of its own: some kernels misread slices."""
    own = pa.concat_arrays([column.cast(pa.large_string()), pa.array([], pa.large_string())])
    return pc.fill_null(own, "")


def within(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked to be sent to every task if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Component label (smallest node) of each node in an undirected graph.

    ``edges`` has columns ``a`` and ``b`` (long); the smallest nodes themselves are
    not listed.  Alternating large-star and
    small-star steps: every node's larger neighbours are hooked to its smallest
    neighbour until each component is a star.  Needs rounds in the logarithm of
    the component size; every round is written to the shared folder.  Nothing
    is gathered in the driver but a count and a hash sum per round.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = materialize(e, "cc")
    seen = None
    for _ in range(max_rounds):
        # Large star: around each node, link every larger neighbour to the smallest.
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # Small star: around each node, link its smaller neighbours and itself to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        row = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(row) == seen:
            break
        seen = tuple(row)
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
