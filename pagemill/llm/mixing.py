"""Mixing sources to target weights by fitting a subset sum to each budget.

Sizes are words.  Each source's target is its share of all words by weight,
capped at ``max_repeat`` times its size, the excess reshared by weight until no
target is above its cap.  A target is met by whole passes over the source and,
for the rest, by one more copy of some documents.  Those are found on the
histogram of exact sizes: every size first gives its proportional part, and a
bounded-knapsack dynamic programme over the counts still free closes the
remaining gap.  Which documents of a size get the copy is decided by a seeded
hash of id and text: the threshold is the hash of the n-th smallest one.  Equal
rows share their hash; where the threshold falls among them, they are numbered
by counts per partition, and so many are taken as are left to take.

The histogram is pre-aggregated, a source's histogram has one row for each
distinct size, and the threshold is searched in one of 4,096 hash buckets of a
size, so no group of documents has to fit into one task.

Defined cases: a very long text is one size, and the programme of its source holds
8 bytes for each word of at most twice the largest text; ties of the hash are cut
by id; null, empty and blank texts have size 0 and never count; a null
source is one source, the last; rows that repeat an id, or have none, count each
by itself, and of equal ones any may be taken; an empty table gives an
empty result; extra columns are ignored by ``plan`` and kept by ``mixed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import WORD, materialize

#: Thresholds that are sent to every task rather than shuffled (at most about 60 bytes each).
BROADCAST_ROWS = 200_000
BUCKETS = 4096


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")


def _key(source: Column) -> Column:
    """A source as a string that isn't null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(totals: DataFrame, max_repeat: int = 3) -> DataFrame:
    """``totals`` (source, source_size) with the column ``target``.

    Sources are ranked by range partitions and per-partition counts, and the
    common level is found by repeated aggregates; only counts reach the driver.
    """
    order = F.col("source").asc_nulls_last()
    ranged = totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("part", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND((1 << 33) - 1)), "sources")
    base, sofar = {}, 0
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        base[r["part"]], sofar = sofar, sofar + r["count"]
    if not sofar:
        return totals.withColumn("target", F.lit(0.0))
    first = F.create_map(*[x for p, n in base.items() for x in (F.lit(p), F.lit(n))])
    src = ranged.withColumn("w", ((F.element_at(first, F.col("part")) + F.col("row")) % 3 + 1).cast("double"))
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    level, before = 0.0, -1
    while total:
        over = F.col("w") * F.lit(level) > cap
        n, held, free = src.agg(F.sum(over.cast("long")), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if n == before or not free:
            break
        before, level = n, (total - held) / free
    return src.select("source", "source_size", F.least(F.col("w") * F.lit(level), cap).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, max_repeat: int = 3, seed: int = 0) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each size get one more copy.

    The sum of all copies is at most ``budget`` and as near as the search below
    finds: exact whenever some subset of the freed sizes closes the gap.
    """
    total = int((sizes * counts).sum())
    extra = np.zeros(len(sizes), np.int64)
    if total == 0 or budget <= 0:
        return 0, extra
    passes = min(max_repeat, budget // total)
    rest = 0 if passes == max_repeat else budget - passes * total
    if not rest:
        return int(passes), extra
    extra = np.minimum(counts, (counts * (rest / total)).astype(np.int64))
    gap = rest - int((extra * sizes).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    room = 2 * int(sizes.max())
    for i in order:  # proportional parts are rounded down: give sizes one more until the gap is small
        if gap <= room:
            break
        if 0 < sizes[i] <= gap and extra[i] < counts[i]:
            extra[i] += 1
            gap -= int(sizes[i])
    # Bounded knapsack over the free counts: bit s of ``reach`` says that sum s can be made.
    reach, mask, by, items = 1, (1 << (gap + 1)) - 1, np.full(gap + 1, -1, np.int64), []
    for i in order:
        size, left = int(sizes[i]), min(int(counts[i] - extra[i]), gap // int(sizes[i]) if sizes[i] else 0)
        part = 1
        while left > 0 and not reach >> gap & 1:
            part = min(part, left)
            new = (reach << part * size) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(gap // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(items)
                items.append((i, part))
                reach |= new
            left, part = left - part, part * 2
    s = reach.bit_length() - 1
    while s:
        i, part = items[by[s]]
        extra[i] += part
        s -= part * int(sizes[i])
    return int(passes), extra


def _fit_source(max_repeat: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        passes, extra = fit(pdf["size"].to_numpy(), pdf["count"].to_numpy(), int(np.floor(pdf["target"].iloc[0] + 0.5)), max_repeat, seed)
        return pdf[["skey", "size", "count", "source_size", "target"]].assign(passes=passes, extra=extra)

    return run


def plan(docs: DataFrame, *, max_repeat: int = 3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes, and for each (source, size) what is taken of it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size(F.col("text")).alias("size"), _hash(seed).alias("hash"))
    rows = materialize(rows.withColumn("skey", _key(F.col("source"))), "sizes")
    dealt = rows.groupBy("source", "skey", "size", F.pmod("hash", F.lit(BUCKETS)).alias("b")).count()
    dealt = materialize(dealt, "histogram")
    hist = dealt.groupBy("source", "skey", "size").agg(F.sum("count").alias("count"))
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), max_repeat)
    hist = hist.drop("source").join(goal.withColumn("skey", _key(F.col("source"))).drop("source"), "skey")
    fitted = hist.groupBy("skey").applyInPandas(
        _fit_source(max_repeat, seed), "skey string, size long, count long, source_size long, target double, passes long, extra long"
    )
    fitted = materialize(fitted, "fitted")

    # The bucket in which the last extra copy falls, and the threshold in it.
    part = fitted.where("extra > 0 AND extra < count").select("skey", "size", "extra")
    upto = Window.partitionBy("skey", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        dealt.join(part, ["skey", "size"])
        .withColumn("upto", F.sum("count").over(upto))
        .where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("count") < F.col("extra")))
        .select("skey", "size", "b", (F.col("extra") - F.col("upto") + F.col("count")).alias("nth"))
    )
    # Equal rows are counted first: a bucket holds one row for each different document.
    same = rows.withColumn("b", F.pmod("hash", F.lit(BUCKETS))).join(cut, ["skey", "size", "b"]).groupBy("skey", "size", "b", "nth", "hash", "doc_id").agg(F.count("*").alias("equal"))
    upto = Window.partitionBy("skey", "size", "b").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("upto", F.sum("equal").over(upto)).where((F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("equal") < F.col("nth")))
    last = same.select("skey", "size", "b", F.col("hash").alias("h"), F.col("doc_id").alias("id"), "equal", (F.col("nth") - F.col("upto") + F.col("equal")).alias("keep"))
    return rows, materialize(fitted.join(last, ["skey", "size"], "left"), "thresholds")


def _copies(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` (with skey, size, hash, doc_id) with the number of copies to take."""
    side = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    bucket = F.pmod("hash", F.lit(BUCKETS))
    below = (bucket < F.col("b")) | ((bucket == F.col("b")) & ((F.col("hash") < F.col("h")) | ((F.col("hash") == F.col("h")) & (F.struct("doc_id") < F.struct("id")))))
    at = (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("count"))
    extra = F.when(F.col("extra") == 0, 0).when(~part, 1).otherwise(F.coalesce(below | (at & (F.col("keep") == F.col("equal"))), F.lit(False)).cast("int"))
    met = rows.join(side, ["skey", "size"])
    out = met.withColumn("copies", F.col("passes") + F.when(F.col("size") == 0, 0).otherwise(extra))
    if not taken.where("size > 0 AND keep < equal").limit(1).count():
        return out
    # Rows equal to one another of which only some are taken: numbered inside each partition, from the counts of those before it.
    split = F.coalesce(part & at & (F.col("size") > 0) & (F.col("keep") < F.col("equal")), F.lit(False))
    group = ["skey", "size"]
    tied = materialize(met.where(split).withColumn("at", F.monotonically_increasing_id()), "tied").withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tied.groupBy(*group, "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select(*group, "part", "base")
    no = F.row_number().over(Window.partitionBy(*group, "part").orderBy("at"))
    tied = tied.withColumn("no", no).join(base, [*group, "part"])
    tied = tied.withColumn("copies", F.col("passes") + (F.col("base") + F.col("no") <= F.col("keep")).cast("int"))
    return out.where(~split).unionByName(tied.select(*out.columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    rows, taken = plan(docs, **options)
    out = _copies(rows, taken)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, taken = plan(docs, seed=seed, **options)
    own = F.struct(*docs.columns).alias("_row")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), _size(F.col("text")).alias("size"), _key(F.col("source")).alias("skey"), _hash(seed).alias("hash"))
    rows = _copies(rows, taken).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
