"""Near-duplicate groups by fast similarity sketching, banding and exact checks.

A document is the set of its distinct five-word shingles (one shingle when it
has fewer words).  Its sketch has ``t`` coordinates.  Round after round, every
shingle is hashed to one coordinate with the value *round + fraction*, and each
coordinate keeps the least.  From round ``t`` on, round ``t + j`` sends all
shingles to coordinate ``j``, so after ``2 t`` rounds at the latest every
coordinate is filled; two sketches agree in a coordinate with a probability of
exactly the Jaccard similarity, with concentration as for independent hashes.

Bands of ``rows`` coordinates give buckets.  Candidate pairs from the buckets
are confirmed on the full shingle sets (64-bit hashes of whole shingles), never
on the sketch.  At a similarity of 0.75, 44 bands of 5 miss a pair with a
probability below 1e-5.

How groups of copies stay cheap, with no pair dropped:

1. Documents with equal shingle sets collapse to one representative, by an
   aggregate that combines before it shuffles.
2. Every member is checked against the smallest id of all its buckets, then
   against each bucket's smallest id that is in another component.  What is
   confirmed gives components.
3. Only where the other members of a bucket still are in several components are
   they checked against each other, block by block inside tasks, so that of many
   texts that are alike but below the threshold no pair is ever a row.  What all
   pairs of a block have in common is counted at once: shingles of a single
   member are set aside, and pairs whose shared ones can't reach the threshold
   with them; common shingles are counted by a matrix product, rare ones by
   neighbours in sorted order.  Members of one component need no further link.

A block holds at most about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles.

Defined cases: a very long text is one set, whole; ties (equal sets) are one
group, known by its least id; null, empty and blank texts have no shingles, link with nothing
and form a group of their own; repeated rows with one id share their group; a
null ``doc_id`` never names a group: such a row takes the group of its copies,
or null, and is not kept; where one id stands on rows with different texts, a
link of any of them is a link of the id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_batches, connected_components, materialize, slices, strings, within

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_FULL = U(0xFFFFFFFFFFFFFFFF)
#: Bytes of text whose shingles are made at once.
SLICE = 1 << 20
#: Members of a bucket, and shingles, that meet another as many in one task.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Representatives whose (id, digest) are sent to every task; more are shuffled.
BROADCAST_ROWS = 500_000
#: A shingle that more members of a block have is counted by a matrix product.
COMMON, COLUMNS = 32, 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor)."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, each text's sorted, and the texts' offsets."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(strings(texts)))
    lists = pc.ascii_split_whitespace(texts)
    words = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh64_intdigest, names), U, len(names))[coded.indices.to_numpy()]
    first = np.cumsum(words) - words
    words = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, words)  # an empty text splits into one empty word
    n = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    upto = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(upto[-1], U)
    with np.errstate(over="ignore"):
        for k in range(1, width + 1):  # texts of k words are one shingle, those of ``width`` or more have full ones
            of = np.flatnonzero(words >= k if k == width else words == k)
            size = n[of]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at, s = np.repeat(first[of], size) + step, U(k)
            for j in range(k):
                s = mix(s * _M1 + h[at + j])
            out[np.repeat(upto[of], size) + step] = s
    for i, j in zip(upto[:-1].tolist(), upto[1:].tolist()):
        out[i:j].sort()
    new = np.concatenate([[True], out[1:] != out[:-1]])[: len(out)]
    new[upto[:-1][n > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[upto]


def sketches(flat: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Of each set that isn't empty ``t`` coordinates: the least (round, fraction) of the shingles hashed there, as one integer."""
    n = np.diff(offsets)
    count = int((n > 0).sum())
    out = np.full((count, t), _FULL)
    cells, live = out.reshape(-1), np.arange(count)
    of = np.repeat(np.arange(count), n[n > 0])
    left, base = flat, of * t
    with np.errstate(over="ignore"):
        for r in range(t):
            x = mix(left ^ mix(U(r) * _M1 + _M3))
            where = (((x >> U(32)) * U(t)) >> U(32)).astype(np.int64)
            np.minimum.at(cells, base + where, (U(r) << U(48)) | (mix(x) >> U(16)))
            open_ = (out[live] == _FULL).any(axis=1)
            if not open_.all():
                live = live[open_]
                if not len(live):
                    return out
                still = np.zeros(count, bool)
                still[live] = True
                keep = still[of]
                left, base, of = left[keep], base[keep], of[keep]
        for i in live:  # the rounds in which all shingles go to coordinate j
            own = left[of == i]
            for j in np.flatnonzero(out[i] == _FULL):
                x = mix(own ^ mix(U(t + j) * _M1 + _M3))
                out[i, j] = (U(t + j) << U(48)) | (mix(x) >> U(16)).min()
    return out


def sketch(one: np.ndarray, t: int) -> np.ndarray:
    """The sketch of one set."""
    return sketches(one, np.array([0, len(one)]), t)[0]


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _signatures(width: int, bands: int, rows: int):
    salt = mix(np.arange(1, bands + 1, dtype=U) * _M1)

    def run(batches):
        for b in batches:
            for part in slices(b, "text", SLICE):
                flat, offsets = shingles(part.column("text"), width)
                n = np.diff(offsets)
                some = n > 0
                sums = {h: np.zeros(len(n), np.int64) for h in ("h1", "h2")}
                keys = []
                with np.errstate(over="ignore"):
                    if some.any():
                        for h, m in zip(sums, (_M2, _M3)):
                            sums[h][some] = np.add.reduceat(mix(flat ^ m), offsets[:-1][some]).view(np.int64)
                    for at in range(0, len(n), 256):
                        here = offsets[at : at + 257]
                        c = sketches(flat[here[0] : here[-1]], here - here[0], bands * rows).reshape(-1, bands, rows)
                        k = np.broadcast_to(salt, c.shape[:2])
                        for j in range(rows):
                            k = mix(k * _M1 + c[:, :, j])
                        keys.append(k.ravel())
                hashes = [pa.array(sums[h], mask=~some) for h in sums]
                bounds = np.concatenate([[0], np.cumsum(some * bands)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(n, pa.int64()), *hashes, _lists(np.concatenate(keys), bounds)],
                    names=["doc_id", "digest", "n", "h1", "h2", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("rep"), _lists(*shingles(part.column("text"), width))], names=["rep", "s"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets pass the similarity threshold."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _runs(batches, by: tuple[str, ...]):
    """Tables of the rows that agree in the columns ``by``, from batches sorted by them."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in by]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            this = tuple(c[i] for c in cols)
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = this
    if held:
        yield pa.Table.from_batches(held)


def in_common(member: np.ndarray, column: np.ndarray, members: int) -> np.ndarray:
    """How many columns each two members share, from (member, column) pairs without repeats."""
    width = np.bincount(column)
    dense = np.flatnonzero(width > COMMON)
    place = np.full(len(width), -1)
    place[dense] = np.arange(len(dense))
    total = np.zeros((members, members), np.int32)
    for at in range(0, len(dense), COLUMNS):
        here = (place[column] >= at) & (place[column] < at + COLUMNS)
        bits = np.zeros((members, COLUMNS), np.float32)
        bits[member[here], place[column[here]] - at] = 1
        total += (bits @ bits.T).astype(np.int32)  # at most COLUMNS: exact in single precision
    rare = place[column] < 0
    order = np.argsort(column[rare], kind="stable")
    m, c = member[rare][order], column[rare][order]
    for d in range(1, COMMON):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        both = np.bincount(m[same] * members + m[same + d], minlength=members * members).reshape(members, members).astype(np.int32)
        total += both + both.T
    return total


def similar(flat: np.ndarray, n: np.ndarray, wanted: np.ndarray, percent: int) -> np.ndarray:
    """Which of the ``wanted`` pairs of sets pass the threshold; sets of ``n`` shingles one behind the other."""
    distinct, column = np.unique(flat, return_inverse=True)
    shared = np.bincount(column, minlength=len(distinct)) > 1
    member = np.repeat(np.arange(len(n)), n)
    most = np.bincount(member, shared[column], len(n))  # no pair has more in common than either has in common with anyone
    most = np.minimum(most[:, None], most[None])
    both = n[:, None] + n[None]
    wanted = wanted & (100 * most >= percent * (both - most))
    busy = wanted.any(axis=0) | wanted.any(axis=1)
    if not busy.any():
        return wanted
    keep = shared[column] & busy[member]
    common = in_common(member[keep], column[keep], len(n))
    return wanted & (100 * common.astype(np.int64) >= percent * (both - common))


def _linked(percent: int):
    """mapInArrow over blocks of buckets, sorted: the links between members of different components."""

    def run(batches):
        for t in _runs(batches, ("key", "lo", "hi")):
            rep, n, c, block = (t.column(x).to_numpy() for x in ("rep", "n", "c", "block"))
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            wanted = (rep[:, None] < rep[None]) & (c[:, None] != c[None])
            if lo != hi:
                wanted &= block[:, None] != block[None]
            if not wanted.any():
                continue
            flat = t.column("s").combine_chunks().flatten().to_numpy()
            a, b = np.nonzero(similar(flat, n, wanted, percent))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return run


def _grown(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links; ``label`` stands for the links before, so each is walked once."""
    links = materialize(links, "links")
    if label is not None:
        if links.isEmpty():
            return label
        links = links.union(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return connected_components(links)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75, bands: int = 44, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    with bounded_batches(docs.sparkSession):  # all Python work is written before the result is handed out
        return _near_duplicates(docs, width, percent, bands, rows)


def _near_duplicates(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    schema = "doc_id long, digest long, n long, h1 long, h2 long, keys array<long>"
    sig = materialize(texts.mapInArrow(_signatures(width, bands, rows), schema), "minhash")

    # A number for each shingle set, and one row that stands for it; an id may stand on rows of several sets.
    reps = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.first("keys").alias("keys"))
    classes = materialize(reps.select("h1", "h2", "n", "first.doc_id", "first.digest", "keys", F.monotonically_increasing_id().alias("rep")), "classes")
    buckets = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).where("hub <> other").select("key", "hub")
    members = materialize(buckets.join(shared, "key"), "members")  # rep, n, key, hub

    wanted = materialize(classes.select("rep", "doc_id", "digest").join(members.select("rep").distinct(), "rep", "left_semi"), "wanted")
    sets = texts.join(within(wanted, BROADCAST_ROWS), ["doc_id", "digest"]).select("rep", "text").mapInArrow(_sets(width), "rep long, s array<long>").dropDuplicates(["rep"])
    sets = materialize(sets, "sets")

    # First each member meets the smallest hub of all its buckets only: a large group needs one link a member.
    nearest = members.groupBy("rep").agg(F.min("hub").alias("hub")).where("hub < rep")
    label = _grown(None, _confirmed(nearest.select(F.col("hub").alias("a"), F.col("rep").alias("b")), sets, percent))
    # Then the hubs of its other buckets, where they are still in another component.
    hubs = label.select(F.col("node").alias("hub"), F.col("component").alias("hc"))
    star = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(hubs, "hub", "left")
    star = star.where(F.coalesce("component", "rep") != F.coalesce("hc", "hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    label = _grown(label, _confirmed(star, sets, percent))

    # Buckets whose members beside the hub, which all have met, still are in several components.
    at = members.where("rep <> hub").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    at = materialize(at, "labelled")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    wide = at.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), blocks.alias("blocks")).where("least <> most").select("key", "blocks")
    open_ = materialize(at.join(wide, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")), "open")
    dealt = open_.join(sets, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep", "n", "c", "s")
    order = ["key", "lo", "hi"]
    label = _grown(label, dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_linked(percent), "a long, b long").distinct())

    # The sets of one id belong together.
    of_id = sig.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2", "n")
    several = of_id.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("lo"), F.max(F.struct("h1", "h2", "n")).alias("hi")).where("lo <> hi").select("doc_id")
    held = of_id.join(several, "doc_id", "left_semi").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("doc_id", "rep").distinct()
    joined = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    label = _grown(label, joined)

    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", "doc_id", F.coalesce("component", "rep").alias("c"))
    named = named.join(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("h1", "h2", "n", "component_id")
    out = sig.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    group = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(False)).alias("kept")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group; rows without an id stay.

    Repeated rows with one id count as one document and all stay or all go.
    """
    gone = near_duplicates(docs, **options).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
