"""Token ids in Arrow files of equal-length sequences.

Each shard is an Arrow file of record batches whose columns are fixed-size
lists: ``ids`` (unsigned 16 or 32 bits, as the vocabulary needs) and ``mask``
(true for a token, false for the padding behind a shard's last one).  Nothing
is compressed, so sequence i of a memory-mapped file is found by arithmetic and
read without a copy.  Beside it, an index file holds doc_id, start (within the
shard) and n_tokens of the shard's documents, in their order.

Documents are dealt to shards by ranges of (doc_id, digest of the text) and
sorted within, so the shards' order is the order of ids, and rows without an id
or of one id don't all meet in one shard.  Every attempt of a task writes files
of its own; the manifest, a table that Spark commits once a task, names those
that count, so lost, repeated and rival attempts leave whole files only.

Defined cases: null and empty texts have the end id alone; a very long text is
written whole, over as many sequences as it needs, and held once in its task;
rows without an id come first; ties of an id are ordered by digest, then text;
repeated rows are all written; an empty table gives no shard; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_batches, slices
from pagemill.llm.tokens import shared

#: Sequences in a record batch.
BATCH = 64
#: Bytes of text encoded at once, and pieces that a worker remembers: a worker takes some 150 MB, for an executor runs several beside its heap.
SLICE, MEMO = 1 << 20, 80_000
MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_sequences long"
_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _index_of(file: str) -> str:
    return file.removesuffix(".arrow") + ".docs.arrow"


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """Writes one attempt at a shard: its sequences and its index."""

    def __init__(self, folder: str, file: str, dtype: np.dtype, length: int):
        store, folder = fs.FileSystem.from_uri(folder)
        store.create_dir(folder, recursive=True)
        self.dtype, self.length, self.schema = dtype, length, _schema(dtype, length)
        self.sinks = [store.open_output_stream(f"{folder}/{n}") for n in (file, _index_of(file))]
        self.out, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], _INDEX)
        self.waiting, self.n_tokens, self.n_docs, self.n_sequences = np.empty(0, dtype), 0, 0, 0

    def _put(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in their order, their ids one behind the other."""
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=_INDEX))
        self.n_tokens += len(ids)
        self.n_docs += len(sizes)
        flat, full = np.concatenate([self.waiting, ids]), BATCH * self.length
        whole = len(flat) // full * full
        for at in range(0, whole, full):
            self._put(flat[at : at + full], full)
        self.waiting = flat[whole:].copy()

    def close(self) -> None:
        if len(self.waiting):
            padded = np.zeros(-(-len(self.waiting) // self.length) * self.length, self.dtype)
            padded[: len(self.waiting)] = self.waiting
            self._put(padded, len(self.waiting))
        for w in (self.out, self.index, *self.sinks):
            w.close()


def _ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id behind each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out


def _writer(folder: str, tokenizer: str, end_id: int, length: int):
    def run(batches):
        task, shard = TaskContext.get(), None
        file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        for b in batches:
            for part in slices(b, "text", SLICE):
                encoder = shared(tokenizer, MEMO)
                shard = shard or _Shard(folder, file, encoder.dtype, length)
                ids, offsets = encoder.ids(part.column("text"))
                shard.add(part.column("doc_id"), _ended(ids, offsets, end_id), np.diff(offsets) + 1)
        if shard is not None:
            shard.close()
            row = [task.partitionId(), file, shard.n_docs, shard.n_tokens, shard.n_sequences]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _MANIFEST.types)], schema=_MANIFEST)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Write the shards and their manifest under ``folder``; returns the manifest."""
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    with bounded_batches(docs.sparkSession):
        rows.mapInArrow(_writer(f"{folder}/shards", tokenizer, end_id, length), MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _open(store, path: str):
    """A reader over the file; local files are memory-mapped."""
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))


def _reader(folder: str):
    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                ids, index = _open(store, f"{at}/{file}"), _open(store, f"{at}/{_index_of(file)}")
                done, held, held_from = 0, np.empty(0, np.uint32), 0
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    n, starts, crc = docs.column("n_tokens").to_numpy(), docs.column("start").to_numpy(), []
                    for start, size in zip(starts.tolist(), n.tolist()):
                        parts = [held[start - held_from :]]
                        while held_from + len(held) < start + size:
                            seq = ids.get_batch(done)
                            flat = seq.column("ids").flatten().to_numpy()
                            valid = seq.column("mask").flatten().to_numpy(zero_copy_only=False)
                            held_from += len(held)
                            held = (flat if valid.all() else flat[valid]).astype("<u4")
                            done += 1
                            parts.append(held)
                        got = parts[0][:size] if len(parts) == 1 else np.concatenate(parts)[:size]
                        crc.append(zlib.crc32(got.tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array(starts + base), docs.column("n_tokens"), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("shard", "file", "n_tokens").orderBy("shard").collect()  # a row a shard
    base, rows = 0, []
    for r in shards:
        rows.append((r["file"], base))
        base += r["n_tokens"]
    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(_reader(f"{folder}/shards"), "doc_id long, start long, n_tokens long, ids_crc32 long")


@dataclass
class Sequences:
    """Random access to one shard's sequences without copying."""

    path: str

    def __post_init__(self):
        store, at = fs.FileSystem.from_uri(self.path)
        self.file = _open(store, at)
        self.first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.file.get_batch(i // self.first)
        k = i % self.first
        return batch.column("ids")[k].values.to_numpy(), batch.column("mask")[k].values
