"""Byte-level BPE: whole texts to ids with offsets, and ids back to bytes.

A rank file lists tokens as bytes.  Each byte has a printable stand-in
character, under which the tokenizers library holds the vocabulary; the merges
that the library needs are read off the ranks: joining a token's bytes by rank,
lowest first, ends with one pair, and that pair is its merge.  The library's
byte-level splitter then encodes Arrow batches, with repeated pieces
remembered (``tokens.Encoder``).

Ids travel as little-endian unsigned 32-bit integers.  Offsets come from the
tokens' bytes: a token that ends inside a character covers the whole of it, and
so does the one that goes on there, as the library reports them.

Decoding looks each id's bytes up in a table made by the stand-ins backwards and
joins them before anything is read as text, so characters split over tokens are
whole again; ``decode_stream`` does the same for ids that arrive in pieces, and
holds back the bytes of an unfinished character.

Work goes by slices of some megabytes, so memory is bounded by the longest text.

Defined cases: null and empty texts have no ids and decode to no bytes; a very
long text is encoded whole; equal texts and repeated rows have equal ids, each
row its own; strings of special tokens are plain text; an id outside the
vocabulary is an error; ids that aren't whole characters decode to those bytes,
and as text of a stream to U+FFFD; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import slices
from pagemill.llm.tokens import Encoder, _gather

ID = np.dtype("<u4")
#: Bytes of text or ids that a worker handles at once, bytes that it hands over at once, and pieces that it remembers: an
#: encoder and a decoder run side by side in each task.
SLICE, DECODED, MEMO = 1 << 20, 4 << 20, 80_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a rank file (base64 and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are joined last when the bytes of a token join by rank; None if they never become one."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        _, i = min((ranks.get(a + b, len(ranks) << 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if parts[i] + parts[i + 1] not in ranks:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_of(ranks: dict[bytes, int]):
    """The library's tokenizer with these ranks, without special tokens."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    stands = byte_characters()
    name = lambda token: "".join(stands[b] for b in token)
    pairs = (last_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1)
    merges = [(name(p[0]), name(p[1])) for p in pairs if p]
    made = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


@functools.lru_cache(maxsize=2)
def specification(path: str) -> str:
    """The tokenizer of a rank file as the library writes it; once a driver, for the merges take a second or two."""
    return tokenizer_of(read_ranks(path)).to_str()


class Table:
    """The bytes of each token of a specification: token i has data[place[i] : place[i] + width[i]]."""

    def __init__(self, vocab: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_characters())}
        tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(back[c] for c in token)
        self.spaced = np.array([t.startswith(b" ") for t in tokens], bool)
        self.data, self.width = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.width) - self.width

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one behind the other."""
        return _gather(self.data, self.place[ids], self.width[ids])

    def spans(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token, counted from its text's start; ``sizes`` are the texts' numbers of ids."""
        data, width = self.bytes_of(ids), self.width[ids]
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
        end = np.cumsum(width)
        first, last = begun[end - width + 1] - 1, begun[end]
        text = np.repeat(np.concatenate([[0], last])[np.cumsum(sizes) - sizes], sizes)
        return first - text, last - text


class Codec(Encoder):
    """The encoder of a specification."""

    def __init__(self, spec: str, memo: int = MEMO):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(spec)
        self.kind = self._kind(json.loads(spec))
        self.bpe = Tokenizer(self.full.model)
        self.bpe.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype, self.letters = ID, {chr(b): c for b, c in enumerate(byte_characters()) if b > 127 and chr(b) != c}
        self.table = Table(self.full.get_vocab())
        self.border = self.table.spaced
        self.limit, self.memo, self.flat = memo, {}, np.empty(0, self.dtype)
        self.start, self.size, self.used = (np.empty(0, np.int64) for _ in range(3))


@functools.lru_cache(maxsize=2)
def _codec(spec: str) -> Codec:
    """This process's encoder of a specification, with what it has learnt so far."""
    return Codec(spec)


@functools.lru_cache(maxsize=2)
def _table(spec: str) -> Table:
    """The same of decoders, which need no tokenizer."""
    return Table(json.loads(spec)["model"]["vocab"])


def _binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes as an Arrow column; ``ends`` are byte offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _encoder(spec: str, spans: bool):
    def run(batches):
        for b in batches:
            for part in slices(b, "text", SLICE):
                codec = _codec(spec)
                ids, offsets = codec.ids(part.column("text"))
                columns = [part.column("doc_id"), _binaries(ids.astype(ID), offsets * ID.itemsize), pa.array(np.diff(offsets))]
                names = ["doc_id", "ids", "n_tokens"]
                if spans:
                    at = pa.array(offsets, pa.int32())
                    columns += [pa.ListArray.from_arrays(at, pa.array(x)) for x in codec.table.spans(ids, np.diff(offsets))]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, ranks: str, *, spans: bool = False) -> DataFrame:
    """doc_id, ids (binary) and n_tokens of every row; with ``spans`` also starts and ends of the tokens, in code points."""
    spec = specification(ranks)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long" + (", starts array<long>, ends array<long>" if spans else "")
    return docs.select("doc_id", "text").mapInArrow(_encoder(spec, spans), schema)


def _decoder(spec: str, column: str):
    def run(batches):
        for b in batches:
            for part in slices(b, column, SLICE):
                table, held = _table(spec), part.column(column).to_pylist()
                flat = np.frombuffer(b"".join(x for x in held if x), ID).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum([len(x or b"") // ID.itemsize for x in held])])
                width = np.concatenate([[0], np.cumsum(table.width[flat])])[upto]  # bytes of all texts before each
                at = 0
                while at < len(held):
                    to = max(at + 1, int(np.searchsorted(width, width[at] + DECODED, side="right")) - 1)
                    data = table.bytes_of(flat[upto[at] : upto[to]])
                    yield pa.RecordBatch.from_arrays([*part.slice(at, to - at).columns, _binaries(data, width[at : to + 1] - width[at])], names=[*b.schema.names, "decoded"])
                    at = to

    return run


def decode(encoded: DataFrame, ranks: str, column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoder(specification(ranks), column), f"{fields}, decoded binary")


def decode_stream(chunks: Iterable[Iterable[int]], ranks: str) -> Iterator[str]:
    """Text of ids that arrive in pieces, whole characters only; a rest that never becomes one ends as U+FFFD."""
    import codecs

    table, reader = _table(specification(ranks)), codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield reader.decode(table.bytes_of(np.fromiter(chunk, np.int64)).tobytes())
    yield reader.decode(b"", True)
