"""Exact token ids of whole texts, with a memo of the pieces that repeat.

The tokenizers library does all encoding.  Two kinds of tokenizer files encode
a text piece by piece, with nothing crossing certain white space; there each
distinct piece is encoded once and remembered:

``word``  word-end BPE that lowers the case and drops white space: pieces
          between spaces and newlines.
``byte``  byte-level BPE: a piece begins with the single space before it, and a
          newline between two words is a piece of its own.

Any other file, a cased one with word ends too, is handed whole texts.

Work goes by slices of an Arrow column: a slice is split and dictionary-encoded
as a whole, each distinct piece is looked up once, and the ids of all texts come
from the memo by one gather.  The memo holds about ``memo`` pieces; a full one
keeps the half that most slices used, so memory stays bounded on any input.  A
Python worker keeps its encoders (``shared``) for the tasks it runs next.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagemill.llm.common import strings

_MARKS = ".,;:!?"
#: A letter word of Latin-1, as the two kinds see it.
_LETTERS = {"word": "^[a-zß-öø-ÿ]+$", "byte": "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$"}
#: The white space beside space and newline, and the places where white space meets.
_OTHER_SPACE = r"\t\x0B\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD_SPACE = rf"  | \n|\n |\n\n|^[ \n]|[ \n]$|[{_OTHER_SPACE}]"
#: Single spaces between two characters that aren't white space.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
# The one split of a word-end file that is known never to join what white space parts.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[str, str]:
    """The stand-ins of byte-level vocabularies, for the bytes above 127 that have one other than themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): chr(256 + i) for i, b in enumerate(rest) if b > 127}


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _strings(texts: pa.Array) -> np.ndarray:
    """The texts as Python strings."""
    return texts.to_numpy(zero_copy_only=False)


class Encoder:
    def __init__(self, path: str, memo: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind, suffix = self._kind(spec), (spec.get("model") or {}).get("end_of_word_suffix")
        self.bpe = Tokenizer(self.full.model)
        self.bpe.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.border = np.zeros(self.full.get_vocab_size(), bool)
        for token, i in self.full.get_vocab().items():
            self.border[i] = token.startswith("Ġ") if self.kind == "byte" else bool(suffix) and token.endswith(suffix)
        # Piece i has the ids flat[start[i] : start[i] + size[i]]; ``used`` counts the slices that held it.
        self.limit, self.memo, self.flat = memo, {}, np.empty(0, self.dtype)
        self.start, self.size, self.used = (np.empty(0, np.int64) for _ in range(3))

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, model, norm = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("normalizer") or {}
        special = all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
        if model.get("type") != "BPE" or model.get("dropout") or not special:
            return "whole"
        steps, norms = pre.get("pretokenizers", []), norm.get("normalizers", [])
        if model.get("end_of_word_suffix") and [s.get("type") for s in steps] == ["Split", "ByteLevel"]:
            cut = steps[0]
            same = cut["pattern"].get("Regex") == _WORD_SPLIT and cut.get("invert") and cut.get("behavior") == "Removed"
            plain = not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            lower = [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"].get("Regex") == r"\s+" and norms[1]["content"] == " "
            return "word" if same and plain and lower else "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "byte"
        return "whole"

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's own ids of the texts, one behind the other, and their numbers."""
        ids = [np.array(e.ids, self.dtype) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate([np.empty(0, self.dtype), *ids]), np.array([len(x) for x in ids], np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of letter words, many to a call.

        A word's last token bears the word end (``word``), its first token the
        space before it (``byte``); that cuts the ids of a call.
        """
        if not words:
            return self._library([])
        coded = " ".join(words)
        if not coded.isascii():
            coded = coded.encode("utf-8").decode("latin-1")
            for byte, letter in self.letters.items():
                coded = coded.replace(byte, letter)
        coded = (" Ġ" + coded.replace(" ", " Ġ")).split() if self.kind == "byte" else coded.split(" ")
        texts = [" ".join(coded[at : at + 64]) for at in range(0, len(coded), 64)]
        flat = np.concatenate([np.array(e.ids, self.dtype) for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.flatnonzero(self.border[flat])
        return flat, np.diff(at, append=len(flat)) if self.kind == "byte" else np.diff(at, prepend=-1)

    def _keep(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Put pieces that aren't there into the memo."""
        self.memo.update(zip(names, range(len(self.memo), len(self.memo) + len(names))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(sizes), np.int64)])
        self.flat = np.concatenate([self.flat, flat])

    def _places(self, names) -> np.ndarray:
        """The pieces' places in the memo, -1 where it lacks them."""
        return np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))

    def _learn(self, pieces: pa.Array) -> None:
        """Put distinct unseen pieces into the memo."""
        core = pc.utf8_rtrim(pieces, _MARKS)
        marks = pc.subtract(pc.binary_length(pieces), pc.binary_length(core))
        plain = pc.and_(pc.less_equal(marks, 1), pc.match_substring_regex(core, _LETTERS[self.kind]))
        other = _strings(pieces.filter(pc.invert(plain))).tolist()
        self._keep(other, *self._library(other))
        pieces, core, marked = pieces.filter(plain), core.filter(plain), pc.equal(marks.filter(plain), 1)
        words = [c for c in _strings(core.unique()).tolist() if c not in self.memo]
        # Behind a space its stand-in is the first letter of the word.
        self._keep(words, *self._words([c[1:] for c in words] if self.kind == "byte" else words))
        pieces, core = (_strings(x.filter(marked)).tolist() for x in (pieces, core))
        ends = [p[-1] for p in pieces]
        new = [m for m in _MARKS if m not in self.memo and m in ends]
        self._keep(new, *self._library(new))
        both = np.stack([self._places(core), self._places(ends)], axis=1)
        self._keep(pieces, _gather(self.flat, self.start[both].ravel(), self.size[both].ravel()), self.size[both].sum(axis=1))

    def _forget(self) -> None:
        """Keep the half of the pieces that most slices held."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
        names = list(self.memo)  # in the order of their places
        self.memo = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.flat = _gather(self.flat, self.start[stay], self.size[stay])
        self.size, self.used = self.size[stay], self.used[stay] // 2
        self.start = np.cumsum(self.size) - self.size

    def _joined(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts given as lists of pieces."""
        coded = lists.flatten().dictionary_encode()
        names = _strings(coded.dictionary)
        at = self._places(names)
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            at[new] = self._places(names[new])
        self.used[at] += 1
        piece = at[coded.indices.to_numpy()]
        size = self.size[piece]
        upto = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.flat, self.start[piece], size), upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of ``dtype``."""
        flat, offsets = self.ids(pa.array(texts, pa.large_string()))
        return [flat[i:j].tobytes() for i, j in zip(offsets, offsets[1:])]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets at which each text's begin and end; null is an empty text."""
        texts = strings(texts)
        if self.kind == "whole" or not len(texts):
            flat, sizes = self._library(texts.to_pylist())
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        if len(self.memo) > self.limit:
            self._forget()
        if self.kind == "word":
            wide = pc.match_substring_regex(texts, r"[^\x{00}-\x{FF}]")  # Latin-1 has one lower case, whoever makes it
            texts = pc.if_else(wide, texts, pc.utf8_lower(texts))
            return self._joined(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", "\x1f "), "\n", "\x1f\n\x1f")
        flat, offsets = self._joined(pc.split_pattern(marked, "\x1f"))
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(where):
            return flat, offsets
        cut = [_SINGLE.split(t) for t in texts.take(pa.array(where)).to_pylist()]
        rest, between = self._joined(pa.array([[c[0], *(" " + p for p in c[1:])] for c in cut], pa.list_(pa.large_string())))
        starts, sizes = offsets[:-1].copy(), np.diff(offsets)
        starts[where], sizes[where] = len(flat) + between[:-1], np.diff(between)
        return _gather(np.concatenate([flat, rest]), starts, sizes), np.concatenate([[0], np.cumsum(sizes)])


@functools.lru_cache(maxsize=2)
def shared(path: str, memo: int = 700_000) -> Encoder:
    """This process's encoder of a file, with what it has learnt so far."""
    return Encoder(path, memo)
