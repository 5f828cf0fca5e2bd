"""Periodic runs of words: a sparse diagonal DP over a text's words.

A run is a longest stretch of words that repeats with a smallest period ``q``
(words ``q`` apart are equal) and is ``least`` words and ``times * q`` long at
least.  On the diagonal of lag ``q`` it is an unbroken line of matches.

For each word in turn its earlier occurrences prolong the diagonals of their
lags; a diagonal that ends long enough is a run at once.  Taken by single words
that is quadratic: the k-th occurrence of a word has k - 1 lags.  So lags go by
octaves, and in the octave from ``2**k`` on a word is looked up together with the
``2**(k+1) - 1`` words behind it.  Such a stretch is no shorter than the period,
hence inside a run its nearest earlier occurrence is one period back, neither
nearer (the period would not be the smallest) nor farther.  So each word keeps
one active lag an octave, the table of lengths is a count of equal lags in a
row, and nothing is lost; a run of three periods or more has such a stretch in
its octave.  Stretches are named by pairs of stretches half as long, exactly, and
those that occur once in their text are dropped, as no longer one recurs; what
is left is sparse.

Tasks take slices of an Arrow column, all its texts in one pass.

Defined cases: null, empty and blank texts have no words, runs or kept words;
very long texts are one sequence, whole, in O(n log n); runs that overlap are all
reported, by start and then period; repeated rows and equal texts give equal
results, each row its own, and a null or repeated ``doc_id`` is carried along;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagemill.llm.common import slices, strings

RUNS = "array<struct<start:long,length:long,period:long>>"


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in the order of their places: a name for each that occurs again (else -1), and how far back it stood last (else 0)."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    name, back = np.full(len(key), -1), np.zeros(len(key), np.int64)
    name[order] = np.where(again, np.cumsum(np.concatenate([[True], ~same])[: len(key)]), -1)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]  # in places of ``key``; the caller turns them into words
    return name, back


def find_runs(words: np.ndarray, offsets: np.ndarray, *, least: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """text, start, length and period of the runs of all texts, in that order; ``words`` are numbers, equal for equal words."""
    if times < 3:
        raise ValueError("an octave is only sure to see runs of three periods")
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words))
    name = _named(text * (int(words.max(initial=0)) + 1) + words)[0]
    found, low = [], 1  # the octave of lags is low .. 2 low - 1, its stretches are 2 low long
    while low * times <= n.max(initial=0):
        wide = np.full(len(words) + low, -1)
        wide[place] = name
        left, right = name, wide[place + low]
        keep = (left >= 0) & (right >= 0)
        place, key = place[keep], left[keep] * (int(name.max(initial=0)) + 1) + right[keep]
        if not len(place):
            break
        name, back = _named(key)
        lag = np.where(back > 0, place - place[np.arange(len(place)) - back], 0)
        lag[(lag < low) | (lag >= 2 * low)] = 0
        # The table of lengths: a diagonal goes on where the word before has the same lag.
        goes_on = (lag[1:] == lag[:-1]) & (place[1:] == place[:-1] + 1)
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        count = np.diff(np.append(begin, len(place)))
        period = lag[begin]
        length = count + 2 * low - 1 + period
        ok = (period > 0) & (length >= np.maximum(least, times * period))
        found.append(np.stack([place[begin] - period, length, period])[:, ok])
        live = name >= 0
        place, name = place[live], name[live]
        low *= 2
    start, length, period = np.concatenate([np.empty((3, 0), np.int64), *found], axis=1)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = text[start]
    return of, start - offsets[of], length, period


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and the texts' offsets; white space is the space and the controls from tab to return."""
    lists = pc.ascii_split_whitespace(strings(texts))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def _find(least: int, times: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                words, offsets = words_of(part.column("text"))
                coded = words.dictionary_encode()
                of, start, length, period = find_runs(coded.indices.to_numpy().astype(np.int64), offsets, least=least, times=times)
                # A word goes if a run has it behind the run's first period.
                first = offsets[of] + start
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, first + period, 1)
                np.add.at(cover, first + length, -1)
                stays = np.cumsum(cover[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays))), pa.scalar(" ", pa.large_string()))
                each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=part.num_rows))]), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), runs, text.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs and the text without what repeats, for each row of ``docs`` (doc_id, text)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_find(least, times), schema)

#: The query over ``documents``: all pairs of equal words within a text, so only for small tables.
ORACLE = r"""WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda h, b:
      list_reduce(list_prepend(xor(h, b), generate_series(1, 8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (
  SELECT doc_id, i, w[1 + CASE WHEN i < coalesce(a, n) THEN i ELSE a + (i - a) % p END] AS s, n
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM p)),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
l AS (SELECT doc_id, min(i) - q AS s, count(*) + q AS n, q FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, n, min(q) AS q FROM l GROUP BY doc_id, s, n),
f AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s + q, s + n - 1)) AS i FROM r),
k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
