"""Maximal periodic runs of words, by Lyndon words.

Every run holds full Lyndon words of its period under one of two orders of the words, the given or the reversed
one, and each of them is the longest Lyndon word that starts at its place. So a stack is scanned from right to left
once under either order: the longest Lyndon word at a place ends where the next smaller suffix starts. Suffixes
that start alike are compared by their longest common extension, found by binary search over rolling hashes.
What the hashes call equal is then compared word by word: hashes of unequal words may agree, so an extension is
only ever found too long, and is cut back to the first pair of words that differs. Of each distance the stretch
that is already compared is remembered, so no word is compared with one at the same distance twice.
Equal neighbouring Lyndon words are then extended to both sides, all at once, again by binary search with hashes,
and every run found is compared with itself shifted by its period. No suffix array is built.

Words of runs of the asked length recur: each three words in a row stand at least ``times - 1`` times in their
text. Only stretches of such words are scanned; the others can't lie in a run.

Defined cases: null and empty texts have no words and no runs; equal rows get equal results; a run's period is
its smallest, so runs don't tie; a very long text is scanned whole, in time n log n; an empty table gives no rows; other columns are kept, and
those with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.arrowkit import ragged, slices, small_batches, utf8_parts
from factloom.llm.words import mix, windows, with_doc, words_of

#: Least words of a run, and least length in periods.
LEAST, TIMES = 6, 4
#: Words that are compared one by one before hashes are asked.
NEAR = 8
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
FIELDS = ("n_words", "runs", "collapsed")


class Extensions:
    """Longest common extensions within one sequence of numbers whose last stands nowhere else."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.array, self.n = x, n
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])
        self.x, self._sums, self._power = x.tolist(), self.sums.tolist(), self.power.tolist()
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, n: int) -> bool:
        s = self._sums
        return not ((s[i + n] - s[i]) * self._power[j - i] - s[j + n] + s[j]) & _MASK

    def right(self, i: int, j: int) -> int:
        """How many numbers from i < j on equal those from j on."""
        x, known = self.x, self.known.get(j - i)
        if known and known[0] <= i <= known[1]:
            return known[1] - i
        n = 0
        while n < NEAR and x[i + n] == x[j + n]:
            n += 1
        if n < NEAR:
            return n
        if known and i < known[0] <= i + n:
            self.known[j - i] = (i, known[1])
            return known[1] - i
        most, step = self.n - j, NEAR
        while n + step <= most and self._alike(i, j, n + step):
            n += step
            step *= 2
        while step > 1:
            step //= 2
            if n + step <= most and self._alike(i, j, n + step):
                n += step
        new = known[0] if known and i < known[0] <= i + n else i + n
        if x[i:new] != x[j : new + j - i]:
            n = self._first_difference(i, j, new - i)
        self.known[j - i] = (i, i + n)
        return n

    def _first_difference(self, i: int, j: int, n: int) -> int:
        return int(np.flatnonzero(self.array[i : i + n] != self.array[j : j + n])[0])

    def both(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the sequence equals itself shifted by j - i, to the left of every i and from it on; by hashes alone."""
        left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        d = self.power[j - i]
        step = 1 << max(int(self.n).bit_length() - 1, 0)
        while step and len(i):
            a, b = i - left - step, i + right + step
            ok = a >= 0
            a = np.maximum(a, 0)
            left += step * (ok & ((self.sums[i] - self.sums[a]) * d == self.sums[j] - self.sums[a + j - i]))
            ok = b + j - i <= self.n
            b = np.where(ok, b, i)
            right += step * (ok & ((self.sums[b] - self.sums[i]) * d == self.sums[b + j - i] - self.sums[j]))
            step //= 2
        return left, right

    def exact(self, i: int, j: int) -> tuple[int, int]:
        """As ``both`` for one pair, number by number."""
        x, p, a, b = self.x, j - i, i, i
        while a and x[a - 1] == x[a - 1 + p]:
            a -= 1
        while b + p < self.n and x[b] == x[b + p]:
            b += 1
        return i - a, b - i


def lyndon_ends(e: Extensions) -> np.ndarray:
    """Where the longest Lyndon word that starts at each place ends: at the next smaller suffix, or the end."""
    x, right, n = e.x, e.right, e.n
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        j, first = i + 1, x[i]
        while j < n:
            other = x[j]
            if first > other:
                break
            if first == other:
                same = right(i, j)
                if x[i + same] > x[j + same]:
                    break
            j = ends[j]
        ends[i] = j
    return np.array(ends, np.int64)


def maximal_runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, end, period) of all maximal runs of at least ``least`` numbers and ``times`` >= 2 periods, sorted.

    Negative numbers part the sequence: each must stand in it once, and the last number must be one. They are
    smaller than all others under both orders.
    """
    found = [np.zeros((0, 3), np.int64)]
    for turned in (False, True):
        y = np.where(x < 0, x, x.max(initial=0) - x) if turned else x
        e = Extensions(y)
        ends = np.append(lyndon_ends(e), e.n)
        i = np.arange(e.n)
        j = ends[:-1]
        p = j - i
        fits = times * p <= e.n
        if times > 2:  # two whole Lyndon words of a run, at least, follow one another
            fits &= (ends[j] - j == p) & (y[np.minimum(j, e.n - 1)] == y)
        i, j = i[fits], j[fits]
        left, right = e.both(i, j)
        ends_, good = j + right, (j + right - (i - left) >= np.maximum(least, times * (j - i)))
        rows = np.stack([i - left, ends_, j - i], 1)[good]
        rows, of = np.unique(rows, axis=0, return_index=True)
        i, j = i[good][of], j[good][of]
        for k, (a, b, q) in enumerate(rows.tolist()):
            if not np.array_equal(y[a : b - q], y[a + q : b]):
                before, after = e.exact(int(i[k]), int(j[k]))
                rows[k, :2] = i[k] - before, j[k] + after
        length = rows[:, 1] - rows[:, 0]
        found.append(rows[length >= np.maximum(least, times * rows[:, 2])])
    return np.unique(np.concatenate(found), axis=0)


def _candidates(word_hash: np.ndarray, doc: np.ndarray, least: int, times: int) -> np.ndarray:
    """Words that may lie in a run: those in three words in a row that recur in their text, in stretches of ``least``."""
    at, h = windows(word_hash, doc, 3)
    _, which, count = np.unique(with_doc(h, doc[at]), return_inverse=True, return_counts=True)
    often = at[count[which] >= min(times - 1, least - 2)]
    mark = np.zeros(len(word_hash) + 1, bool)
    mark[[*[often + k for k in range(3)]]] = True
    edge = np.flatnonzero(np.diff(mark[:-1].astype(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return ragged((end - begin)[long], begin[long])


def runs_of_texts(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: the number of words of each, and of all runs the text and (start, end, period) in words."""
    w, n = words_of(data, offsets), len(offsets) - 1
    n_words = np.bincount(w.doc, minlength=n)
    first = np.cumsum(n_words) - n_words
    at = _candidates(w.hashes(w.start, w.end), w.doc, max(least, 3), times)
    if not len(at):
        return n_words, np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    ids: dict[bytes, int] = {}
    raw, start, end = w.padded, w.start[at].tolist(), w.end[at].tolist()
    numbers = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(start, end, strict=True)], np.int64)
    parted = np.append(np.flatnonzero((np.diff(at) != 1) | (np.diff(w.doc[at]) != 0)) + 1, len(at))
    x = np.insert(numbers, parted, -1 - np.arange(len(parted)))
    place = np.insert(at, parted, -1)
    runs = maximal_runs(x, least, times)
    begin = place[runs[:, 0]]
    doc = w.doc[begin]
    begin = begin - first[doc]
    runs = np.stack([begin, begin + runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    order = np.lexsort((runs[:, 2], runs[:, 0], doc))
    return n_words, doc[order], runs[order]


def _collapsed(text: bytes, n: int, runs: np.ndarray) -> bytes:
    words = text.split()
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _find(text_col: str, names: list[str], least: int, times: int) -> Callable:
    def run(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in slices(offsets, 1 << 20):
                own, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                n_words, doc, runs = runs_of_texts(raw, own, least, times)
                edge = np.searchsorted(doc, np.arange(b - a + 1))
                left = [_collapsed(raw[own[k] : own[k + 1]].tobytes(), int(n_words[k]), runs[edge[k] : edge[k + 1]]) for k in range(b - a)]
                parts = [runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]]
                told = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["start", "length", "period"]))
                new = [pa.array(n_words, pa.int64()), told, pa.array(left, pa.binary()).cast(pa.string())]
                kept = batch.slice(a, b - a).drop_columns([c for c in names if c in batch.schema.names])
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], [*kept.schema.names, *names])

    return run


def find_runs(docs: DataFrame, text_col: str = "text", prefix: str = "", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words; by start, then period) and collapsed appended.

    collapsed: the words, joined by single spaces, without those that a run holds after its first period.
    """
    small_batches(docs.sparkSession)
    names = [prefix + c for c in FIELDS]
    kept = [f for f in docs.schema if f.name not in names]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    new = zip(names, ("long", "array<struct<start:long,length:long,period:long>>", "string"), strict=True)
    return docs.mapInArrow(_find(text_col, names, least, times), ", ".join([*[fields] * bool(fields), *(f"`{c}` {t}" for c, t in new)]))
