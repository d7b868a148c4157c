"""Packing token sequences by a non-negative least-squares plan over the histogram of lengths.

Each document is cut into full windows and one tail; full windows are sequences as they are. What is left
is a histogram of at most ``window - 1`` tail lengths, whose size doesn't depend on the data. On the driver
all combinations of two or three lengths that fill a window exactly are enumerated, a non-negative
least-squares solution says how often to use each, the repeats are rounded to what the histogram holds,
exact fits among the rest are taken greedily, and the residue is laid end to end and cut at window borders.
Spark then numbers the tails of each length and every tail finds its slot from its number alone.

Ids come from tiktoken with the vocabulary of ``Bpe``. It takes no run of about a million blanks, so texts with
long runs go to ``Bpe`` itself, which gives the same ids.

Defined cases: null and empty texts are documents of the end token only; equal rows and equal doc_ids are
packed one by one, so ties in length are broken by the id and then by the row's place, and only decide which of them goes where; a very long text is encoded whole and becomes many windows; an empty table gives no pieces;
columns other than the id and the text aren't carried.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.arrowkit import ragged, small_batches
from factloom.llm.bpe import WORDS, Bpe, _loaded, tokenizer_source
from factloom.llm.scratch import materialize

#: Rows of one length that are numbered together at most, about.
NUMBERED_TOGETHER = 20_000
#: Blanks in a row from which on tiktoken isn't asked: it keeps a way back for each and has room for less than a million.
LONG_BLANKS = 100_000
#: Python's blanks include all that tiktoken's pattern takes for one.
_BLANKS = re.compile(r"\s+")


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """All multisets of two or three present lengths with the sum ``window``; a pair has 0 in the third column."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    lengths = np.flatnonzero(have[:window])
    lengths = lengths[lengths > 0]
    pairs = lengths[(lengths * 2 <= window) & have[window - lengths]]
    out = [np.stack([pairs, window - pairs, 0 * pairs], 1)]
    for a in lengths[lengths * 3 <= window].tolist():
        b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(out)


def nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that bring the lengths used near ``counts``: accelerated projected gradient, length 0 left out."""
    size, b = len(counts), counts.astype(float)
    used = lambda x: np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
    rows = np.bincount(combos.ravel(), minlength=size)
    steep = combos.shape[1] * max(1, rows[1:].max(initial=1))
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        gap = b - used(z)
        gap[0] = 0
        after = np.maximum(0, z + gap[combos].sum(1) / steep)
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = after + (t - 1) / t_after * (after - x)
        if (after - x) @ gap[combos].sum(1) < 0:  # the momentum overshot
            z, t_after = after, 1.0
        x, t = after, t_after
    return x


class Plan:
    """Slots of every tail length, from the histogram alone."""

    def __init__(self, window: int, counts: np.ndarray):
        """counts[n]: tails of n tokens, 0 < n < window."""
        self.window, left = window, counts.astype(np.int64).copy()
        left[0] = 0
        combos = combinations(window, np.flatnonzero(left))
        x = nnls(combos, left) if len(combos) else np.zeros(0)
        chosen: dict[int, int] = {}
        for rounds in (np.floor(x + 0.5).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):
            for i in np.argsort(-x, kind="stable").tolist():
                lengths, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
                if n := min(int(rounds[i]), int((left[lengths] // times).min())):
                    left[lengths] -= n * times
                    chosen[i] = chosen.get(i, 0) + n
        self.repeats = list(chosen.values())
        taken = counts.astype(np.int64) - left
        taken[0] = 0
        slots, sequences = [], 0
        for i, n in chosen.items():
            offset = 0
            for length in combos[i][combos[i] > 0].tolist():
                slots.append((length, n, sequences, offset))
                offset += length
            sequences += n
        slots.sort(key=lambda s: s[0])
        table = np.array(slots, np.int64).reshape(-1, 4)
        base = np.cumsum(taken) - taken
        self.base, self.taken = base, taken
        self.slot_start = np.cumsum(table[:, 1]) - table[:, 1]
        self.slot_sequence, self.slot_offset = table[:, 2], table[:, 3]
        rest = left * np.arange(len(left))
        self.rest_base = np.cumsum(rest) - rest
        self.rest_sequence = sequences
        self.sequences = sequences + -(-int(rest.sum()) // window)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of the number-th tail of a length, and how many of its tokens fit before the window's end."""
        planned = number < self.taken[length]
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        if planned.any():
            at = self.base[length[planned]] + number[planned]
            slot = np.searchsorted(self.slot_start, at, "right") - 1
            sequence[planned] = self.slot_sequence[slot] + at - self.slot_start[slot]
            offset[planned] = self.slot_offset[slot]
        free = ~planned
        position = self.rest_base[length[free]] + (number[free] - self.taken[length[free]]) * length[free]
        sequence[free] = self.rest_sequence + position // self.window
        offset[free] = position % self.window
        return sequence, offset, np.minimum(length, self.window - offset)


@lru_cache(maxsize=2)
def _fast(source: str) -> tiktoken.Encoding:
    bpe = Bpe(source)
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=bpe.id_of, special_tokens=bpe.special)


def _ids(source: str, text: str) -> np.ndarray:
    if len(text) < LONG_BLANKS or max((m.end() - m.start() for m in _BLANKS.finditer(text)), default=0) < LONG_BLANKS:
        return np.asarray(_fast(source).encode(text, allowed_special="all"), "<u4")
    bpe = _loaded(source)
    ids = bpe.encode([text])[0]
    bpe.cache.clear()  # runs of this length aren't worth remembering
    return ids


def _cut(source: str, window: int, end_token: int, keep_ids: bool):
    def cut(batches):
        seen = 0
        for batch in batches:
            tails, windows, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(_ids(source, text or ""), np.uint32(end_token)).astype("<u4")
                full = len(ids) - len(ids) % window
                parts = [ids[i : i + window].tobytes() for i in range(0, full, window)]
                windows.append(parts if keep_ids else [zlib.crc32(p) for p in parts])
                tails.append(ids[full:].tobytes())
                tokens.append(len(ids))
            kind = pa.list_(pa.binary() if keep_ids else pa.int64())
            mark = np.arange(seen, seen + len(tokens)) + (TaskContext.get().partitionId() << 33)
            seen += len(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark), pa.array(tokens, pa.int64()), pa.array([t % window for t in tokens], pa.int32()), pa.array(windows, kind), pa.array(tails, pa.binary())], ["doc_id", "mark", "doc_tokens", "tail_len", "windows", "tail"])

    return cut


def _pieces(plan: Plan, first_window: np.ndarray, keep_ids: bool):
    def pieces(batches):
        window = plan.window
        for batch in batches:
            tokens, tail_len, number, at = (batch.column(c).to_numpy() for c in ("doc_tokens", "tail_len", "number", "window_number"))
            length = tail_len.astype(np.int64)
            full = tokens // window
            row, nth = np.repeat(np.arange(len(tokens)), full), ragged(full, np.zeros(len(tokens), np.int64))
            sequence, offset, fits = plan.place(length, number)
            tailed, over = np.flatnonzero(length > 0), np.flatnonzero(fits < length)
            tails = batch.column("tail").to_pylist()
            ids = batch.column("windows").flatten().to_pylist() + [tails[i][: 4 * n] for i, n in zip(tailed.tolist(), fits[tailed].tolist(), strict=True)] + [tails[i][4 * n :] for i, n in zip(over.tolist(), fits[over].tolist(), strict=True)]
            crc = [zlib.crc32(x) if isinstance(x, bytes) else x for x in ids]
            rows = np.concatenate([row, tailed, over])
            start = np.concatenate([nth * window, (full * window)[tailed], (full * window + fits)[over]])
            size = np.concatenate([np.full(len(row), window), fits[tailed], (length - fits)[over]])
            into = np.concatenate([plan.sequences + first_window[tail_len[row]] + at[row] + nth, sequence[tailed], sequence[over] + 1])
            there = np.concatenate([np.zeros(len(row), np.int64), offset[tailed], np.zeros(len(over), np.int64)])
            cols = [batch.column("doc_id").take(pa.array(rows)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(tokens[rows]), pa.array(into), pa.array(there)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return pieces


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_token: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unsigned 32-bit, little-endian) if kept.

    Every token lies in one piece; all sequences but the last of the residue are full.
    """
    small_batches(docs.sparkSession)
    source = tokenizer_source(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _cut(source, window, end_token, keep_ids), f"doc_id {kind}, mark long, doc_tokens long, tail_len int, windows array<{'binary' if keep_ids else 'long'}>, tail binary"
    )
    cut = materialize(cut, "cut")
    n_windows = F.floor(F.col("doc_tokens") / window)
    counts, windows = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in cut.groupBy("tail_len").agg(F.count("*").alias("n"), F.sum(n_windows).alias("w")).collect():  # at most one row per length
        counts[r.tail_len], windows[r.tail_len] = r.n, r.w
    buckets = max(64, -(-int(counts.max()) // NUMBERED_TOGETHER))
    key = ["tail_len", "bucket"]
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("mark"), F.lit(buckets)))
    within = Window.partitionBy(*key).orderBy("doc_id", "mark")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("tail_len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*key).agg(F.count("*").alias("n"), F.sum(n_windows).alias("w"))
    bases = bases.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"))
    numbered = dealt.select("*", (F.row_number().over(within) - 1).cast("long").alias("k"), F.coalesce(F.sum(n_windows).over(before), F.lit(0)).alias("w"))
    placed = numbered.join(bases, key).select("doc_id", "doc_tokens", "tail_len", "windows", "tail", (F.col("k") + F.col("n0")).alias("number"), (F.col("w") + F.col("w0")).alias("window_number"))
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return placed.mapInArrow(_pieces(Plan(window, counts), np.cumsum(windows) - windows, keep_ids), out)
