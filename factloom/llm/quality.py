"""Quality rules: word statistics and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Repetitive text shrinks too far and
incompressible text (random strings, encoded data) hardly at all; what is too far depends on the length,
since short texts give the compressor little to learn from. A text is rejected if its whole lies outside the
band of its length, or if more than ``CHUNK_SHARE`` of its chunks lie outside the band of theirs.

Defined cases: null and empty texts have no words and fail the base rule; ties don't arise; repeated rows are
judged alike; very long texts are read whole; an empty table gives no rows; other columns of any name are kept by
``judge``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from factloom.llm.arrowkit import slices, small_batches, utf8_parts
from factloom.llm.words import windows, with_doc, words_of

#: Bytes of a chunk.
CHUNK = 4096
#: Bands: least bytes of a text, then the lowest and highest compressed share of its bytes that pass. Shorter texts always pass.
BANDS = ((256, 0.20, 0.95), (512, 0.20, 0.88), (1024, 0.20, 0.80), (2048, 0.19, 0.74), (4096, 0.18, 0.70), (16384, 0.16, 0.68), (65536, 0.14, 0.66))
#: Share of chunks that may lie outside their band.
CHUNK_SHARE = 0.34
#: Fixed values of the base rule.
LEAST_WORDS, REPEAT_PERCENT, SYMBOLS, WINDOW = 10, 20, b"#*$%&|<>", 5


def out_of_band(size: int, compressed: int, bands: tuple = BANDS) -> bool:
    low, high = next(((lo, hi) for least, lo, hi in reversed(bands) if size >= least), (0.0, 1e9))
    return not low * size <= compressed <= high * size


def compression_verdict(text: bytes, compressor: zstandard.ZstdCompressor) -> bool:
    """Whether the text and its chunks lie within their bands."""
    if out_of_band(len(text), len(compressor.compress(text))):
        return False
    if len(text) < 2 * CHUNK:
        return True
    chunks = [text[i : i + CHUNK] for i in range(0, len(text) - len(text) % CHUNK, CHUNK)]
    return sum(out_of_band(len(c), len(compressor.compress(c))) for c in chunks) <= CHUNK_SHARE * len(chunks)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    n = len(offsets) - 1
    w = words_of(data, offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out = {"n_words": np.bincount(w.doc, minlength=n), "word_chars": per_text(w.inside & ((data & 0xC0) != 0x80)), "n_symbols": per_text(symbol[data])}

    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.searchsorted(offsets, start, "right") - 1
    keep = (doc < n) & (start < len(data))  # a break at a text's end starts an empty line, or the next text's first once more
    start, doc = np.unique(start[keep]), None
    doc = np.searchsorted(offsets, start, "right") - 1
    following = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, len(data))[following], offsets[doc + 1])
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.inside, out=filled[1:])
    worded = filled[end] > filled[start]
    start, end, doc = start[worded], end[worded], doc[worded]
    line = with_doc(w.hashes(start, end), doc)
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:]] = line[order[1:]] == line[order[:-1]]
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)

    at, window = windows(w.hashes(w.start, w.end), w.doc, WINDOW)
    window = with_doc(window, w.doc[at])
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(text_col: str, names: list[str]):
    def run(batches):
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = utf8_parts(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in slices(offsets, 1 << 20):
                own, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                s = statistics(raw, own)
                failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
                kept = [not f and compression_verdict(raw[own[i] : own[i + 1]].tobytes(), compressor) for i, f in enumerate(failed.tolist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(s[f].astype(np.int64)) for f in FIELDS), pa.array(failed), pa.array(kept, pa.bool_())], [*batch.schema.names, *names])

    return run


def judge(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the statistics, base_failed and kept appended; columns of ``docs`` that have these names, after ``prefix``, are replaced."""
    small_batches(docs.sparkSession)
    names = [prefix + c for c in (*FIELDS, "base_failed", "kept")]
    docs = docs.drop(*(c for c in names if c in docs.columns and c != text_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_judge(text_col, names), f"{fields}, {', '.join(f'`{c}` long' for c in names[:-2])}, {', '.join(f'`{c}` boolean' for c in names[-2:])}")
