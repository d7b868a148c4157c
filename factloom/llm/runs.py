"""Runs: a few MB of texts as one compressed row, and questions about hashes that all runs answer together.

A run is a row (run, n_docs, n_bytes, ids, texts), so passes over the corpus join small answers to whole runs and shuffle
each run once, compressed. ``multiplicities`` exchanges the runs' sorted hash sets by hash range and tells
every run which of its hashes reach a given total.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import small_batches, utf8_parts
from factloom.llm.scratch import materialize

#: Bytes and rows of a run at most (a longer text is a run by itself).
RUN_BYTES, RUN_ROWS = 2 << 20, 1 << 16
#: Hashes of one range that are compared together, about.
RANGE_HASHES = 500_000
#: The id of rows whose own id is null; ids themselves are longs above it.
NO_ID = -(2**63)


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def expand(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, stored by byte planes."""
    gaps = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T)


def expand_sorted(b: bytes) -> np.ndarray:
    planes = expand(b, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _build(run_bytes: int):
    def build(batches):
        yield from _pack_runs(batches, run_bytes)

    return build


def _pack_runs(batches, run_bytes: int):
    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, offsets, size = [], [], [np.zeros(1, np.int64)], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 24) + seq]), pa.array([sum(map(len, ids))]), pa.array([size]), pa.array([squeeze(np.concatenate(ids))]), pa.array([squeeze(np.concatenate([np.diff(np.concatenate(offsets)).astype("<i8").view("u1"), *texts]))])],
            ["run", "n_docs", "n_bytes", "ids", "texts"],
        )

    for batch in batches:
        data, off = utf8_parts(batch.column(1))
        own = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        a = 0
        while a < len(own):
            room = run_bytes - size
            b = min(max(int(np.searchsorted(off, off[a] + room, "right")) - 1, a), a + RUN_ROWS - sum(map(len, ids)), len(own))
            if b == a and not ids:
                b = a + 1
            if b > a:
                ids.append(own[a:b])
                texts.append(data[off[a] : off[b]])
                offsets.append(off[a + 1 : b + 1] - off[a] + size)
                size += int(off[b] - off[a])
                a = b
            if a < len(own):
                yield row()
                seq, ids, texts, offsets, size = seq + 1, [], [], [np.zeros(1, np.int64)], 0
    if ids:
        yield row()


def build_runs(docs: DataFrame, id_col: str, text_col: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The runs of ``docs``, written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return materialize(rows.mapInArrow(_build(run_bytes), "run long, n_docs long, n_bytes long, ids binary, texts binary"), "runs", "uncompressed")


def open_run(ids: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a run's texts."""
    i = expand(ids, "<i8")
    raw = expand(texts, "u1")
    offsets = np.concatenate([[0], np.cumsum(raw[: 8 * len(i)].view("<i8"))])
    return i, raw[8 * len(i) :], offsets


def total_bytes(runs: DataFrame) -> int:
    return runs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def range_bits(hashes: float, least: int = 6) -> int:
    """Leading bits that part about so many hashes into ranges of bounded size."""
    return max(least, int(np.ceil(np.log2(max(1.0, hashes / RANGE_HASHES)))))


def cut_ranges(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the ranges within a sorted array of 64-bit hashes."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, tops), [len(sorted_hashes)]])


def multiplicities(runs: DataFrame, unique: Callable, hashes: float, least: int, hot: int | None = None) -> DataFrame:
    """run, answers: array<struct<part, bits, hot>>, telling which hashes reach ``least``, and which ``hot`` (at most 65,535), if asked.

    unique(ids, data, offsets) gives a run's distinct 64-bit hashes, sorted, and their counts. The bits, part by
    part, follow the order of the distinct hashes. Ranges with nothing that reaches ``least`` are left out.
    """
    bits = range_bits(hashes)

    def emit(batches):
        for batch in batches:
            for run, ids, texts in zip(*(batch.column(c).to_pylist() for c in ("run", "ids", "texts")), strict=True):
                h, n = unique(*open_run(ids, texts))
                edge = cut_ranges(h, bits)
                parts = [p for p in range(1 << bits) if edge[p + 1] > edge[p]]
                low = [squeeze_sorted(h[edge[p] : edge[p + 1]] >> np.uint64(16)) for p in parts]
                count = [squeeze(np.minimum(n[edge[p] : edge[p + 1]], hot or least).astype("<u2")) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([run] * len(parts), pa.int64()), pa.array(low, pa.binary()), pa.array(count, pa.binary())], ["part", "run", "low", "count"])

    def meet(group):
        part, run = group.column("part")[0].as_py(), group.column("run").to_pylist()
        low = [expand_sorted(b) for b in group.column("low").to_pylist()]
        count = np.concatenate([expand(b, "<u2") for b in group.column("count").to_pylist()]).astype(np.int64)
        _, which = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(which, count)[which]
        ends = np.cumsum([len(x) for x in low])
        told = lambda enough: pa.array([squeeze(np.packbits(enough[e - len(x) : e])) for x, e in zip(low, ends.tolist(), strict=True)], pa.binary())
        return pa.table({"run": pa.array(run, pa.int64()), "part": pa.array([part] * len(run), pa.int32()), "bits": told(total >= least), "hot": told(total >= hot) if hot else pa.nulls(len(run), pa.binary())})

    sent = runs.mapInArrow(emit, "part int, run long, low binary, count binary")
    told = sent.groupBy("part").applyInArrow(meet, "run long, part int, bits binary, hot binary")
    return told.groupBy("run").agg(F.collect_list(F.struct("part", "bits", "hot")).alias("answers"))


def enough(h: np.ndarray, answers: list[dict] | None, hashes: float, which: str = "bits") -> np.ndarray:
    """The answers (bits or hot) to a run's sorted distinct hashes, as booleans."""
    bits = range_bits(hashes)
    edge = cut_ranges(h, bits)
    out = np.zeros(len(h), bool)
    for a in answers or []:
        p = a["part"]
        out[edge[p] : edge[p + 1]] = np.unpackbits(expand(a[which], "u1"))[: edge[p + 1] - edge[p]]
    return out
