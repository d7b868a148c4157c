"""Near-duplicates by SimHash and anchor points.

A text's fingerprint has 64 bits; a bit is set if more than half of its shingles' hashes have it set. The anchors
are the words of a covering code over the fingerprint's bits: blocks of 23 bits carry the perfect Golay code of
radius 3, and where there are very many fingerprints, further 15 bits carry a Hamming code of radius 1. Every bit string
has a nearest anchor, its home, in each block.

Two fingerprints that differ in at most ``threshold`` bits have a string half-way, ``ceil(threshold / 2)`` bits from
either. Its home lies within the covering radius plus that many bits of both. So each fingerprint is copied to the
homes of all strings that near it, and fingerprints are compared where they meet: with half the threshold on
either side, a fingerprint goes to about 68 anchors; with all of it on one side, to about 1,300.

Equal fingerprints count once. An anchor's fingerprints are linked by a spanning forest: what was
reached isn't compared again. Very many at one anchor are dealt to the anchors of the same code over rotated bits, where
every pair meets for the same reason.

Defined cases: texts that are null, empty or without words have fingerprint zero and are linked like others; of
fewer words than a shingle's the whole sequence is the shingle; equal rows get equal results; ties within a bit (half the
hashes) leave it unset; a null id takes part but is never a component's name, which is null where no id is
reachable; texts of any length are read whole; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import ragged, slices, small_batches, utf8_parts
from factloom.llm.components import components
from factloom.llm.scratch import materialize, passing
from factloom.llm.words import LOWER, mix

WORDS, THRESHOLD, SEED = 4, 4, 42
#: Fingerprints from which on a third block parts the anchors further.
MANY = 1 << 26
#: Fingerprints at one anchor that are all compared, and that are linked without other anchors.
SMALL, LARGE = 8, 4096
#: Shingles whose bits are counted at once; copies of fingerprints in a task, about.
STEP, TASK_ROWS = 1 << 16, 1_000_000


class Code:
    """A perfect cyclic code, and of every syndrome the words near it by the flips after which one of them is home."""

    def __init__(self, bits: int, generator: int, radius: int, flips: int):
        self.bits, self.check = bits, generator.bit_length() - 1
        rest = np.zeros(bits, np.int64)
        for k in range(bits):
            r = 1 << k
            while r.bit_length() > self.check:
                r ^= generator << (r.bit_length() - 1 - self.check)
            rest[k] = r
        self.low = self._table(rest[: bits // 2])
        self.high = self._table(rest[bits // 2 :])
        errors = self._errors(max(radius, flips))
        weight = np.bitwise_count(errors)
        of = self.syndrome(errors)
        leader = np.zeros(1 << self.check, np.int64)
        leader[of[weight <= radius]] = errors[weight <= radius]
        tried, cost = errors[weight <= flips], weight[weight <= flips].astype(np.int64)
        s = np.arange(1 << self.check)
        near = tried[None, :] ^ leader[s[:, None] ^ of[weight <= flips][None, :]]
        keys = (np.repeat(s, len(tried)) << bits | near.ravel())
        order = np.lexsort((np.tile(cost, len(s)), keys))
        first = order[np.flatnonzero(np.diff(keys[order], prepend=-1))]
        owner, level, near = first // len(tried), np.tile(cost, len(s))[first], near.ravel()[first]
        order = np.lexsort((level, owner))
        self.near, self.level = near[order], level[order]
        counts = np.stack([np.bincount(owner[level <= e], minlength=len(s)) for e in range(flips + 1)])
        self.count, self.start = counts, np.cumsum(counts[-1]) - counts[-1]

    @staticmethod
    def _table(rest: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << len(rest), np.int64)
        for k, r in enumerate(rest.tolist()):
            out[1 << k : 2 << k] = out[: 1 << k] ^ r
        return out

    def _errors(self, most: int) -> np.ndarray:
        """All words of at most so many set bits."""
        single = 1 << np.arange(self.bits)
        out = last = np.zeros(1, np.int64)
        for _ in range(most):
            last = np.unique((last[:, None] | single[None, :]).ravel())
            out = np.union1d(out, last)
        return out

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        half = self.bits // 2
        return self.low[x & ((1 << half) - 1)] ^ self.high[x >> half]


@lru_cache(maxsize=8)
def codes(blocks: tuple[str, ...], flips: int) -> tuple[Code, ...]:
    make = {"golay": lambda: Code(23, 0b101011100011, 3, flips), "hamming": lambda: Code(15, 0b10011, 1, flips)}
    made = {name: make[name]() for name in set(blocks)}
    return tuple(made[name] for name in blocks)


def blocks_for(fingerprints: int) -> tuple[str, ...]:
    return ("golay", "golay", *["hamming"] * (fingerprints > MANY))


def anchors(prints: np.ndarray, blocks: tuple[str, ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit fingerprints all anchors that they are copied to: index of the fingerprint, the anchor's number."""
    flips = -(-threshold // 2)
    who, cell, used, shift = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64), 0
    for code in codes(blocks, flips):
        own = ((prints >> np.uint64(shift)) & np.uint64((1 << code.bits) - 1)).astype(np.int64)
        s = code.syndrome(own)[who]
        n = code.count[flips - used, s]
        at = ragged(n, code.start[s])
        who, cell, used = np.repeat(who, n), np.repeat(cell, n), np.repeat(used, n) + code.level[at]
        cell = cell << (code.bits - code.check) | (own[who] ^ code.near[at]) >> code.check
        shift += code.bits
    return who, cell


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of every one of the joined texts."""
    n = len(offsets) - 1
    lowered = LOWER[data].tobytes()
    many, hashes = np.zeros(n, np.int64), []
    digest = xxhash.xxh64_digest
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = lowered[a:b].split()
        if len(parts) <= words:
            hashes += [digest(b" ".join(parts), seed)] * bool(parts)
            many[k] = bool(parts)
            continue
        text = b" ".join(parts)
        end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        first = (end[: len(parts) - words + 1] - np.fromiter(map(len, parts[: len(parts) - words + 1]), np.int64) - 1).tolist()
        hashes += [digest(text[x:y], seed) for x, y in zip(first, (end[words - 1 :] - 1).tolist(), strict=True)]
        many[k] = len(first)
    h = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    doc, count = np.repeat(np.arange(n), many), np.zeros((n, 64), np.int64)
    for a in range(0, len(h), STEP):
        own = doc[a : a + STEP]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        count[own[begin]] += np.add.reduceat(np.unpackbits(h[a : a + STEP], axis=1), begin, axis=0, dtype=np.int64)
    return np.packbits(2 * count > many[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def forest(prints: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that hold together what links of at most ``threshold`` bits hold together."""
    out, todo, rest = [], [], prints
    while todo or len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        x = todo.pop()
        near = np.bitwise_count(rest ^ x) <= threshold
        if near.any():
            hit, rest = rest[near], rest[~near]
            out.append((np.full(len(hit), x), hit))
            todo.extend(hit)
    return out


def links_at(cell: np.ndarray, prints: np.ndarray, threshold: int, blocks: tuple[str, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within every anchor of rows sorted by anchor; with ``blocks``, large groups are dealt to anchors over rotated bits."""
    begin = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
    size = np.diff(begin, append=len(cell))
    out = []
    for n in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        group = prints[begin[size == n][:, None] + np.arange(n)]
        for i in range(n - 1):
            x, y = np.broadcast_to(group[:, i : i + 1], (len(group), n - 1 - i)), group[:, i + 1 :]
            near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
            out.append((x[near], y[near]))
    for a, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own = np.unique(prints[a : a + n])
        out += _dealt(own, threshold, blocks) if blocks and len(own) > LARGE else forest(own, threshold)
    return out


def _dealt(prints: np.ndarray, threshold: int, blocks: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    turned = prints << np.uint64(18) | prints >> np.uint64(46)
    passes, out = -(-len(prints) // (1 << 17)), []
    for k in range(passes):
        who, cell = [], []
        for a in range(0, len(prints), 1 << 14):
            w, c = anchors(turned[a : a + (1 << 14)], blocks, threshold)
            mine = mix(c.astype(np.uint64)) % np.uint64(passes) == k
            who.append(w[mine] + a)
            cell.append(c[mine])
        who, cell = np.concatenate(who), np.concatenate(cell)
        order = np.argsort(cell, kind="stable")
        out += links_at(cell[order], prints[who[order]], threshold)
    return out


def _fingerprint(words: int, seed: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            out = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, seed) for a, b in slices(offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64))], ["doc_id", "print"])

    return run


def _copied(blocks: tuple[str, ...], threshold: int):
    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(prints), 1000):
                who, cell = anchors(prints[a : a + 1000], blocks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(prints[a + who].view(np.int64))], ["cell", "print"])

    return run


def _linked(blocks: tuple[str, ...], threshold: int):
    def told(cell, prints):
        found = links_at(cell, prints, threshold, blocks)
        a, b = (np.concatenate([*(f[k] for f in found), np.zeros(0, np.uint64)]) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    def run(batches):
        cells, prints, n = [], [], 0
        for batch in batches:
            cells.append(batch.column(0).to_numpy())
            prints.append(batch.column(1).to_numpy().view(np.uint64))
            n += len(batch)
            if n >= STEP and cells[0][0] != cells[-1][-1]:
                cell, own = np.concatenate(cells), np.concatenate(prints)
                whole = int(np.searchsorted(cell, cell[-1]))
                yield told(cell[:whole], own[:whole])
                cells, prints, n = [cell[whole:]], [own[whole:]], len(cell) - whole
        if n:
            yield told(np.concatenate(cells), np.concatenate(prints))

    return run


def links(prints: DataFrame, n: int, threshold: int = THRESHOLD) -> DataFrame:
    """a, b of distinct fingerprints (column print, n of them): links that hold together all that at most ``threshold`` differing bits link."""
    spark = prints.sparkSession
    blocks = blocks_for(n)
    copies = n * 70 * (3 if len(blocks) > 2 else 1)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), copies // TASK_ROWS)
    copied = prints.select("print").repartition(parts).mapInArrow(_copied(blocks, threshold), "cell long, print long")
    return copied.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_linked(blocks, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, print (the fingerprint as a long), component_id (the smallest id reachable by links)."""
    small_batches(docs.sparkSession)
    with passing(docs.sparkSession):
        return materialize(_components(docs, id_col, text_col, words, threshold, seed), "simhash", keep=True)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: int, seed: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    own = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint(words, seed), f"doc_id {kind}, print long"), "prints")
    groups = materialize(own.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    size = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    roots = components(links(groups, size.groups, threshold))
    rooted = groups.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = materialize(rooted.join(least, "root").select("print", "n", "component_id"), "told")
    # rows of a fingerprint that more than a thousandth of all rows have aren't shuffled: there are at most a thousand of these
    often = F.col("n") > (size.rows or 0) // 1000
    hot = own.join(F.broadcast(told.where(often).select("print", "component_id", F.lit(True).alias("hot"))), "print", "left")
    rest = hot.where("hot IS NULL").select("doc_id", "print").join(told.where(~often).select("print", "component_id"), "print")
    return hot.where("hot").select("doc_id", "print", "component_id").unionByName(rest.select("doc_id", "print", "component_id"))
