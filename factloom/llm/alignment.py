"""Alignment of two tokenizers over the same texts.

Byte-level tokens (A) and sentence pieces (B) of one text cover the same bytes. Running sums of their lengths are the places where
tokens end; places where tokens of both sides end are the common cuts, which part both sequences into groups. Tokens find their
group by binary search among the cuts. Links, between tokens that end together or between all tokens of a group, are expanded by
repetition. All of that runs on whole batches of texts at once, since texts' ends are common cuts. How often
ids are linked is counted per task first, then by id pair and a salt, then by id pair.

Ids of A come from tiktoken with the vocabulary of ``Bpe`` (texts with very long runs of blanks from ``Bpe`` itself), without special
tokens. No piece of B holds a blank after another character, so B's merges never leave a run of blanks and the word after it: such units are
encoded by sentencepiece once and remembered.

Defined cases: texts that are null or empty, and those whose pieces aren't the text's bytes (texts with
U+2581 itself, or that B's model rewrites), have no tokens, groups or links; equal rows get equal results and each counts; of
pairs with the highest count of a B id all count as best; texts of any length are aligned whole; an empty table gives
no rows; other columns aren't carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import ragged, small_batches
from factloom.llm.bpe import WORDS, Bpe, tokenizer_source
from factloom.llm.packing import _BLANKS, LONG_BLANKS
from factloom.llm.scratch import materialize, passing

#: Pairs up to which their counts travel to every task, 17 bytes each; beyond, pairs of texts meet counts in a shuffle.
TOLD_PAIRS = 4_000_000
#: Units that a task remembers, distinct pairs that it holds, links that it counts at once, salts.
CACHE_UNITS, HELD_PAIRS, STEP, SALTS = 400_000, 2_000_000, 1 << 23, 16
#: Bytes of texts that are aligned at once, at least.
SLICE = 1 << 20
BLANK = "▁"
_UNITS = re.compile(r" +[^ ]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteSide:
    """Ids and bytes of a byte-level vocabulary, special tokens being plain text."""

    def __init__(self, source: str):
        self.bpe = Bpe(source)
        self.bpe.split = None
        self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=self.bpe.id_of, special_tokens={})
        self.lengths = self.bpe.lengths

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG_BLANKS or max((m.end() - m.start() for m in _BLANKS.finditer(text)), default=0) < LONG_BLANKS:
            return np.array(self.fast.encode_ordinary(text), np.int64)
        ids = self.bpe.encode([text])[0].astype(np.int64)
        self.bpe.cache.clear()  # runs of this length aren't worth remembering
        return ids

    def joined(self, ids: np.ndarray) -> bytes:
        return self.bpe.decode(ids)


class PieceSide:
    """Ids and bytes of a sentencepiece model that puts a blank before the text."""

    def __init__(self, model: bytes, cache_units: int = CACHE_UNITS):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in names]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.apart = BLANK in names and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in names)  # merges stay within units
        self.cache: dict[str, bytes | None] = {}
        self.cache_units = cache_units

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, each given with its blank before; None where the pieces aren't the text."""
        parts = [[] if BLANK in t else _UNITS.findall(t) if self.apart else [t] for t in texts]
        new = set().union(*parts).difference(self.cache)
        if len(self.cache) + len(new) > self.cache_units:
            self.cache.clear()
            new = set().union(*parts)
        new = list(new)
        for unit, ids in zip(new, self.model.encode([u[1:] for u in new], num_threads=1), strict=True):
            if unit == " ":  # the text's last blank; alone it would be an empty text
                ids = [self.model.piece_to_id(BLANK)]
            same = b"".join(map(self.pieces.__getitem__, ids)) == unit.encode()
            self.cache[unit] = np.array(ids, "<u4").tobytes() if same else None
        out = []
        for p in parts:
            found = [*map(self.cache.__getitem__, p)]
            out.append(None if not p or None in found else np.frombuffer(b"".join(found), "<u4").astype(np.int64))
        return out


@lru_cache(maxsize=1)
def _sides(source: str, model: bytes) -> tuple[ByteSide, PieceSide]:
    return ByteSide(source), PieceSide(model)


@lru_cache(maxsize=1)
def _names(size: int) -> list[str]:
    """Decimal ids with each mark that may follow."""
    return [f"{i}{mark}" for i in range(size) for mark in ",|;"]


def common_cuts(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where tokens of both sides end, and the group of every token of either side."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    return cuts, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)


def expanded(a_first: np.ndarray, a_n: np.ndarray, b_first: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a_n[g] tokens from a_first[g] on with b_n[g] from b_first[g] on, group by group."""
    each = np.repeat(b_n, a_n)
    return np.repeat(ragged(a_n, a_first), each), ragged(each, np.repeat(b_first, a_n))


class Aligned:
    """Texts' tokens, groups and links, as arrays over all of them."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray, whole_groups: bool):
        self.a, self.b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
        self.n_a, self.n_b = (np.array([*map(len, x)], np.int64) for x in (a, b))
        self.cuts, self.a_group, self.b_group = common_cuts(a_lengths[self.a], b_lengths[self.b])
        groups = np.arange(len(self.cuts))
        self.a_first, self.b_first = np.searchsorted(self.a_group, groups), np.searchsorted(self.b_group, groups)
        self.a_size, self.b_size = np.diff(self.a_first, append=len(self.a)), np.diff(self.b_first, append=len(self.b))
        last = np.ones(len(groups), np.int64)
        args = (self.a_first, self.a_size, self.b_first, self.b_size) if whole_groups else (self.a_first + self.a_size - 1, last, self.b_first + self.b_size - 1, last)
        self.link_a, self.link_b = expanded(*args)
        edge = np.concatenate([[0], np.cumsum(self.n_a)])
        self.group_edge = np.searchsorted(self.a_first, edge)
        self.n_groups = np.diff(self.group_edge)
        self.link_edge = np.searchsorted(self.link_a, edge)

    def rendered(self) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``: the groups' ids in order."""
        n = len(self.a) + len(self.b)
        code = np.zeros(n, np.int64)
        a_at = np.arange(len(self.a)) + self.b_first[self.a_group]
        b_at = np.arange(len(self.b)) + (self.a_first + self.a_size)[self.b_group]
        code[a_at], code[b_at] = self.a * 3, self.b * 3
        code[a_at[self.a_first + self.a_size - 1]] += 1
        code[b_at[self.b_first + self.b_size - 1]] += 2
        names = _names(int(max(self.a.max(initial=0), self.b.max(initial=0)) >> 16) + 1 << 16)
        edge = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(map(names.__getitem__, code[x:y].tolist()))[:-1] for x, y in zip(edge, edge[1:], strict=False)]


def _align(shared, whole_groups: bool) -> Callable:
    def told(ids: list, texts: list[str]):
        one, two = _sides(*shared.value)
        texts = [" " + t if t else "" for t in texts]
        b = two.encode(texts)
        nothing = np.zeros(0, np.int64)
        a = [one.encode(t) if ids_b is not None else nothing for t, ids_b in zip(texts, b, strict=True)]
        good = [ids_b is not None and one.joined(ids_a) == t.encode() for t, ids_a, ids_b in zip(texts, a, b, strict=True)]
        x = Aligned([i if g else nothing for g, i in zip(good, a, strict=True)], [i if g else nothing for g, i in zip(good, b, strict=True)], one.lengths, two.lengths, whole_groups)
        keys = (x.a[x.link_a] * len(two.lengths) + x.b[x.link_b]).astype("<u4" if len(one.lengths) * len(two.lengths) <= 1 << 32 else "<u8")
        links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((x.link_edge * keys.itemsize).astype(np.int64)), pa.py_buffer(keys)]).cast(pa.binary())
        columns = [*map(pa.array, (x.n_a, x.n_b, x.n_groups, np.diff(x.link_edge))), pa.array(x.rendered(), pa.string()), links]
        return pa.RecordBatch.from_arrays([pa.array(ids) if isinstance(ids, list) else ids, *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    def run(batches):
        for batch in batches:
            texts, a, size = batch.column(1).to_pylist(), 0, 0
            for k, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= SLICE or k == len(texts):
                    yield told(batch.column(0).slice(a, k - a), [t or "" for t in texts[a:k]])
                    a, size = k, 0

    return run


def align(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``, ids in order), links.

    tokenizer: a byte-level tokenizer.json (A); model: a sentencepiece model that puts a blank before texts (B); A reads that blank too.
    links: of tokens that end together, or with ``whole_groups`` of all tokens of a group, the ids as
    a * (size of B) + b, unsigned little-endian, of 32 bits where these hold all pairs.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((tokenizer_source(tokenizer), f.read()))  # two vocabulary files
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_align(shared, whole_groups), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary")


def sizes(tokenizer: str, model: str) -> tuple[int, int]:
    """Ids of either side."""
    return Bpe(tokenizer_source(tokenizer)).size, sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()


def _keys(column: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """All link keys of a binary column, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    width = 8 if wide else 4
    return raw.view("<u8" if wide else "<u4").astype(np.int64), (edge - edge[0]) // width


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def _counted(wide: bool) -> Callable:
    def run(batches):
        salt = TaskContext.get().partitionId() % SALTS
        names = ["key", "salt", "n"]

        def out(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), salt, np.int32)), pa.array(counts)], names)

        held, counts, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            waiting.append(_keys(batch.column(0), wide)[0])
            n += len(waiting[-1])
            if n >= STEP:
                new, times = np.unique(np.concatenate(waiting), return_counts=True)
                held, counts = _merged([held, new], [counts, times])
                waiting, n = [], 0
                if len(held) > HELD_PAIRS:
                    yield out(held, counts)
                    held, counts = held[:0], counts[:0]
        new, times = np.unique(np.concatenate([*waiting, held[:0]]), return_counts=True)
        yield out(*_merged([held, new], [counts, times]))

    return run


def pair_counts(aligned: DataFrame, size_b: int, wide: bool = False) -> DataFrame:
    """key, n, best of every linked id pair: how many links hold it, and whether none of its B id's pairs has more."""
    parts = aligned.select("links").mapInArrow(_counted(wide), "key long, salt int, n long")
    counts = materialize(parts.groupBy("key", "salt").agg(F.sum("n").alias("n")).groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    b = F.pmod("key", F.lit(size_b))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most one row per B id
    return counts.join(F.broadcast(most), b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(told, wide: bool) -> Callable:
    def run(batches):
        keys, n, best = told.value
        for batch in batches:
            own, edge = _keys(batch.column(batch.schema.get_field_index("links")), wide)
            at = np.searchsorted(keys, own)
            sums = [np.concatenate([[0], np.cumsum(v[at])]) for v in (best.astype(np.int64), n)]
            rest = batch.drop_columns(["links"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(s[edge[1:]] - s[edge[:-1]]) for s in sums)], [*rest.schema.names, "n_best", "count_sum"])

    return run


def _exploded(wide: bool) -> Callable:
    def run(batches):
        for batch in batches:
            own, edge = _keys(batch.column(1), wide)
            mark = np.repeat(batch.column(0).to_numpy(), np.diff(edge))
            order = np.lexsort((own, mark))
            mark, own = mark[order], own[order]
            new = np.flatnonzero(np.diff(own, prepend=-1).astype(bool) | np.diff(mark, prepend=-1).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(mark[new]), pa.array(own[new]), pa.array(np.diff(new, append=len(own)))], ["mark", "key", "times"])

    return run


def score(aligned: DataFrame, counts: DataFrame, told_pairs: int = TOLD_PAIRS, wide: bool = False) -> DataFrame:
    """``aligned`` without links, with n_best (links whose pair is best for its B id) and count_sum (of links' pairs' counts).

    Counts travel to the tasks where there are at most ``told_pairs``. Beyond that, texts' distinct pairs are joined with them; pairs that
    hold more than a thousandth of all links, of which there are at most a thousand, are broadcast for it.
    Both tables must be written ones, with a column ``mark`` that tells rows of ``aligned`` apart.
    """
    spark = aligned.sparkSession
    kept = [f for f in aligned.schema if f.name != "links"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    total = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    if total.pairs <= told_pairs:
        table = counts.orderBy("key").toArrow().combine_chunks()
        told = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "n", "best")))
        return aligned.mapInArrow(_scored(told, wide), f"{fields}, n_best long, count_sum long")
    own = aligned.select("mark", "links").mapInArrow(_exploded(wide), "mark long, key long, times long")
    often = F.col("n") > F.lit((total.links or 0) // 1000)
    hot = own.join(F.broadcast(counts.where(often)), "key", "left")
    rest = hot.where("n IS NULL").select("key", "mark", "times").join(counts.where(~often).hint("shuffle_hash"), "key")
    found = hot.where("n IS NOT NULL").unionByName(rest)
    sums = found.groupBy("mark").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.drop("links").join(sums, "mark", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def cross_align(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False, told_pairs: int = TOLD_PAIRS, rendering=None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every row.

    rendering: a function of the groups' column; what it makes of it stands in its place, so long renderings needn't be written.
    """
    size_a, size_b = sizes(tokenizer, model)
    wide = size_a * size_b > 1 << 32
    with passing(docs.sparkSession):
        groups = F.col("groups") if rendering is None else rendering(F.col("groups"))
        found = align(docs, tokenizer, model, id_col, text_col, whole_groups).withColumns({"groups": groups, "mark": F.monotonically_increasing_id()})
        aligned = materialize(found, "aligned")
        counts = materialize(pair_counts(aligned, size_b, wide), "counts")
        return materialize(score(aligned, counts, told_pairs, wide).drop("mark"), "alignment", keep=True)
