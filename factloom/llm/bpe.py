"""Byte-pair encoding by speculation and verification.

A word is first cut greedily into its longest vocabulary entries. Such a cut is the true BPE result
exactly when every two neighbours are compatible, that is when merging their joint bytes would
leave the border between them. Compatibility is decided for all distinct neighbour pairs of a batch
at once: one walks down the right edge of the left token's merge tree and the left edge of the right
one's and looks for a merge across the border that comes before the edge tokens' own next merge.
Only words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from factloom.llm.arrowkit import ragged, small_batches

#: Fixed value: how byte-level BPE cuts text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a Python worker remembers; beyond that it forgets all and learns anew.
CACHE_WORDS = 400_000


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Vocabulary, merges and what encoding needs of them, from the text of a tokenizer.json."""

    def __init__(self, source: str, cache_words: int = CACHE_WORDS):
        spec = json.loads(source)
        byte_of, model = _printable_bytes(), spec["model"]
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.pieces = [b""] * size
        for text, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in text) if text not in special else text.encode()
        for text, i in special.items():
            self.pieces[i] = text.encode()
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1 for bytes
        keys, order = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) in self.rank:
                continue
            self.rank[x, y] = (r, z)
            keys.append(x * size + y)
            order.append(r)
            if self.born[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, r
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_rank = np.array(keys, np.int64)[by_key], np.array(order, np.int64)[by_key]
        self.size = size
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special.values() and p}
        self.longest: dict[bytes, int] = {}
        for p in self.id_of:
            self.longest[p[:2]] = max(len(p), self.longest.get(p[:2], 1))
        lengths = np.array([len(p) for p in self.pieces])
        self.flat, self.starts, self.lengths = np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.cache, self.cache_words = {}, cache_words

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ids, longest = [], 0, len(word), self.id_of, self.longest
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves a border between the bytes of a[i] and those of b[i]."""
        never = np.int64(2**62)
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), np.asarray(a, np.int64), np.asarray(b, np.int64)
        x_next, y_next = np.full(len(a), never), np.full(len(a), never)  # ranks at which x and y are merged away
        while len(at):
            key = x * self.size + y
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[k] == key, self.pair_rank[k], never)
            # of equal merges the leftmost goes first: x's own precedes the border's, the border's precedes y's own
            broken = (across < x_next) & (across <= y_next) & (across < never)
            ok[at[broken]] = False
            on = ~broken & ((self.born[x] >= 0) | (self.born[y] >= 0))
            at, x, y, x_next, y_next = at[on], x[on], y[on], x_next[on], y_next[on]
            younger = self.born[x] >= self.born[y]  # undo the later of the two merges
            x_next, y_next = np.where(younger, self.born[x], x_next), np.where(younger, y_next, self.born[y])
            x, y = np.where(younger, self.right[x], x), np.where(younger, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, in n log n steps."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heapq.heapify(queue)
        while queue:
            _, i, x, y = heapq.heappop(queue)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = rank[x, y][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in rank:
                    heapq.heappush(queue, (rank[p][0], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in rank:
                heapq.heappush(queue, (rank[p][0], before[i], *p))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids (unsigned 32-bit, little-endian) of words not met before."""
        raw = [w.encode() for w in words]
        guess = [self.greedy(w) for w in raw]
        count = np.array([len(g) for g in guess])
        flat = np.array([t for g in guess for t in g], np.int64)
        inside = np.ones(max(len(flat) - 1, 0), bool)
        inside[np.cumsum(count)[:-1] - 1] = False
        at = np.flatnonzero(inside)
        pairs, which = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[which]
        failing = np.zeros(len(words), bool)
        failing[np.repeat(np.arange(len(words)), count)[at[~good]]] = True
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(count) * 4
        out = {w: data[e - 4 * n : e] for w, e, n in zip(words, ends.tolist(), count.tolist(), strict=True)}
        for i in np.flatnonzero(failing).tolist():
            out[words[i]] = np.array(self.merge(raw[i]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str | None], step: int = 1 << 20) -> list[np.ndarray]:
        """Ids of every text; null has none."""
        out: list[np.ndarray] = []
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= step:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        find, cache = self.words.findall, self.cache
        parts = []
        for t in texts:
            if self.split is not None and any(s in t for s in self.special):
                parts.append([w for i, p in enumerate(self.split.split(t)) for w in ([self.special[p]] if i % 2 else find(p))])
            else:
                parts.append(find(t))
        new = set().union(*parts).difference(cache)
        if len(cache) + len(new) > self.cache_words:
            cache.clear()
            new = set().union(*parts)
        for s in [w for w in new if isinstance(w, int)]:
            cache[s] = np.array([s], "<u4").tobytes()
            new.discard(s)
        if new:
            cache.update(self.learn(list(new)))
        return [np.frombuffer(b"".join(map(cache.__getitem__, p)), "<u4") for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.flat[ragged(self.lengths[ids], self.starts[ids])].tobytes()


@lru_cache(maxsize=2)
def _loaded(source: str) -> Bpe:
    return Bpe(source)


def tokenizer_source(path: str) -> str:
    """The tokenizer file's text, read once by the driver: a vocabulary of bounded size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(spark: SparkSession, path: str):
    """A column function: text to array<int> of token ids as ``encode`` of the tokenizers library without added special tokens.

    Null and empty texts give an empty array. Texts of any length are encoded whole. Ids depend on the text
    alone, so repeated rows and ties need no rule, other columns, whatever their names, are left as they are, and an empty table gives no rows.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_source(path))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids = _loaded(shared.value).encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, ids)])
        values = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))

    return encode


def decoder(spark: SparkSession, path: str):
    """A column function: array<int> of ids to text as ``decode(..., skip_special_tokens=False)``; null gives the empty text.

    Bytes that aren't UTF-8 become U+FFFD; null ids are left out.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_source(path))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = _loaded(shared.value)
        return pa.array([bpe.decode(x.values.drop_null().to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else "" for x in ids], pa.string())

    return decode


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")).cast("binary"), 256)


