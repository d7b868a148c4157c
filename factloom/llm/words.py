"""Words, lines and windows of many texts at once, as numpy arrays over their joined UTF-8 bytes.

Segments are compared by 64-bit hashes. Short ones take their bytes eight at a time, each load followed by a
bijective mix that isn't linear, so no family of words collides by construction; longer ones are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Bytes of a segment that is hashed eight bytes at a time, at most.
SHORT = 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    inside: np.ndarray  # of each byte: whether it belongs to a word
    padded: bytes  # the joined texts, then 8 spare bytes
    offsets: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte segments."""
        size = end - start
        out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        load = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, 0, (1,))
        todo = np.flatnonzero((size > 0) & (size <= SHORT))
        at, rest = start[todo], size[todo]
        while len(todo):
            spare = (np.maximum(0, 8 - rest) * 8).astype(np.uint64)
            out[todo] = mix(out[todo] ^ (load[at] << spare))
            more = rest > 8
            todo, at, rest = todo[more], at[more] + 8, rest[more] - 8
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.padded[start[i] : end[i]], digest_size=8).digest(), "little")
        return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D; they don't cross the texts that ``offsets`` part."""
    n = len(data)
    inside = ~SPACE[data]
    first, last = offsets[:-1], offsets[1:]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first[first < n]] = False
    after[last[last > first] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, doc, inside, data.tobytes() + bytes(8), offsets)


def windows(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all n-word windows within one text, and the windows' hashes."""
    if len(word_hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(0xA24BAED4963EE407) + word_hash[at + j]
    return at, mix(h)


def with_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(h + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
