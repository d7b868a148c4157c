"""Exact removal of repeated byte passages by a distributed, common-prefix-aware merge sort of suffixes.

A passage of 50 bytes that also starts in a document with a smaller id is removed. Which suffixes have to be
compared is told by their content alone: of every 50-byte window the 24-byte gram with the least hash is its anchor,
so equal windows have equal anchors, and successive windows with one anchor form one owned string. Grams that
only one document has can't take part; the runs find them out by exchanging sorted fingerprints. The owned strings
that are left, each written as its suffix from the anchor on and then the bytes before the anchor backwards, are
sorted within each run, front-coded (the length shared with the predecessor and the rest) and exchanged by
ranges of the gram's hash. A loser tree merges the runs of a range: it keeps with every loser the prefix known to be
shared with the last winner, and compares strings only from there on. Equal strings come out next to each other, and
so do all owned strings of one gram, whose windows are then matched exactly. Answers go back to the runs, where
each passage's copies were collapsed to the smallest id before they were sent.

A gram that very many documents have, each in a context of its own, would bring one string a document to one
range. The windows of such grams are exchanged one by one instead, by ranges of their own hash (128 bits stand
for the 50 bytes), so they spread over all tasks; what a run's documents share is one window there, too.

Defined cases: null and empty texts have no bytes; texts of fewer than 50 bytes are kept; rows with equal ids
aren't copies of each other; rows without an id are kept whole and remove nothing; columns other than id and text
aren't carried; of equal strings, however many, the one of the smallest id stays; a very long text is a run by itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import ragged, slices
from factloom.llm.runs import NO_ID, RUN_BYTES, build_runs, cut_ranges, enough, expand, expand_sorted, multiplicities, open_run, range_bits, squeeze, squeeze_sorted, total_bytes
from factloom.llm.scratch import materialize
from factloom.llm.words import mix

PASSAGE, GRAM = 50, 24
SPREAD = PASSAGE - GRAM + 1  # grams of a window
#: A suffix as it is sorted: at most 50 bytes from the anchor on, 26 before it backwards, spare bytes, both lengths.
RECORD = 80
#: Bytes of text for one anchor, roughly; only sizes ranges.
BYTES_AN_ANCHOR = 14
#: Documents from which on a gram's windows are exchanged one by one (counted run by run).
HOT = 4096


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _anchors(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(data)
    long = np.flatnonzero(np.diff(offsets) >= PASSAGE)
    if not len(long):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray((n,), "<u8", padded.tobytes(), 0, (1,))
    gram = mix(load[: n - 23] * np.uint64(0x9E3779B97F4A7C15) + load[8 : n - 15] * np.uint64(0xD6E8FEB86659FD93) + load[16 : n - 7] * np.uint64(0xA24BAED4963EE407) + (load[16 : n - 7] >> np.uint64(29)) + (load[8 : n - 15] >> np.uint64(31)))
    low = np.uint64(2**32 - 1)  # places in a slice; of grams that agree in the upper bits the leftmost is the anchor, in every text alike
    least = _sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), SPREAD)
    count = np.diff(offsets)[long] - PASSAGE + 1
    window, doc = ragged(count, offsets[long]), np.repeat(long, count)
    at = (least[window] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return [at[first], window[first], window[last], doc[first], mix(gram[at[first]])]  # mixed anew: the least of many hashes is small, and ranges go by size


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors' positions, the first and last windows they own, their documents and their grams' hashes."""
    parts = []
    for a, b in slices(offsets, 1 << 19):
        at, first, last, doc, h = _anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append((at + offsets[a], first + offsets[a], last + offsets[a], doc + a, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))


def _named(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    keep = ids[found[3]] != NO_ID
    return found if keep.all() else tuple(x[keep] for x in found)


def _grams(ids, data, offsets):
    """Distinct grams of a run and how many documents have them."""
    *_, doc, h = _named(ids, anchors(data, offsets))
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return h[first], np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _window_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the 50 bytes at each place."""
    load = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))
    one, two = (np.full(len(at), seed, np.uint64) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    for j in (*range(0, PASSAGE - 8, 8), PASSAGE - 8):
        chunk = load[at + j]
        one, two = mix(one ^ chunk), mix(two + chunk * np.uint64(0xD6E8FEB86659FD93))
    return one, two


class HotWindows:
    """A run's distinct windows of hot grams, sorted by hash, with the places where they occur."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray):
        count = last - first + 1
        at, doc = ragged(count, first), np.repeat(doc, count)
        one, two = _window_hashes(data, at) if len(at) else (np.zeros(0, np.uint64),) * 2
        order = np.lexsort((two, one))
        one, two, self.at, self.doc = one[order], two[order], at[order], doc[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        start = np.flatnonzero(new)
        self.one, self.two, self.of = one[start], two[start], np.cumsum(new) - 1
        self.least = np.minimum.reduceat(ids[self.doc], start) if len(start) else np.zeros(0, np.int64)


class SuffixRun:
    """A run's distinct suffixes, sorted within the ranges of their grams' hashes, with the places where they occur."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, answers: list[dict] | None, hashes: float):
        at, first, last, doc, h = _named(ids, anchors(data, offsets))
        grams, which = np.unique(h, return_inverse=True)
        stay, hot = (enough(grams, answers, hashes, k)[which] if len(h) else np.zeros(0, bool) for k in ("bits", "hot"))
        self.hot = HotWindows(ids, data, first[hot], last[hot], doc[hot])
        stay &= ~hot
        at, first, last, doc, part = at[stay], first[stay], last[stay], doc[stay], h[stay] >> np.uint64(64 - range_bits(hashes))
        right, left = last + PASSAGE - at, at - first
        padded = np.concatenate([np.zeros(SPREAD, np.uint8), data, np.zeros(PASSAGE, np.uint8)])
        record = np.zeros((len(at), RECORD), np.uint8)
        on, back = np.arange(PASSAGE), np.arange(SPREAD - 1)
        view = np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)
        record[:, :PASSAGE] = view[at + SPREAD] * (on < right[:, None])
        record[:, PASSAGE : PASSAGE + SPREAD - 1] = view[at + 1, SPREAD - 2 :: -1][:, : SPREAD - 1] * (back < left[:, None])
        record[:, -2], record[:, -1] = right, left + 1
        order = np.argsort(record.view(f"S{RECORD}").ravel(), kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        record = record[order]
        differs = record[1:] != record[:-1]
        new = np.ones(len(record), bool)
        new[1:] = differs.any(1)
        start = np.flatnonzero(new)
        self.record, self.part = record[start], part[order][start]
        self.shared = np.zeros(len(start), np.uint8)  # bytes shared with the predecessor
        if len(start) > 1:
            self.shared[1:] = differs[start[1:] - 1].argmax(1)
        self.of = np.cumsum(new) - 1
        self.first, self.last, self.doc = first[order], last[order], doc[order]
        self.start, self.least = start, np.minimum.reduceat(ids[self.doc], start) if len(start) else np.zeros(0, np.int64)


def _each(batches, hashes: float):
    for batch in batches:
        for run, ids, texts, answers in zip(*(batch.column(c).to_pylist() for c in ("run", "ids", "texts", "answers")), strict=True):
            i, data, offsets = open_run(ids, texts)
            yield run, i, data, offsets, SuffixRun(i, data, offsets, answers, hashes)


def _send(hashes: float):
    def run(batches):
        bits = range_bits(hashes)
        for key, _, _, _, s in _each(batches, hashes):
            begin = np.flatnonzero(np.concatenate([[True], s.part[1:] != s.part[:-1]])) if len(s.part) else np.zeros(0, np.int64)
            parts, first, shared, rest, least = [], [], [], [], []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(s.part)], strict=False):
                lcp = s.shared[a:b].copy()
                lcp[0] = 0
                parts.append(int(s.part[a]))
                first.append(a)
                shared.append(squeeze(lcp))
                rest.append(squeeze(s.record[a:b][np.arange(RECORD) >= lcp[:, None]]))
                least.append(squeeze(s.least[a:b].astype("<i8")))
            edge = cut_ranges(s.hot.one, bits)
            for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():  # ranges of windows come after those of suffixes
                a, b = edge[p], edge[p + 1]
                parts.append((1 << bits) + p)
                first.append(int(a))
                shared.append(squeeze_sorted(s.hot.one[a:b]))
                rest.append(squeeze(s.hot.two[a:b]))
                least.append(squeeze(s.hot.least[a:b].astype("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([key] * len(parts), pa.int64()), pa.array(first, pa.int64()), *(pa.array(x, pa.binary()) for x in (shared, rest, least))], ["part", "run", "first", "shared", "rest", "least"])

    return run


def front_decoded(shared: list[int], rest: bytes, width: int = RECORD):
    """The strings of a front-coded run."""
    at, last = 0, b""
    for n in shared:
        last = last[:n] + rest[at : at + width - n]
        at += width - n
        yield last


def merge(runs: list[tuple[list[int], list[bytes]]], width: int = RECORD):
    """(bytes shared with the string before, run, place in it) of all strings of sorted runs, in order.

    runs: of each the lengths shared with the predecessor, and the strings. A loser tree in which every loser
    keeps the length it shares with the last winner: of two candidates the one that shares more comes first, and only at
    equal lengths bytes are compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    size = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    place = [0] * k
    head: list[bytes | None] = [runs[i][1][0] if size[i] else None for i in range(k)]
    known = [0] * k  # of each run's head: bytes shared with the last winner on its path

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; the loser's known length is brought up to date."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        h = known[a]
        if h != known[b]:
            return h > known[b]
        if h == width or x == y:
            known[max(a, b)] = width
            return a < b
        h = width - ((int.from_bytes(x[h:], "big") ^ int.from_bytes(y[h:], "big")).bit_length() + 7 >> 3)
        if x[h] < y[h]:
            known[b] = h
            return True
        known[a] = h
        return False

    tree = [0] * (2 * k)  # losers at 1..k-1
    winner = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while head[top] is not None:
        yield known[top], top, place[top]
        place[top] += 1
        if place[top] < size[top]:
            head[top] = runs[top][1][place[top]]
            known[top] = runs[top][0][place[top]]
        else:
            head[top] = None
        node = k + top >> 1
        while node:
            other = tree[node]
            h, g = known[top], known[other]
            x = head[top]
            if x is None or head[other] is None or h == g:
                if not beats(top, other):
                    tree[node], top = top, other
            elif h < g:
                tree[node], top = top, other
            node >>= 1


def windows_of(record: bytes) -> list[bytes]:
    right, left = record[-2], record[-1] - 1
    whole = record[PASSAGE : PASSAGE + left][::-1] + record[:right]
    return [whole[j : j + PASSAGE] for j in range(len(whole) - PASSAGE + 1)]


def resolve(variants: list[tuple[bytes, int]]) -> list[list[tuple[int, int, int]]]:
    """Owned strings of one gram with their smallest ids: for each, (first window, last window, smallest id of any that has them)."""
    if len(variants) == 1:
        record, doc = variants[0]
        return [[(0, record[-2] + record[-1] - 1 - PASSAGE, doc)]]
    least: dict[bytes, int] = {}
    split = [windows_of(record) for record, _ in variants]
    for ws, (_, doc) in zip(split, variants, strict=True):
        for w in ws:
            if doc < least.get(w, doc + 1):
                least[w] = doc
    out = []
    for ws in split:
        spans: list[tuple[int, int, int]] = []
        for j, w in enumerate(ws):
            m = least[w]
            if spans and spans[-1][2] == m:
                spans[-1] = (spans[-1][0], j, m)
            else:
                spans.append((j, j, m))
        out.append(spans)
    return out


def _meet(bits: int):
    def run(group):
        return _meet_windows(group) if group.column("part")[0].as_py() >> bits else _meet_suffixes(group)

    return run


def _answers(names: list[int], told: list[np.ndarray], windows: bool) -> pa.Table:
    some = [k for k, t in enumerate(told) if len(t)]
    return pa.table({"run": pa.array([names[k] for k in some], pa.int64()), "windows": pa.array([windows] * len(some), pa.bool_()), "told": pa.array([squeeze(np.asarray(told[k], "<i8")) for k in some], pa.binary())})


def _meet_windows(group):
    """Of a range's windows tell each run those that have a smaller id elsewhere: place, smallest id."""
    names, first = group.column("run").to_pylist(), group.column("first").to_pylist()
    one = [expand_sorted(b) for b in group.column("shared").to_pylist()]
    size = [len(x) for x in one]
    one, two = np.concatenate(one), np.concatenate([expand(b, "<u8") for b in group.column("rest").to_pylist()])
    own = np.concatenate([expand(b, "<i8") for b in group.column("least").to_pylist()])
    order = np.lexsort((two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    least = np.empty(len(one), np.int64)
    least[order] = np.minimum.reduceat(own[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    told, end = [], np.cumsum(size)
    for n, e, f in zip(size, end.tolist(), first, strict=True):
        at = np.flatnonzero(least[e - n : e] < own[e - n : e])
        told.append(np.stack([at + f, least[e - n : e][at]], 1).ravel())
    return _answers(names, told, True)


def _meet_suffixes(group):
    """Merge a range's runs; tell each run, for its suffixes, which windows have a smaller id elsewhere."""
    names = group.column("run").to_pylist()
    first = group.column("first").to_pylist()
    shared = [expand(b, "u1").tolist() for b in group.column("shared").to_pylist()]
    rest = [expand(b, "u1").tobytes() for b in group.column("rest").to_pylist()]
    least = [expand(b, "<i8").tolist() for b in group.column("least").to_pylist()]
    strings = [list(front_decoded(s, r)) for s, r in zip(shared, rest, strict=True)]
    told: list[list[int]] = [[] for _ in names]

    def close(variants: list[tuple[bytes, int]], places: list[list[tuple[int, int]]]) -> None:
        if len(variants) == 1 and len(places[0]) == 1:
            return
        for spans, where in zip(resolve(variants), places, strict=True):
            for r, i in where:
                own = least[r][i]
                for a, b, m in spans:
                    if m < own:
                        told[r] += (first[r] + i, a, b, m)

    variants: list[tuple[bytes, int]] = []
    places: list[list[tuple[int, int]]] = []
    for known, r, i in merge(list(zip(shared, strings, strict=True))):
        if known < GRAM and variants:
            close(variants, places)
            variants, places = [], []
        if known == RECORD and variants:
            variants[-1] = (variants[-1][0], min(variants[-1][1], least[r][i]))
            places[-1].append((r, i))
        else:
            variants.append((strings[r][i], least[r][i]))
            places.append([(r, i)])
    if variants:
        close(variants, places)
    return _answers(names, [np.array(t, np.int64) for t in told], False)


def _remove(hashes: float, as_text: bool):
    def told_to(batches):
        for batch in batches:
            told = batch.column("told").to_pylist()
            for (_, ids, data, offsets, s), t in zip(_each([batch], hashes), told, strict=True):
                begin, end = [s.first[(w := s.least[s.of] < ids[s.doc])]], [s.last[w] + PASSAGE]
                least = s.hot.least.copy()
                for answer in t or []:
                    if answer["windows"]:
                        item, m = expand(answer["told"], "<i8").reshape(-1, 2).T
                        least[item] = m
                gone = s.hot.at[least[s.hot.of] < ids[s.hot.doc]]
                begin.append(gone)
                end.append(gone + PASSAGE)
                for answer in t or []:
                    if answer["windows"]:
                        continue
                    item, a, b, m = expand(answer["told"], "<i8").reshape(-1, 4).T
                    count = np.append(s.start[1:], len(s.of))[item] - s.start[item]
                    where = ragged(count, s.start[item])
                    a, b, m = (np.repeat(x, count) for x in (a, b, m))
                    smaller = m < ids[s.doc[where]]
                    begin.append((s.first[where] + a)[smaller])
                    end.append((s.first[where] + b + PASSAGE)[smaller])
                begin, end = np.concatenate(begin), np.concatenate(end)
                depth = np.bincount(begin, minlength=len(data) + 1)[: len(data) + 1] - np.bincount(end, minlength=len(data) + 1)[: len(data) + 1]
                gone = np.cumsum(depth)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                opens[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(opens)])
                removed = sums[offsets[1:]] - sums[offsets[:-1]]
                kept_data = data[~gone].tobytes()
                size = np.diff(offsets)
                kept_end = np.cumsum(size - removed)
                for a, b in slices(offsets, 1 << 20):
                    kept = [kept_data[e - n : e] for e, n in zip(kept_end[a:b].tolist(), (size - removed)[a:b].tolist(), strict=True)]
                    crc = [zlib.crc32(data[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a:b], mask=ids[a:b] == NO_ID), pa.array(size[a:b]), pa.array(crc, pa.int64()), pa.array(removed[a:b]), pa.array((spans[offsets[1:]] - spans[offsets[:-1]])[a:b]), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
                        ["doc_id", "n_bytes", "crc32", "n_removed", "n_spans", "kept"],
                    )

    return told_to


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES, as_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes and crc32 (of the whole text), n_removed, n_spans, and kept, the bytes that are left (as text: without halves of characters)."""
    runs = build_runs(docs, id_col, text_col, run_bytes)
    size = total_bytes(runs)
    hashes = size / BYTES_AN_ANCHOR
    answers = materialize(multiplicities(runs, _grams, hashes, 2, HOT), "repeated")
    asked = runs.select("run", "ids", "texts").join(answers, "run", "left")
    sent = asked.mapInArrow(_send(hashes), "part int, run long, first long, shared binary, rest binary, least binary")
    told = materialize(sent.groupBy("part").applyInArrow(_meet(range_bits(hashes)), "run long, windows boolean, told binary").groupBy("run").agg(F.collect_list(F.struct("windows", "told")).alias("told")), "told")
    kind = docs.schema[id_col].dataType.simpleString()
    out = asked.join(told, "run", "left").mapInArrow(_remove(hashes, as_text), "doc_id long, n_bytes long, crc32 long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary"))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
