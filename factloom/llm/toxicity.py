"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

Character n-grams (of bytes, lower-cased, with word borders) are hashed to embedding rows; a word is the mean of
its n-grams, a window the mean of its words, and a linear softmax over windows is trained jointly with the
embeddings in numpy. Unseen misspellings share most n-grams with the words they spoil. Since the softmax is
linear, every n-gram's part of a window's log-odds is one number; a text's log-odds are those of its most toxic
window, so a few words count in long texts too, calibrated on training texts that the embeddings weren't fitted to.

Defined cases: null and empty texts score as texts without n-grams, with the lowest log-odds; if no label can
be learned from, all scores are 0; a document labelled twice counts as toxic if any label says so; repeated
rows are scored alike; very long texts are scored and learned from whole; an empty table gives no rows; columns
other than id, text and label are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import slices, small_batches, utf8_parts
from factloom.llm.heldout import held_out, sampled, share_for
from factloom.llm.scratch import materialize

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 16
#: Words of a window.
WINDOW = 8
#: The sample of labelled texts that is learned from: rows and bytes of whole texts, about. Every window of a sampled text counts.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 8 << 20
EPOCHS, BATCH_WINDOWS, RATE = 6, 4096, 0.3
_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), ord("@"), ord("$"), ord("!"), ord("*")]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[~_KEEP[_FOLD]] = 0x20


class Grams:
    """Words of joined texts and their n-grams' buckets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        gap = np.arange(n)  # one space before each text, so that none touch
        padded = np.full(len(data) + n + 8, 0x20, np.uint8)
        doc_of = np.repeat(gap, np.diff(offsets))
        padded[np.arange(len(data)) + doc_of + 1] = _FOLD[data]
        inside = padded != 0x20
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.doc = np.searchsorted(offsets[:-1] + gap, start - 1, "right") - 1
        self.words = len(start)
        word = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]])) - 1
        load = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), 0, (1,))
        self.at, self.bucket = [], []
        solid = inside[1:]
        for size in range(2, max(GRAMS) + 1):  # bytes 1 to size-2 belong to a word; the first and last may be borders
            if size > 2:
                solid = solid[: len(solid) - 1] & inside[size - 2 : size - 2 + len(solid) - 1] if size > 3 else inside[1:-1]
            if size in GRAMS:
                i = np.flatnonzero(solid[: len(load)])
                h = (load[i] & np.uint64((1 << 8 * size) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                self.at.append(word[i + 1].astype(np.int32))
                self.bucket.append((h >> np.uint64(64 - 17)).astype(np.int32))
        self.at, self.bucket = np.concatenate(self.at), np.concatenate(self.bucket)
        self.per_word = np.maximum(1, np.bincount(self.at, minlength=self.words))


def window_odds(grams: Grams, score: np.ndarray, n: int) -> np.ndarray:
    """Of every text the largest mean of word scores over ``WINDOW`` words in a row (all, if it has fewer); -inf without words."""
    out = np.full(n, -np.inf)
    if not grams.words:
        return out
    sums = np.concatenate([[0.0], np.cumsum(np.bincount(grams.at, score[grams.bucket], grams.words) / grams.per_word)])
    first = np.flatnonzero(np.concatenate([[True], grams.doc[1:] != grams.doc[:-1]]))
    last = np.append(first[1:], grams.words)
    end = np.repeat(last, last - first)
    begin = np.repeat(first, last - first)
    at = np.arange(grams.words)
    stop = np.minimum(at + WINDOW, end)
    mean = (sums[stop] - sums[at]) / (stop - at)
    mean[(stop - at < WINDOW) & (at > begin)] = -np.inf  # a shorter window counts only where the text itself is shorter
    out[grams.doc[first]] = np.maximum.reduceat(mean, first)
    return out


def _odds(data: np.ndarray, offsets: np.ndarray, score: np.ndarray) -> np.ndarray:
    parts = [window_odds(Grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), score, b - a) for a, b in slices(offsets, 1 << 19)]
    return np.concatenate(parts) if parts else np.zeros(0)


def windows_of(texts: list[str | None], labels: list[int]) -> tuple[list[bytes], np.ndarray]:
    """All windows of the texts, each with its text's label."""
    out, of = [], []
    for text, label in zip(texts, labels, strict=True):
        words = (text or "").encode().split()
        own = [b" ".join(words[i : i + WINDOW]) for i in range(0, max(1, len(words)), WINDOW)]
        out += own
        of += [label] * len(own)
    return out, np.array(of, np.int64)


def fit(windows: list[bytes], labels: np.ndarray, classes: int = 2, seed: int = 11) -> np.ndarray:
    """Every bucket's part of the log-odds of class 1: embeddings and softmax trained jointly (Adagrad on cross-entropy, in minibatches)."""
    n = len(windows)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear, bias = rng.normal(0, 0.5, (DIMENSIONS, classes)).astype(np.float32), np.zeros(classes, np.float32)
    speed_e, speed_l, speed_b = np.full(BUCKETS, 1e-8), np.full(linear.shape, 1e-8), np.full(classes, 1e-8)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(n), max(1, -(-n // BATCH_WINDOWS))):
            raw = [windows[i] for i in rows.tolist()]
            g = Grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            own = g.doc[g.at]
            w = 1.0 / (g.per_word[g.at] * np.maximum(1, np.bincount(g.doc, minlength=len(rows)))[own])
            used, b = np.unique(g.bucket, return_inverse=True)
            rows_e = embed[used]
            by_class = rows_e @ linear
            logit = np.stack([np.bincount(own, by_class[b, k] * w, len(rows)) for k in range(classes)], 1) + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            gap = (p / p.sum(1, keepdims=True) - np.eye(classes)[labels[rows]]) / len(rows)
            coef = np.stack([np.bincount(b, gap[own, k] * w, len(used)) for k in range(classes)], 1)
            grad_e, grad_l, grad_b = coef @ linear.T, rows_e.T @ coef, gap.sum(0)
            speed_e[used] += (grad_e**2).mean(1)
            speed_l += grad_l**2
            speed_b += grad_b**2
            embed[used] -= (RATE * grad_e / np.sqrt(speed_e[used])[:, None]).astype(np.float32)
            linear -= (RATE * 0.2 * grad_l / np.sqrt(speed_l)).astype(np.float32)
            bias -= (RATE * 0.2 * grad_b / np.sqrt(speed_b)).astype(np.float32)
    return (embed @ (linear[:, 1] - linear[:, 0])).astype(np.float32)


def calibrate(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds that fit the labels best (Newton steps on a lightly penalised logistic fit)."""
    finite = np.isfinite(odds)
    x, y = odds[finite], labels[finite].astype(float)
    if len(set(y.tolist())) < 2:
        return 0.0, 8.0 if len(y) and y[0] else -8.0
    mid, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mid) / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * beta)
        beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return float(beta[0] / scale), float(beta[1] - beta[0] * mid / scale)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[np.ndarray, float, float] | None:
    """Bucket scores, slope and offset; None if there are no labelled rows outside the held-out fold.

    About ``rows`` labelled rows are learned from, or fewer if their whole texts would have more than about ``size`` bytes.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    share = share_for(marked, rows)
    train = docs.where(sampled(share, id_col) & ~held_out(id_col)).select(id_col, F.col(text_col).alias("t")).join(marked.where(sampled(share, id_col)), id_col)
    train = materialize(train, "train")
    found = train.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    train = train.where(sampled(share * min(1.0, size / max(1, found)), id_col))
    fits = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(4)) > 0
    got = train.where(fits).select("t", "y").orderBy(id_col, "t").toArrow()
    if not len(got):
        return None
    score = fit(*windows_of(got.column("t").to_pylist(), got.column("y").to_pylist()))
    checked = train.where(~fits).select("y", log_odds(docs, score, "t").alias("x")).toArrow()
    x, yc = checked.column("x").to_numpy(), checked.column("y").to_numpy()
    if len(yc) < 20 or len(set(yc.tolist())) < 2:  # too few to calibrate on apart
        checked = train.select("y", log_odds(docs, score, "t").alias("x")).toArrow()
        x, yc = checked.column("x").to_numpy(), checked.column("y").to_numpy()
    return score, *calibrate(x, yc)


def log_odds(docs: DataFrame, score: np.ndarray, text_col: str):
    """A column with the uncalibrated log-odds of each text; -inf without words."""
    shared = docs.sparkSession.sparkContext.broadcast(score)

    @F.arrow_udf("double")
    def odds(texts: pa.Array) -> pa.Array:
        return pa.array(_odds(*utf8_parts(texts), shared.value))

    return odds(F.col(text_col))


def probability(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, text_col: str = "text"):
    """A column with the probability of each text being toxic."""
    if model is None:
        return F.lit(0.0)
    score, slope, offset = model
    x = F.greatest(log_odds(docs, score, text_col), F.lit(-1e6)) * slope + offset
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
