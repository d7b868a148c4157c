"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors by
multiplication after rotating the first by two places and the second by one, so order counts. A text is the
bundle (sum) of its trigrams, a language's prototype the bundle of its training texts, and a text gets the
language whose prototype has the largest cosine with it.

Defined cases: texts that are null or have no letter get ``und`` and score 0, as do all texts if nothing could
be learned; of equal cosines the first language by name wins; null languages aren't learned; repeated rows are
scored alike; very long texts are read whole; an empty table gives no rows, and nothing to learn; other columns are
never read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import small_batches
from factloom.llm.heldout import held_out, sampled, share_for

DIMENSIONS = 1024
#: Symbols: 0 for anything but letters, 1-26 for a-z, the rest for all other letters by a hash of the code point.
ALPHABET = 64
#: Texts that prototypes are learned from, about.
TRAIN_ROWS = 20_000
#: Trigram vectors that a worker keeps.
KEPT = 24_000
_SEED = 7


class Encoder:
    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(_SEED)
        self.letters = rng.choice(np.array([-1, 1], np.int8), (ALPHABET, dimensions))
        self.symbol = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] == "L":
                low = chr(cp).lower()
                c = ord(low) if len(low) == 1 else cp
                self.symbol[cp] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 8) % (ALPHABET - 27)
        self.row = np.full(ALPHABET**3, -1, np.int32)
        self.vectors = np.zeros((0, dimensions), np.int8)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // ALPHABET**2, codes // ALPHABET % ALPHABET, codes % ALPHABET
        return np.roll(self.letters, 2, 1)[a] * np.roll(self.letters, 1, 1)[b] * self.letters[c]

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' vectors, and whether they have a letter."""
        joined = np.frombuffer(("  ".join(["", *texts, ""])).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) + 2 for t in texts])
        s = self.symbol[joined].astype(np.int32)
        code = (s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:]
        doc = np.repeat(np.arange(len(texts)), sizes)  # of the middle symbol, from the one before each text on
        doc = np.concatenate([doc, np.full(max(0, len(code) - len(doc)), len(texts) - 1)])[: len(code)]
        keep = (s[1:-1] != 0) | ((s[:-2] != 0) & (s[2:] != 0))
        code, doc = code[keep], doc[keep]
        new = np.unique(code[self.row[code] < 0])
        if len(self.vectors) + len(new) > KEPT:
            self.row[:] = -1
            self.vectors, new = self.vectors[:0], np.unique(code)
        if len(new):
            self.row[new] = len(self.vectors) + np.arange(len(new))
            self.vectors = np.concatenate([self.vectors, self.bind(new)])
        width = max(1, len(self.vectors))
        counts = np.bincount(doc * width + self.row[code], minlength=len(texts) * width).reshape(len(texts), width)
        used = np.flatnonzero(counts.any(0))
        return counts[:, used].astype(np.float32) @ self.vectors[used].astype(np.float32), counts.any(1)


_encoder: list[Encoder] = []


def _bundles(texts: list[str | None], most: int = 400_000):
    """(first row, vectors, has letters) of successive parts of the texts."""
    if not _encoder:
        _encoder.append(Encoder())
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and b - a < 128 and (b == a or size + len(texts[b] or "") <= most):
            size += len(texts[b] or "")
            b += 1
        yield (a, *_encoder[0].bundles([t or "" for t in texts[a:b]]))
        a = b


def _learn(batches):
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
        for a, vectors, some in _bundles(texts):
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.maximum(norm, 1e-9)
            own = langs[a : a + len(vectors)]
            names = sorted(set(own))
            sums = [unit[(own == x) & some].sum(0).astype(np.float64) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(sums), pa.list_(pa.float64()))], ["lang", "bundle"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Language names and their prototypes of unit length, from about ``rows`` of the rows that aren't held out."""
    small_batches(docs.sparkSession)
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    part = train.where(sampled(share_for(train, rows), "i")).select("t", "l").mapInArrow(_learn, "lang string, bundle array<double>")
    sums = part.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    found = {r.lang: [x.v for x in sorted(r.vs)] for r in sums.groupBy("lang").agg(F.collect_list(F.struct("pos", "v")).alias("vs")).collect()}  # one row per language
    names = sorted(n for n, v in found.items() if any(v))
    if not names:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    vectors = np.array([found[n] for n in names])
    return names, (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text"):
    """A column of struct<lang_pred, score> for the text column; score is the cosine, at least 0."""
    small_batches(docs.sparkSession)
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, prototypes = shared.value
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if names:
            for a, vectors, some in _bundles(texts.to_pylist()):
                cosine = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(1)
                for i in np.flatnonzero(some).tolist():
                    lang[a + i] = names[best[i]]
                    score[a + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict(F.col(text_col))
