"""Texts of several megabytes through the encoders, packing and the pipeline, and the compression verdict by a plain twin."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import quality, queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgé🙂") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(700_000), prose(300), None, "", "x" * 200_000]
    path = tmp_path_factory.mktemp("long")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    assert len(texts[0].encode()) > 5_000_000
    return str(path), texts


def test_encode_and_pack(spark, long_table):
    path, texts = long_table
    library = Tokenizer.from_file(queries.BYTE_BPE)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in queries.op1_bpe(spark, path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(ids[i]) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    pieces = queries.op2_packing(spark, path).collect()
    for i in ids:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(ids[i]) + 1
    assert all(p.offset + p.length <= 1024 for p in pieces)


def test_pipeline(spark, long_table):
    path, texts = long_table
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").distinct().collect()} == {0, 1}


def kept(text: str | None) -> bool:
    """The verdict by plain loops: words, then the bands of the whole and of full chunks."""
    raw, words = (text or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)} if len(words) < 3000 else set()
    if len(words) < 10 or 100 * len(twice) > 20 * len(words):
        return False
    pack = zstandard.ZstdCompressor(level=3).compress

    def odd(part: bytes) -> bool:
        low, high = 0.0, 1e9
        for least, a, b in quality.BANDS:
            if len(part) >= least:
                low, high = a, b
        return not low * len(part) <= len(pack(part)) <= high * len(part)

    chunks = [raw[i : i + 4096] for i in range(0, len(raw) // 4096 * 4096, 4096)] if len(raw) >= 8192 else []
    return not odd(raw) and sum(map(odd, chunks)) <= quality.CHUNK_SHARE * len(chunks)


def test_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.kept for r in queries.op9_quality(spark, SF).collect()}
    small = {i for i, t in docs.items() if len((t or "").split()) < 3000}
    assert {i: got[i] for i in small} == {i: kept(docs[i]) for i in small} and len({got[i] for i in small}) == 2
