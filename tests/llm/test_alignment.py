"""Alignment of two tokenizers against the libraries' own ids and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment, bpe, queries
from tests.conftest import SF
from tests.llm.test_llm import SCHEMA, awkward


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(queries.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    a.encode_special_tokens = True
    return a, b


def tokens(libraries, text: str | None):
    """Ids and byte ends of both sides, or two empty sides."""
    a, b = libraries
    byte_of = bpe._printable_bytes()
    ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    whole = (" " + (text or "")).encode()
    if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return [], [], [], []
    return ids_a, np.cumsum([*map(len, raw_a)]).tolist(), ids_b, np.cumsum([*map(len, raw_b)]).tolist()


def expected(libraries, rows: list[tuple]) -> list[tuple]:
    done, counts = [], Counter()
    for doc_id, text in rows:
        ids_a, ends_a, ids_b, ends_b = tokens(libraries, text)
        cuts = sorted(set(ends_a) & set(ends_b))
        at_b = dict(zip(ends_b, ids_b, strict=True))
        links = [(x, at_b[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in at_b]
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append("|".join(",".join(map(str, ids)) for ids in (ids_a[i:x], ids_b[j:y])))
            i, j = x, y
        counts.update(links)
        done.append((doc_id, len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, a, b, g, len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(t.encode()).hexdigest() if t else "") for d, a, b, g, k, t in done]


def compared(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_query_by_plain_loops(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("d")
    got = alignment.cross_align(spark.table("d").repartition(5), queries.BYTE_BPE, queries.PIECE_BPE, rendering=None).collect()
    compared([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got], expected(libraries, docs))


def test_awkward_rows_and_shuffled_counts(spark, libraries, tmp_path):
    """Both ways of bringing counts back give the plain loops' rows."""
    more = ["<s> </s> <unk>", "▁ own mark", "a  b", " a ", "tail ", "\n\n\t", "ﬁ ½ ́ ﬁ", "x" + " " * 120_000 + "y", "é🙂" * 50, "<0x41>"]
    table = awkward() + [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(more)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(libraries, [(r[0], r[1]) for r in table])
    compared(queries.op13_alignment(spark, str(tmp_path)).collect(), want)
    got = alignment.cross_align(docs, queries.BYTE_BPE, queries.PIECE_BPE, told_pairs=0)
    assert sorted(map(repr, (tuple(r)[:5] + (r.n_best, r.count_sum) for r in got.collect()))) == sorted(repr(w[:7]) for w in want)
    assert alignment.cross_align(docs.limit(0), queries.BYTE_BPE, queries.PIECE_BPE).count() == 0


def test_pieces_equal_the_library(libraries):
    rng = random.Random(1)
    side = alignment.PieceSide(open(queries.PIECE_BPE, "rb").read(), cache_units=300)
    texts = ["".join(rng.choice(" \n\t'abAB1!é🙂́ﬁ  <0x4>") for _ in range(60)) for _ in range(400)]
    for t, ids in zip(texts, side.encode([" " + t for t in texts]), strict=True):
        want = libraries[1].encode(t)
        raw = b"".join(side.pieces[i] for i in want)
        assert (None if ids is None else ids.tolist()) == (want if raw == (" " + t).encode() else None)


def test_links_of_whole_groups():
    """All pairs of a group, and tokens that end together, on lengths of either side."""
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(1, 40)
        ends = [sorted({*rng.sample(range(1, total), rng.randint(0, total - 1)), total}) for _ in range(2)]
        lengths = [np.diff([0, *e]) for e in ends]
        ids = [np.arange(len(e)) for e in ends]
        table = np.concatenate([lengths[0], [1] * 50]), np.concatenate([lengths[1], [1] * 50])
        for whole in (False, True):
            x = alignment.Aligned([ids[0]], [ids[1]], *table, whole)
            cuts = sorted(set(ends[0]) & set(ends[1]))
            group = [[sum(c < e for c in cuts) for e in side] for side in ends]
            want = [(i, j) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if (group[0][i] == group[1][j] if whole else e == f)]
            assert sorted(zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)) == want
            assert x.n_groups.tolist() == [len(cuts)]


def test_counts_flush_and_merge(spark, monkeypatch):
    """Wide keys and narrow ones, equal keys in several rows."""
    rng = random.Random(3)
    rows = [[rng.randrange(40) * 100 + rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(50)]
    for wide, kind in ((False, "<u4"), (True, "<u8")):
        df = spark.createDataFrame([(np.array(r, kind).tobytes(),) for r in rows], "links binary")
        got = {r.key: (r.n, r.best) for r in alignment.pair_counts(df, 100, wide).collect()}
        n = Counter(k for r in rows for k in r)
        assert got == {k: (c, c == max(v for q, v in n.items() if q % 100 == k % 100)) for k, c in n.items()}
