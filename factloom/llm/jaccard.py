"""Exact Jaccard self-join of word shingles with token-combination prefixes.

A document's tokens are its distinct shingles' hashes, ordered rare ones first. Two documents that link miss at most
n // 5 of one's n tokens, so of any prefix's signatures, more than that must be lost to lose all. A rare token is
a signature by itself. Frequent tokens are dealt into subclasses by hash and only pairs of one subclass are
signatures: p tokens of a subclass take p - 1 losses to lose all their pairs. The prefix is extended until its
signatures take more than n // 5 losses; two linked documents then share a signature. Pairs that share one are
verified on their whole shingle sets.

Documents with equal sets are one class with one representative, found by partial aggregation of set
fingerprints, run by run. Within a signature's bucket documents are first tested against a centre, the set that most
buckets hold. What these tests connect needs no further test. In a small bucket all other pairs are compared. In a
large one they needn't be: two sets x and y that share no token which the centre c lacks share no more than
min(|x & c|, |y & c|), and these are known. So only sets for which this suffices, or that hold a token which another
one also holds and the centre lacks, are compared, those that don't link with the centre with all of them, in blocks
of bounded size. Nothing is capped.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing; with fewer
words than a shingle the whole sequence is one; rows are nodes, so repeated rows form one class; a row without
an id joins no class and has no component; a very long text is a run by itself; an empty table gives no rows;
columns other than id and text aren't carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrowkit import ragged, slices
from factloom.llm.components import components
from factloom.llm.runs import NO_ID, RUN_BYTES, build_runs, cut_ranges, enough, expand, expand_sorted, multiplicities, open_run, range_bits, squeeze, squeeze_sorted, total_bytes
from factloom.llm.scratch import materialize, passing
from factloom.llm.words import LOWER, mix, windows, words_of

SHINGLE = 5
#: Least similarity, as a fraction: linked if 5 * shared >= 4 * joint.
NUM, DEN = 4, 5
#: A token held by so many sets (counted run by run) is frequent.
FREQUENT = 16
#: Tokens of a document for one subclass of its frequent tokens.
PER_SUBCLASS = 16
#: Bytes of text for one shingle, roughly; only sizes ranges.
BYTES_A_SHINGLE, BYTES_A_SIGNATURE = 6, 24
#: Sets of a bucket whose pairs are all compared, at most, and of a block of a larger bucket, about.
SMALL, BLOCK = 16, 512
_NODE_BITS = 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of every text the sorted distinct hashes of its shingles, A-Z taken as a-z."""
    out: list[np.ndarray] = []
    for a, b in slices(offsets, 1 << 20):
        raw, own = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        w = words_of(raw, own)
        h = w.hashes(w.start, w.end)
        at, shingle = windows(h, w.doc, SHINGLE)
        edge = np.searchsorted(w.doc[at], np.arange(b - a + 1))
        first = np.searchsorted(w.doc, np.arange(b - a + 1))
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= SHINGLE:
                out.append(np.unique(shingle[edge[i] : edge[i + 1]]))
            elif n:
                x = np.array([n], np.uint64)
                for k in range(first[i], first[i + 1]):
                    x = mix(x * np.uint64(0xA24BAED4963EE407) + h[k : k + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _local(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (two 64-bit numbers) of the sets, and of every row the run's row that stands for its set: the one with the smallest id; -1 for none."""
    prints = np.array([(s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2)
    stands, best = np.full(len(sets), -1, np.int64), {}
    for i in np.argsort(ids, kind="stable").tolist():
        if len(sets[i]) and ids[i] != NO_ID:
            stands[i] = best.setdefault((*prints[i].tolist(), len(sets[i])), i)
    return prints, stands


def _meta(batches):
    for batch in batches:
        for run, ids, texts in zip(*(batch.column(c).to_pylist() for c in ("run", "ids", "texts")), strict=True):
            i, data, offsets = open_run(ids, texts)
            sets = shingle_sets(data, offsets)
            prints, stands = _local(i, sets)
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([ids]), pa.array([squeeze(np.array([len(s) for s in sets], "<i8"))]), pa.array([squeeze(stands)]), pa.array([squeeze(prints)]), pa.array([squeeze(np.array([(zlib.crc32(data[a:b]), b - a) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], "<i8").reshape(-1, 2))])], ["run", "ids", "sizes", "stands", "prints", "texts"])


def _distinct(batches):
    for batch in batches:
        for run, ids, sizes, stands, prints in zip(*(batch.column(c).to_pylist() for c in ("run", "ids", "sizes", "stands", "prints")), strict=True):
            stands = expand(stands, "<i8")
            at = np.unique(stands[stands >= 0])
            p = expand(prints, "<u8").reshape(-1, 2)[at].view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array((run << _NODE_BITS) + at), pa.array(expand(ids, "<i8")[at]), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(expand(sizes, "<i8")[at])], ["node", "doc", "p1", "p2", "n"])


def _unique(ids, data, offsets):
    sets = shingle_sets(data, offsets)
    _, stands = _local(ids, sets)
    own = [sets[i] for i in np.unique(stands[stands >= 0]).tolist()]
    return np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def level(n: int) -> int:
    """Subclasses of frequent tokens for sets of n: a power of two, so that sets of like size agree."""
    return 1 << max(0, (n // PER_SUBCLASS).bit_length() - 1)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a set: single rare tokens, or pairs of frequent tokens within a subclass."""
    n = len(tokens)
    need = n - -(-n * NUM // DEN) + 1
    rare = tokens[~frequent]
    singles = mix(rare[:need] + np.uint64(1))
    if len(rare) >= need or n < NUM:  # smaller sets link with equal ones only, and those are one class
        return singles
    often, out = tokens[frequent], [singles]
    for subclasses in sorted({level(m) for m in (-(-n * NUM // DEN), n)}):
        sub = (often >> np.uint64(17)) % np.uint64(subclasses)
        order = np.argsort(sub, kind="stable")
        first = np.ones(len(often), bool)
        first[order[1:]] = sub[order[1:]] != sub[order[:-1]]
        gain = np.cumsum(~first)
        stop = int(np.searchsorted(gain, need - len(rare))) + 1
        order = order[order < stop]
        t, s = often[order], sub[order]
        for step in range(1, len(t)):
            same = s[step:] == s[:-step]
            if not same.any():
                break
            x, y = t[:-step][same], t[step:][same]
            out.append(mix(mix(x + np.uint64(2)) * np.uint64(0x9FB21C651E98DF25) + y + np.uint64(subclasses)))
    return np.unique(np.concatenate(out))


def _sign(hashes: float, bits: int):
    def run(batches):
        for batch in batches:
            for key, ids, texts, answers, chosen in zip(*(batch.column(c).to_pylist() for c in ("run", "ids", "texts", "answers", "chosen")), strict=True):
                i, data, offsets = open_run(ids, texts)
                sets = shingle_sets(data, offsets)
                _, stands = _local(i, sets)
                own = [sets[k] for k in np.unique(stands[stands >= 0]).tolist()]
                if not own:
                    continue
                all_tokens = np.unique(np.concatenate(own))
                often = all_tokens[enough(all_tokens, answers, hashes)]
                sig, who, n = [], [], []
                for k in sorted(chosen or []):
                    s = sets[k]
                    frequent = np.zeros(len(s), bool)
                    if len(often):
                        frequent = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    sig.append(signatures(s, frequent))
                    who.append(np.full(len(sig[-1]), k, np.int32))
                    n.append(np.full(len(sig[-1]), len(s), np.int32))
                if not sig:
                    continue
                sig, who, n = np.concatenate(sig), np.concatenate(who), np.concatenate(n)
                order = np.argsort(sig, kind="stable")
                sig, who, n = sig[order], who[order], n[order]
                edge = cut_ranges(sig, bits)
                parts = [p for p in range(1 << bits) if edge[p + 1] > edge[p]]
                cut = lambda f, x: pa.array([f(x[edge[p] : edge[p + 1]]) for p in parts], pa.binary())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([key] * len(parts), pa.int64()), cut(squeeze_sorted, sig), cut(squeeze, who.astype("<i4")), cut(squeeze, n.astype("<i4"))], ["part", "run", "sig", "who", "n"])

    return run


def _buckets(group):
    """Entries of the signatures that at least two sets share."""
    sig, node, n = [], [], []
    for run, s, w, m in zip(*(group.column(c).to_pylist() for c in ("run", "sig", "who", "n")), strict=True):
        sig.append(expand_sorted(s))
        node.append((run << _NODE_BITS) + expand(w, "<i4").astype(np.int64))
        n.append(expand(m, "<i4"))
    sig, node, n = np.concatenate(sig), np.concatenate(node), np.concatenate(n).astype(np.int64)
    order = np.lexsort((node, n, sig))
    sig, node, n = sig[order], node[order], n[order]
    same = np.zeros(len(sig) + 1, bool)
    same[1:-1] = sig[1:] == sig[:-1]
    keep = same[1:] | same[:-1]
    # buckets of the same members say the same: one of them is enough
    sig, node, n = sig[keep], node[keep], n[keep]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    which = np.cumsum(np.isin(np.arange(len(sig)), first)) - 1
    if len(sig):
        total = np.zeros((len(first), 2), np.uint64)
        total[:, 0] = np.add.reduceat(mix(node.astype(np.uint64)), first)
        total[:, 1] = np.add.reduceat(mix(node.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), first)
        _, one = np.unique(total, axis=0, return_index=True)
        stay = np.isin(which, one)
        sig, node, n, which = sig[stay], node[stay], n[stay], total[which[stay], 0]
    return pa.table({"bucket": pa.array(which.astype(np.uint64).view(np.int64) if len(sig) else np.zeros(0, np.int64)), "node": pa.array(node), "n": pa.array(n)})


def _extract(batches):
    compressor = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for run, ids, texts, chosen in zip(*(batch.column(c).to_pylist() for c in ("run", "ids", "texts", "wanted")), strict=True):
            _, data, offsets = open_run(ids, texts)
            at = sorted(set(chosen))
            yield pa.RecordBatch.from_arrays([pa.array([(run << _NODE_BITS) + k for k in at], pa.int64()), pa.array([compressor.compress(data[offsets[k] : offsets[k + 1]].tobytes()) for k in at], pa.binary())], ["node", "text"])


def _linked(shared: int, n: int, m: int) -> bool:
    return DEN * shared >= NUM * (n + m - shared)


def _with_sets(batches):
    """Batches of pairs a, b with their texts, and the sets by node."""
    for batch in batches:
        known: dict[int, bytes] = {}
        for side in ("a", "b"):
            known |= dict(zip(batch.column(side).to_pylist(), batch.column(f"{side}_text").to_pylist(), strict=True))
        raw = [zstandard.ZstdDecompressor().decompress(t) for t in known.values()]
        yield batch, dict(zip(known, shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), strict=True))


def _verify(batches):
    for batch, sets in _with_sets(batches):
        pairs = [(sets[x], sets[y]) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        shared = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in pairs]
        linked = [_linked(k, len(s), len(t)) for k, (s, t) in zip(shared, pairs, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "shared", "linked"])


def _texted(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")


def verify(pairs: DataFrame, tried: DataFrame | None, texts: DataFrame) -> DataFrame:
    """a, b, shared, linked of the pairs that weren't tried before: the whole sets compared."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fresh = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti") if tried is not None else pairs
    return _texted(fresh, texts).mapInArrow(_verify, "a long, b long, shared long, linked boolean")


def _centred(buckets: DataFrame) -> DataFrame:
    """bucket, a, b, a_n, n: every set b of a bucket with the bucket's centre a, the set that most buckets hold."""
    often = buckets.groupBy("node").agg(F.count("*").alias("often"))
    centres = buckets.join(often, "node").groupBy("bucket").agg(F.max(F.struct("often", "n", "node")).alias("c"))
    return buckets.join(centres, "bucket").where(F.col("node") != F.col("c.node")).select("bucket", F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("a_n"), "n")


def _outside(batches):
    """Tokens of b that a lacks: all, or of sets that don't link the first n // 5 + 1 by hash, of which a linked set has one."""
    for batch, sets in _with_sets(batches):
        centre, token, node, loose = [], [], [], []
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            s, t = sets[x], sets[y]
            rest = np.setdiff1d(t, s, assume_unique=True)
            apart = not _linked(len(t) - len(rest), len(s), len(t))
            if apart:
                rest = rest[: len(t) - -(-len(t) * NUM // DEN) + 1]
            for out, value in ((centre, x), (node, y), (loose, int(apart))):
                out.append(np.full(len(rest), value, np.int64))
            token.append(rest.view(np.int64))
        if centre:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (centre, token, node, loose)], ["a", "token", "b", "loose"])


def _links_within(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between sets that were tested against one centre: a, b, n, root, shared (with the centre), linked (to it).

    Sets that may link either share a token their centre lacks, or both share enough with the centre. Only those
    meet: each with the loose ones, in blocks of bounded size. Of a block's links a spanning forest is told.
    """
    outer = _texted(members.select("a", "b"), texts).mapInArrow(_outside, "a long, token long, b long, loose long")
    common = outer.groupBy("a", "token").agg(F.count("*").alias("k"), F.max("loose").alias("l")).where("k > 1 AND l > 0").select("a", "token")
    touching = outer.join(common, ["a", "token"]).select("a", "b").distinct()
    least = members.groupBy("a").agg(F.min("n").alias("least"))
    enough_shared = (DEN + NUM) * F.col("shared") >= NUM * (F.col("n") + F.col("least"))
    near = members.join(least, "a").where(enough_shared)
    some_loose = near.where(~F.col("linked")).select("a").distinct()
    chosen = touching.unionByName(near.join(some_loose, "a").select("a", "b")).distinct()
    meets = members.join(chosen, ["a", "b"])
    blocks = meets.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min(F.col("linked").cast("int")).alias("all_linked")).where("all_linked = 0")
    placed = meets.join(blocks, "a").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("b").alias("node"), "own", "root", "linked")
    return dealt.join(texts, "node").groupBy("a", "i", "j").applyInArrow(_block_links, "a long, b long")


def _block_links(group):
    node, root, loose, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "linked", "own"))
    loose = ~loose
    raw = [zstandard.ZstdDecompressor().decompress(t) for t in group.column("text").to_pylist()]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, edge = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    begin = np.concatenate([[0], np.cumsum(size)])
    two = len(np.unique(own)) > 1
    parent = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for x in np.flatnonzero(loose).tolist():
        t = token[begin[x] : begin[x + 1]]
        shared = np.bincount(holders[ragged(edge[t + 1] - edge[t], edge[t])], minlength=len(sets))
        good = (DEN * shared >= NUM * (size + size[x] - shared)) & (root != root[x])
        if two:
            good &= own != own[x]
        for y in np.flatnonzero(good).tolist():
            p, q = find(int(root[x])), find(int(root[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((node[x], node[y]))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def _pairs(rows: DataFrame, condition: str) -> DataFrame:
    """a, b of rows of one bucket whose roots differ and that meet the condition on x and y."""
    x, y = (rows.select("bucket", *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "bucket")) for side in ("x", "y"))
    return x.join(y, "bucket").where(f"x_node < y_node AND x_root <> y_root AND {condition}").select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES, with_texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links); with_texts: also n_bytes and crc32 of the text."""
    with passing(docs.sparkSession):
        out = materialize(_components(docs, id_col, text_col, run_bytes), "groups", keep=True)
    return out if with_texts else out.drop("n_bytes", "crc32")


def _components(docs: DataFrame, id_col: str, text_col: str, run_bytes: int) -> DataFrame:
    runs = build_runs(docs, id_col, text_col, run_bytes)
    size = total_bytes(runs)
    hashes, bits = size / BYTES_A_SHINGLE, range_bits(size / BYTES_A_SIGNATURE)
    meta = materialize(runs.mapInArrow(_meta, "run long, ids binary, sizes binary, stands binary, prints binary, texts binary"), "meta", "uncompressed")
    own = meta.mapInArrow(_distinct, "node long, doc long, p1 long, p2 long, n long")
    keys = ["p1", "p2", "n"]
    first = own.groupBy(*keys).agg(F.min(F.struct("doc", "node")).alias("r"))
    classes = materialize(own.join(first, keys).select("node", "r.doc", F.col("r.node").alias("rep")), "classes")
    run_of, place = F.shiftright("node", _NODE_BITS), F.col("node").bitwiseAND((1 << _NODE_BITS) - 1).cast("int")
    chosen = classes.where("node = rep").groupBy(run_of.alias("run")).agg(F.collect_list(place).alias("chosen"))
    answers = multiplicities(runs, _unique, hashes, FREQUENT)
    signed = runs.select("run", "ids", "texts").join(answers, "run", "left").join(chosen, "run").mapInArrow(_sign(hashes, bits), "part int, run long, sig binary, who binary, n binary")
    buckets = materialize(signed.groupBy("part").applyInArrow(_buckets, "bucket long, node long, n long").distinct(), "buckets")
    wanted = buckets.select("node").distinct().groupBy(run_of.alias("run")).agg(F.collect_list(place).alias("wanted"))
    texts = materialize(runs.select("run", "ids", "texts").join(wanted, "run").mapInArrow(_extract, "node long, text binary"), "texts", "uncompressed")

    around = materialize(_centred(buckets), "centred")
    tried = materialize(verify(around.where(DEN * F.least("a_n", "n") >= NUM * F.greatest("a_n", "n")), None, texts), "tried")
    roots = components(tried.where("linked").select("a", "b"))
    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("bucket", "size")
    open_ = materialize(rooted.join(mixed, "bucket"), "open")
    pairs = _pairs(open_.where(F.col("size") <= SMALL), f"{DEN} * least(x_n, y_n) >= {NUM} * greatest(x_n, y_n)")
    large = open_.where(F.col("size") > SMALL).select("bucket", F.col("node").alias("b"), "root")
    members = around.join(large, ["bucket", "b"]).select("a", "b", "a_n", "n", "root").distinct()
    known = tried.select(F.explode(F.array(F.struct("a", "b", "shared", "linked"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "linked"))).alias("t")).select("t.*")
    # sets of too different a size weren't tried: they don't link, and share no more than the smaller one holds
    of_centre = members.join(known, ["a", "b"], "left").select("a", "b", "n", "root", F.coalesce("shared", F.least("a_n", "n")).alias("shared"), F.coalesce("linked", F.lit(False)).alias("linked"))
    members = materialize(of_centre, "members")
    more = materialize(verify(pairs, tried, texts), "tried")
    links = tried.unionByName(more).where("linked").select("a", "b").unionByName(_links_within(members, texts))
    roots = components(links)

    grown = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = grown.groupBy("root").agg(F.min("doc").alias("component"))
    told = grown.join(smallest, "root").groupBy(run_of.alias("run")).agg(F.collect_list(F.struct(place.alias("at"), "component")).alias("told"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = meta.select("run", "ids", "sizes", "stands", "texts").join(told, "run", "left").mapInArrow(_report, "doc_id long, n_shingles long, component_id long, n_bytes long, crc32 long")
    return out.select(F.col("doc_id").cast(kind), "n_shingles", F.col("component_id").cast(kind), "n_bytes", "crc32")


def _report(batches):
    for batch in batches:
        for ids, sizes, stands, told, texts in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "stands", "told", "texts")), strict=True):
            i, stands = expand(ids, "<i8"), expand(stands, "<i8")
            component = i.copy()
            if told:
                of = np.zeros(len(i), np.int64)
                of[[t["at"] for t in told]] = [t["component"] for t in told]
                component = np.where(stands >= 0, of[np.maximum(stands, 0)], i)
            null = i == NO_ID
            crc, size = expand(texts, "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(i, mask=null), pa.array(expand(sizes, "<i8")), pa.array(component, mask=null), pa.array(size), pa.array(crc)], ["doc_id", "n_shingles", "component_id", "n_bytes", "crc32"])
