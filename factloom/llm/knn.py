"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots, a sample of the vectors that grows with the square root of their number, part the space into Voronoi
cells. A cell's summary is its count and its radius. Every query first meets the rows of its own cell, which
bounds its k-th score from below; by Cauchy-Schwarz no row x of a cell with pivot p can score more than
<q,p> + |q| |x-p|, so the query is replicated only to cells whose radius allows more than that bound, and there
meets only rows far enough from the pivot. Queries travel, not rows, as they are few against the rows.
Cells are split into blocks of bounded size by a hash of the row, so a vector that fills a third of the table is
solved by many tasks; the blocks' answers, k of each, are merged.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids;
shorter vectors are extended by zeros; components so large that a score could leave 64 bits are an error;
equal scores go to the smaller id; of repeated ids every row counts as a candidate, but none with the query's own id,
and one of them asks; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.scratch import materialize

#: Rows of a block, about; queries that meet a block at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 2048


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: array<long> of floor(256 x); only complete, finite vectors."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(256 * c).cast("long")).alias("v"))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column, as float64; whole numbers below 2**53 stay exact."""
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(col)))])
    if len(flat) == dims * len(col):
        return flat.reshape(len(col), dims).astype(np.float64)
    out = np.zeros((len(col), dims))
    for i in range(len(col)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _assign(pivots: np.ndarray):
    half = (pivots**2).sum(1) / 2

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), pivots.shape[1])
            cell = (x @ pivots.T - half).argmax(1)
            away = np.linalg.norm(x - pivots[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


def _solve(k: int, dims: int):
    """Rows: of one block, side 0 the data and side 1 the queries. Best k of every query among the block's rows."""

    def run(_, group):
        side = group.column("side").to_numpy()
        data, ask = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
        ids, away = data.column("id").to_numpy(), data.column("away").to_numpy()
        order = np.argsort(-away, kind="stable")
        ids, away = ids[order], away[order]
        x = _matrix(data.column("v").combine_chunks(), dims)[order]
        q_ids, need = ask.column("id").to_numpy(), ask.column("away").to_numpy()
        out_q, out_x, out_s = [], [], []
        by_need = np.argsort(-need, kind="stable")
        q = _matrix(ask.column("v").combine_chunks(), dims)
        for part in np.array_split(by_need, max(1, -(-len(by_need) // QUERY_ROWS))):
            if not len(part):
                continue
            reach = int(np.searchsorted(-away, -need[part].min(), "right"))  # rows far enough from the pivot for any query here
            near = x[:reach]
            scores = _products(q[part], near)
            for i, row in zip(part.tolist(), scores, strict=True):
                own = ids[:reach] != q_ids[i]
                s, who = row[own], ids[:reach][own]
                if len(s) > k:
                    top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    s, who = s[top], who[top]
                best = np.lexsort((who, -s))[:k]
                out_q += [q_ids[i]] * len(best)
                out_x += who[best].tolist()
                out_s += s[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_x, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by exact integer inner product. is_query: tells queries by the id column. pivots: a quarter of the square root of the row count, if not given."""
    sound = quantized(vectors, id_col, vector_col)
    n, dims, most = sound.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    kinds = "query_id long, vec_id long, score long"
    if not n:
        return sound.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if (most or 0.0) >= 2**53 or (most or 0.0) ** 2 * dims >= 2**63:
        raise ValueError("components too large: scores could leave 64 bits")
    want = pivots or max(1, int(n**0.5 / 4))
    by_hash = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = sound.where(by_hash < int(min(1.0, 4 * want / n + 64 / n) * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(want).select("v").toArrow()  # bounded by ``want``
    if not len(chosen):  # few distinct ids, all hashed high
        chosen = sound.limit(want).select("v").toArrow()
    centre = np.unique(_matrix(chosen.column("v").combine_chunks(), dims), axis=0)
    placed = sound.withColumn("mark", F.monotonically_increasing_id()).mapInArrow(_assign(centre), "id long, v array<long>, mark long, cell int, away double")
    placed = materialize(placed, "cells")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # one row per pivot
    count = np.zeros(len(centre), np.int64)
    radius = np.full(len(centre), -1.0)
    for r in cells:
        count[r.cell], radius[r.cell] = -(-r.n // BLOCK_ROWS), r.radius
    blocks = F.get(F.lit(count.tolist()), F.col("cell"))
    data = placed.select(F.lit(0).alias("side"), "cell", F.pmod(F.xxhash64("mark"), blocks).cast("int").alias("block"), "id", "v", "away")
    asked = placed.where(is_query(F.col("id"))).select("id", "v", "cell").dropDuplicates(["id"])
    solve = _solve(k, dims)

    def met(queries: DataFrame) -> DataFrame:
        """queries: cell, id, v, away (the least distance from the pivot that matters)."""
        spread = queries.select(F.lit(1).alias("side"), "cell", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"), "id", "v", "away")
        return data.unionByName(spread).groupBy("cell", "block").applyInArrow(solve, kinds)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    own = materialize(merged(met(asked.withColumn("away", F.lit(0.0)))), "own")
    bounds = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    sent = asked.join(bounds, "id", "left").mapInArrow(_send(centre, radius), "id long, v array<long>, cell int, away double")
    return merged(own.select("query_id", "vec_id", "score").unionByName(met(sent)))


def _send(pivots: np.ndarray, radius: np.ndarray):
    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("v"), pivots.shape[1])
            bound = np.array([-np.inf if b is None else b for b in batch.column("bound").to_pylist()])
            norm = np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
            least = (bound[:, None] - q @ pivots.T) / norm * (1 - 1e-9) - 1e-6  # rows nearer to the pivot can't reach the bound
            go = (least <= radius[None]) & (radius[None] >= 0)
            go[np.arange(len(q)), batch.column("cell").to_numpy()] = False  # met already
            row, cell = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(np.maximum(0, least[row, cell]))], ["id", "v", "cell", "away"])

    return run
