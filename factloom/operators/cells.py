"""Nearest unit vectors by cells: an index that is written once, and searches that open only cells which may hold a result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.lineage import cut
from factloom.operators.topk import QUERY_BLOCK, VECTOR_BLOCK, best_of_block, top_per_group

#: Most cells of an index: pivots and their statistics travel to the tasks, so their number is bounded.
CELLS = 1024
#: Scores have six digits; a cell must be able to better the threshold by more than what rounding hides.
SLACK = 2e-6


@dataclass(frozen=True)
class Cells:
    """vectors: cell, distance to its pivot, vec_id, embedding; pivots: unit vectors, one a cell."""

    vectors: DataFrame
    pivots: np.ndarray


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return x / np.where((norm := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1.0, norm)


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows and pivots; zero vectors, which have no direction, keep their length of 0 in the formula."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, squares))


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of rows with an id and a vector of finite numbers; others take no part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine)


def build(vectors: DataFrame) -> Cells:
    """Vectors in cells around pivots: half as many as the root of their number, ``CELLS`` at most, different ones among those whose ids hash lowest."""
    rows = cut(finite(vectors))
    most = min(CELLS, max(1, round(rows.count() ** 0.5 / 2)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * most).select("embedding").toArrow()
    pivots = _units(chosen.column("embedding")) if chosen.num_rows else np.zeros((0, 1))
    pivots = pivots[np.sort(np.unique(pivots, axis=0, return_index=True)[1])[:most]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = _apart(_units(b.column("embedding")), pivots)
                cell = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell]), b.column("vec_id"), b.column("embedding")], ["cell", "apart", "vec_id", "embedding"])

    return Cells(cut(rows.mapInArrow(place, f"cell int, apart double, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}")), pivots)


def kept(index: Cells, ids: DataFrame) -> Cells:
    """The index of those vectors only whose vec_id is among ``ids``: filtered before any cell is opened, with the radii that are left."""
    return Cells(cut(index.vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")), index.pivots)


def opened(index: Cells, queries: DataFrame, k: int, best: DataFrame | None = None) -> DataFrame:
    """query_id, cell, embedding: the cells that queries open, by at most ``CELLS`` statistics of cells.

    Without ``best``: the nearest cells that together hold more than k vectors. With it (vec_id, score of the k-th, null if
    there are fewer): all others that, by their least and greatest distance from the pivot, may hold a better vector.
    """
    stats = index.vectors.groupBy("cell").agg(F.count("*").alias("n"), F.min("apart").alias("lo"), F.max("apart").alias("hi"), F.max(F.forall("embedding", lambda v: v == 0)).alias("zero")).orderBy("cell").toArrow()
    cell, n, lo, hi, zero = (stats.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "lo", "hi", "zero"))
    pivots, second = index.pivots[cell] if len(cell) else index.pivots, best is not None

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(cell):
                continue
            x = _units(b.column("embedding"))
            apart = _apart(x, pivots)
            order = np.argsort(apart, axis=1, kind="stable")
            sums = np.take_along_axis(np.broadcast_to(n, apart.shape), order, 1).cumsum(1)
            first = np.zeros(apart.shape, bool)
            np.put_along_axis(first, order, np.concatenate([np.zeros((len(x), 1)), sums[:, :-1]], 1) <= k, 1)
            if second:
                score = b.column("score").to_numpy(zero_copy_only=False)
                size = (x * x).sum(1)
                reach = np.sqrt(np.maximum(0.0, size + 1 - 2 * (np.nan_to_num(score, nan=-2.0) - SLACK)))
                least = np.maximum(np.maximum(0.0, apart - hi), lo - apart)
                may = (least <= reach[:, None] + 1e-9) | (zero[None, :] & (score < SLACK)[:, None]) | (size < 0.5)[:, None] | np.isnan(score)[:, None]
                first = may & ~first
            q, c = np.nonzero(first)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(q)), pa.array(cell[c], pa.int32()), b.column("embedding").take(pa.array(q))], ["query_id", "cell", "embedding"])

    asks = finite(queries)
    if second:
        asks = asks.join(best, "vec_id", "left")
    return cut(asks.mapInArrow(choose, f"query_id long, cell int, embedding {asks.schema['embedding'].dataType.simpleString()}"))


def _solved(index: Cells, asks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of an opened cell. Cells and the queries that open them are dealt into blocks."""
    held = index.vectors.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / VECTOR_BLOCK)).cast("int").alias("m"))
    size = asks.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("int").alias("n")).join(held, "cell")
    size = F.broadcast(size)  # a row a cell: at most CELLS
    each = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    dealt = lambda c, most: F.pmod(F.xxhash64(c), most).cast("int")
    n, m = F.col("n"), F.col("m")
    q = asks.join(size, "cell").select("cell", F.lit(True).alias("ask"), dealt("query_id", n).alias("i"), each(m).alias("j"), F.col("query_id").alias("vec_id"), "embedding")
    v = index.vectors.join(size, "cell").select("cell", F.lit(False).alias("ask"), each(n).alias("i"), dealt("vec_id", m).alias("j"), "vec_id", "embedding")
    return q.unionByName(v).groupBy("cell", "i", "j").applyInArrow(best_of_block(k), "query_id long, vec_id long, score double")


def search(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the k most similar vectors by cosine, exactly; ties to the smaller id, no vector is its own.

    A query's nearest cells are solved first; the k-th score then bounds which others are opened. Vectors travel once
    for each block of queries of their cell, and not at all where no query opens it. A zero vector scores 0 with all.
    Fewer than k vectors: all. Repeated ids of vectors are told as often as they occur.
    """
    first = cut(_solved(index, opened(index, queries, k), k))
    few = top_per_group(first, ["query_id"], [F.desc("score"), "vec_id"], k)
    bound = few.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("score"))
    rest = _solved(index, opened(index, queries, k, bound), k)
    return top_per_group(first.unionByName(rest), ["query_id"], [F.desc("score"), "vec_id"], k)
