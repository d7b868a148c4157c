"""Top-k per group and vector neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries and vectors of a block, about: what one task holds as matrices. Queries whose scores stand side by side.
QUERY_BLOCK, VECTOR_BLOCK, SIDE_BY_SIDE = 2048, 4096, 256


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without a Python object for each number."""
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks)])
    return flat.reshape(len(vectors), -1)


def best_of_block(k: int):
    """For applyInArrow: of a block (ask, vec_id, embedding), the k best vectors of each query by cosine."""
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy(zero_copy_only=False)
        ids = group.column("vec_id").to_numpy()
        x = matrix(group.column("embedding"))
        x /= np.where((norm := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1.0, norm)
        q, v, q_ids, v_ids = x[asks], x[~asks], ids[asks], ids[~asks]
        rows = []
        for at in range(0, len(q), SIDE_BY_SIDE):
            for i, s in enumerate(np.round(q[at : at + SIDE_BY_SIDE] @ v.T, 6), at):
                s, who = s[v_ids != q_ids[i]], v_ids[v_ids != q_ids[i]]
                top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                rows += [(q_ids[i], who[j], s[j]) for j in top[np.lexsort((who[top], -s[top]))[:k]]]
        q_out, v_out, s_out = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q_out, pa.int64()), "vec_id": pa.array(v_out, pa.int64()), "score": pa.array(s_out, pa.float64())})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the k most similar vectors by cosine.

    Queries and vectors are dealt into blocks and every block of the one meets every block of the other: exact
    cosines of all pairs, k of each pair of blocks kept. Only ids and scores are ranked.
    """
    n, m = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_BLOCK))
    each = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    dealt = lambda size: F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int")
    some = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asks = some(queries).select(F.lit(True).alias("ask"), dealt(n).alias("i"), each(m).alias("j"), "vec_id", "embedding")
    held = some(vectors).select(F.lit(False).alias("ask"), each(n).alias("i"), dealt(m).alias("j"), "vec_id", "embedding")
    scored = asks.unionByName(held).groupBy("i", "j").applyInArrow(best_of_block(k), "query_id long, vec_id long, score double")
    return top_per_group(scored, ["query_id"], [F.desc("score"), "vec_id"], k)
