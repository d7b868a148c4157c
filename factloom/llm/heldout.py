"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sampled(share: float, id_col: str = "doc_id") -> Column:
    """A fixed pseudo-random share of ids."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000 + 0.5)


def share_for(df: DataFrame, rows: int) -> float:
    """The share of ``df`` that gives about ``rows`` rows."""
    n = df.count()
    return min(1.0, rows / n) if n else 1.0
