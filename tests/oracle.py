"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import glob
import os

import duckdb


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return rows(c.sql(sql).df())


def rows(df) -> tuple[list[str], list]:
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
