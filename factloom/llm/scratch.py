"""Tables that cut a lineage, kept where driver and executors both reach them."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where driver and executors are one process and none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    own = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_written", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables that are written meanwhile go at the end, but for those written with ``keep``."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's own setting: shuffle files go as soon as the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. keep: the table outlasts an enclosing ``passing``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None and not keep:
        paths.append(path)
    if spark.conf.get(CLEANUP, None) != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
