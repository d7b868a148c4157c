"""Written tables that cut a lineage, where driver and executors both reach them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Spark's own setting: shuffle files go as soon as the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that spark.checkpoint.dir names, and read back; a lost executor replays no step before it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="factloom-")  # driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/factloom-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, None) != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` for joins that sort and merge: written tables are far smaller in files than as rows, so by their files' sizes Spark would send millions of rows through the driver."""
    return df.hint("merge")
