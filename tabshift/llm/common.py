"""What the operators of this subpackage share: the shared folder, staged tables, shard counts and order buckets.

An empty table has no cut points and one bucket; rows with equal keys share a bucket; null keys have none. The columns that are
added have the names that are asked for, and the caller's tables have been reduced to columns of its own before.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHARDS, MAX_BUCKETS = 20_000, 200_000
MAX_SAMPLE = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), a fresh local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="tabshift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabshift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    Once it is written, the shuffle files that led to it are of no more use, and Spark is told to remove them.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files under ``df`` as the planner sees them, without a job; None if unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def shard_count(df: DataFrame, bytes_each: int, most: int = MAX_SHARDS) -> int:
    """Shards so that each has about ``bytes_each`` of input, never fewer than the shuffle partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(most, max(least, math.ceil((input_bytes(df) or 0) / bytes_each))))


def order_cuts(df: DataFrame, key: str, n: int) -> list[float]:
    """At most n - 1 rising cut points that part the rows into about equal shares by ``key``.

    They are quantiles of a sample of about 64 keys a share, MAX_SAMPLE in all at most (small tables are taken whole). Cuts only
    balance work: whatever they are, every row keeps its place in the order.
    """
    keys = df.select(F.col(key).cast("double").alias("k")).filter("k is not null")
    want = min(64 * n, MAX_SAMPLE)
    total = keys.count()
    if total > 2 * want:
        keys = keys.sample(fraction=want / total, seed=7)
    found = np.sort(keys.toArrow()["k"].to_numpy())
    if not len(found):
        return []
    return sorted({float(found[len(found) * i // n]) for i in range(1, n)})


def with_order_bucket(df: DataFrame, key: str, cuts: list[float], name: str = "bucket") -> DataFrame:
    """Add an int bucket that never falls as ``key`` grows: the number of ``order_cuts`` at or below it; null for null keys."""
    if not cuts:
        return df.withColumn(name, F.when(F.col(key).isNotNull(), 0))
    splits = [-math.inf, *cuts, math.inf]
    out = Bucketizer(splits=splits, inputCol=f"_{name}", outputCol=f"_{name}_out", handleInvalid="keep").transform(df.withColumn(f"_{name}", F.col(key).cast("double")))
    return out.withColumn(name, F.when(F.col(key).isNotNull(), F.col(f"_{name}_out").cast("int"))).drop(f"_{name}", f"_{name}_out")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, in upper or lower case."""
    taken, before = {c.lower() for c in df.columns}, "_"
    while any(c.startswith(before) for c in taken):
        before += "_"
    return [before + n for n in names]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
