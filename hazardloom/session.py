"""Session helpers: the shared folder for written state, and plan shaping."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="hazardloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` once as a Parquet table in the shared folder and read it back.

    Used where several jobs reuse one expensive result; it survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fix the point at which costly columns are computed.

    Spark moves a filter on a computed column below it by repeating the expression there,
    so a filter on the end of a long chain would evaluate (and compile) the chain again.
    Filters do not move below a generator, so the columns pass through a one-row one.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*columns))))


def computed_if_read(df: DataFrame, columns: list[str]) -> DataFrame:
    """As :func:`computed_once`, but a column that nothing reads later isn't computed.

    Spark computes all that goes into a generator, and drops a projected column that nobody reads.  Filters do
    not move below a projection with the row's number in it; the number is never negative.
    """
    numbered = F.monotonically_increasing_id() >= 0
    return df.withColumns({c: F.when(numbered, F.col(f"`{c}`")) for c in columns})


# Rows of CPU-bound work that one task takes on.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of a scan over the session's cores, and over more tasks where each would get too many rows.

    For CPU-bound row work on an input with few splits, as compressed files hold millions of rows in one; an input
    with enough splits is left as it is, without a shuffle.  The rows are counted, which a columnar file answers from its
    footer.  The keys together should have no hot value.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks, *keys)
