"""Resumable training runs: folders of finished parts, found again by what they were made from.

A run's folder is named by a digest of its data and settings, so that other queries, sessions and
processes that ask for the same run read its parts, and one that was cut off goes on after
the last finished part.  A part is a Parquet table; it counts once its success mark is there.
"""

from __future__ import annotations

import getpass
import hashlib
import json
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.session import shared_dir

# Changes when parts of an older layout can't be read any more.
LAYOUT = 1


def runs_folder(spark: SparkSession) -> str:
    """Where runs are kept: ``hazardloom.runs.dir``, or below the shared folder.

    A local session without either setting uses one folder per user, so that its runs outlive it.
    """
    configured = spark.conf.get("hazardloom.runs.dir", None)
    if configured:
        return configured
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared or not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{shared or shared_dir(spark)}/runs"
    return f"{tempfile.gettempdir()}/hazardloom-runs-{getpass.getuser()}"


def table_digest(df: DataFrame, columns: list[str]) -> str:
    """Digest of a table's rows in any order: their number and two sums of row hashes."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    types = [df.schema[c].dataType.simpleString() for c in columns]
    return hashlib.sha256(json.dumps([*map(str, found), columns, types]).encode()).hexdigest()


def settings_digest(*parts) -> str:
    return hashlib.sha256(json.dumps([LAYOUT, *parts], sort_keys=True, default=str).encode()).hexdigest()[:32]


class RunStore:
    """The parts of one run."""

    def __init__(self, spark: SparkSession, name: str, digest: str, root: str | None = None):
        self.spark, self.folder = spark, f"{root or runs_folder(spark)}/{name}-{digest}"

    def inside(self, name: str, digest: str) -> RunStore:
        """A run that builds on this one."""
        return RunStore(self.spark, name, digest, self.folder)

    def path(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def has(self, part: str) -> bool:
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path(part)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(self.path(part))

    def part(self, part: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The finished part, made first if it is missing; leftovers of one that was cut off are replaced."""
        if not self.has(part):
            made = make()
            made.write.mode("overwrite").parquet(self.path(part))
            return self.spark.read.schema(made.schema).parquet(self.path(part))
        return self.read(part)
