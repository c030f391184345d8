"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rows:
    """A frame whose columns are renamed by position, so that neither extra
    columns nor names that differ only in case can clash with an operator's own.

    ``rows[name]`` is the column of exactly that name; ``rows.give(df)``
    puts the original columns back, in order and under their names.
    """

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.own = [f"_in{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.own)

    def __getitem__(self, name: str) -> Column:
        return F.col(self.own[self.names.index(name)])

    def give(self, df: DataFrame) -> DataFrame:
        return df.select(*self.own).toDF(*self.names)


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only in a local session (as in
    tests) may it be unset; it has a temporary folder then, which goes with
    the process. A cluster's executors can't read one of the driver's."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        at = context.getConf().get("spark.checkpoint.dir")
        if not at:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        context.setCheckpointDir(at)
    return context._jsc.sc().getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and cut its lineage."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the checkpoint folder, for tables."""
    return f"{_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int) -> DataFrame:
    """Mark a checkpointed df for broadcast if it has at most ``most`` rows;
    beyond that the planner's shuffled joins are left to do the work."""
    return F.broadcast(df) if df.count() <= most else df
