"""Results as rows: metric values in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "key string, stat string, value double"


def rows(df: DataFrame, values: list[tuple[str | None, str | None, Column]]) -> DataFrame:
    """(key, stat, value) rows of each row of df."""
    each = [F.struct(F.lit(k).cast("string").alias("key"), F.lit(s).cast("string").alias("stat"), v.cast("double").alias("value")) for k, s, v in values]
    return df.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def with_stats(values: DataFrame, digits: int = 6, sample: bool = False) -> DataFrame:
    """values (key, value) and their mean and standard deviation as rows."""
    spread = F.stddev_samp if sample else F.stddev_pop
    stats = values.agg(F.avg("value").alias("mean"), spread("value").alias("std"))
    own = values.select("key", F.lit(None).cast("string").alias("stat"), F.round("value", digits).alias("value"))
    return own.unionByName(rows(stats, [(None, "mean", F.round("mean", digits)), (None, "std", F.round("std", digits))]))


def present(name: str) -> Column:
    """Neither null nor NaN, for a numeric column."""
    return F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
