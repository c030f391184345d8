"""The driver's tables in the shapes that metrics take, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: common table expressions, by the frame they stand for
SQL = {
    "ref": "ref as (select vec_id // 2 as id, embedding::double[] as v from embeddings where vec_id % 2 = 0)",
    "tgt": "tgt as (select vec_id // 2 as id, embedding::double[] as v from embeddings where vec_id % 2 = 1)",
    "signals": """lim as (select min(epoch_us(ts)) as a, max(epoch_us(ts)) as b from events),
      sums as (select user_id, (epoch_us(ts) - a) * 64 // (b - a + 1) as t, sum(value) as v from events, lim group by 1, 2),
      grid as (select user_id, t from (select distinct user_id from events), unnest(range(64)) as g(t)),
      signals as (select user_id as signal, grid.t as t, coalesce(v, 0.0) as v from grid left join sums using (user_id, t))""",
    "pixels": """k as (select vec_id, unnest(range(64)) as i, embedding::double[] as e from embeddings),
      lev as (select vec_id as image, i // 8 as y, i % 8 as x, floor(least(greatest((e[i + 1] + 1) / 2, 0), 1) * 255)::bigint as r, floor(least(greatest((e[64 - i] + 1) / 2, 0), 1) * 255)::bigint as g,
        floor(least(greatest((e[(i * 7) % 64 + 1] + 1) / 2, 0), 1) * 255)::bigint as b from k),
      pixels as (select *, (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 as l from lev)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings of even ids as reference, of odd ids as target."""
    e = table(spark, sf_dir, "embeddings")
    side = lambda k: e.where(F.col("vec_id") % 2 == k).select(F.expr("vec_id div 2").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return side(0), side(1)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a signal: sums of values in 64 equal spans of time."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    lim = F.broadcast(e.agg(F.min("us").alias("a"), F.max("us").alias("b")))
    sums = e.crossJoin(lim).groupBy("user_id", F.expr("(us - a) * 64 div (b - a + 1)").alias("t")).agg(F.sum("value").alias("v"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("t"))
    return grid.join(sums, ["user_id", "t"], "left").select(F.col("user_id").alias("signal"), F.lit(0).alias("channel"), "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals of even and odd ids."""
    return df.where(F.col("signal") % 2 == 0), df.where(F.col("signal") % 2 == 1)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a picture of 8 x 8 pixels, its numbers from -1 to 1 as levels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    level = lambda at: F.floor(F.least(F.greatest((F.expr(f"e[{at}]") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255)
    return e.select(F.col("vec_id").alias("image"), F.expr("i div 8").alias("y"), (F.col("i") % 8).alias("x"), level("i").alias("r"), level("63 - i").alias("g"), level("(i * 7) % 64").alias("b"))


def annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as images, orders as their annotations and regions as
    categories (of which 0 is no label and 5 is unknown)."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_totalprice").cast("double")
    annotations = o.select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("category_id"),
        F.when(F.col("o_orderstatus") == "F", F.array(number, number, number, number)).when(F.col("o_orderstatus") == "O", F.array(number, number, number)).alias("bbox"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(number, number)).alias("keypoints"), F.when(F.col("o_orderkey") % 7 != 0, number).alias("area"),
        F.when(F.col("o_orderkey") % 2 == 0, F.when(F.col("o_orderkey") % 4 == 0, '{"counts": [1], "size": [2, 2]}').otherwise('{"size": [2, 2]}')).alias("segmentation"),
    )
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return images, annotations, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
