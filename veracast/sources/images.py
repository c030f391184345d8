"""Pictures, lists of pictures and annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = "*.{png,jpg,jpeg,bmp}"
ANNOTATIONS = (
    "images array<struct<id: long, file_name: string, height: int, width: int>>, categories array<struct<id: long, name: string>>, "
    "annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>, keypoints: array<double>, area: double, segmentation: string>>"
)


def read_images(spark: SparkSession, path: str | list[str], listed: DataFrame | None = None) -> DataFrame:
    """(image, height, width, data): the file's stem and three bytes a pixel,
    red first. Files that can't be decoded are left out, as are those whose path isn't in ``listed``, if it is given."""
    df = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES).load(path)
    if listed is not None:
        df = df.join(listed, _plain(F.col("image.origin")) == F.col("_listed"), "left_semi")
    stem = F.regexp_extract(F.col("image.origin"), r"([^/]+?)(?:\.[^./]*)?$", 1)

    def red_first(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data = []
            for x, h, w, n in zip(*(batch.column(c).to_pylist() for c in ("data", "height", "width", "n"))):
                a = np.frombuffer(x, np.uint8).reshape(h, w, n)
                data.append(np.ascontiguousarray(np.repeat(a, 3, axis=2) if n == 1 else a[..., 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("height"), batch.column("width"), pa.array(data, pa.binary())], ["image", "height", "width", "data"])

    flat = df.select(stem.alias("image"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    return flat.mapInArrow(red_first, "image string, height int, width int, data binary")


def listed_images(spark: SparkSession, path: str, column: str = "image") -> DataFrame:
    """The pictures that a file of JSON lines names in ``column``. Their folders
    are read, and pictures that aren't in the list left out by a join, so only the names of
    folders reach the driver."""
    listed = spark.read.json(path).select(_plain(F.col(column)).alias("_listed")).where("_listed is not null").distinct()
    folders = [r[0] for r in listed.select(F.regexp_extract("_listed", r"^(.*)/[^/]*$", 1).alias("f")).distinct().collect()]
    if not folders:
        folders = [path.rpartition("/")[0] or "."]
    return read_images(spark, folders, listed)


def _plain(path: Column) -> Column:
    """A path without the scheme of a local file."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO file."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.from_json("value", ANNOTATIONS).alias("d")).select("d.*")
    each = lambda c: whole.select(F.explode(c).alias("e")).select("e.*")
    annotations = whole.select(F.posexplode("annotations").alias("pos", "e")).select("pos", "e.*")
    return each("images"), annotations, each("categories")
