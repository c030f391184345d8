"""Checks of image annotations.

images: id. categories: id, name. annotations: pos (place in the file), id,
image_id, category_id, bbox (array<double>), keypoints (array<double>), area
and segmentation (the JSON of a mask, as text). A field that is null isn't
there. Results are rows of (key, stat, value): the name of a list, or an
image, and an offending id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = {"bbox": "bbox", "segmentation": "mask", "keypoints": "keypoints", "category_id": "label"}


def _listed(df: DataFrame, key: str | Column, id_: str = "id") -> DataFrame:
    return df.select((F.lit(key) if isinstance(key, str) else key).alias("key"), F.lit(None).cast("string").alias("stat"), F.col(id_).cast("double").alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def annotation_types(annotations: DataFrame) -> DataFrame:
    """The kinds of annotation that any row has."""
    one = annotations.agg(*(F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(kind) for c, kind in TYPES.items()))
    each = F.array(*(F.struct(F.lit(kind).alias("type"), F.col(kind).alias("there")) for kind in TYPES.values()))
    return one.select(F.explode(each).alias("e")).where("e.there").select("e.type")


def completeness(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """img_no_annot: images without any annotation, and annotations (of a
    known image) without a known category other than 0. annot_missing_fields:
    annotations with neither box, mask nor keypoints."""
    bare = images.join(annotations.select(F.col("image_id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    known = categories.where("id <> 0").select(F.col("id").alias("_c"))
    unlabelled = annotations.join(images.select(F.col("id").alias("_i")), F.col("image_id") == F.col("_i"), "left_semi").join(known, F.col("category_id") == F.col("_c"), "left_anti")
    empty = annotations.where("bbox is null and segmentation is null and keypoints is null")
    return _union([_listed(bare, "img_no_annot"), _listed(unlabelled, "img_no_annot"), _listed(empty, "annot_missing_fields")])


def correctness(annotations: DataFrame, categories: DataFrame, valid_names: list[str] | None = None, keypoints: int | None = None, area: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Invalid labels and their annotations, boxes without four numbers,
    keypoints of another number, masks out of bounds or without area, counts,
    size or box. Checks whose limit isn't given are left out."""
    parts = []
    if valid_names:
        bad = categories.where(~F.coalesce(F.col("name").isin(valid_names), F.lit(False)))
        parts += [_listed(bad, "invalid_labels"), _listed(annotations.join(bad.select(F.col("id").alias("_c")), F.col("category_id") == F.col("_c"), "left_semi"), "annots_invalid_label")]
    parts.append(_listed(annotations.where(F.size("bbox") != 4).where("bbox is not null"), "annots_invalid_bbox"))
    if keypoints:
        parts.append(_listed(annotations.where("keypoints is not null").where(F.size("keypoints") != keypoints), "annots_invalid_kp"))
    masks = annotations.where("segmentation is not null")
    low, high = area
    outside = reduce(lambda a, b: a | b, [c for c in ((F.col("area") < low) if low is not None else None, (F.col("area") > high) if high is not None else None) if c is not None], F.lit(False))
    has = lambda field: F.get_json_object("segmentation", f"$.{field}").isNotNull()
    parts += [_listed(masks.where(outside), "annots_mask_oob"), _listed(masks.where("area is null"), "annots_missing_area"), _listed(masks.where(~has("counts")), "annots_missing_counts"), _listed(masks.where(~has("size")), "annots_missing_size"), _listed(masks.where("bbox is null"), "annots_missing_bbox")]
    return _union(parts)


def uniqueness(annotations: DataFrame, types: list[str] | None = None) -> DataFrame:
    """By image, annotations that repeat a kind that an earlier one of the
    same category has."""
    chosen = [c for c in TYPES if (c != "category_id" if types is None else TYPES[c] in types or c in types)]
    kinds = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in chosen)), lambda k: k.isNotNull())
    each = annotations.where("image_id is not null and category_id is not null").select("pos", "id", "image_id", "category_id", F.explode(kinds).alias("kind"))
    order = Window.partitionBy("image_id", "category_id", "kind").orderBy("pos")
    again = each.withColumn("n", F.row_number().over(order)).where("n > 1").select("image_id", "pos", "id").distinct()
    return _listed(again, F.col("image_id").cast("string"))
