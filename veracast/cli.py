"""spark-submit entry point: metrics of a table, of signals or of pictures, as a JSON report."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracast.operators import annotations as annotation_checks
from veracast.operators import extract, features, images, prepare, synthesis, tabular, timeseries
from veracast.plans import registry
from veracast.sources import images as image_files
from veracast.sources.signals import read_signals
from veracast.sources.tables import read_table

Metrics = dict[str, Callable[[], DataFrame]]
#: signals that a synthetic set must have
LEAST_SIGNALS = 5


def _kinds(df: DataFrame) -> tuple[list[str], list[str], str | None]:
    """(columns of numbers, of text, one of vectors) of a table."""
    number = lambda t: t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal")
    vector = next((c for c, t in df.dtypes if t in ("array<float>", "array<double>")), None)
    return [c for c, t in df.dtypes if number(t)], [c for c, t in df.dtypes if t in ("string", "boolean")], vector


def _numbered(df: DataFrame) -> DataFrame:
    """A number for each row."""
    return df.withColumn("_id", F.monotonically_increasing_id())


def feature_metrics(context: features.Context) -> Metrics:
    """The metrics of (id, v) vectors of both sides; what they share is worked out once."""
    out: Metrics = {}
    for name, own in (("ImprovedPrecision", "precision"), ("ImprovedRecall", "recall"), ("Density", "density"), ("Coverage", "coverage"), ("Authenticity", "authenticity")):
        out[name] = lambda own=own: context.metric(own).unionByName(context.metric(own, instances=True))
    r, t = context.reference, context.target
    return out | {
        "FrechetDistance": lambda: features.frechet(r, t, context), "PrecisionRecallDistribution": lambda: features.prd(r, t), "GIQA": lambda: features.giqa(r, t), "MMD": lambda: features.mmd(r, t),
        "CosineSimilarity": lambda: features.cosine(r, t), "WassersteinDistance": lambda: features.wasserstein(r, t), "GeometryScore": lambda: features.geometry_score(r, t), "MultiScaleIntrinsicDistance": lambda: features.intrinsic_distance(r, t),
    }


def tabular_layer(target: DataFrame, reference: DataFrame | None) -> tuple[DataFrame, DataFrame | None, list[str], dict[str, str]]:
    """(target, reference, columns, tags): text as codes, fitted on the
    reference if there is one; values that stand for a missing one as null."""
    numbers, text, _ = _kinds(target)
    columns = [c for c in target.columns if c in numbers + text]
    if not columns:
        raise registry.BadInput("the table has no column of numbers or text")
    base = target if reference is None else reference
    if missing := [c for c in columns if c not in base.columns]:
        raise registry.BadInput(f"the reference lacks {', '.join(missing)}")
    tidy = lambda df: prepare.without_sentinels(df.select(*(F.col(c).cast("string").alias(c) if c in text else c for c in columns)), values=("NaN", "nan"))
    tags = {r["column"]: r["tag"] for r in prepare.profile(tidy(base), columns).collect()}  # a row a column
    encoder = prepare.Encoder.fit(tidy(base), text)
    return encoder.encode(tidy(target)), None if reference is None else encoder.encode(tidy(reference)), columns, tags


def computable(modality: str, domain: str, target: DataFrame, reference: DataFrame | None, extractor: str | None = None) -> Metrics:
    """The metrics that can be computed of these frames, by name."""
    if domain == "synthesis_val" and reference is None:
        raise registry.BadInput("a reference is needed")
    if modality == "tabular":
        vector = _kinds(target)[2]
        if vector and domain == "synthesis_val":  # a table of embeddings
            side = lambda df: _numbered(df.where(F.col(vector).isNotNull())).select(F.col("_id").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            return feature_metrics(features.Context(side(reference), side(target)))
        own, other, c, tags = tabular_layer(target, reference)
        discrete, continuous = [x for x in c if tags[x] == "discrete"], [x for x in c if tags[x] != "discrete"]
        if domain == "input_val":
            uniform = lambda: _union([tabular.uniformity_discrete(own, x) for x in discrete] + [tabular.uniformity_continuous(own, x) for x in continuous]).where("stat is null")
            return {
                "MissingScore": lambda: tabular.missing(own, c), "UniquenessScore": lambda: tabular.uniqueness(own, c), "UniformityScore": uniform, "DimCurseScore": lambda: tabular.dim_curse(own, c), "OutlierScore": lambda: tabular.outliers(own, c),
                "CorrelationScore": lambda: tabular.correlation(own, c), "VIFactorScore": lambda: tabular.vif(own, c), "KAnonymityScore": lambda: tabular.k_anonymity(target, target.columns),
            }
        prepared = prepare.Prepared.fit(other, c)
        real, syn = (prepared.transform(_numbered(df), keep=("_id",)) for df in (other, own))
        vectors = lambda df: df.select(F.col("_id").alias("id"), F.array(*c).alias("v"))
        return feature_metrics(features.Context(vectors(real), vectors(syn))) | {
            "StatisticalSimScore": lambda: synthesis.statistical_similarity(other, own, discrete, continuous), "StatisticalDivergenceScore": lambda: synthesis.divergence(other, own, c),
            "CoherenceScore": lambda: synthesis.coherence(other, own, c), "DCRPrivacy": lambda: synthesis.privacy(real, syn, "_id", c, "dcr"), "NNDRPrivacy": lambda: synthesis.privacy(real, syn, "_id", c, "nndr"),
        }
    if modality == "time_series":
        if domain == "input_val":
            return {"Uniqueness": lambda: timeseries.uniqueness(target), "SNR": lambda: timeseries.snr(target)}
        if (n := target.select("signal").distinct().count()) < LEAST_SIGNALS:
            raise registry.BadInput(f"{n} signals are too few; {LEAST_SIGNALS} are the least")
        return {
            "DTW": lambda: timeseries.dtw(reference, target), "CrossCorrelation": lambda: timeseries.cross_correlation(reference, target), "SpectralCoherence": lambda: timeseries.spectral_coherence(reference, target),
            "SpectralWassersteinDistance": lambda: timeseries.spectral_wasserstein(reference, target),
        }
    if modality == "image":
        if domain != "input_val":
            if extractor is None:
                raise registry.NotImplemented_("synthetic pictures are compared by their vectors: name a function that extracts them")
            side = lambda df: extract.extracted(df, extract.named(extractor)).select("id", "v")
            return feature_metrics(features.Context(side(reference), side(target)))
        pixels = images.pixels_of(target)
        out: Metrics = {"Brightness": lambda: images.brightness(pixels), "Colorfulness": lambda: images.colourfulness(pixels), "ExposureBrightness": lambda: images.exposure(pixels), "EME": lambda: images.eme(pixels)}
        for name, of in (("Tenengrad", images.tenengrad), ("TenengradRelative", images.tenengrad_relative), ("DOM", images.dom)):
            out[name] = lambda name=name, of=of: images.of_pictures(target, {name: of})
        if reference is not None:
            out = {"PSNR": lambda: images.psnr(images.pixels_of(reference), pixels), "SSIM": lambda: images.of_pairs(reference, target, {"SSIM": images.ssim}), "MSSSIM": lambda: images.of_pairs(reference, target, {"MSSSIM": images.ms_ssim})}
        return out
    raise registry.NotFound(f"no modality {modality}")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def paired(reference: DataFrame, target: DataFrame, repeat: bool) -> DataFrame:
    """The reference pictures under the names of the targets that they are
    compared with: as many as targets, or repeated in turn."""
    n, m = reference.count(), target.count()
    if not n or n != m and not repeat:
        raise registry.BadInput(f"{n} reference pictures for {m} targets")
    if not repeat:
        return reference
    place = lambda df, *c: features.positions(df.select(F.xxhash64("image").alias("id"), *c))
    names = place(target, F.col("image").alias("name")).select("name", (F.col("pos") % n).alias("turn"))
    return place(reference, "height", "width", "data").join(names, F.col("pos") == F.col("turn")).select(F.col("name").alias("image"), "height", "width", "data")


def load(spark: SparkSession, modality: str, path: str, column: str = "image") -> DataFrame:
    """A folder or file; of pictures also a file of JSON lines that names them in ``column``."""
    if modality == "tabular":
        return read_table(spark, path)
    if modality == "time_series":
        return read_signals(spark, path)
    if modality == "image":
        return image_files.listed_images(spark, path, column) if path.endswith(".jsonl") else image_files.read_images(spark, path)
    raise registry.NotFound(f"no modality {modality}")


def chosen(spark: SparkSession, found: Metrics, modality: str, domain: str, reference_type: str | None, levels: list[str] | None, categories: list[str] | None, groups: list[str] | None, names: list[str] | None) -> Metrics:
    """Those of the computable metrics that the registry has under these attributes, or that are named."""
    known = registry.registry(spark)
    if names:
        picked = registry.select_named(known, names, modality, domain, reference_type)
    else:
        parts = [registry.select(known, modality, domain, reference_type, level, category, groups) for level in levels or [None] for category in categories or [None]]
        picked = _union(parts)
    wanted = {r[0] for r in picked.select("name").distinct().collect()}  # names
    if names and (lacking := sorted(wanted - set(found))):
        raise registry.NotImplemented_(f"{', '.join(lacking)} can't be computed of these data")
    if not wanted:
        raise registry.NotFound("no metric of these attributes")
    return {n: of for n, of in found.items() if n in wanted}


def audit(spark: SparkSession, modality: str, domain: str, target: str, reference: str | None = None, metrics: list[str] | None = None, annotation_file: str | None = None, reference_type: str | None = None, levels: list[str] | None = None, categories: list[str] | None = None, groups: list[str] | None = None, extractor: str | None = None, column: str = "image", repeat_reference: bool = False) -> dict:
    """The report of the chosen metrics (all that can be computed by default)."""
    frame = load(spark, modality, target, column)
    other = load(spark, modality, reference, column) if reference else None
    if modality == "image" and domain == "input_val" and other is not None:
        other = paired(other, frame, repeat_reference)
    found = chosen(spark, computable(modality, domain, frame, other, extractor), modality, domain, reference_type, levels, categories, groups, metrics)
    errors: dict[str, list[str]] = {}
    results = registry.evaluate(found, errors=errors)
    if levels:
        results = results.where(F.col("level").isin(levels))
    if annotation_file:
        pictures, notes, kinds = image_files.read_annotations(spark, annotation_file)
        results = results.unionByName(registry.evaluate({"DatasetCompletness": lambda: annotation_checks.completeness(pictures, notes, kinds), "AnnotationCorrectness": lambda: annotation_checks.correctness(notes, kinds), "AnnotationUniqueness": lambda: annotation_checks.uniqueness(notes)}, "annotation"))
    counted = frame.select("signal").distinct() if modality == "time_series" else frame
    return registry.report(results, counted.count(), errors=errors)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    add = parser.add_argument
    add("--modality", "-m", required=True, choices=["tabular", "time_series", "image"])
    add("--validation_domain", default="input_val", choices=["input_val", "synthesis_val", "input", "synth"])
    add("--target_data", required=True)
    add("--reference_data")
    add("--reference_type", choices=["dataset", "instance", "none"])
    add("--evaluation_level", nargs="+", choices=["dataset", "instance"])
    add("--metric_category", nargs="+", choices=["data", "feature", "annotation"])
    add("--metric_groups", nargs="+", choices=["quality", "privacy", "utility", "validity"])
    add("--specific_metrics", nargs="+")
    add("--annotation_file")
    add("--extractor_model_name", help="module:factory of a function from pictures to vectors")
    add("--file_path_column", default="image", help="column of paths in a file of JSON lines")
    add("--repeat_reference", action="store_true", help="compare all targets with the reference pictures in turn")
    add("--batch_size", type=int, help="rows a batch that Python functions see at once")
    add("--compute_n_workers", type=int, help="partitions of a shuffle")
    add("--output_dir", default="metric_results")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("veracast").getOrCreate()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", asked.batch_size), ("spark.sql.shuffle.partitions", asked.compute_n_workers)):
        if value:
            spark.conf.set(key, value)
    domain = {"input": "input_val", "synth": "synthesis_val"}.get(asked.validation_domain, asked.validation_domain)
    try:
        out = audit(spark, asked.modality, domain, asked.target_data, asked.reference_data, asked.specific_metrics, asked.annotation_file, asked.reference_type, asked.evaluation_level, asked.metric_category, asked.metric_groups, asked.extractor_model_name, asked.file_path_column, asked.repeat_reference)
    except (registry.NotFound, registry.NotImplemented_, registry.BadInput) as refused:
        print(f"{refused.status}: {refused}", file=sys.stderr)
        return 2
    os.makedirs(asked.output_dir, exist_ok=True)
    for name, what in (("output.json", out), ("config.json", vars(asked))):
        with open(os.path.join(asked.output_dir, name), "w") as f:
            json.dump(what, f, indent=2)
    return 0


if __name__ == "__main__":
    sys.exit(main())
