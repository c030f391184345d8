"""The metrics there are, how to choose among them, and how to report them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "modality string, domain string, category string, name string, reference_type string, levels array<string>, metric_group string, higher_is_better boolean, min_value double, max_value double"
INF = float("inf")
_D, _I, _B = ["dataset"], ["instance"], ["dataset", "instance"]


def _entries() -> list[tuple]:
    out: list[tuple] = []

    def add(modality: str, domain: str, category: str, reference: str, group: str, *metrics: tuple) -> None:
        for name, levels, higher, low, high in metrics:
            out.append((modality, domain, category, name, reference, levels, group, higher, low, high))

    image = [("DOM", _I, True, 0.0, 1.0), *((n, _I, False, 0.0, 1.0) for n in ("Tenengrad", "TenengradRelative", "EME", "ExposureBrightness", "Brightness", "Colorfulness"))]
    add("image", "input_val", "data", "none", "quality", *image)
    add("image", "input_val", "data", "instance", "quality", ("PSNR", _I, True, 0.0, INF), ("SSIM", _I, True, 0.0, 1.0), ("MSSSIM", _I, True, 0.0, 1.0))
    add("image", "input_val", "annotation", "none", "validity", *((n, _B, None, None, None) for n in ("DatasetCompletness", "AnnotationCorrectness", "AnnotationUniqueness")))
    neighbours = [(n, _B, True, 0.0, 1.0) for n in ("ImprovedPrecision", "ImprovedRecall", "Density", "Coverage")]
    for modality in ("image", "tabular", "time_series"):
        add(modality, "synthesis_val", "feature", "dataset", "quality", *neighbours)
        add(modality, "synthesis_val", "feature", "dataset", "privacy", ("Authenticity", _B, True, 0.0, 1.0))
        if modality != "tabular":
            add(modality, "synthesis_val", "feature", "dataset", "quality", ("PrecisionRecallDistribution", _D, None, None, None), ("FrechetDistance", _D, False, 0.0, INF), ("GeometryScore", _D, False, 0.0, INF), ("MultiScaleIntrinsicDistance", _D, False, 0.0, INF))
    add("image", "synthesis_val", "feature", "dataset", "quality", ("GIQA", _B, True, 0.0, 1.0))
    add("tabular", "input_val", "data", "none", "privacy", ("KAnonymityScore", _D, True, 0.0, 100.0))
    add("tabular", "input_val", "data", "none", "quality", *((n, _D, False, 0.0, 1.0) for n in ("CorrelationScore", "UniquenessScore", "UniformityScore", "OutlierScore", "MissingScore")), ("DimCurseScore", _D, False, 0.0, INF), ("VIFactorScore", _D, False, 0.0, INF))
    add("tabular", "synthesis_val", "data", "dataset", "quality", ("StatisticalSimScore", _D, True, 0.0, 1.0), ("StatisticalDivergenceScore", _D, False, -INF, INF), ("CoherenceScore", _D, True, 0.0, 1.0))
    add("tabular", "synthesis_val", "feature", "dataset", "privacy", ("NNDRPrivacy", _D, True, 0.0, 100.0), ("DCRPrivacy", _D, True, 0.0, 100.0))
    add("time_series", "input_val", "data", "none", "quality", ("Uniqueness", _I, False, 0.0, 100.0), ("SNR", _I, False, 0.0, INF))
    add("time_series", "synthesis_val", "data", "dataset", "quality", ("SpectralCoherence", _D, False, 0.0, INF), ("SpectralWassersteinDistance", _D, False, 0.0, INF), ("DTW", _B, False, 0.0, INF), ("CrossCorrelation", _B, True, -INF, INF))
    add("time_series", "synthesis_val", "feature", "dataset", "quality", *((n, _D, False, 0.0, INF) for n in ("WassersteinDistance", "MMD", "CosineSimilarity")))
    return out


ENTRIES = _entries()


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, SCHEMA)


def select(metrics: DataFrame, modality: str, domain: str, reference_type: str | None = None, level: str | None = None, category: str | None = None, groups: list[str] | str | None = None) -> DataFrame:
    """Metrics of a modality and domain; further arguments narrow the choice."""
    groups = [groups] if isinstance(groups, str) else groups
    conditions = [F.col("modality") == modality, F.col("domain") == domain]
    if reference_type is not None:
        conditions.append(F.col("reference_type") == reference_type)
    if level is not None:
        conditions.append(F.array_contains("levels", level))
    if category is not None:
        conditions.append(F.col("category") == category)
    if groups is not None:
        conditions.append(F.col("metric_group").isin(groups))
    return metrics.where(reduce(lambda a, b: a & b, conditions)).dropDuplicates(["modality", "domain", "category", "name"])


def select_named(metrics: DataFrame, names: list[str], modality: str, domain: str, reference_type: str | None = None) -> DataFrame:
    """Of those, the named ones; a name that isn't among them raises."""
    found = select(metrics, modality, domain, reference_type).where(F.col("name").isin(names))
    missing = sorted(set(names) - {r[0] for r in found.select("name").collect()})  # names asked for
    if missing:
        raise NotFound(f"no {modality} metric of {domain} is called {', '.join(missing)}")
    return found


def described(metrics: DataFrame) -> DataFrame:
    """id (modality.domain.category.name) and the descriptors of each metric."""
    return metrics.select(F.concat_ws(".", "modality", "domain", "category", "name").alias("id"), "reference_type", F.array_join("levels", ",").alias("levels"), "metric_group", "higher_is_better", "min_value", "max_value")


class NotFound(LookupError):
    """Nothing matches what was asked for (404)."""

    status = 404


class NotImplemented_(NotImplementedError):
    """There are such metrics, but none that can be computed (501)."""

    status = 501


class BadInput(ValueError):
    """The data doesn't fit the request (400)."""

    status = 400


def evaluate(metrics: dict[str, Callable[[], DataFrame]], category: str = "data", errors: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (metric, category, level, key, stat, value) of all metrics, in one
    plan. A row whose stat is "instance" is of the instance level. With
    ``errors``, what a metric that refuses its data says is noted there, and the others go on."""
    if not metrics:
        raise NotImplemented_("no metric to compute")
    parts = []
    for name, run in metrics.items():
        try:
            found = run()
        except ValueError as refused:
            if errors is None:
                raise
            errors.setdefault(name, []).append(str(refused))
            continue
        level = F.when(F.col("stat").eqNullSafe("instance"), "instance").otherwise("dataset")
        parts.append(found.select(F.lit(name).alias("metric"), F.lit(category).alias("category"), level.alias("level"), "key", "stat", "value"))
    if not parts:
        raise BadInput("; ".join(x for said in (errors or {}).values() for x in said))
    return reduce(DataFrame.unionByName, parts)


def report(results: DataFrame, n: int, names: list[str] | None = None, errors: dict[str, list[str]] | None = None) -> dict:
    """The result rows as nested levels, metrics and values, for JSON.

    Rows become one JSON text a metric on the cluster; a metric's instances are
    a list in the order of their keys."""
    entry = F.struct(F.coalesce("key", F.lit("")).alias("key"), F.coalesce("stat", F.lit("")).alias("stat"), "value")
    folded = results.groupBy("level", "category", "metric").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("rows"))
    import json

    out: dict = {}
    annotated = False
    for level, category, metric, text in sorted(tuple(r) for r in folded.collect()):  # a row a metric
        rows = json.loads(text)
        annotated |= category == "annotation"
        at = out.setdefault(f"{level}_level", {"num_instances": n, "label_metrics": None, "raw_data_metrics": {}} if level == "dataset" else {"instance_names": names if names is not None else [str(i) for i in range(n)], "label_metrics": None, "raw_data_metrics": {}})
        if level == "instance":
            value: dict = {"dtype": "array", "subtype": "float", "value": [r.get("value") for r in rows]}
        else:
            own = [r for r in rows if not r["stat"]]
            stats = {r["stat"]: r.get("value") for r in rows if r["stat"] and not r["key"]}
            by_key: dict[str, list] = {}
            for r in own:
                by_key.setdefault(r["key"], []).append(r.get("value"))
            if category == "annotation":
                value = {"dtype": "key_array", "subtype": "int", "value": {k: [int(x) for x in v] for k, v in by_key.items()}}
            elif len(own) == 1:
                value = {"dtype": "numeric", "subtype": "float", "value": own[0].get("value")}
            else:
                value = {"dtype": "key_value", "subtype": "float", "value": {k: v[0] if len(v) == 1 else v for k, v in by_key.items()}}
            if stats:
                value["stats"] = stats
        kind = "label_metrics" if category == "annotation" else "raw_data_metrics"
        if at[kind] is None:
            at[kind] = {}
        at[kind][metric] = value
    out["errors"] = errors or None
    return out
