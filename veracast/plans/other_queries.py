"""Queries of signals, pictures, annotations, preparation, the registry and streams, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracast.operators import annotations, images, prepare, timeseries
from veracast.plans import registry
from veracast.plans.tables import SQL, annotated, halves, pixels, signals, table
from veracast.streaming import windows

# --- signals ----------------------------------------------------------------

_S = f"with {SQL['signals']}"
_TS_UNIQUE = f"{_S} select signal::varchar as key, 'instance' as stat, round(avg((abs(v - n) <= 1e-4)::int), 6) as value from (select *, lead(v) over (partition by signal order by t) as n from signals) where n is not null group by signal"
_TS_SNR = f"{_S} select signal::varchar as key, 'instance' as stat, round(avg(v) / stddev_pop(v), 6) as value from signals group by signal"
_LAST = "last as (select t, v from signals where signal = (select max(signal) from signals where signal % 2 = 0))"
_XCORR = f"""{_S}, {_LAST}, c as (select a.signal, a.t - l.t as lag, sum(a.v * l.v) as c from signals a, last l where a.signal % 2 = 1 group by 1, 2), m as (select signal, max(c) as v from c group by 1)
  select signal::varchar as key, 'instance' as stat, round(v, 6) as value from m union all select 'cross_correlation', null, round(avg(v), 6) from m"""
_FEATURES = f"""{_S}, x as (select *, t::double as u, lag(v) over (partition by signal order by t) as b from signals),
  n as (select signal, count(*) as n, avg(v) as mean, stddev_pop(v) as std, var_pop(v) as var, min(v) as min, max(v) as max, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr,
    sum(v * v) as abs_energy, sqrt(avg(v * v)) as rms, sum((coalesce(v * b < 0, false))::int)::bigint as zero_crossings, avg(v - b) as mean_diff, avg(abs(v - b)) as mean_abs_diff, sum(abs(v - b)) as sum_abs_diff, covar_pop(u, v) / var_pop(u) as slope,
    (avg(v * b) - avg(case when b is not null then v end) * avg(b)) / var_pop(v) as autocorrelation from x group by 1),
  m as (select signal, avg(pow(v - mean, 3)) as m3, avg(pow(v - mean, 4)) as m4 from signals join n using (signal) group by 1)
  select signal, 0 as channel, n, {", ".join(f"round({c}, 8) as {c}" for c in ("mean", "std", "var", "min", "max", "median", "iqr"))}, round(m3 / pow(std, 3), 8) as skewness, round(m4 / pow(var, 2) - 3, 8) as kurtosis,
    round(abs_energy, 8) as abs_energy, round(rms, 8) as rms, zero_crossings, {", ".join(f"round({c}, 8) as {c}" for c in ("mean_diff", "mean_abs_diff", "sum_abs_diff", "slope", "autocorrelation"))} from n join m using (signal)"""


def _pair(of):
    return lambda s, d: of(*halves(signals(s, d)))


# --- pictures ---------------------------------------------------------------

_P = f"with {SQL['pixels']}"


def _per_image(stat: str, value: str) -> str:
    return f"{_P} select image::varchar as key, '{stat}' as stat, round({value}, 6) as value from pixels group by image"


_BRIGHT = _per_image("brightness", "avg(sqrt(0.299::double * r * r + 0.587::double * g * g + 0.114::double * b * b))")
_EXPOSED = _per_image("exposure", "(avg(l) + 2 * stddev_pop(l)) / 255")
_COLOURS = _per_image("colorfulness", "sqrt(var_pop(abs(r - g)) + var_pop(abs(0.5::double * (r + g) - b))) + 0.3::double * sqrt(pow(avg(abs(r - g)), 2) + pow(avg(abs(0.5::double * (r + g) - b)), 2))")
_EME = f"""{_P}, c as (select image, y // 4 as i, x // 4 as j, 20 * ln(greatest(max(l), 0.1) / greatest(min(l), 0.1)) as c from pixels group by 1, 2, 3) select image::varchar as key, 'eme' as stat, round(avg(c) filter (j >= 1), 6) as value from c group by image"""
_PSNR = f"""{_P}, e as (select a.image, (pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)) / 3 as e from pixels a join pixels b on b.image = a.image and b.y = a.y and b.x = 7 - a.x)
  select image::varchar as key, 'psnr' as stat, round(20 * log10(255 / (sqrt(avg(e)) + 1e-8)), 6) as value from e group by image"""
_BORDER = "case when {0} < 0 then -({0}) when {0} > 7 then 14 - ({0}) else {0} end"
_SOBEL = f"""{_P}, o as (select * from (values (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) as k(dy, dx, wx, wy)),
  m as (select p.image, p.y, p.x, {_BORDER.format("(p.y + dy)")} as ny, {_BORDER.format("(p.x + dx)")} as nx, wx, wy from pixels p, o), g as (select m.image, m.y, m.x, sum(wx * q.l) as gx, sum(wy * q.l) as gy from m join pixels q on q.image = m.image and q.y = ny and q.x = nx group by 1, 2, 3)
  select image::varchar as key, 'tenengrad' as stat, round(avg(sqrt(gx * gx + gy * gy)), 6) as value from g group by image"""


def _mirrored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pixels(spark, d)
    return p, p.withColumn("x", 7 - F.col("x"))


def _pictures(metrics: dict):
    return lambda s, d: images.of_pictures(images.pictures(pixels(s, d)), metrics)


def _picture_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pictures of 8 x 8 pixels need a small window, and hold two scales of it."""
    a, b = (images.pictures(p) for p in _mirrored(s, d))
    return images.of_pairs(a, b, {"ssim": lambda x, y: images.ssim(x, y, 3), "ms_ssim": lambda x, y: images.ms_ssim(x, y, 3, weights=(0.5, 0.5))})


# --- annotations ------------------------------------------------------------

_A = """with c as (select r_regionkey as id, r_name as name from region), a as (select o_orderkey as id, o_custkey as image_id, substr(o_orderpriority, 1, 1)::bigint as category_id, case o_orderstatus when 'F' then 4 when 'O' then 3 end as box,
  o_orderkey % 3 = 0 as kp, case when o_orderkey % 7 <> 0 then o_totalprice end as area, o_orderkey % 2 = 0 as mask, o_orderkey % 4 = 0 as counts from orders)"""


def _list(key: str, where: str, source: str = "a") -> str:
    return f"select '{key}' as key, null::varchar as stat, id::double as value from {source} where {where}"


_COMPLETE = f"""{_A} {_list("img_no_annot", "id not in (select image_id from a)", "(select c_custkey as id from customer)")} union all {_list("img_no_annot", "image_id in (select c_custkey from customer) and category_id not in (select id from c where id <> 0)")}
  union all {_list("annot_missing_fields", "box is null and not kp and not mask")}"""
_CORRECT = f"""{_A} {_list("invalid_labels", "name not in ('ASIA', 'EUROPE')", "c")} union all {_list("annots_invalid_label", "category_id in (select id from c where name not in ('ASIA', 'EUROPE'))")} union all {_list("annots_invalid_bbox", "box <> 4")}
  union all {_list("annots_invalid_kp", "kp")} union all {_list("annots_mask_oob", "mask and (area < 50000 or area > 300000)")} union all {_list("annots_missing_area", "mask and area is null")} union all {_list("annots_missing_counts", "mask and not counts")}
  union all {_list("annots_missing_size", "false")} union all {_list("annots_missing_bbox", "mask and box is null")}"""
_REPEATED = f"""{_A}, e as (select *, unnest([case when box is not null then 'b' end, case when kp then 'k' end, case when mask then 'm' end]) as kind from a), n as (select *, row_number() over (partition by image_id, category_id, kind order by id) as n from e where kind is not null)
  select image_id::varchar as key, null::varchar as stat, id::double as value from (select distinct image_id, id from n where n > 1)"""
_TYPES = f"{_A} select unnest(['bbox', 'mask', 'keypoints', 'label']) as type from (select 1 from a limit 1)"


def _complete(s, d):
    return annotations.completeness(*annotated(s, d))


def _correct(s, d):
    _, notes, kinds = annotated(s, d)
    return annotations.correctness(notes, kinds, ["ASIA", "EUROPE"], 17, (50_000, 300_000))


# --- preparation ------------------------------------------------------------

CUSTOMER = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def _profile(s, d):
    p = prepare.profile(table(s, d, "customer"), ["c_nationkey", "c_acctbal", "c_mktsegment"])
    return p.select("column", "tag", "is_categ", "dtype", "n_options", F.array_join("options", ",").alias("options"))


_PROFILE = """with n as (select count(*) as n, count(distinct c_mktsegment) as k, count(distinct c_nationkey) as nk from customer)
  select 'c_nationkey' as "column", 'continuous' as tag, 0 as is_categ, 'integer' as dtype, 0::bigint as n_options, null::varchar as options union all select 'c_acctbal', 'continuous', 0, 'numerical', 0, null
  union all select 'c_mktsegment', 'discrete', (k < 0.03 * n)::int, 'string', k, (select string_agg(distinct c_mktsegment, ',' order by c_mktsegment) from customer) from n"""


def _encoded(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    e = prepare.Encoder.fit(c, ["c_mktsegment"])
    return e.encode(c.withColumn("segment", F.col("c_mktsegment")).drop("c_mktsegment").withColumnRenamed("segment", "c_mktsegment")).select("c_custkey", F.col("c_mktsegment").alias("code"))


def _decoded(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    e = prepare.Encoder.fit(c, ["c_mktsegment"])
    return e.decode(e.encode(c))


def _one_hot(s, d):
    c = table(s, d, "customer").select("c_mktsegment", "c_custkey")
    e = prepare.Encoder.fit(c.drop("c_custkey"), ["c_mktsegment"])
    hot = e.one_hot(e.encode(c))
    names = [x for x in hot.columns if "_OH-" in x]
    return hot.agg(*(F.sum(F.col(f"`{x}`")).alias(f"n{x.rpartition('-')[2]}") for x in names))


def _scaled(kind: str):
    def run(s, d):
        c = table(s, d, "customer").select("c_custkey", "c_acctbal")
        return prepare.Scaler.fit(c, ["c_acctbal"], kind).transform(c).select("c_custkey", F.round("c_acctbal", 6).alias("scaled"))

    shift, scale = {"standard": ("avg(c_acctbal)", "stddev_pop(c_acctbal)"), "minmax": ("min(c_acctbal)", "max(c_acctbal) - min(c_acctbal)"), "maxabs": ("0", "max(abs(c_acctbal))"), "robust": ("quantile_cont(c_acctbal, 0.5)", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)")}[kind]
    return run, f"select c_custkey, round((c_acctbal - a) / b, 6) as scaled from customer, (select {shift} as a, {scale} as b from customer)"


def _gappy(s, d):
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("double")).alias("c_nationkey"))


_GAPPY = "g as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal end as c_acctbal, case when c_custkey % 4 <> 0 then c_nationkey::double end as c_nationkey from customer)"


def _imputed(kind: str):
    fill = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)"}
    if kind == "mode":
        value = lambda c: f"(select {c} from g where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
    else:
        value = lambda c: f"(select {fill[kind].format(c)} from g)"
    sql = f"with {_GAPPY} select c_custkey, {', '.join(f'round(coalesce({c}, {value(c)}), 6) as {c}' for c in ('c_acctbal', 'c_nationkey'))} from g"
    return (lambda s, d: prepare.impute(_gappy(s, d), ["c_acctbal", "c_nationkey"], kind).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("c_nationkey", 6).alias("c_nationkey"))), sql


def _near_filled(s, d):
    c = prepare.impute_knn(_gappy(s, d), "c_custkey", ["c_acctbal", "c_nationkey"])
    return c.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("c_nationkey", 6).alias("c_nationkey"))


_KNN = f"""with {_GAPPY}, m as (select avg(c_acctbal) as ma, stddev_pop(c_acctbal) as sa, avg(c_nationkey) as mn, stddev_pop(c_nationkey) as sn from g),
  z as (select c_custkey as k, c_acctbal as ra, c_nationkey as rn, (c_acctbal - ma) / sa as a, (c_nationkey - mn) / sn as n from g, m),
  p as (select q.k, o.k as o, sqrt((coalesce(pow(q.a - o.a, 2.0), 0) + coalesce(pow(q.n - o.n, 2.0), 0)) * 2 / ((q.a - o.a is not null)::int + (q.n - o.n is not null)::int)) as d, q.a is null as ga, q.n is null as gn, o.ra, o.rn from z q, z o where q.k <> o.k and (q.a is null or q.n is null) and (q.a - o.a is not null or q.n - o.n is not null)),
  fa as (select k, avg(ra) as v from (select *, row_number() over (partition by k order by d, o) as i from p where ga and ra is not null) where i <= 2 group by k), fn as (select k, avg(rn) as v from (select *, row_number() over (partition by k order by d, o) as i from p where gn and rn is not null) where i <= 2 group by k)
  select c_custkey, round(coalesce(c_acctbal, fa.v, ma), 6) as c_acctbal, round(coalesce(c_nationkey, fn.v, mn), 6) as c_nationkey from g cross join m left join fa on fa.k = c_custkey left join fn on fn.k = c_custkey"""


def _pca(s, d):
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    c = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scaled = prepare.Scaler.fit(t, c).transform(t)
    return prepare.Components.fit(scaled, c, 2).transform(scaled).select("l_orderkey", "l_linenumber", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


def _sentinels(s, d):
    o = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") == 7, 999.0).when(F.col("l_quantity") == 8, -1.0).when(F.col("l_quantity") == 9, float("nan")).otherwise(F.col("l_quantity")).alias("q"))
    return prepare.without_sentinels(o, ["q"]).select("l_orderkey", "l_linenumber", "q")


def _texts(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", prepare.row_to_text(p, ["p_name", "p_brand", "p_size"]).alias("text"))


# --- registry and streams ---------------------------------------------------


def _literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"'{x}'::double"
    return "'" + str(x).replace("'", "''") + "'"


_VALUES = ", ".join("(" + ", ".join([_literal(".".join(e[:4])), _literal(e[0]), _literal(e[1]), _literal(e[4]), _literal(",".join(e[5])), *map(_literal, e[6:])]) + ")" for e in registry.ENTRIES)
_REGISTRY = f"with r(id, modality, domain, reference_type, levels, metric_group, higher_is_better, min_value, max_value) as (values {_VALUES})"
_COLUMNS = "id, reference_type, levels, metric_group, higher_is_better::boolean as higher_is_better, min_value::double as min_value, max_value::double as max_value"


def folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a temporary one in a local session without."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="veracast-")


def _streamed(s, d):
    """The day's windows over the events table, read as a stream."""
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    updates = windows.run_available(windows.quality_by_window(events), folder(s))
    return windows.latest(updates, ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "missing", "mean", "snr")


_STREAM = "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, count(*) filter (value is null) as missing, round(avg(value), 6) as mean, round(avg(value) / nullif(stddev_pop(value), 0), 6) as snr from events group by 1, 2"

QUERIES = {
    "ts_uniqueness": (lambda s, d: timeseries.uniqueness(signals(s, d)), _TS_UNIQUE),
    "ts_snr": (lambda s, d: timeseries.snr(signals(s, d)), _TS_SNR),
    "ts_crosscorr": (_pair(timeseries.cross_correlation), _XCORR),
    "ts_dtw": (_pair(timeseries.dtw), None),
    "ts_spectral_coherence": (_pair(timeseries.spectral_coherence), None),
    "ts_spectral_wasserstein": (_pair(timeseries.spectral_wasserstein), None),
    "ts_features": (lambda s, d: timeseries.features(signals(s, d)), _FEATURES),
    "ts_spectral_features": (lambda s, d: timeseries.spectral_features(signals(s, d)), None),
    "img_brightness": (lambda s, d: images.brightness(pixels(s, d)), _BRIGHT),
    "img_exposure": (lambda s, d: images.exposure(pixels(s, d)), _EXPOSED),
    "img_colorfulness": (lambda s, d: images.colourfulness(pixels(s, d)), _COLOURS),
    "img_eme": (lambda s, d: images.eme(pixels(s, d), (4, 4)), _EME),
    "img_psnr": (lambda s, d: images.psnr(*_mirrored(s, d)), _PSNR),
    "img_tenengrad": (_pictures({"tenengrad": images.tenengrad}), _SOBEL),
    "img_tenengrad_rel": (_pictures({"tenengrad_rel": images.tenengrad_relative}), None),
    "img_dom": (_pictures({"dom": images.dom}), None),
    "img_ssim": (_picture_pairs, None),
    "coco_completeness": (_complete, _COMPLETE),
    "coco_correctness": (_correct, _CORRECT),
    "coco_uniqueness": (lambda s, d: annotations.uniqueness(annotated(s, d)[1]), _REPEATED),
    "coco_types": (lambda s, d: annotations.annotation_types(annotated(s, d)[1]), _TYPES),
    "prep_profile": (_profile, _PROFILE),
    "prep_encode": (_encoded, "select c_custkey, dense_rank() over (order by c_mktsegment)::double as code from customer"),
    "prep_decode": (_decoded, "select c_custkey, c_mktsegment from customer"),
    "prep_one_hot": (_one_hot, f"with r as (select dense_rank() over (order by c_mktsegment) as r from customer) select {', '.join(f'(count(*) filter (r = {k}))::double as n{k}' for k in range(1, 6))} from r"),
    **{f"prep_scale_{k}": _scaled(k) for k in ("standard", "minmax", "maxabs", "robust")},
    **{f"prep_impute_{k}": _imputed(k) for k in ("mean", "median", "mode")},
    "prep_impute_knn": (_near_filled, _KNN),
    "prep_pca": (_pca, None),
    "prep_sentinels": (_sentinels, "select l_orderkey, l_linenumber, case when l_quantity not in (7, 8, 9) then l_quantity end as q from lineitem"),
    "prep_row_to_text": (_texts, "select p_partkey, 'p_name is ' || p_name || ', p_brand is ' || p_brand || ', p_size is ' || p_size as text from part"),
    "metric_catalogue": (lambda s, d: registry.described(registry.registry(s)), f"{_REGISTRY} select {_COLUMNS} from r"),
    "metric_selection": (lambda s, d: registry.described(registry.select(registry.registry(s), "tabular", "synthesis_val", "dataset", "dataset", groups=["privacy"])), f"{_REGISTRY} select {_COLUMNS} from r where modality = 'tabular' and domain = 'synthesis_val' and reference_type = 'dataset' and contains(levels, 'dataset') and metric_group = 'privacy'"),
    "stream_windows": (_streamed, _STREAM),
}
