"""Queries of the feature-space metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracast.operators import features
from veracast.plans.tables import SQL, table, vectors

_SETS = f"{SQL['ref']}, {SQL['tgt']}"
_NEAR = f"""with {_SETS}, rr as (select a.id, list_sort(min(list_distance(a.v, b.v), 5)) as d from ref a, ref b where a.id <> b.id group by 1), tt as (select a.id, list_sort(min(list_distance(a.v, b.v), 5)) as d from tgt a, tgt b where a.id <> b.id group by 1),
  p as (select ref.id as r, tgt.id as t, list_distance(ref.v, tgt.v) as d, rr.d[5] as rk, rr.d[1] as r1, tt.d[5] as tk from ref join rr on ref.id = rr.id, tgt join tt on tgt.id = tt.id),
  f as (select *, (d < rk or abs(d - rk) <= 1e-8 + 1e-5 * abs(rk))::int as in_r, (d < r1 or abs(d - r1) <= 1e-8 + 1e-5 * abs(r1))::int as in_1, (d < tk or abs(d - tk) <= 1e-8 + 1e-5 * abs(tk))::int as in_t from p),
  bt as (select t as id, sum(in_r) as in_r, sum(in_1) as in_1, sum(in_t) as in_t from f group by t), br as (select r as id, max(in_t) as covered, max(in_r) as near from f group by r)"""
_VALUE = {"precision": "avg((in_r > 0)::int) as v from bt", "recall": "avg(covered) as v from br", "density": "avg(in_r / 5.0::double) as v from bt", "coverage": "avg(near) as v from br", "authenticity": "avg((in_1 = 0)::int) as v from bt"}
_INSTANCE = {"precision": "(in_r > 0)::int", "recall": "in_t", "density": "in_r / 5.0::double", "coverage": "in_r", "authenticity": "(in_1 = 0)::int"}


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return features.neighbourhoods(*vectors(spark, d))


def _neighbour(name: str):
    sql = f"{_NEAR} select '{name}' as key, null::varchar as stat, round(v, 6) as value from (select {_VALUE[name]})"
    return (lambda s, d: features.neighbour_metric(_neighbours(s, d), name)), sql


def _instances(name: str):
    sql = f"{_NEAR} select id::varchar as key, 'instance' as stat, round(({_INSTANCE[name]})::double, 6) as value from bt"
    return (lambda s, d: features.neighbour_metric(_neighbours(s, d), name, instances=True)), sql


_DOT = "list_dot_product({0}, {1})"
_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs({0}[i] - {1}[i])))"
_KERNEL = {
    "rbf": "exp(-pow(list_distance({0}, {1}), 2) / 64)",
    "laplacian": f"exp(-{_L1} / 64)",
    "poly": f"pow({_DOT} / 64 + 1, 3)",
    "sigmoid": f"tanh({_DOT} / 64 + 1)",
    "cosine": f"{_DOT} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}))",
    "additive_chi2": "-list_sum(list_transform(range(1, 65), lambda i: case when {0}[i] + {1}[i] <> 0 then pow({0}[i] - {1}[i], 2) / ({0}[i] + {1}[i]) else 0 end))",
}
_KERNEL["chi2"] = f"exp({_KERNEL['additive_chi2']})"


def _kernel(name: str):
    """Kernels of chi-square kind take magnitudes, as they need."""
    positive = "chi2" in name
    sets = _SETS.replace("embedding::double[] as v", "list_transform(embedding::double[], lambda e: abs(e)) as v") if positive else _SETS
    k = _KERNEL[name].format("a.v", "b.v")
    sql = f"""with {sets}, x as (select avg({k}) as v from ref a, ref b), y as (select avg({k}) as v from tgt a, tgt b), z as (select avg({k}) as v from ref a, tgt b)
    select '{name}' as key, null::varchar as stat, round(x.v + y.v - 2 * z.v, 6) as value from x, y, z"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        sides = vectors(spark, d)
        return features.mmd(*((side.withColumn("v", F.transform("v", lambda e: F.abs(e))) if positive else side) for side in sides), name)

    return run, sql


_MEANS = "select i, avg(v[i]) as m from {0}, unnest(range(1, 65)) as g(i) group by i"
_LINEAR = f"with {_SETS}, x as ({_MEANS.format('ref')}), y as ({_MEANS.format('tgt')}) select 'linear' as key, null::varchar as stat, round(sum((x.m - y.m) * (x.m - y.m)), 6) as value from x join y using (i)"
_MULTI = f"""with {_SETS}, l as (select 0 as side, a.id as i, b.id as j, pow(list_distance(a.v, b.v), 2) as d from ref a, ref b union all select 1, a.id, b.id, pow(list_distance(a.v, b.v), 2) from tgt a, tgt b union all select 2, a.id, b.id, pow(list_distance(a.v, b.v), 2) from ref a, tgt b),
  n as (select count(*) as n from ref), m as (select sum(case when side = 2 then 2 * d else d end) / pow(2 * max(n), 2) as mean from l, n),
  k as (select side, sum({" + ".join(f"exp(-d / (2 * {2.0**e}::double * mean))" for e in range(-3, 2))}) as s from l, m where side = 2 or i <> j group by side)
  select 'multi_gaussian' as key, null::varchar as stat, round(sum(case when side = 2 then -2 * s / pow(n, 2) else s / (n * (n - 1)) end) + 2 / (max(n) - 1), 6) as value from k, n"""
_COSINE = f"""with {_SETS}, a as (select v, row_number() over (order by id) as p from ref), b as (select v, row_number() over (order by id) as p from tgt)
  select 'cosine' as key, null::varchar as stat, round(avg({_KERNEL["cosine"].format("a.v", "b.v")}), 6) as value from a join b using (p)"""


def _sides_1d(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").cast("double").alias("x"))
    return e.where(F.col("id") % 2 == 0), e.where(F.col("id") % 2 == 1)


_W1 = """with a as (select value as x, row_number() over (order by value, event_id) as p from events where event_id % 2 = 0), b as (select value as y, row_number() over (order by value, event_id) as p from events where event_id % 2 = 1)
  select 'wasserstein' as key, null::varchar as stat, round(avg((x - y) * (x - y)), 6) as value from a join b using (p)"""


def _half_means(name: str, side: str, k: int) -> str:
    return f"{name} as (select i, avg(v[i]) as m from {side}, unnest(range(1, 65)) as g(i) where id % 2 = {k} group by i)"


_RATIOS = f"""with {_SETS}, {_half_means("r1", "ref", 0)}, {_half_means("r2", "ref", 1)}, {_half_means("t1", "tgt", 0)}, {_half_means("t2", "tgt", 1)},
  d as (select round(sum(pow(r1.m - r2.m, 2)), 6) as rr, round(sum(pow(t1.m - t2.m, 2)), 6) as tt, round(sum(pow(r1.m - t2.m, 2)), 6) as x, round(sum(pow(r2.m - t1.m, 2)), 6) as y from r1 join r2 using (i) join t1 using (i) join t2 using (i))
  select null::varchar as key, 'dispersion_ratio' as stat, round(tt / rr, 6) as value from d union all select null, 'distance_ratio', round((x + y) / 2 / rr, 6) from d"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    """The curve over shares that are given: labels of even and odd embeddings."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.sum(F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("vec_id") % 2 == 1, 1).otherwise(0)).alias("t"))
    n = e.agg(F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    return features.prd_summary(features.prd_curve(e.crossJoin(F.broadcast(n)).select(F.col("label").alias("cluster"), (F.col("r") / F.col("nr")).alias("ref"), (F.col("t") / F.col("nt")).alias("tgt"))))


_PRD = """with c as (select label, count(*) filter (vec_id % 2 = 0) as r, count(*) filter (vec_id % 2 = 1) as t from embeddings group by 1), s as (select label, r / sum(r) over () as r, t / sum(t) over () as t from c),
  a as (select a, tan(1e-10::double + a * ((pi() / 2 - 2e-10::double) / 1000)) as s from unnest(range(1001)) as g(a)), p as (select a, any_value(a.s) as s, sum(least(s.r * a.s, s.t)) as p from a, s group by a),
  v as (select least(greatest(p, 0), 1) as p, least(greatest(p / s, 0), 1) as r from p)
  select 'precision' as key, null::varchar as stat, round(avg(p), 6) as value from v union all select 'recall', null, round(avg(r), 6) from v union all select null, 'max_f_beta', round(max(65 * p * r / (64 * p + r + 1e-10)), 6) from v
  union all select null, 'max_f_beta_inv', round(max((1 + 1.0::double / 64) * p * r / (r / 64 + p + 1e-10)), 6) from v"""

QUERIES = {
    **{f"feat_{n}": _neighbour(n) for n in features.NEIGHBOUR_METRICS},
    **{f"feat_{n}_instances": _instances(n) for n in features.NEIGHBOUR_METRICS},
    "feat_mmd_linear": (lambda s, d: features.mmd_linear(*vectors(s, d)), _LINEAR),
    **{f"feat_mmd_{n}": _kernel(n) for n in _KERNEL},
    "feat_mkmmd": (lambda s, d: features.mk_mmd(*vectors(s, d)), _MULTI),
    "feat_cosine": (lambda s, d: features.cosine(*vectors(s, d)), _COSINE),
    "feat_ratios": (lambda s, d: features.ratios(features.mmd_linear, *vectors(s, d)), _RATIOS),
    "feat_wasserstein": (lambda s, d: features.wasserstein(*vectors(s, d)), None),
    "feat_wasserstein_1d": (lambda s, d: features.wasserstein_1d(*_sides_1d(s, d)), _W1),
    "feat_frechet": (lambda s, d: features.frechet(*vectors(s, d)), None),
    "feat_prd": (lambda s, d: features.prd(*vectors(s, d)), None),
    "feat_prd_curve": (_shares, _PRD),
    "feat_msid": (lambda s, d: features.intrinsic_distance(*vectors(s, d)), None),
    "feat_geometry_score": (lambda s, d: features.geometry_score(*vectors(s, d)), None),
    "feat_giqa": (lambda s, d: features.giqa(*vectors(s, d)), None),
}
