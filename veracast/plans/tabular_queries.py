"""Queries of the tabular metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracast.functions.longform import rows
from veracast.functions.quantiles import percentiles
from veracast.operators import synthesis, tabular
from veracast.plans.tables import table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEW = ["l_quantity", "l_discount", "l_tax"]


def _stats(values: str, sample: bool = False, ctes: str = "") -> str:
    std = "stddev_samp" if sample else "stddev_pop"
    return f"""with {ctes} v as ({values}) select key, null::varchar as stat, round(value, 6) as value from v
    union all select null, 'mean', round(avg(value), 6) from v union all select null, 'std', round({std}(value), 6) from v"""


def _row(key: str | None, stat: str | None, value: str) -> str:
    text = lambda x: "null::varchar" if x is None else f"'{x}'"
    return f"select {text(key)} as key, {text(stat)} as stat, ({value})::double as value"


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    gap = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    return _lineitem(spark, d).select("l_quantity", "l_extendedprice", gap("l_discount"), gap("l_tax"))


_GAPPY = "t as (select l_quantity, l_extendedprice, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem)"
_MISSING = f"""with {_GAPPY}, a as (select {", ".join(f"round(100.0::double * count(*) filter ({c} is null) / count(*), 3) as {c}" for c in NUMBERS)},
  avg(round(100.0::double * ({" + ".join(f"({c} is null)::int" for c in NUMBERS)}) / 4, 3)) as r from t)
{" union all ".join(f"{_row(c, None, c)} from a" for c in NUMBERS)} union all {_row(None, "row_mean", "round(r, 6)")} from a union all {_row(None, "column_mean", f"round(({' + '.join(NUMBERS)}) / 4, 6)")} from a"""


def _outlier(c: str) -> str:
    return f"""select '{c}' as key, (100.0::double * count(*) filter (abs({c} - m) / nullif(s, 0) > 3) / count(*) + 100.0::double * count(*) filter ({c} < q1 - 1.5::double * (q3 - q1) or {c} > q3 + 1.5::double * (q3 - q1)) / count(*)) / 2 as value
    from lineitem, (select avg({c}) as m, stddev_pop({c}) as s, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from lineitem)"""


def _correlated(c: str) -> str:
    return f"select '{c}' as key, round(100.0::double * ({' + '.join(f'(coalesce(abs(corr({c}, {o})), 0) > 0.05)::int' for o in NUMBERS if o != c)}) / 3, 1) as value from lineitem"


def _level(stat: str, entropy: str) -> str:
    return f"round(100.0::double * (1 - ((1 - {stat} > 0.80)::int + (round({entropy}, 4) > 0.95)::int) / 2.0::double), 1)"


def _discrete(name: str, column: str, k: int = 0) -> str:
    return f"""with c as (select {column}, count(*) as n from {name} where {column} is not null group by 1), p as (select n / sum(n) over () as p from c),
    a as (select greatest(count(*), {k})::double as k, sum(p * p) as pp, sum(p) as sp, -sum(p * log2(p)) as h from p),
    b as (select case when k <= 1 then 0.0 else (pp - 2 * sp / k + 1 / k) * k / (k - 1) end as chi2, case when k <= 1 then 1.0 else h / log2(k) end as entropy from a)
    {_row(column, None, _level("chi2", "entropy"))} from b union all {_row(column, "chi2", "round(chi2, 6)")} from b union all {_row(column, "entropy", "round(entropy, 6)")} from b"""


_CONTINUOUS = f"""with x as (select value::double as x from events where value is not null), l as (select count(*) as n, min(x) as a, max(x) as b, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from x),
  w as (select *, (b - a) / (log2(n) + 1) as sturges, 2 * (q3 - q1) / cbrt(n::double) as fd from l), k as (select *, ceil((b - a) / case when fd > 0 then least(sturges, fd) else sturges end) as bins from w),
  c as (select x, count(*) as m, sum(count(*)) over (order by x) as upto from x group by x), u as (select *, (x - a) / (b - a) as u from c, k),
  s as (select max(greatest(upto / n - u, u - (upto - m) / n)) as ks from u), h as (select least(floor(u * bins), bins - 1) as bin, sum(m) / max(n) as p, max(bins) as bins from u group by 1),
  e as (select -sum(p * log2(p)) / log2(max(bins)) as entropy from h), b as (select ks, entropy from s, e)
  {_row("value", None, _level("ks", "entropy"))} from b union all {_row("value", "ks", "round(ks, 6)")} from b union all {_row("value", "entropy", "round(entropy, 6)")} from b"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _lineitem(spark, d)
    return t.where(F.col("l_orderkey") % 2 == 0), t.where(F.col("l_orderkey") % 2 == 1)


def _tv(c: str) -> str:
    return f"""select '{c}' as key, 1 - sum(abs(r / tr - s / ts)) / count(*) as value from (select {c}, count(*) filter (l_orderkey % 2 = 0) as r, count(*) filter (l_orderkey % 2 = 1) as s,
    sum(count(*) filter (l_orderkey % 2 = 0)) over () as tr, sum(count(*) filter (l_orderkey % 2 = 1)) over () as ts from lineitem group by {c}) where r > 0"""


def _ks(c: str) -> str:
    return f"""select '{c}' as key, 1 - max(r / tr - s / ts) as value from (select sum(r) over w as r, sum(s) over w as s, sum(r) over () as tr, sum(s) over () as ts from (
    select least(floor((x - a) / ((b - a) / 99)), 98) as cell, count(*) filter (k = 0) as r, count(*) filter (k = 1) as s from
    (select {c}::double as x, l_orderkey % 2 as k from lineitem), (select min({c})::double as a, max({c})::double as b from lineitem) group by 1) window w as (order by cell))"""


def _densities(source: str) -> str:
    """CTEs up to pdf (g, pt, p, q), of a source of (syn, x)."""
    return f"""x as ({source}), d as (select syn, count(*) as n, stddev_samp(x) as sd from x group by 1), l as (select min(x) as a, max(x) as b from x),
    h as (select syn, sd * pow(n::double, -0.2) as h from d), c as (select syn, x, count(*) as m from x group by 1, 2),
    g as (select g, a + g * ((b - a) / 299) as pt from l, unnest(range(300)) as r(g)),
    k as (select g, min(pt) as pt, sum(case when syn = 0 then m * exp(-0.5::double * ((x - pt) / h) * ((x - pt) / h)) else 0 end) as k0, sum(case when syn = 1 then m * exp(-0.5::double * ((x - pt) / h) * ((x - pt) / h)) else 0 end) as k1
      from c join h using (syn), g group by g),
    pdf as (select g, pt, k0 / sum(k0) over () as p, k1 / sum(k1) over () as q from k)"""


_KL = "greatest(sum(case when p > 0 then p * ln(p / (q + 1e-10)) else 0 end), 0)"
_JS = "greatest((sum(case when p > 0 then p * log2(p / ((p + q) / 2 + 1e-10)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2 + 1e-10)) else 0 end)) / 2, 0)"


def _divergence(of: str) -> str:
    one = lambda c: f"select '{c}' as key, (with {_densities(f'select l_orderkey % 2 as syn, {c}::double as x from lineitem')} select {of} from pdf) as value"
    return _stats(" union all ".join(one(c) for c in NUMBERS), sample=True)


def _coherence(name: str, columns: list[str], key: str, kind: str, cells: bool = False) -> str:
    """Of a table split by the parity of key."""
    side = lambda s: f"{s} as (select {', '.join(f'{c}::double as {c}' for c in columns)} from {name} where {key} % 2 = {0 if s == 'r' else 1})"
    ctes = [side("r"), side("s")]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if kind == "spearman":
        for s in "rs":
            ctes.append(f"{s}2 as (select {', '.join(f'rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}' for c in columns)} from {s})")
    one = {}
    for s in "rs":
        if kind == "kendall":
            sign = lambda c: f"sign(a.{c} - b.{c})"
            # pairs of equal values are counted first
            for i, j in pairs if cells else []:
                x, y = (sign(columns[k]) for k in (i, j))
                ctes.append(f"{s}c{i}{j} as (select {columns[i]}, {columns[j]}, count(*) as w from {s} group by 1, 2), {s}m{i}{j} as (select sum(a.w * b.w * {x} * {y}) / sqrt(sum(a.w * b.w * {x} * {x}) * sum(a.w * b.w * {y} * {y})) as c{i}_{j} from {s}c{i}{j} a, {s}c{i}{j} b)")
            if cells:
                ctes.append(f"{s}m as (select * from {', '.join(f'{s}m{i}{j}' for i, j in pairs)})")
                one[s] = f"{s}m"
                continue
            values = ", ".join(f"sum({sign(columns[i])} * {sign(columns[j])}) / sqrt(sum({sign(columns[i])} * {sign(columns[i])}) * sum({sign(columns[j])} * {sign(columns[j])})) as c{i}_{j}" for i, j in pairs)
            ctes.append(f"{s}m as (select {values} from {s} a, {s} b)")
        else:
            of = f"{s}2" if kind == "spearman" else s
            ctes.append(f"{s}m as (select {', '.join(f'corr({columns[i]}, {columns[j]}) as c{i}_{j}' for i, j in pairs)} from {of})")
        one[s] = f"{s}m"
    # equal weights: each of the p (p - 1) terms weighs 1 / (p - 1), over p
    p = len(columns)
    terms = " + ".join(f"2 * abs(coalesce(rm.c{i}_{j}, 1) - coalesce(sm.c{i}_{j}, 1)) / {p - 1}" for i, j in pairs)
    return f"with {', '.join(ctes)} {_row(None, None, f'round(1 - ({terms}) / {p}.0::double / 2, 3)')} from rm, sm"


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("n"))
    real, syn = c.where(F.col("c_custkey") % 2 == 0), c.where(F.col("c_custkey") % 2 == 1)
    return synthesis.standardised(real, ["a", "n"], real), synthesis.standardised(syn, ["a", "n"], real)


def _privacy(kind: str) -> str:
    value = "d[1]" if kind == "dcr" else "d[1] / (d[2] + 1e-10)"
    source = f"""with c as (select c_custkey as k, (c_acctbal - m) / s as a, (c_nationkey - m2) / s2 as n from customer, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s, avg(c_nationkey) as m2, stddev_pop(c_nationkey) as s2 from customer where c_custkey % 2 = 0)),
      near as (select q.k % 2 as syn, list_sort(min(sqrt((q.a - t.a) * (q.a - t.a) + (q.n - t.n) * (q.n - t.n)), 2)) as d from c q, c t where t.k % 2 = 0 and q.k <> t.k group by q.k)
      select syn, {value} as x from near"""
    return f"""with {_densities(source)}, f as (select *, sum(p) over (order by g) as cp, sum(q) over (order by g) as cq from pdf),
    m as (select min(g) filter (cp >= 0.25) as pl, min(g) filter (cp >= 0.75) as ph, min(g) filter (cq >= 0.25) as ql, min(g) filter (cq >= 0.75) as qh, min(pt) as a, max(pt) as b from f),
    o as (select sum(least(p, q)) as overlap, sum(case when g < pl then q else 0 end) as leak, sum(case when g >= ph then q else 0 end) as nfidel, max((qh - ql) / (greatest(ph, qh) - least(pl, ql))) as divers,
      ((sum(q * pt) - sum(p * pt)) / max(b - a) + 1) / 2 as ctd from f, m)
    {_row(None, None, "100 - round(100 * leak, 1)")} from o {"".join(f" union all {_row(None, n, f'round(100 * ({e}), 1)')} from o" for n, e in (("overlap", "overlap"), ("leak", "leak"), ("nfidel", "nfidel"), ("fidel", "1 - leak - nfidel"), ("divers", "divers"), ("ctd_disp", "ctd")))}"""


def _quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = percentiles(table(spark, d, "events"), ["value"], [0.25, 0.5, 0.75])
    v = lambda i: F.round(F.col("value")[i], 6)
    return rows(q, [("value", "p25", v(0)), ("value", "p50", v(1)), ("value", "p75", v(2)), ("value", "iqr", F.round(F.col("value")[2] - F.col("value")[0], 6))])


_QUARTILES = f"""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.75) as c from events)
  {_row("value", "p25", "round(a, 6)")} from q union all {_row("value", "p50", "round(b, 6)")} from q union all {_row("value", "p75", "round(c, 6)")} from q union all {_row("value", "iqr", "round(c - a, 6)")} from q"""

_VIF2 = f"""with g as (select sum(l_quantity * l_quantity) as a, sum(l_quantity * l_discount) as b, sum(l_discount * l_discount) as c from lineitem), v as (select 1 / (1 - b * b / (a * c)) as v from g)
  {_row("l_quantity", "vif", "round(v, 6)")} from v union all {_row("l_discount", "vif", "round(v, 6)")} from v union all {_row(None, None, "(v > 5)::int")} from v"""



def _determinant(rows_: list[int], columns: list[int]) -> str:
    """Of the Gram matrix of sums g<i><j>, without a row and column or more, by cofactors."""
    if not rows_:
        return "1"
    terms = (f"{'-' if k % 2 else '+'} g{min(rows_[0], c)}{max(rows_[0], c)} * ({_determinant(rows_[1:], columns[:k] + columns[k + 1 :])})" for k, c in enumerate(columns))
    return " ".join(terms)


def _vif(name: str, columns: list[str]) -> str:
    """A column's factor is its square sum times the inverse Gram matrix's diagonal; columns are scaled by their means, which changes nothing."""
    n = range(len(columns))
    sums = ", ".join(f"sum({columns[i]} / m{i} * {columns[j]} / m{j}) / count(*) as g{i}{j}" for i in n for j in n if i <= j)
    means = ", ".join(f"avg({c}) as m{i}" for i, c in enumerate(columns))
    one = ", ".join(f"g{i}{i} * ({_determinant([k for k in n if k != i], [k for k in n if k != i])}) / ({_determinant(list(n), list(n))}) as v{i}" for i in n)
    each = " union all ".join(_row(c, "vif", f"round(v{i}, 6)") + " from v" for i, c in enumerate(columns))
    return f"""with m as (select {means} from {name}), g as (select {sums} from {name}, m), v as (select {one} from g)
  {each} union all {_row(None, None, "(" + " + ".join(f"(v{i} > 5)::int" for i in n) + f") / {len(columns)}.0::double")} from v"""


_UNIQUE = f"""{_row(None, None, "round(100.0::double * sum(case when c > 1 then c else 0 end) / sum(c), 6)")} from (select count(*) as c from lineitem group by l_linenumber, {", ".join(NUMBERS)})"""


def _k_anonymous(name: str, columns: str) -> str:
    return f"{_row(None, None, 'round(100.0::double * (1 - min(c)::double / sum(c)), 6)')} from (select count(*) as c from {name} group by {columns})"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Change of each source of orders' mean price between the parities of customers, in percent."""
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_custkey") % 2 == 1, F.col("o_totalprice"))).alias("b"))
    return o.select("o_orderpriority", F.round(synthesis.change_percent(F.col("a"), F.col("b")), 6).alias("change"))


_CHANGES = "select o_orderpriority, round((avg(o_totalprice) filter (o_custkey % 2 = 0) - avg(o_totalprice) filter (o_custkey % 2 = 1)) / (avg(o_totalprice) filter (o_custkey % 2 = 1) + 1e-20) * 100, 6) as change from orders group by 1"

PART = ["p_size", "p_retailprice"]


def _split(spark: SparkSession, d: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, name)
    return t.where(F.col(key) % 2 == 0), t.where(F.col(key) % 2 == 1)


QUERIES = {
    "tab_missing": (lambda s, d: tabular.missing(_gappy(s, d), NUMBERS), _MISSING),
    "tab_uniqueness": (lambda s, d: tabular.uniqueness(_lineitem(s, d), ["l_linenumber", *NUMBERS]), _UNIQUE),
    "tab_outliers": (lambda s, d: tabular.outliers(_lineitem(s, d), NUMBERS), _stats(" union all ".join(map(_outlier, NUMBERS)))),
    "tab_correlation": (lambda s, d: tabular.correlation(_lineitem(s, d), NUMBERS, 0.05), _stats(" union all ".join(map(_correlated, NUMBERS)))),
    "tab_dimcurse": (lambda s, d: tabular.dim_curse(_lineitem(s, d), NUMBERS), f"{_row(None, None, 'count(*) / 4.0::double')} from lineitem"),
    "tab_vif": (lambda s, d: tabular.vif(_lineitem(s, d), NUMBERS), _vif("lineitem", NUMBERS)),
    "tab_vif2": (lambda s, d: tabular.vif(_lineitem(s, d), ["l_quantity", "l_discount"]), _VIF2),
    "tab_kanonymity": (lambda s, d: tabular.k_anonymity(table(s, d, "customer"), ["c_nationkey", "c_mktsegment"]), _k_anonymous("customer", "c_nationkey, c_mktsegment")),
    "tab_kanonymity_lineitem": (lambda s, d: tabular.k_anonymity(_lineitem(s, d), ["l_returnflag", "l_linestatus", "l_linenumber"]), _k_anonymous("lineitem", "l_returnflag, l_linestatus, l_linenumber")),
    "tab_uniformity_priority": (lambda s, d: tabular.uniformity_discrete(table(s, d, "orders"), "o_orderpriority"), _discrete("orders", "o_orderpriority")),
    "tab_uniformity_brand": (lambda s, d: tabular.uniformity_discrete(table(s, d, "part"), "p_brand", 30), _discrete("part", "p_brand", 30)),
    "tab_uniformity_event_type": (lambda s, d: tabular.uniformity_discrete(table(s, d, "events"), "event_type"), _discrete("events", "event_type")),
    "tab_uniformity_ks": (lambda s, d: tabular.uniformity_continuous(table(s, d, "events"), "value"), _CONTINUOUS),
    "tab_percentiles": (_quartiles, _QUARTILES),
    "tab_tv_similarity": (lambda s, d: synthesis.tv_similarity(*_halves(s, d), "l_returnflag"), f"select key, null::varchar as stat, round(value, 6) as value from ({_tv('l_returnflag')})"),
    "tab_ks_similarity": (lambda s, d: synthesis.ks_similarity(*_halves(s, d), "l_extendedprice"), f"select key, null::varchar as stat, round(value, 6) as value from ({_ks('l_extendedprice')})"),
    "tab_stat_sim": (lambda s, d: synthesis.statistical_similarity(*_halves(s, d), ["l_linenumber", "l_tax"], ["l_quantity", "l_extendedprice"]), _stats(" union all ".join([_tv("l_linenumber"), _tv("l_tax"), _ks("l_quantity"), _ks("l_extendedprice")]))),
    "tab_divergence_kl": (lambda s, d: synthesis.divergence(*_halves(s, d), NUMBERS, "kl"), _divergence(_KL)),
    "tab_divergence_js": (lambda s, d: synthesis.divergence(*_halves(s, d), NUMBERS, "js"), _divergence(_JS)),
    "tab_coherence_pearson": (lambda s, d: synthesis.coherence(*_halves(s, d), NUMBERS), _coherence("lineitem", NUMBERS, "l_orderkey", "pearson")),
    "tab_coherence_spearman": (lambda s, d: synthesis.coherence(*_halves(s, d), NUMBERS, "spearman"), _coherence("lineitem", NUMBERS, "l_orderkey", "spearman")),
    "tab_coherence_kendall": (lambda s, d: synthesis.coherence(*_halves(s, d), FEW, "kendall"), _coherence("lineitem", FEW, "l_orderkey", "kendall", cells=True)),
    "tab_coherence_kendall_part": (lambda s, d: synthesis.coherence(*_split(s, d, "part", "p_partkey"), PART, "kendall"), _coherence("part", PART, "p_partkey", "kendall")),
    "tab_dcr": (lambda s, d: synthesis.privacy(*_records(s, d), "c_custkey", ["a", "n"], "dcr"), _privacy("dcr")),
    "tab_nndr": (lambda s, d: synthesis.privacy(*_records(s, d), "c_custkey", ["a", "n"], "nndr"), _privacy("nndr")),
    "tab_change": (_changes, _CHANGES),
}
