"""Mixing sources to target weights by systematic sampling.

A source with weight w is to supply the share w of ``budget`` characters, so
each of its documents has an expected number of copies: what the source is to
supply over what it holds. Within a source the expected copies are summed from
the first document on, one random offset in [0, 1) is added, and a document is
emitted once for each integer that its step crosses: the count is off by less
than one a source, and a document's by less than one of its expectation.

Sums are of integers (units of 10**-8 copies), so that neither order nor
partitioning changes the result. A source's documents are spread over
``BUCKETS`` by a hash of doc_id (of the text where there is none), and the
order is by bucket, then id: bucket
totals (sources x buckets rows) are accumulated first, and each bucket then
sums its own documents, so that a hot source is the work of many tasks. What is
ranked are rows of a few numbers, equal ones in one with their number, so that a
row that is repeated a million times is one as well. Texts take no part in it:
mix() joins the copies to them, in one shuffle by id and without a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, reliable

UNIT = 100_000_000
BUCKETS = 4096


def bucket(id_: Column, text: Column, buckets: int) -> Column:
    """By the first 28 bits of the MD5 of the id, which SQL engines agree on;
    of the text where there is no id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), text, F.lit(""))), 1, 7), 16, 10).cast("long") % buckets


def _offset(source: Column, seed: int) -> Column:
    """The source's random offset in units, a hash of its name and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 7), 16, 10).cast("long") % UNIT


def _steps(held: DataFrame, weights: dict[str, float] | None, budget: int | None, seed: int) -> DataFrame:
    """_s, _b, _step and _first: the first sum and the step of each source and
    bucket. held: _source, _bucket, _n and _size."""
    source = held.groupBy("_source").agg(F.sum("_size").alias("_total"))
    if weights is None:  # by the square root of a source's size
        weight = F.floor(F.sqrt(F.col("_total").cast("double")) * 1000).cast("long")
    else:
        # scaled to integers; a source that isn't named supplies nothing
        named = [F.when(F.col("_source").eqNullSafe(F.lit(k)), F.lit(int(round(v * 1_000_000)))) for k, v in weights.items()]
        weight = F.coalesce(*named, F.lit(0)).cast("long") if named else F.lit(0).cast("long")
    source = source.withColumn("_weight", F.when(F.col("_total") > 0, weight).otherwise(F.lit(0)))
    whole = source.agg(F.sum("_weight").alias("_all_weight"), F.sum("_total").alias("_all_size"))
    target = F.lit(budget).cast("long") if budget is not None else F.col("_all_size")
    share = F.col("_weight").cast("double") / F.col("_all_weight")
    step = F.coalesce(F.floor(F.when(F.col("_weight") > 0, share * target / F.col("_total") * UNIT)), F.lit(0)).cast("long")
    source = source.crossJoin(F.broadcast(whole)).select(F.col("_source").alias("_s"), step.alias("_step"))  # one row
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = held.withColumn("_before", before).join(source, F.col("_source").eqNullSafe(F.col("_s")))
    return steps.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_step", (F.col("_before") * F.col("_step") + _offset(F.col("_source"), seed)).alias("_first"))


def _copies(rows: Rows, weights: dict[str, float] | None, budget: int | None, buckets: int, seed: int, more: list[Column]) -> DataFrame:
    """_source, _id, _hash (of the text), the columns of ``more``, _n, _step and
    _copies: how many copies all _n rows that are alike in these have together."""
    text = F.coalesce(rows["text"], F.lit(""))
    thin = rows.df.select(rows["source"].alias("_source"), rows["doc_id"].alias("_id"), F.md5(text).alias("_hash"), *more, bucket(rows["doc_id"], text, buckets).alias("_bucket"), F.coalesce(F.length(rows["text"]).cast("long"), F.lit(0)).alias("_size"))
    last = [c for c in thin.columns if c not in ("_bucket", "_size")]
    thin = reliable(thin.groupBy(*last, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size")))
    held = reliable(thin.groupBy("_source", "_bucket").agg(F.sum("_n").alias("_n"), F.sum("_size").alias("_size")))
    steps = _steps(held, weights, budget, seed)
    df = thin.join(steps, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    order = Window.partitionBy("_source", "_bucket").orderBy("_id", "_hash", *last[3:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_to", F.col("_first") + F.sum(F.col("_n") * F.col("_step")).over(order))
    return df.select(*last, "_n", "_step", (F.expr(f"_to div {UNIT}") - F.expr(f"(_to - _n * _step) div {UNIT}")).alias("_copies")).where("_copies > 0")


def _each(copies: DataFrame, chunk: int = 10_000) -> DataFrame:
    """copies with a row for each copy and its number from 0, _at; many copies
    are counted out by the chunk, so that no array is long."""
    chunks = copies.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {chunk})")))
    return chunks.withColumn("_at", F.explode(F.expr(f"sequence(_chunk * {chunk}, least(_copies, (_chunk + 1) * {chunk}) - 1)"))).drop("_chunk")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, source and copy (1, 2, ...) of every emitted document.

    ``weights`` are target shares by source, in any scale; None takes the
    square root of each source's characters. ``budget`` is in characters; None
    keeps as many as docs has. Null and empty texts have no characters but are
    emitted at their source's rate, as are very long ones; a source without characters supplies
    nothing. Documents without a source are a source of their own, a null
    doc_id sorts first, repeated rows are documents of their own, and ties are
    ordered by the text's hash. Other columns aren't looked at; an empty table
    gives an empty result."""
    each = _each(_copies(Rows(docs), weights, budget, buckets, seed, []))
    # of _n rows that are alike, each has _step div UNIT copies, and some one more
    whole = f"_n * (_step div {UNIT})"
    copy = F.expr(f"case when _at < {whole} then _at div _n else _step div {UNIT} end + 1")
    return each.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), copy.alias("copy"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """The rows of docs, each as many times as mixture() emits it; all columns,
    and the same defined results. Texts move once, to their copies, by id.

    Rows that are alike in all columns are one with all their copies; columns
    of maps aren't compared, so of rows that differ in these only any may stand for all."""
    rows = Rows(docs)
    comparable = [F.col(f.name) for f in rows.df.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.xxhash64(*comparable).alias("_row")
    copies = reliable(_copies(rows, weights, budget, buckets, seed, [row]))
    names = [c.lower() for c in ("_source", "_id", "_hash", "_row")]
    asked = rows.df.select(*rows.own, rows["source"].alias("a_source"), rows["doc_id"].alias("a_id"), F.md5(F.coalesce(rows["text"], F.lit(""))).alias("a_hash"), row.alias("a_row"))
    alike = F.col("a_row") == F.col("_row")
    for name in names[:-1]:
        alike = alike & F.col(f"a{name}").eqNullSafe(F.col(name))
    once = asked.join(copies.where("_n = 1").hint("shuffle_hash"), alike)
    out = _each(once).select(*rows.own)
    repeated = reliable(copies.where("_n > 1"))
    if not repeated.isEmpty():
        own = F.struct(*rows.own)
        one = asked.join(repeated.select(*names), alike, "left_semi").groupBy("a_source", "a_id", "a_hash", "a_row").agg(F.first(own).alias("_one"))
        out = out.union(_each(one.join(repeated, alike)).select("_one.*"))
    return rows.give(out)


SQL = f"""
with d as (select doc_id, source, text, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), text, '')), 1, 7))::bigint % {BUCKETS} as bucket, coalesce(length(text), 0) as size from documents),
s as (select source, sum(size)::bigint as total, floor(sqrt(sum(size)::double) * 1000)::bigint as weight from d group by source),
w as (select sum(weight)::bigint as all_weight, sum(total)::bigint as all_size from s),
r as (select source, coalesce(floor(case when total > 0 then (weight::double / all_weight) * all_size / total * {UNIT} end), 0)::bigint as step,
  ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 7))::bigint % {UNIT} as first from s, w),
p as (select d.doc_id, d.source, step, first + sum(step) over (partition by d.source order by bucket, doc_id nulls first, md5(coalesce(text, '')) rows between unbounded preceding and current row) as upto
  from d join r on d.source is not distinct from r.source),
c as (select doc_id, source, floor(upto / {UNIT}::double)::bigint - floor((upto - step) / {UNIT}::double)::bigint as copies from p)
select doc_id, source, unnest(range(1, copies + 1)) as copy from c where copies > 0
"""
