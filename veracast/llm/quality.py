"""Quality rules with host-level verdicts.

Each rule marks a document that fails it and, at a stricter limit, one that
comes near to failing. Failures are counted by host (the ``source`` column);
a beta prior fitted to all hosts by the method of moments shrinks each host's
rate, and the host's verdict decides how many failures its documents may have:

    trusted  (shrunken rate under 2 %)    rejected at 2 failures
    mixed                                 rejected at 1 failure
    bad      (shrunken rate over 50 %)    rejected at 1 failure or 2 near ones

A document without a failure or near failure is never rejected for its host.

All rules are built-in expressions over the whole text. They are evaluated
twice, for the hosts' counts and for the verdict, as that is cheaper than to
shuffle the texts or to join flags back to them: both passes are narrow, and
only the hosts' counts are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, reliable

RULES = ("empty", "symbols", "capitals", "exclaims", "repeats", "word_length", "digits")
SYMBOLS = "#$&%*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRUSTED, BAD = 0.02, 0.5
_MOST = 1e6


def _measures(rows: Rows) -> DataFrame:
    """Characters, blanks, symbols, capitals, exclamation marks, digits and
    distinct words. The words are split off once, and tell the blanks too."""
    t = F.coalesce(rows["text"], F.lit(""))
    flat = t
    for blank in "\n\t\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    df = rows.df.withColumn("_words", F.split(flat, " ", -1))
    number = lambda kind: F.regexp_count(t, F.lit(kind)).cast("long")
    df = df.select("*", F.length(t).cast("long").alias("_n"), (F.size("_words") - 1).cast("long").alias("_gaps"), number(f"[{SYMBOLS}]").alias("_sym"), number("[A-Z]").alias("_cap"), number("!").alias("_exc"), number("[0-9]").alias("_dig"), F.size(F.array_distinct("_words")).cast("long").alias("_dis"))
    return df.drop("_words")


def _fails() -> list[tuple[str, str]]:
    """(failure, near failure) of each rule in terms of the measures; integers only."""
    return [
        ("_n = _gaps", "_n = _gaps"),
        ("10 * _sym >= 3 * (_gaps + 1)", "10 * _sym >= 2 * (_gaps + 1)"),
        ("10 * _cap > 3 * _n", "10 * _cap > 2 * _n"),
        ("5 * _exc > _gaps + 1 and _gaps >= 4", "10 * _exc > _gaps + 1 and _gaps >= 4"),
        ("_gaps >= 19 and _dis * _dis < 4 * (_gaps + 1)", "_gaps >= 19 and _dis * _dis < 6 * (_gaps + 1)"),
        ("_n - _gaps > 20 * (_gaps + 1) and _gaps >= 4", "_n - _gaps > 15 * (_gaps + 1) and _gaps >= 4"),
        ("10 * _dig > 3 * _n", "10 * _dig > 2 * _n"),
    ]


def _counted(rows: Rows) -> DataFrame:
    """rows with _mask (a bit for each failed rule), _fail and _near (how many)."""
    df = _measures(rows)
    bit = lambda k: " + ".join(f"case when {x[k]} then {{}} else 0 end" for x in _fails())
    ones = [1] * len(RULES)
    df = df.withColumn("_mask", F.expr(bit(0).format(*(1 << i for i in range(len(RULES))))).cast("long"))
    return df.withColumn("_fail", F.bit_count("_mask").cast("long")).withColumn("_near", F.expr(bit(1).format(*ones)).cast("long"))


def host_verdicts(docs: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunken) and verdict of each host."""
    rows = Rows(docs)
    counts = reliable(_counted(rows).groupBy(rows["source"].alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.expr("case when _fail > 0 then 1L else 0L end")).alias("n_failed")))
    total = counts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("_m"),
        F.try_divide(F.sum("n_failed"), F.sum("n_docs")).alias("_mean"),
        F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("_var"),
    )
    # one row; strength is alpha + beta
    prior = total.select("_mean", F.least(F.lit(_MOST), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("_mean") * (1 - F.col("_mean")), F.col("_var")) - 1, F.lit(_MOST)))).alias("_strength"))
    rate = (F.col("n_failed") + F.col("_mean") * F.col("_strength")) / (F.col("n_docs") + F.col("_strength"))
    judged = counts.crossJoin(F.broadcast(prior)).withColumn("rate", rate)
    verdict = F.when(F.col("rate") < TRUSTED, "trusted").when(F.col("rate") > BAD, "bad").otherwise("mixed")
    return judged.select("host", "n_docs", "n_failed", "rate", verdict.alias("verdict"))


_REJECTED = "case _verdict when 'trusted' then _fail >= 2 when 'bad' then _fail >= 1 or _near >= 2 else _fail >= 1 end"
#: whether a document is rejected depends on its host
_OPEN = "_fail = 1 or _fail = 0 and _near >= 2"


def _joined(df: DataFrame, host: Column, hosts: DataFrame, most_hosts: int, hot: int) -> DataFrame:
    """df with _rate and _verdict of its host. Hosts are broadcast if there are
    at most most_hosts; else those of more than ``hot`` documents are (or, of
    so many of them, most_hosts of those with the most), and the others are
    joined in a shuffle in which rows of the broadcast ones spread over all tasks."""
    if hosts.count() <= most_hosts:
        return df.join(F.broadcast(hosts.drop("_docs")), host.eqNullSafe(F.col("_host")), "left")
    big = hosts.where(F.col("_docs") > hot).orderBy(F.desc("_docs"), "_host").limit(most_hosts)
    big = reliable(big.select(F.col("_host").alias("_big"), F.col("_rate").alias("_big_rate"), F.col("_verdict").alias("_big_verdict")))
    df = df.join(F.broadcast(big), host.eqNullSafe(F.col("_big")), "left")
    spread = F.when(F.col("_big_verdict").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)) + 1).otherwise(0)
    key = F.when(F.col("_big_verdict").isNull(), host)
    df = df.select("*", spread.alias("_spread"), key.alias("_key"))
    small_hosts = hosts.select("_host", F.lit(0).cast("long").alias("_no_spread"), F.col("_rate").alias("_r"), F.col("_verdict").alias("_v"))
    df = df.join(small_hosts, (F.col("_spread") == F.col("_no_spread")) & F.col("_key").eqNullSafe(F.col("_host")), "left")
    return df.withColumn("_rate", F.coalesce("_big_rate", "_r")).withColumn("_verdict", F.coalesce("_big_verdict", "_v"))


def _hosts(docs: DataFrame) -> DataFrame:
    return reliable(host_verdicts(docs).select(F.col("host").alias("_host"), F.col("n_docs").alias("_docs"), F.col("rate").alias("_rate"), F.col("verdict").alias("_verdict")))


def quality_verdicts(docs: DataFrame, most_hosts: int = 500_000, hot: int = 1_000_000) -> DataFrame:
    """doc_id, host, failed (a bit for each of RULES), n_failed, n_near,
    host_rate, host_verdict and rejected of every row of docs.

    A null text counts as empty and fails the rule "empty", as does one of
    blanks only. A very long text is measured whole. Documents without a source are one host, null. A null doc_id
    and repeated rows are kept and judged one by one. Other columns aren't
    looked at; an empty table gives an empty result. Hosts are broadcast up to
    ``most_hosts`` of them; beyond, the join is shuffled, without texts, and only hosts
    of more than ``hot`` documents are broadcast. The result is the same."""
    rows = Rows(docs)
    thin = _counted(rows).select(rows["doc_id"].alias("doc_id"), rows["source"].alias("host"), F.col("_mask").alias("failed"), "_fail", "_near")
    df = _joined(thin, F.col("host"), _hosts(docs), most_hosts, hot)
    return df.select("doc_id", "host", "failed", F.col("_fail").alias("n_failed"), F.col("_near").alias("n_near"), F.round("_rate", 6).alias("host_rate"), F.col("_verdict").alias("host_verdict"), F.expr(_REJECTED).alias("rejected"))


def keep_good(docs: DataFrame, most_hosts: int = 500_000, hot: int = 1_000_000) -> DataFrame:
    """docs without those that quality_verdicts() rejects; all columns, and the
    same defined results. Beyond ``most_hosts`` hosts only documents whose
    verdict depends on their host are shuffled: those with one failure, or with none and two near ones."""
    rows, hosts = Rows(docs), _hosts(docs)
    df = _counted(rows)
    if hosts.count() <= most_hosts:
        return rows.give(_joined(df, rows["source"], hosts, most_hosts, hot).where(f"not ({_REJECTED})"))
    sure = df.where(f"_fail = 0 and not ({_OPEN})").select(*rows.own)
    asked = _joined(df.where(_OPEN), rows["source"], hosts, most_hosts, hot).where(f"not ({_REJECTED})").select(*rows.own)
    return rows.give(sure.union(asked))


def sql(documents: str = "documents") -> str:
    """The verdicts as DuckDB SQL."""
    without = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    mask = " + ".join(f"(case when {a} then {1 << i} else 0 end)" for i, (a, _) in enumerate(_fails()))
    fail, near = (" + ".join(f"(case when {x[k]} then 1 else 0 end)" for x in _fails()) for k in (0, 1))
    blank = "' ' || chr(10) || chr(9) || chr(13)"
    return f"""
    with t as (select *, coalesce(text, '') as t from {documents}),
    m as (select *, length(t) as _n, length(t) - length(translate(t, {blank}, '')) as _gaps, {without(SYMBOLS)} as _sym, {without(UPPER)} as _cap,
      {without("!")} as _exc, {without("0123456789")} as _dig, len(list_distinct(string_split(translate(t, chr(10) || chr(9) || chr(13), '   '), ' '))) as _dis from t),
    f as (select *, cast({mask} as bigint) as _mask, cast({fail} as bigint) as _fail, cast({near} as bigint) as _near from m),
    h as (select source, count(*) as n, sum(case when _fail > 0 then 1 else 0 end) as k from f group by source),
    a as (select cast(sum(k) as double) / sum(n) as mean, var_pop(cast(k as double) / n) as var from h),
    p as (select mean, least({_MOST!r}, greatest(1.0, coalesce(case when var = 0 then null else mean * (1 - mean) / var end - 1, {_MOST!r}))) as strength from a),
    r as (select source, (k + mean * strength) / (n + strength) as rate from h, p),
    v as (select *, case when rate < {TRUSTED} then 'trusted' when rate > {BAD} then 'bad' else 'mixed' end as verdict from r)
    select f.*, rate, verdict,
      case verdict when 'trusted' then _fail >= 2 when 'bad' then _fail >= 1 or _near >= 2 else _fail >= 1 end as rejected
    from f left join v on f.source is not distinct from v.source
    """


SQL = f"""select doc_id, source as host, _mask as failed, _fail as n_failed, _near as n_near, round(rate, 6) as host_rate, verdict as host_verdict, rejected from ({sql()})"""
