"""URL filters by expressions of host suffix and path prefix.

A URL is brought into a canonical form and expanded into host suffixes times
path prefixes (and the exact path, with and without its query); a rule is one
such expression. Expansions and rules are equi-joined on the first four bytes
of their SHA-256; a match counts only if the full digests agree. Of a URL's
matches the rule with the most host labels wins, then the longest path, then
"allow" over "block", then the least rule id.

What is expanded follows from the rules, not from the URL: first host
suffixes, of as many labels as any rule's host has, are joined with the
rules' hosts; then, for the hosts that are left, path prefixes of as many
parts as that host's rules have. A URL of any length thus gives no more
expressions than there are different shapes of rules.

URLs are made distinct first, so a page that is linked a million times is
expanded once. Only URLs move, never the pages' contents. Verdicts go back to
the pages by a broadcast if few URLs matched; else URLs of very many pages do,
and the others are joined in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rows, reliable

PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$"
ESCAPE = "%(2[DE]|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)"
#: (rule_id, expression, action)
RULES = [
    (1, "spam-farm.example.org/", "block"),
    (2, "cheap-pills.example.com/", "block"),
    (3, "casino-win.example.org/", "block"),
    (4, "free-bets.example.com/", "block"),
    (5, "ads-track.example.org/", "block"),
    (6, "cheap-pills.example.com/fr/", "allow"),
    (7, "m.free-bets.example.com/", "allow"),
    (8, "m.free-bets.example.com/de/", "block"),
    (9, "blog.ththon.example.net/fr/65.html", "block"),
]


def _unescaped(path: Column) -> Column:
    """path with escapes of letters, digits, and - . _ ~ undone, which mean the
    same either way. Only paths with an escape are taken apart."""
    code = lambda p: F.upper(F.substring(p, 1, 2))
    known = lambda p: F.concat(F.lit("%"), code(p)).rlike(f"^{ESCAPE}$")
    parts = F.split(path, "%")
    decoded = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.when(known(p), F.concat(F.char(F.conv(code(p), 16, 10).cast("int")), F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p)))
    return F.when(F.contains(path, F.lit("%")), F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))).otherwise(path)


def _resolved(path: Column) -> Column:
    """path without parts that are empty, "." or "..", the last with the part
    before it. Only paths that hold one are taken apart."""
    # a stack: the parts that stay, one string; a part is cut off its end
    add = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), p))
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(parts, F.lit(""), add)
    folder = last.isin("", ".", "..")
    return F.when(path.rlike(r"//|/\.{1,2}(?:/|$)"), F.concat(walked, F.when(folder, "/").otherwise(""))).otherwise(path)


def parsed(url: Column) -> list[Column]:
    """host, path and query of a URL's canonical form; the host is empty if there is none."""
    part = lambda i: F.regexp_extract(F.trim(url), PARTS, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"\.{2,}", "."), r"^\.|\.$", "")
    path = F.when(part(2) == "", "/").otherwise(part(2))
    return [F.coalesce(host, F.lit("")).alias("host"), _resolved(_unescaped(path)).alias("path"), part(3).alias("query")]


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule_id, expression and action of the winning rule of each url that has one.
    rules: rule_id, expression and action without nulls."""
    listed = rules.withColumn("r_host", F.substring_index("expression", "/", 1)).withColumn("r_path", F.expr("substring(expression, length(r_host) + 1)"))
    listed = listed.withColumn("r_labels", F.size(F.split("r_host", r"\.")))
    # parts of a path that rules end in: how many slashes a folder has; 0 for an exact path
    depth = F.when(F.col("r_path").endswith("/"), F.length("r_path") - F.length(F.replace("r_path", F.lit("/"), F.lit("")))).otherwise(0)
    hosts = listed.groupBy(F.col("r_host")).agg(F.collect_set(depth).alias("depths")).select(F.sha2("r_host", 256).alias("h_digest"), "depths").withColumn("h_prefix", _prefix(F.col("h_digest")))
    listed = listed.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", _prefix(F.col("digest")))
    # one row: the numbers of labels that rules' hosts have
    labels = listed.agg(F.sort_array(F.collect_set("r_labels")).alias("sizes"))
    each = urls.select("url", *parsed(F.col("url"))).where("host <> ''").crossJoin(F.broadcast(labels))
    own = F.split("host", r"\.")
    suffix = F.transform(F.filter("sizes", lambda k: (k < F.size(own)) & (k >= 2)), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    each = each.select("url", "host", "path", "query", F.explode(F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(F.concat(F.array("host"), suffix))).alias("suffix"))
    each = each.withColumn("u_digest", F.sha2("suffix", 256)).withColumn("u_prefix", _prefix(F.col("u_digest")))
    each = each.join(hosts, F.col("u_prefix") == F.col("h_prefix")).where("u_digest = h_digest")
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    folders = F.transform(F.filter("depths", lambda k: (k > 0) & (k <= slashes)), lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))
    paths = F.array_distinct(F.concat(folders, F.array("path", F.concat("path", "query"))))
    each = each.select("url", F.explode(F.transform(paths, lambda p: F.concat("suffix", p))).alias("e"))
    each = each.select("url", F.sha2("e", 256).alias("e_digest")).withColumn("e_prefix", _prefix(F.col("e_digest")))
    hits = each.join(listed, F.col("e_prefix") == F.col("prefix")).where("e_digest = digest")
    rank = F.struct((-F.col("r_labels")).alias("a"), (-F.length("r_path")).alias("b"), F.col("action"), F.col("rule_id"), F.col("expression"))
    return hits.groupBy("url").agg(F.min(rank).alias("best")).select("url", "best.rule_id", "best.expression", "best.action")


def url_verdicts(pages: DataFrame, rules: list[tuple[int, str, str]] | DataFrame = RULES, most_urls: int = 500_000, hot: int = 200_000) -> DataFrame:
    """page_id, url, verdict ("allow", "block" or "none"), rule_id and expression of every row of pages.

    rules: (rule_id, expression, action) rows, of canonical expressions. Both
    are compared in canonical form: hosts in lower case without dots at their
    ends or side by side; paths without empty, "." and ".." parts and without
    escapes of letters, digits and - . _ ~. An IP address has no suffix but itself.

    A null, empty or unparsable URL has the verdict "none", as one that no rule
    matches. A very long URL is treated as any other. A null page_id is
    carried along, repeated rows get the same verdict, and of equal rules the
    least rule_id counts. Rules with nulls never match. Other columns aren't
    looked at; an empty table of pages or rules is fine.

    Up to ``most_urls`` URLs with a verdict are broadcast; beyond that, those
    that more than ``hot`` pages have (if as few) are, and the rest is joined in a shuffle.
    The result is the same."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "rule_id long, expression string, action string")
    known = Rows(rules)
    listed = known.df.select(known["rule_id"].cast("long").alias("rule_id"), known["expression"].alias("expression"), known["action"].alias("action")).dropna()
    rows = Rows(pages)
    asked = rows.df.select(rows["page_id"].alias("page_id"), rows["url"].alias("url"))
    urls = asked.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("pages"))
    best = reliable(_matched(urls.select("url"), listed).withColumnRenamed("url", "u"))

    def given(some: DataFrame, verdicts: DataFrame) -> DataFrame:
        out = some.join(verdicts, F.col("url") == F.col("u"), "left")
        return out.select("page_id", "url", F.coalesce("action", F.lit("none")).alias("verdict"), "rule_id", "expression")

    if best.count() <= most_urls:
        return given(asked, F.broadcast(best))
    many = reliable(urls.where(F.col("pages") > hot).select(F.col("url").alias("h")))
    if many.count() > most_urls:  # too many to broadcast: many keys, none of which is most of the rows
        return given(asked, best)
    of_many, of_few = (asked.join(F.broadcast(many), F.col("url") == F.col("h"), how) for how in ("left_semi", "left_anti"))
    few_known = of_few.where("url is not null")
    parts = [given(of_many, F.broadcast(best.join(F.broadcast(many), F.col("u") == F.col("h"), "left_semi"))), given(few_known, best)]
    none = of_few.where("url is null").select("page_id", "url", F.lit("none").alias("verdict"), F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("expression"))
    return parts[0].unionByName(parts[1]).unionByName(none)


SQL = f"""
with rules(rule_id, expression, action) as (values {", ".join(f"({i}::bigint, '{e}', '{a}')" for i, e, a in RULES)}),
u as (select distinct url, regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '{PARTS}', 1)), '\\.{{2,}}', '.', 'g'), '^\\.|\\.$', '', 'g') as host,
  regexp_extract(trim(url), '{PARTS}', 2) as p, regexp_extract(trim(url), '{PARTS}', 3) as q from pages where url is not null),
e0 as (select url, host, case when p = '' then '/' else p end as p, q from u where host <> ''),
e1 as (select url, host, q, array_to_string(list_transform(regexp_extract_all(p, '%..|[^%]+|%'), lambda x:
  case when regexp_matches(upper(x), '^{ESCAPE}$') then chr(('0x' || substr(x, 2, 2))::integer) else x end), '') as p from e0),
e2 as (select url, host, q, p, list_reduce(list_prepend('', string_split(p, '/')), lambda acc, x:
  case when x in ('', '.') then acc when x = '..' then regexp_replace(acc, '/[^/]*$', '') else acc || '/' || x end) as walked from e1),
v as (select url, q, string_split(host, '.') as labels, host, case when regexp_matches(p, '//|/\\.{{1,2}}(?:/|$)')
  then walked || (case when regexp_matches(p, '/\\.{{0,2}}$') then '/' else '' end) else p end as path from e2),
w as (select url, path, q, labels, host, string_split(path, '/') as dirs from v),
h as (select url, unnest(case when regexp_matches(host, '{ADDRESS}') then [host] else list_distinct([host] || [array_to_string(labels[i:], '.') for i in range(2, len(labels))]) end) as host from w),
p as (select url, unnest(list_distinct([array_to_string(dirs[1:i], '/') || '/' for i in range(1, greatest(len(dirs) - 1, 1) + 1)] || [path, path || q])) as path from w),
e as (select h.url, h.host || p.path as expression from h join p using (url)),
m as (select e.url, r.*, row_number() over (partition by e.url order by
    length(split_part(r.expression, '/', 1)) - length(replace(split_part(r.expression, '/', 1), '.', '')) desc,
    length(r.expression) - length(split_part(r.expression, '/', 1)) desc, action, rule_id) as n
  from e join rules r on e.expression = r.expression)
select page_id, pages.url, coalesce(action, 'none') as verdict, rule_id, expression from pages left join (select * from m where n = 1) b on pages.url = b.url
"""
