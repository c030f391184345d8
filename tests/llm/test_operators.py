"""Each operator against a brute-force version, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veracast.llm import html_text, licenses, media, mixing, near_dedup, packing, quality, sharding, toxicity, url_filter, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "re", "su") for b in ("la", "mo", "ne", "pi") for c in ("n", "s", "r", "tok", "d")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = " ".join(word(rng) for _ in range(60_000))
    return [
        (1, "one two three four five six seven", "en", "a", 33),
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", None),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", None, 4),
        (None, "a row without an id but with words", "en", "a", 30),
        (None, None, None, None, None),
        (6, long, "en", "c", len(long)),
        (7, "é" * 30_000, "fr", "c", 30_000),
        (8, "x", "en", "c", 1),
        (9, "$$$ ### %%% &&& word " * 30, "en", "a", 600),
    ]


def awkward(spark):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(awkward_rows(), DOCS)
    return df.select("*", F.lit(1).alias("slot"), F.lit("x").alias("_fail"), F.lit(2).alias("TEXT"), F.lit(3).alias("key"), F.lit(4).alias("_copies"), F.lit(5).alias("_in1"), F.lit(6).alias("rank"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=((1, 1, 0), (9, 0, 1), (None, 1, 1), (2, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


FILTERS = {
    "quality": lambda s, d: quality.keep_good(d),
    "toxicity": lambda s, d: toxicity.keep_ordinary(d, labels(s)),
    "near": lambda s, d: near_dedup.keep_one(d),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns_and_survive_awkward_tables(spark, name):
    df = awkward(spark)
    got = FILTERS[name](spark, df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    ids = Counter(r[0] for r in got.collect())
    assert FILTERS[name](spark, empty(spark)).count() == 0
    if name == "quality":  # blank and symbol-ridden texts go, all else stays
        assert ids == Counter({1: 2, 2: 1, None: 1, 6: 1, 7: 1, 8: 1})
    elif name == "toxicity":  # two labelled rows are no evidence
        assert sum(ids.values()) == len(awkward_rows())
    elif name == "near":  # one of the three equal texts; those without words stay
        assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, None: 2, 6: 1, 7: 1, 8: 1, 9: 1})
    else:
        assert set(ids) <= {r[0] for r in awkward_rows()}


def test_scans_survive_awkward_tables(spark):
    df, none = awkward(spark), empty(spark)
    n = len(awkward_rows())
    assert licenses.licenses(df).count() == 0 and licenses.licenses(none).count() == 0
    assert quality.quality_verdicts(df).count() == n and quality.quality_verdicts(none).count() == 0
    assert toxicity.toxicity_scores(df, labels(spark)).count() == n and toxicity.toxicity_scores(none, labels(spark)).count() == 0
    assert toxicity.toxicity_scores(df, labels(spark).limit(0)).where("is_toxic").count() == 0
    assert near_dedup.duplicates(none).count() == 0
    assert [tuple(r) for r in near_dedup.duplicates(df).collect()] == [(2, 1)]
    assert mixing.mixture(none).count() == 0 and packing.packed(none).count() == 0


# --- words ------------------------------------------------------------------


def test_words_are_the_same_wherever_they_stand():
    texts = ["One two, THREE!", None, "", "three-two\x0bone", "één ÉÉN", "x" * 1_200_000 + " one"]
    h, offset, stem = words.word_hashes(pa.array(texts), 3)
    assert offset.tolist() == [0, 3, 3, 3, 6, 8, 10]
    assert h[0] == h[5] == h[9] and h[1] == h[4] and h[2] == h[3] and h[6] == h[7]
    assert len(set(h.tolist())) == 5 and stem[0] == stem[9] and stem[2] != stem[0]
    s, offset = words.shingle_hashes(h, offset, 3)
    assert offset.tolist() == [0, 1, 1, 1, 2, 3, 4]
    table = pa.table({"t": pa.array(["ab" * 50] * 20)})
    parts = list(words.pieces(table, "t", 250))
    assert sum(p.num_rows for p in parts) == 20 and len(parts) > 5 and not list(words.pieces(table.slice(0, 0), "t"))


# --- 1 licenses -------------------------------------------------------------


def edit_distance_words(a: list[str], b: list[str]) -> int:
    """Words of a that a longest common subsequence with b lacks."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return len(a) - row[-1]


def test_licenses_are_found_and_confirmed(spark):
    rng = random.Random(1)
    texts, want = [], {}
    for i, (name, template) in enumerate(licenses.TEMPLATES.items()):
        own = template.split(" ")
        if len(own) > 30:  # a changed word is within tolerance
            own[7] = "changed"
        texts.append((i, prose(rng, 50) + "\n" + " ".join(own) + "\n" + prose(rng, 50)))
        want[i] = name
    texts += [(100, "The license of a driver is not a template. " + prose(rng, 60)), (101, prose(rng, 30)), (102, None), (103, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("line", F.lit(0))
    got = licenses.licenses(df).collect()
    assert {r.doc_id: r.license for r in got} == want and len(got) == len(want)
    scanner = licenses.Scanner()
    for r in got:  # the differences are those of an exact alignment, or near it
        own, block = licenses.words(licenses.TEMPLATES[r.license]), licenses.words(dict(texts)[r.doc_id].split("\n", 1)[1])
        assert edit_distance_words(own, block) <= r.words_lacking <= edit_distance_words(own, block) + 2
        # of all templates, confirmed ones are as close to the wording as any
        best = min(edit_distance_words(w, block) / len(w) for n, w in scanner.words.items())
        assert r.words_lacking / len(own) <= best + 0.02
    with pytest.raises(ValueError):
        licenses.Scanner({"none": "words only"})


def test_licenses_in_long_lines(spark):
    rng = random.Random(13)
    names = list(licenses.TEMPLATES)
    rows = [(i, f"{prose(rng, n)} {licenses.TEMPLATES[name]} {prose(rng, n)}".replace("\n", " ")) for i, (n, name) in enumerate((n, name) for n in (400, 10_000) for name in names)]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == dict(enumerate(names * 2)) and len(got) == len(rows)
    assert all(r.words_lacking == r.words_inserted == 0 < r.bytes_saved for r in got)


def test_licenses_in_wrapped_lines(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for width in (30, 70, 80):
        for mark in ("", "# ", " * "):
            for name, template in licenses.TEMPLATES.items():
                lines = [x for p in template.split("\n") for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
                want[len(rows)] = (name, 2)
                rows.append((len(rows), "\n".join([prose(rng, 9), "", *(mark + x for x in lines), prose(rng, 9)])))
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.license, r.line) for r in got} == want and len(got) == len(rows)


def test_deciding_words_are_not_within_tolerance():
    cc, gnu = "This work is licensed under a Creative Commons {} International License.", "This work is licensed under the GNU {}."
    gpl = licenses.TEMPLATES["GPL-3.0-or-later"]
    texts = {
        cc.format("Attribution 4.0"): "CC-BY-4.0-notice",
        cc.format("Attribution-NonCommercial 4.0"): "CC-BY-NC-4.0-long-notice",
        cc.format("Attribution-NonCommercial-ShareAlike 4.0"): "CC-BY-NC-SA-4.0-notice",
        cc.format("Attribution-NoDerivatives 4.0"): "CC-BY-ND-4.0-notice",
        cc.format("Attribution 3.0"): None,
        "Licensed under CC BY-NC-SA 4.0.": None,
        gnu.format("General Public License, version 3.0"): "GPL-3.0-notice",
        gnu.format("Lesser General Public License, version 3"): "LGPL-3.0-notice",
        gnu.format("Affero General Public License, version 3"): "AGPL-3.0-notice",
        "This work is licensed under the Eclipse Public License, version 2.": None,
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1-notice",
        "Licensed under the Mozilla License, Version 2.0.": None,
        "Released under the BSD License.": None,
        gpl: "GPL-3.0-or-later",
        gpl.replace("version 3", "version 2"): "GPL-2.0-or-later",
        gpl.replace("GNU General", "GNU Lesser General"): "LGPL-3.0-or-later",
        gpl.replace("GNU General", "GNU Library General").replace("version 3", "version 2"): None,
        gpl.replace("GNU General", "GNU Affero General"): "AGPL-3.0-or-later",
        gpl.replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License"): None,
    }
    scanner = licenses.Scanner()
    assert {t: next((x[1] for x in scanner.scan(licenses.words(t), 0.2, 16)), None) for t in texts} == texts


def test_every_license_of_a_document_is_found(spark):
    rng = random.Random(15)
    names = list(licenses.TEMPLATES)
    lists = [["MIT-notice", "Apache-2.0"], ["MIT", "GPL-3.0-or-later"], ["BSD-3-Clause"] * 3 + ["ISC"], names, names[::-1] + names]
    rows = [(i, "\n".join(licenses.TEMPLATES[x] for x in own)) for i, own in enumerate(lists)]
    rows += [(len(lists) + i, "\n".join(f"{prose(rng, 8)}\n{licenses.TEMPLATES[x]}" for x in own)) for i, own in enumerate(lists)]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, own in enumerate(lists + lists):
        found = sorted((r.line, r.license) for r in got if r.doc_id == i)
        assert [x for _, x in found] == own and len({x for x, _ in found}) == len(own)


def test_licenses_of_awkward_rows(spark):
    """Repeated rows, rows without an id, very long texts; and a paraphrase
    that names no licence isn't one, whatever else the text holds."""
    rng = random.Random(19)
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-notice"]
    long = f"{prose(rng, 60_000)}\n{mit}\n{prose(rng, 60_000)}\n{apache}"
    rows = [(1, mit), (1, mit), (None, apache), (2, long), (None, None), (3, ""), (4, "Released under the MIT terms."), (5, "Released under the MIT terms. A licensed driver.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("license"), F.lit(1).alias("TEXT"))
    got = Counter((r.doc_id, r.line, r.license) for r in licenses.licenses(df).collect())
    assert got == Counter({(1, 0, "MIT"): 2, (None, 0, "Apache-2.0-notice"): 1, (2, 1, "MIT"): 1, (2, 4 + mit.count("\n") - 1, "Apache-2.0-notice"): 1})


# --- 2 HTML -----------------------------------------------------------------


def nearest_labels(labels: list[str]) -> list[str]:
    out = []
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            out.append(x)
            continue
        found = sorted((abs(i - j), y) for j, y in enumerate(labels) if y in ("good", "bad"))
        close = {y for d, y in found if found and d == found[0][0]}
        out.append(close.pop() if len(close) == 1 else "good" if x == "near" else "bad")
    return out


def test_second_pass_is_the_nearest_decided_neighbour():
    rng = random.Random(2)
    for _ in range(500):
        x = [rng.choice(["good", "bad", "near", "short"]) for _ in range(rng.randrange(9))]
        assert html_text.second_pass(x) == nearest_labels(x)


def test_html_extraction(spark):
    main = "The story of the house is that it was on the hill and that all of us were in it for a year. " * 3
    page = f"""<!DOCTYPE html><html><head><title>no</title><script>var a = "<p>the of and</p>";</script></head><body>
    <nav><ul><li><a href='x>y'>Home</a></li><li><a>News of the day</a></li></ul></nav><h1>A story</h1><p>{main}<br>It was so.<p>{main}
    <div class=ad>Buy</div><footer>&copy; 2020 the owners of the site and all of its rights in the world of today</footer></body>"""
    text, n, good = html_text.extract(page)
    assert text.count("The story of the house") == 6 and "It was so." in text
    assert "Home" not in text and "owners" not in text and "var a" not in text and good < n
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "< 3 > 2"), (5, "u", "<script>"), (6, "u", "<div>" * 50_000 + main), (7, "u", "<a " * 20_000), (8, "u", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extracted(df).collect()
    assert len(got) == len(rows) and got[0] == got[1] and got[0].text == text
    assert got[2].text is None and [r.text for r in got[3:5]] == ["", ""] and got[6].text == ""
    assert got[7].text == " ".join(main.split()) and got[8].n_blocks <= 1
    assert html_text.extracted(df.limit(0)).count() == 0


def page_brute(parts: list[tuple[str, bool, str]]) -> str:
    """The text of a page whose blocks are (text, is all of it a link?, tag)."""
    labels = []
    for text, link, _ in parts:
        words_ = text.lower().split()
        share = sum(re.sub(r"^\W+|\W+$", "", w) in html_text.STOP_WORDS for w in words_) / len(words_)
        if link or "copyright" in text.lower():
            labels.append("bad")
        elif len(text) < 70:
            labels.append("short")
        elif share < 0.15:
            labels.append("bad")
        else:
            labels.append("good" if share >= 0.25 and len(text) >= 200 else "near")
    return "\n".join(text for (text, *_), x in zip(parts, nearest_labels(labels)) if x == "good")


def test_whole_extraction_of_made_up_pages(spark):
    rng = random.Random(20)
    pages, want, kinds = [], {}, Counter()
    for i in range(300):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            stop = rng.choice([0, 0.1, 0.2, 0.3, 0.6])
            text = " ".join(rng.choice(["the", "of", "und", "que", "with"]) if rng.random() < stop else word(rng) for _ in range(rng.choice([2, 8, 15, 40, 90])))
            parts.append((text + rng.choice(["", ".", "!", " copyright 2020"]), rng.random() < 0.2, rng.choice(["p", "div", "li", "h2", "td", "blockquote"])))
        body = "".join(f"<{tag} class='a>b'>{'<a href=x>' if link else '<b>' * (k % 2)}{text}{'</a>' if link else '</b>' * (k % 2)}</{tag}>{rng.choice(['', '<!-- <p>the of and</p> -->', '<script>var a = 1 < 2;</script>', chr(10)])}" for k, (text, link, tag) in enumerate(parts))
        pages.append((i, f"http://x/{i}", f"<html><head><title>t</title></head><body>{body}</body></html>"))
        want[i] = (page_brute(parts), len(parts))
    got = html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.text, r.n_blocks) for r in got} == want and sum(bool(x) for x, _ in want.values()) > 100


def test_unclosed_elements_do_not_swallow_the_page():
    main = "The story of the house is that it was on the hill and that all of us were in it for a year. " * 3
    want = " ".join(main.split())
    closed = [f"<{x}>gone of the <b>page</b></{x}>" for x in ("svg", "math", "noscript", "object", "iframe", "template")]
    opened = ['<svg viewBox="0 0 1 1"/>', "<math/>", "<svg />", *(x.split(">")[0] + ">" for x in closed), "<svg><svg></svg>", *closed]
    for x in opened:
        got = html_text.extract(f"<html><head><title>no</title></head><body><p>{main}</p>{x}<p>{main}</p><svg>gone</svg><p>{main}</p></body></html>")[0]
        assert got.count(want) == 3 and "gone" not in got and "no\n" not in got
    for x in ("<head><title>no <b>of</title><meta charset=u><script>var a</script>", "<head><style>b {}</style>", "<head><svg/>", "<head>", "<head><noscript><img></noscript>"):
        assert html_text.extract(f"<html>{x}<p>{main}</p><div>{main}</div>")[0] == f"{want}\n{want}"
    assert html_text.extract(f"<html><head><title>no</title>{main}")[0] == want
    n = 20_000
    assert html_text.extract("<svg>" * n + f"<p>{main}</p>" + "<template>" * n)[0] == want
    assert html_text.extract("<svg>" * n + "<p>gone</p>" + "</svg>" * n + f"<p>{main}</p>")[0] == want


# --- 3 URLs -----------------------------------------------------------------


def canonical(url: str) -> tuple[str, str, str]:
    """host, path and query, character by character."""
    m = re.match(url_filter.PARTS, url.strip(" "))
    if not m:
        return "", "", ""
    host = ".".join(x for x in re.sub(r"\.+", ".", m[1].lower()).split(".")).strip(".")
    path, at = "", 0
    raw = m[2] or "/"
    while at < len(raw):
        code = raw[at + 1 : at + 3]
        if raw[at] == "%" and re.fullmatch("[0-9A-Fa-f]{2}", code) and (chr(int(code, 16)).isascii() and chr(int(code, 16)).isalnum() or chr(int(code, 16)) in "-._~"):
            path += chr(int(code, 16))
            at += 3
        else:
            path += raw[at]
            at += 1
    kept: list[str] = []
    parts = path.split("/")
    for x in parts:
        if x == "..":
            kept = kept[:-1]
        elif x not in ("", "."):
            kept.append(x)
    folder = parts[-1] in ("", ".", "..")
    return host, "/" + "/".join(kept) + ("/" if folder and kept else ""), m[3] or ""


def url_brute(url: str | None, rules) -> tuple:
    host, path, query = canonical(url) if url else ("", "", "")
    address = re.match(url_filter.ADDRESS, host)
    best = None
    for rule, expression, action in rules:
        if not host or expression is None:
            continue
        h, _, p = expression.partition("/")
        ok_host = host == h or not address and host.endswith("." + h) and "." in h
        ok_path = "/" + p in (path, path + query) or ("/" + p).endswith("/") and path.startswith("/" + p)
        if ok_host and ok_path:
            rank = (-h.count("."), -len(expression) + len(h), action, rule)
            best = min(best, (rank, rule, expression, action)) if best else (rank, rule, expression, action)
    return (best[3], best[1], best[2]) if best else ("none", None, None)


URL_RULES = [(1, "example.org/", "block"), (2, "b.example.org/p/", "allow"), (3, "b.example.org/p/", "block"), (4, "a.b.example.org/p/q.html", "block"), (5, "example.org/p?a=1", "allow"), (6, "org/", "block"), (7, "x.example.org/p", "block"), (8, None, "block"), (9, "2.3/", "block"), (10, "10.1.2.3/a/", "block"), (11, "[::1]/", "block"), (12, "other.net/p/q/r/", "block"), (13, "other.net/p/", "allow")]


def test_url_verdicts(spark):
    rng = random.Random(3)
    hosts = ["a.b.example.org", "b.example.org", "EXAMPLE.org", "org", "x.example.org.", "other.net", "10.1.2.3", "[::1]", "..b..example.org", "1.2.3"]
    paths = ["", "/", "/p", "/p/", "/p/q.html", "/p/q/r", "//p", "/P", "/p/../p/./q/r/", "/..", "/%70/x", "/p%2Fq", "/%7ex/../p/", "/p%", "/p%2", "/a/b", "/x/..", "/x/%2e%2E/p/q//r/s"]
    urls = [f"{s}{u}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(paths)}{rng.choice(['', '?a=1', '#f'])}" for s in ("http://", "https://", "//") for u in ("", "me:pw@") for _ in range(70)]
    urls += [None, "", "no url", "http://", "mailto:x@y.z", "http:///p", urls[0], " http://b.example.org/p/ ", "http://user@[::1]:8080/x"]
    long = [f"http://{'a.' * 30_000}b.example.org/{'p/' * 50_000}x", f"http://example.org/{'x/' * 3000}{'../' * 3000}p?a=1", f"http://other.net/p/q/r/{'%70' * 20_000}"]
    urls += long
    df = spark.createDataFrame([(i if i % 7 else None, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule_id", F.lit(0)).withColumn("digest", F.lit(0)).withColumn("host", F.lit(0))
    want = Counter((i if i % 7 else None, u, *url_brute(u, URL_RULES)) for i, u in enumerate(urls))
    assert {v for _, u, v, *_ in want if u in long} == {"allow", "block"} and len({r for *_, r, _ in want}) > 8
    for limits in ({}, {"most_urls": 0}, {"most_urls": 5, "hot": 2}, {"most_urls": 30, "hot": 2}):
        got = url_filter.url_verdicts(df, URL_RULES, **limits).collect()
        assert Counter((r.page_id, r.url, r.verdict, r.rule_id, r.expression) for r in got) == want
    assert url_filter.url_verdicts(df.limit(0), URL_RULES).count() == 0
    none = spark.createDataFrame([], "rule_id long, expression string, action string")
    assert url_filter.url_verdicts(df, none).where("verdict = 'none'").count() == len(urls)


def test_addresses_expand_to_themselves():
    assert url_brute("http://10.1.2.3/a/b", URL_RULES) == ("block", 10, "10.1.2.3/a/")
    assert url_brute("http://1.2.3/", URL_RULES) == ("block", 9, "2.3/") and url_brute("http://9.1.2.3/", URL_RULES)[0] == "none"


def test_url_sql_agrees_on_awkward_urls(spark, tmp_path):
    import duckdb

    urls = [f"http://{h}{p}" for h in ("m.free-bets.example.com", "X.CHEAP-PILLS..example.com.", "10.1.2.3", "[::1]:80", "blog.ththon.example.net") for p in ("", "/de/x", "/de/../fr/", "/%64e/x", "//de//y", "/fr/65.html", "/fr/./65.html?q", "/d%", "/..", "/a/..")]
    df = spark.createDataFrame(list(enumerate([*urls, None, "", "no"])), "page_id long, url string")
    pages = df.toPandas()  # noqa: F841, duckdb reads it by name
    want = duckdb.connect().execute(url_filter.SQL).fetchall()
    got = url_filter.url_verdicts(df).collect()
    assert Counter((r.page_id, r.url, r.verdict, r.rule_id, r.expression) for r in got) == Counter(want) and len({x[3] for x in want}) > 5


# --- 4 media ----------------------------------------------------------------


def test_thumbnails_are_the_block_means():
    rng = np.random.default_rng(0)
    for height, width in ((64, 64), (1, 1), (17, 33), (8, 200)):
        for restart in (0, 2):
            grey = np.clip(np.cumsum(rng.normal(0, 9, (height, width)), 1) + 128, 0, 255).astype(np.uint8)
            w, h, n, thumb = media.decode(media.encode(grey, 90, restart))
            padded = np.pad(grey, ((0, -height % 8), (0, -width % 8)), mode="edge")
            means = padded.reshape(padded.shape[0] // 8, 8, -1, 8).mean((1, 3))
            assert (w, h, n) == (width, height, 1) and np.abs(means - thumb).max() <= 1.0


def test_colour_with_subsampled_chroma():
    """Interleaved scan, 4:2:0: the grey encoder's blocks put together by hand."""
    grey = np.kron(np.array([[30, 60], [90, 200]]), np.ones((8, 8))).astype(np.uint8)
    dc, ac = media._DC, media._AC
    quant = 8
    bits = ""

    def put(code):
        nonlocal bits
        bits += f"{code[0]:0{code[1]}b}"

    def block(value, before):
        nonlocal bits
        d = value - before
        size = abs(d).bit_length()
        put(dc[size])
        if size:
            bits += f"{d if d > 0 else d + (1 << size) - 1:0{size}b}"
        put(ac[0])

    levels = [int(x) - 128 for x in (30, 60, 90, 200)]
    before = 0
    for v in levels:
        block(v, before)
        before = v
    block(10, 0), block(-5, 0)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    data = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, b"\0" + bytes([quant] * 64)) + part(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + part(0xC4, b"\0" + b"".join(media._DC_CODE)) + part(0xC4, b"\x10" + b"".join(media._AC_CODE)) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    w, h, n, thumb = media.decode(data)
    assert (w, h, n) == (16, 16, 3) and thumb.tolist() == [[30, 60], [90, 200]] and grey.shape == (16, 16)


def test_media_columns(spark):
    rng = np.random.default_rng(1)
    good = media.encode(rng.integers(0, 255, (40, 24)).astype(np.uint8))
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, good[:200]), (5, b"GIF89a"), (6, progressive), (None, good), (7, good[:-60]), (8, b"\xff\xd8\xff\xd9"), (9, b"\xff\xd8" + b"\xff" * 50_000)]
    df = spark.createDataFrame(rows, "media_id long, data binary").withColumn("status", F.lit(1))
    got = media.media_columns(df).collect()
    assert [r.status for r in got] == ["ok", "ok", "missing", "empty", "corrupt", "corrupt", "unsupported", "ok", "corrupt", "corrupt", "corrupt"]
    assert (got[0].width, got[0].height, got[0].thumb_width, got[0].thumb_height, len(got[0].thumb)) == (24, 40, 3, 5, 15) and got[0] == got[1]
    assert got[0].thumb_md5 == hashlib.md5(bytes(got[0].thumb)).hexdigest() and got[2].width is None
    assert media.media_columns(df.limit(0)).count() == 0
    for i in range(400):  # no damage raises anything else
        bad = bytearray(good)
        bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
        try:
            media.decode(bytes(bad))
        except (media.Corrupt, media.Unsupported):
            pass


def test_embeddings_come_back(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 64).tolist(), 0) for i in range(20)] + [(20, None, 0), (21, [], 0), (22, [None] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.media_id: r for r in media.media_columns(media.embedding_media(df)).collect()}
    for i, e, _ in rows[:20]:
        level = np.frombuffer(bytes(got[i].thumb), np.uint8).astype(float) / 255 * 6 - 3
        assert np.abs(level - np.clip(e, -3, 3)).max() < 0.12
    assert got[20].status == got[21].status == "missing" and got[22].status == "ok"


# --- 5 quality --------------------------------------------------------------


def quality_brute(text: str | None) -> tuple[list[bool], list[bool]]:
    t = text or ""
    n, gaps = len(t), sum(c in " \n\t\r" for c in t)
    count = lambda chars: sum(c in chars for c in t)
    distinct = len(set(re.split(r"[ \n\t\r]", t)))
    sym, cap, exc, dig = count(quality.SYMBOLS), count(quality.UPPER), count("!"), count("0123456789")
    hard = [n == gaps, sym >= 0.3 * (gaps + 1), cap > 0.3 * n, exc > 0.2 * (gaps + 1) and gaps >= 4, gaps >= 19 and distinct**2 < 4 * (gaps + 1), n - gaps > 20 * (gaps + 1) and gaps >= 4, dig > 0.3 * n]
    soft = [n == gaps, sym >= 0.2 * (gaps + 1), cap > 0.2 * n, exc > 0.1 * (gaps + 1) and gaps >= 4, gaps >= 19 and distinct**2 < 6 * (gaps + 1), n - gaps > 15 * (gaps + 1) and gaps >= 4, dig > 0.2 * n]
    return hard, soft


def test_quality_verdicts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        host = f"h{i % 5}"
        junk = i % 5 == 0 and i % 10 < 9 or i % 5 == 1 and i % 4 == 0
        text = rng.choice(["SHOUT!! LOUD!! " * 10, "same " * 40, "a | b | c | " * 9, "12345 678 " * 9]) if junk else prose(rng, rng.randrange(1, 200))
        rows.append((i, text, "en", host, len(text)))
    rows += awkward_rows()
    got = quality.quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(any(quality_brute(r[1])[0]))
    mean = sum(map(sum, hosts.values())) / len(rows)
    var = np.var([np.mean(x) for x in hosts.values()])
    strength = min(1e6, max(1.0, mean * (1 - mean) / var - 1))
    rate = {h: (sum(x) + mean * strength) / (len(x) + strength) for h, x in hosts.items()}
    verdict = {h: "trusted" if x < 0.02 else "bad" if x > 0.5 else "mixed" for h, x in rate.items()}
    want = Counter()
    for r in rows:
        hard, soft = quality_brute(r[1])
        v = verdict[r[3]]
        rejected = sum(hard) >= 2 if v == "trusted" else sum(hard) >= 1 or v == "bad" and sum(soft) >= 2
        want[r[0], r[3], sum(1 << k for k, x in enumerate(hard) if x), sum(soft), round(rate[r[3]], 5), v, rejected] += 1
    assert Counter((r.doc_id, r.host, r.failed, r.n_near, round(r.host_rate, 5), r.host_verdict, r.rejected) for r in got) == want
    assert {"bad", "mixed"} <= set(verdict.values())
    # the shuffled join gives the same
    df = spark.createDataFrame(rows, DOCS)
    good = Counter(tuple(r) for r in quality.keep_good(df).collect())
    left = Counter(r.doc_id for r in got if not r.rejected)
    assert Counter(r[0] for r in good.elements()) == left
    for limits in ({"most_hosts": 0}, {"most_hosts": 1, "hot": 10}, {"most_hosts": 6, "hot": 40}):
        again = quality.quality_verdicts(df, **limits)
        assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
        assert Counter(tuple(r) for r in quality.keep_good(df, **limits).collect()) == good


# --- 6 toxicity -------------------------------------------------------------


def toxic_corpus(seed: int, n: int = 900) -> pd.DataFrame:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = prose(rng, rng.randrange(20, 200)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(own) // 40)):
                own.insert(rng.randrange(len(own)), rng.choice(["vilefool", "rotbrain", "scumlord" + rng.choice("abcdefgh"), "filthpig"]))
        rows.append((i, " ".join(own), int(toxic)))
    return pd.DataFrame(rows, columns=["id", "text", "toxic"])


def test_toxicity_held_out():
    train, test = toxic_corpus(1), toxic_corpus(2)
    model = toxicity.fit(train)
    n, ordinary, bad, score = model.scores(pa.array(test["text"]))
    found, toxic = model.toxic(n, score), test["toxic"].to_numpy() == 1
    assert found[toxic].mean() >= 0.98 and found[~toxic].mean() <= 0.01
    assert np.array_equal(score, bad - ordinary)
    # ordinary words offset toxic ones, and no word isn't toxic
    one = pa.array(["rotbrain vilefool", "rotbrain vilefool " + "balan " * 2000, "balan", "", None])
    n, ordinary, bad, score = model.scores(one)
    assert model.toxic(n, score).tolist() == [True, False, False, False, False] and score[0] > 3 and (score[3:] == 0).all()


def brute_model(texts: list[list[list[str]]], ratio: float):
    """Interpolated Kneser-Ney models of [ordinary, toxic] texts, by dictionaries:
    functions of (class, word before or None, word)."""
    stem = lambda w: w[: toxicity.STEM]
    before, third = [], []
    for part in texts:
        one, two = defaultdict(set), defaultdict(set)
        for text in part:
            for i, w in enumerate(text):
                v = text[i - 1] if i else None
                one[w].add(v)
                two[v, w].add(text[i - 2] if i > 1 else None)
        before.append(Counter({w: len(x) for w, x in one.items()}))
        third.append(Counter({k: len(x) for k, x in two.items()}))

    def discount(count):
        n1, n2 = (sum(x == k for x in count.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 1.0

    def telling(counts):
        rate = lambda c, x: (counts[c][x] + 1) / sum(counts[c].values())
        return {x for x in counts[0] | counts[1] if rate(0, x) > ratio * rate(1, x) or rate(1, x) > ratio * rate(0, x)}

    def level(counts, tell):
        kept = [{x: max(c[x] - discount(c), 0) if x in tell else 0 for x in counts[0] | counts[1]} for c in counts]
        left = [Counter({x: counts[c][x] - kept[c][x] for x in kept[c]}) for c in (0, 1)]
        total = [sum(c.values()) for c in counts]
        return [{x: k / total[c] for x, k in kept[c].items()} for c in (0, 1)], [1 - sum(kept[c].values()) / total[c] for c in (0, 1)], left

    kept, rest, left = level(before, telling(before))
    stems = [Counter() for _ in (0, 1)]
    for c in (0, 1):
        for w, x in left[c].items():
            stems[c][stem(w)] += x
    stem_tell = telling(stems)
    stem_kept, stem_rest, stem_left = level(stems, stem_tell)
    pooled = left[0] + left[1]
    within = Counter()
    for w, x in pooled.items():
        within[stem(w)] += x
    shared = {s: sum(stem_left[c][s] for c in (0, 1)) if s in stem_tell else x + 1 for s, x in within.items()}
    total = sum(shared.values()) + 1
    words, pairs = before[0] | before[1], telling(third)

    def begin(c, s):
        return stem_kept[c][s] + stem_rest[c] * shared[s] / total

    def lower(c, w):
        if w in words:
            return kept[c][w] + rest[c] * begin(c, stem(w)) * pooled[w] / (within[stem(w)] + 1)
        if stem(w) in within:
            return rest[c] * begin(c, stem(w)) / (within[stem(w)] + 1) / len(words)
        return rest[c] * stem_rest[c] / total / len(words)

    def probability(c, v, w):
        mine = {x: n for x, n in third[c].items() if x[0] == v}
        own = {x: max(third[c][x] - discount(third[c]), 0) for x in pairs if x[0] == v}
        if not own or not mine:
            return lower(c, w)
        n = sum(mine.values())
        return own.get((v, w), 0) / n + (1 - sum(own.values()) / n) * lower(c, w)

    return probability, words, pairs


def test_models_against_dictionaries():
    """Words, beginnings, backoff, bigrams and the comparison, on a small
    corpus in which some pairs of ordinary words tell the classes apart."""
    rng = random.Random(3)
    texts: list[list[list[str]]] = [[], []]
    for i in range(240):
        own = [rng.choice("abcdefghijklmnop") + rng.choice(["", "ness", "ing", "stone"]) for _ in range(rng.randrange(0, 40))]
        for _ in range(len(own) // 8 * (i % 4 == 0)):
            at = rng.randrange(len(own))
            own[at:at] = rng.choice([["b", "cing"], ["vilefool"], ["vile" + "f" + rng.choice("xyz")], [rng.choice("abcd"), "rot"]])
        texts[i % 4 == 0].append(own)
    hashed = []
    for part in texts:
        h, o, s = words.word_hashes(pa.array([" ".join(x) for x in part]), toxicity.STEM)
        hashed.append((h, o, s))
    for ratio in (2.0, 6.0):
        model = toxicity._estimate(toxicity.counted(hashed), ratio)
        probability, known, pairs = brute_model(texts, ratio)
        assert pairs and len(model.pair) == len(pairs) and len(model.word) == len(known)
        test = [x for part in texts for x in part[:25]] + [["vilefresh", "b", "cing", "zzz", "vilefool"], ["rot"], ["new", "stones", "anew"]]
        n, ordinary, bad, score = model.scores(pa.array([" ".join(x) for x in test]))
        for text, k, a, b, apart in zip(test, n, ordinary, bad, score):
            assert k == len(text)
            want = [sum(np.log(probability(c, text[i - 1] if i else None, w)) for i, w in enumerate(text)) / max(len(text), 1) for c in (0, 1)]
            assert np.isclose(a, want[0]) and np.isclose(b, want[1]) and np.isclose(apart, want[1] - want[0])
        # no more than one in all, and a context's words as much as those without it
        for v in [None, "b", "a", "vilefool"]:
            for c in (0, 1):
                assert sum(probability(c, v, w) for w in known) <= 1 + 1e-9
        assert (np.exp(model.word_ll).sum(axis=1) <= 1 + 1e-9).all()
    assert toxicity._discount(np.array([1, 1, 1, 2, 7])) == 3 / 5 and toxicity._discount(np.array([4.0])) == 1


def test_threshold_has_the_fewest_errors():
    rng = random.Random(17)
    for _ in range(300):
        score = np.array([rng.randrange(12) / 4 for _ in range(rng.randrange(2, 12))])
        toxic = np.array([rng.random() < 0.2 + x / 4 for x in score])
        errors, _, threshold = toxicity._threshold(score, toxic)
        errors_at = lambda t: int(((score > t) != toxic).sum())
        if len(set(score.tolist())) > 1:
            assert errors == errors_at(threshold) == min(errors_at((a + b) / 2) for a, b in zip(sorted(set(score.tolist())), sorted(set(score.tolist()))[1:]))


def test_shared_counts_are_of_all_documents(spark):
    train = toxic_corpus(4, 120)
    docs = [(i, t, "en", "s", 0) for i, t in enumerate([*train["text"], "balan balanx other words", None, ""])] + awkward_rows()
    word, stem = toxicity._vocabulary(train)
    vocabulary = spark.sparkContext.broadcast((word, stem))
    got = toxicity.shared_counts(spark.createDataFrame(docs, DOCS).repartition(3), vocabulary)
    h, _, s = words.word_hashes(pa.array([d[1] for d in docs]), toxicity.STEM)
    count = Counter(h.tolist())
    assert got.by_word.tolist() == [count[x] for x in word.tolist()]
    other = Counter(b for a, b in zip(h.tolist(), s.tolist()) if a not in set(word.tolist()))
    assert got.by_stem[:-1].tolist() == [other[x] for x in stem.tolist()] and got.by_word.sum() + got.by_stem.sum() == len(h)
    # what tells the classes apart doesn't depend on them
    a, b = (toxicity.fit(train, shared=x) for x in (None, got))
    test = pa.array(toxic_corpus(5, 120)["text"])
    assert np.corrcoef(a.scores(test)[3], b.scores(test)[3])[0, 1] > 0.99


def test_toxicity_operator(spark):
    train = toxic_corpus(1)
    docs = spark.createDataFrame([(int(i), t, "en", "s", len(t)) for i, t in zip(train["id"], train["text"])], DOCS)
    marks = spark.createDataFrame([(int(i), 1, int(x)) for i, x in zip(train["id"], train["toxic"])], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    toxic = {int(i) for i, x in zip(train["id"], train["toxic"]) if x}
    found = {i for i, r in got.items() if r.is_toxic}
    assert len(found & toxic) >= 0.98 * len(toxic) and len(found - toxic) <= 3
    kept = {r.doc_id for r in toxicity.keep_ordinary(docs, marks).collect()}
    assert kept == set(got) - found


# --- 7 sharding -------------------------------------------------------------


def test_rebalancing_moves_little_and_evens_out():
    rng = random.Random(7)
    size = [rng.randrange(1, 1000) for _ in range(512)]
    start = [s % 8 for s in range(512)]
    even = sharding.rebalanced(start, size, 8)
    load = [sum(s for s, o in zip(size, even) if o == i) for i in range(8)]
    assert max(load) <= sum(size) / 8 * 1.02 and sharding.rebalanced(even, size, 8) == even
    fewer = sharding.rebalanced(even, size, 7)
    load = [sum(s for s, o in zip(size, fewer) if o == i) for i in range(7)]
    assert max(load) <= sum(size) / 7 * 1.02 and all(a == b or b < 7 for a, b in zip(even, fewer))
    more = sharding.rebalanced(even, size, 9)
    moved = sum(s for s, a, b in zip(size, even, more) if a != b)
    assert moved <= 1.2 * sum(size) / 9
    hot = [10**6] + [1] * 511
    assert sharding.rebalanced(start, hot, 8).count(0) < 64 and sharding.rebalanced(start, [0] * 512, 8) == start


def test_sharded(spark, tmp_path):
    path = str(tmp_path / "map")
    df = awkward(spark)
    got = sharding.sharded(df, path, slots=64, shards=4).collect()
    want = Counter()
    for doc_id, text, *_ in awkward_rows():
        key = str(doc_id) if doc_id is not None else hashlib.md5(text.encode()).hexdigest() if text is not None else ""
        want[doc_id, int(hashlib.md5(key.encode()).hexdigest()[:7], 16) % 64, len((text or "").encode())] += 1
    assert Counter((r.doc_id, r.slot, r.n_bytes) for r in got) == want
    kept = sharding.SlotMap(spark, path, 64)
    versions = kept.versions()
    owner = kept.read()
    assert all(owner[r.slot] == r.shard and r.map_version == versions[-1] for r in got)
    first = kept.read(1)
    sharding.sharded(df, path, slots=64, shards=3)
    assert kept.versions() == [*versions, versions[-1] + 1] and kept.read(1) == first and max(kept.read()) == 2
    assert sharding.sharded(empty(spark), str(tmp_path / "none")).count() == 0
    # a version that was begun and not committed is left alone
    (tmp_path / "map" / f"version={versions[-1] + 2}").mkdir()
    assert kept.write(first) == versions[-1] + 3 and kept.read() == first and kept.versions()[-2:] == [versions[-1] + 1, versions[-1] + 3]


# --- 8 packing --------------------------------------------------------------


def test_fullest_is_the_best_subset():
    rng = random.Random(8)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(9)))
        room = rng.randrange(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = packing.fullest(dict(counts), room)
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)
        assert all(counts[k] >= v for k, v in got.items())


def test_patterns_use_up_the_multiset():
    rng = random.Random(9)
    counts = Counter(min(64, int(rng.expovariate(0.05)) + 1) for _ in range(5000))
    found = packing.patterns(dict(counts), 64)
    used = Counter()
    for chosen, times in found:
        assert sum(k * v for k, v in chosen.items()) <= 64
        for k, v in chosen.items():
            used[k] += v * times
    assert used == counts and len(found) < 200
    windows, total = sum(t for _, t in found), sum(k * v for k, v in counts.items())
    assert windows <= total / 64 * 1.01 + 1


def test_packed(spark):
    rng = random.Random(10)
    rows = awkward_rows() + [(i, prose(rng, rng.randrange(1, 300)), "en", "a", 1) for i in range(100, 400)]
    # a third of the rows are one row, and as many have one length
    rows += [(77, prose(rng, 31), "en", "a", 1)] * 200 + [(None, prose(rng, 300), "en", "a", 1)] * 30 + [(i, prose(rng, 128 * (i % 4 + 1)), "en", "a", 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, DOCS).withColumn("window", F.lit(0)).withColumn("bucket", F.lit(0))
    got = packing.packed(df, capacity=128, buckets=5).collect()
    tokens = Counter()
    for doc_id, text, *_ in rows:
        tokens[doc_id] += len(re.findall(r"[^ \t\n\x0b\f\r]+", text or ""))
    packed = Counter()
    windows = defaultdict(list)
    for r in got:
        packed[r.doc_id] += r.n_tokens
        assert r.start == r.piece * 128
        windows[r.window].append((r.offset, r.n_tokens))
    assert packed == +tokens
    for parts in windows.values():  # side by side, from 0 on, within the window
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128
    assert sorted(windows) == list(range(len(windows))) and len(windows) <= sum(tokens.values()) / 128 * 1.02 + 1


# --- 9 mixing ---------------------------------------------------------------


def test_mixing_follows_weights(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice("aaaaaabbc"), 0) for i in range(600)] + awkward_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit(0)).withColumn("_step", F.lit(0))
    weights = {"a": 1.0, "b": 2.0, "c": 0.5}
    budget = 60_000
    got = mixing.mixture(df, weights, budget).collect()
    size, count = Counter(), Counter()
    for r in rows:
        size[r[3]] += len(r[1] or "")
        count[r[3]] += 1
    emitted = Counter(r.source for r in got)
    for source in size:
        expected = count[source] * weights.get(source, 0) / 3.5 * budget / size[source]
        assert abs(emitted[source] - expected) < 1.01
        copies = Counter(r.doc_id for r in got if r.source == source and r.copy == 1 and r.doc_id not in (None, 1))
        per = expected / count[source]
        each = Counter(r.doc_id for r in got if r.source == source and r.doc_id not in (None, 1))
        assert all(int(per) <= n <= int(per) + 1 for n in each.values()) and all(n == 1 for n in copies.values())
    full = mixing.mix(df, weights, budget)
    assert full.columns == df.columns and full.dtypes == df.dtypes
    assert Counter((r[0], r[3]) for r in full.collect()) == Counter((r.doc_id, r.source) for r in got)
    assert mixing.mixture(df, {}).count() == 0


def mixture_brute(rows: list[tuple], weights: dict, budget: int, buckets: int) -> Counter:
    """(doc_id, source, copy) by one running sum a source."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    number = lambda x: int(md5(x)[:7], 16)
    own = defaultdict(list)
    for doc_id, text, _, source, *_ in rows:
        key = str(doc_id) if doc_id is not None else text or ""
        own[source].append((number(key) % buckets, doc_id is not None, doc_id or 0, md5(text or ""), doc_id, len(text or "")))
    size = {s: sum(x[-1] for x in held) for s, held in own.items()}
    weight = {s: round(weights.get(s, 0) * 1_000_000) * (size[s] > 0) for s in own}
    out: Counter = Counter()
    for s, held in own.items():
        step = int(weight[s] / sum(weight.values()) * budget / size[s] * mixing.UNIT) if weight[s] else 0
        at = number(f"7:{s or ''}") % mixing.UNIT
        for *_, doc_id, _ in sorted(held, key=lambda x: x[:4]):
            copies = (at + step) // mixing.UNIT - at // mixing.UNIT
            at += step
            out.update((doc_id, s, k + 1) for k in range(copies))
    return out


def test_mixing_of_repeated_rows_and_a_hot_source(spark):
    """A third of all rows are one row, most are of one source."""
    rng = random.Random(18)
    rows = [(i, prose(rng, rng.randrange(1, 40)), "en", rng.choice("aaaaaaab"), 0) for i in range(300)]
    rows += [(7, rows[7][1], "de", rows[7][3], 1)] * 3 + [rows[9]] * 2 + [(None, None, None, "a", None)] * 200 + [(None, f"text {i % 5}", "en", None, i) for i in range(20)] + awkward_rows()
    df = spark.createDataFrame(rows, DOCS)
    for weights, budget in (({"a": 1.0, "b": 3.0, "c": 0.1}, 90_000), ({"a": 1.0, "b": 1.0}, 4_000)):
        want = mixture_brute(rows, weights, budget, 8)
        assert Counter(map(tuple, mixing.mixture(df, weights, budget, buckets=8).collect())) == want
        full = Counter(tuple(r) for r in mixing.mix(df, weights, budget, buckets=8).collect())
        assert Counter((r[0], r[3]) for r in full.elements()) == Counter((d, s) for d, s, _ in want.elements())
        assert set(full) <= set(rows)
    few = spark.createDataFrame([(1, "k", 3, 1, 25), (2, "k", 1, 1, 3)], "_id long, _source string, _n long, _step long, _copies long")
    assert Counter(r["_id"] for r in mixing._each(few, 10).collect()) == Counter({1: 25, 2: 3})


# --- 10 near-dedup ----------------------------------------------------------


def jaccard(a: str, b: str, k: int = 3) -> float:
    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def families(seed: int, n: int, copies: int, rate: float, first: int = 0, passage: str = "") -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        own = (passage + " " + " ".join(word(rng) for _ in range(rng.randrange(60, 160)))).split()
        for _ in range(copies):
            text = [word(rng) if rng.random() < rate else w for w in own]
            out.append((first + len(out), " ".join(text), "en", "s", 0))
    return out


def groups_of(pairs) -> dict[int, int]:
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


@pytest.mark.parametrize("limits", [(400, 200_000), (8, 200_000), (8, 30)])
def test_near_duplicates_against_all_pairs(spark, limits):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = families(1, 40, 3, 0.05) + families(2, 60, 1, 0, 1000, passage) + families(3, 1, 60, 0.04, 2000)
    got = near_dedup.duplicates(spark.createDataFrame(rows, DOCS), limit=limits[0], most_in_task=limits[1]).collect()
    group = groups_of((r.doc_id, r.kept_doc_id) for r in got)
    assert all(r.kept_doc_id < r.doc_id for r in got) and all(group[r.doc_id] == r.kept_doc_id for r in got)
    sure = missed = 0
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            s = jaccard(a[1], b[1])
            if s >= 0.6:
                sure += 1
                missed += group.get(a[0], a[0]) != group.get(b[0], b[0])
    assert sure > 1000 and missed <= 0.05 * sure
    assert not [r for r in got if 1000 <= r.doc_id < 2000]  # a shared passage is no copy


def test_recall_at_moderate_similarity(spark):
    rows = families(4, 400, 2, 0.055)
    text = {r[0]: r[1] for r in rows}
    pairs = [(i, i + 1) for i in range(0, 800, 2) if jaccard(text[i], text[i + 1]) >= 0.55]
    got = {(r.kept_doc_id, r.doc_id) for r in near_dedup.duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(pairs) > 30 and sum(p in got for p in pairs) >= 0.9 * len(pairs)


def test_rows_like_one_that_leaves_a_node_are_compared_with_it(spark):
    rng = np.random.default_rng(16)
    need = near_dedup.needed(0.5)
    pivot = rng.integers(0, 128, near_dedup.COORDINATES).astype(np.uint8)
    sketch, want = [pivot], set()
    for i in range(30):
        x = pivot.copy()
        x[rng.permutation(128)[:45]] += 128  # like the pivot
        y = x.copy()
        y[np.flatnonzero(x == pivot)[:40]] ^= 192  # like x only
        assert (x == pivot).sum() >= need > (y == pivot).sum() and (x == y).sum() >= need
        sketch += [x, y]
        want.add(2 * i + 2)
    sketch += list(rng.integers(0, 256, (30, 128)).astype(np.uint8))
    nodes = spark.createDataFrame([(7, i, bytearray(s.tobytes())) for i, s in enumerate(sketch)], "key long, id long, sketch binary")
    big = spark.createDataFrame([(7,)], "key long")
    for most in (50_000, 9):
        edges, children = near_dedup._split(nodes, big, 0.5, 2, most)
        found = {tuple(r) for e in edges for r in e.collect()}
        assert found == {(i, 0) for i in range(1, 61)}
        assert {r.id for r in children.collect()} == want | set(range(61, 91))
    # in a task: 0 and 3 are compared with all, 1 is like both
    rows = np.stack([pivot, pivot, pivot, pivot])
    rows[1, :50] += 128
    rows[3, :50] += 128
    rows[3, 50:75] += 128
    rows[2] ^= 85
    edges = near_dedup.compare(np.array([4, 5, 6, 7]), rows, need, np.array([True, False, False, True]))
    assert groups_of(edges) == {4: 4, 5: 4, 7: 4}


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(7, 7), (400, 399), (400, 399)]
    want = {x: r for x, r in groups_of(edges).items() if x != r}
    got = near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.u: r.v for r in got} == want and len(got) == len(want)
    assert near_dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_id_with_two_texts(spark):
    rows = families(5, 2, 1, 0) + families(6, 1, 1, 0, 0)
    got = near_dedup.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == [0, 1]


def test_groups_do_not_depend_on_what_fits_a_task(spark):
    """Edge for edge: large nodes are split across tasks with the same groups."""
    rows = families(31, 25, 4, 0.04) + families(32, 1, 80, 0.05, 3000) + families(33, 60, 1, 0, 5000)
    df = spark.createDataFrame(rows, DOCS)
    want = {}
    for most in (200_000, 30):
        got = {r.doc_id: r.kept_doc_id for r in near_dedup.duplicates(df, limit=20, most_in_task=most).collect()}
        want = want or got
        assert got == want
    near = groups_of((a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if jaccard(a[1], b[1]) >= 0.6)
    assert sum(want.get(x, x) != r for x, r in near.items()) <= 0.02 * len(near)


# --- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    good = families(20, 60, 1, 0) + families(21, 10, 3, 0.03, 500)
    junk = [(900 + i, "SHOUT!! LOUD!! " * 20, "en", "s", 0) for i in range(5)]
    rows = good + junk + awkward_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).drop("text").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert not {r.doc_id for r in kept.collect()} & {r[0] for r in junk}
    assert {r[0] for r in good} <= {r.doc_id for r in kept.collect()}
    one = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} & set(range(500, 530)) == set(range(500, 530, 3))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & {r[0] for r in junk} and not ids & ({*range(500, 530)} - {*range(500, 530, 3)})
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    labels(spark).drop("text").limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over one table, each worked out in plain Python."""
    rng = random.Random(30)
    rows = []

    def add(text: str, source: str) -> None:
        rows.append((len(rows), text, "en", source, len(text)))

    singles = [t for _, t, *_ in families(40, 120, 1, 0)]
    copies = [t for _, t, *_ in families(41, 12, 3, 0.02)]
    for i, text in enumerate(singles + copies):
        add(text, "abc"[i % 3])
    bad = ("vilefool", "rotbrain", "filthpig", "scumlord")
    for i in range(40):
        own = prose(rng, rng.randrange(30, 120)).split()
        for _ in range(max(2, len(own) // 20)):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        add(" ".join(own), "abcd"[i % 4])
    for i in range(30):
        add(rng.choice(["SHOUT!! LOUD!! " * 20, "12345 678 " * 30, "same " * 60, " "]), "d" if i % 3 else "a")
    marks = [(r[0], 1, int(any(w in r[1] for w in bad))) for r in rows if r[0] % 4]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # quality
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(any(quality_brute(r[1])[0]))
    mean, var = sum(map(sum, hosts.values())) / len(rows), np.var([np.mean(x) for x in hosts.values()])
    strength = min(1e6, max(1.0, mean * (1 - mean) / var - 1))
    kept = []
    for r in rows:
        x = hosts[r[3]]
        rate, (hard, soft) = (sum(x) + mean * strength) / (len(x) + strength), quality_brute(r[1])
        if not (sum(hard) >= 2 if rate < 0.02 else sum(hard) >= 1 or rate > 0.5 and sum(soft) >= 2):
            kept.append(r)
    assert len(rows) - len(kept) >= 30
    # toxicity
    kept = [r for r in kept if not any(w in r[1] for w in bad)]
    # near duplicates
    group = groups_of((a[0], b[0]) for i, a in enumerate(kept) for b in kept[i + 1 :] if jaccard(a[1], b[1]) >= 0.5)
    kept = [r for r in kept if group.get(r[0], r[0]) == r[0]]
    assert len(kept) == 132
    # mixing
    size: Counter = Counter()
    for r in kept:
        size[r[3]] += len(r[1])
    mixed = mixture_brute(kept, {s: int(n**0.5 * 1000) / 1_000_000 for s, n in size.items()}, sum(size.values()), mixing.BUCKETS)
    copies_of = Counter(d for d, _, _ in mixed.elements())
    # packing
    want = Counter({r[0]: len(r[1].split()) * copies_of[r[0]] for r in kept if copies_of[r[0]]})
    tokens: Counter = Counter()
    windows = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        tokens[r.doc_id] += r.n_tokens
        windows[r.window].append((r.offset, r.n_tokens))
    assert tokens == want
    assert len(windows) == -(-sum(want.values()) // packing.CAPACITY) and all(sum(n for _, n in x) <= packing.CAPACITY for x in windows.values())
    for parts in windows.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
