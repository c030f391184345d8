"""HTML extraction by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass classifies
each block by its length, link density and stop-word density as good, bad,
near (too short or with too few stop words to be sure) or short. The second
pass lets near and short blocks inherit the label of the nearest block that
the first pass decided; if neighbours on both sides are equally near and
differ, a near block is good and a short one bad. A page's text is its good
blocks.

Pages are parsed in Arrow batches, each on its own: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rows
from .words import pieces

BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center col dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style noscript template head svg math iframe object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just me more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle elles en est et il ils je la le les leur leurs lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y été être "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja kein man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wie wir zu zum zur über "
    "al como con de del el ella en entre es esta este esto ha la las lo los más me mi muy no nos o para pero por que se si sin sobre son su sus también te tiene un una y ya yo".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*(?:>|\Z)", re.S)
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in ("script", "style")}
_TITLE_END = re.compile(r"</title\b[^>]*(?:>|\Z)", re.I)
#: what may stand in a head; any other tag, and text, begins the body
_HEAD = frozenset("base basefont bgsound link meta title script style noscript template head html".split())


@dataclass(frozen=True)
class Rules:
    short: int = 70  # characters below which a block is short
    long: int = 200  # from which a block with many stop words is good
    link_density: float = 0.2
    few_stop_words: float = 0.15
    many_stop_words: float = 0.25


@dataclass
class Block:
    text: str
    linked: int  # characters of the text that are in links
    heading: bool
    label: str = ""


def _ends(page: str) -> dict[int, int]:
    """Start of each skipped element that has an end tag -> where this ends."""
    open_: dict[str, list[int]] = {}
    out = {}
    at = 0
    while tag := _TOKEN.search(page, at):
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if name not in SKIPPED or name == "head":
            continue
        end = bool(tag[1] or tag[4])
        if name in _END:
            if not end:
                stop = _END[name].search(page, at)
                at = stop.end() if stop else len(page)
        elif not end:
            if not (name in ("svg", "math") and tag[0].endswith("/>")):
                open_.setdefault(name, []).append(tag.start())
        elif open_.get(name):
            out[open_[name].pop()] = at
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text. Tags that aren't closed and stray
    ends are taken as they come; what isn't a tag is text. A skipped element
    without an end tag skips nothing but its own tag; a head ends at its end
    tag or where the body's content begins."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    link = heading = False
    skip = ""
    at = 0
    ends: dict[int, int] | None = None
    titled = True  # until no end of a title is left

    def close() -> None:
        if parts:
            joined = html.unescape("".join(p for p, _ in parts))
            text = " ".join(joined.split())
            if text:
                linked = sum(len(" ".join(html.unescape(p).split())) for p, in_link in parts if in_link)
                out.append(Block(text, min(linked, len(text)), heading))
            parts.clear()

    while at < len(page):
        tag = _TOKEN.search(page, at)
        if skip == "head" and page[at : tag.start() if tag else len(page)].strip():
            skip = ""
        if not skip and (tag is None or tag.start() > at):
            parts.append((page[at : tag.start() if tag else len(page)], link))
        if tag is None:
            break
        begin, at = tag.start(), tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        end = bool(tag[1] or tag[4])
        if skip == "head":
            if name == "head" and end or name not in _HEAD:
                skip = ""
                if end and name == "head":
                    continue
            elif name == "title" and not end:  # its text is no body text
                stop = titled and _TITLE_END.search(page, at)
                titled = bool(stop)
                at = stop.end() if stop else at
                continue
            elif name not in SKIPPED or end or name == "head":
                continue
        if name in SKIPPED and not end:
            if name in _END:  # raw text: other tags in it don't count
                stop = _END[name].search(page, at)
                at = stop.end() if stop else len(page)
            elif name == "head":
                close()
                skip = name
            elif not (name in ("svg", "math") and tag[0].endswith("/>")):
                close()
                if ends is None:
                    ends = _ends(page)
                at = ends.get(begin, at)
        elif name == "a":
            link = not end
        elif name in BLOCK_TAGS:
            close()
            if name in HEADINGS:
                heading = not end
            elif heading and name != "br":
                heading = False
            if name not in ("br",):
                link = False
    close()
    return out


def first_pass(block: Block, rules: Rules) -> str:
    n = len(block.text)
    if block.linked > rules.link_density * n:
        return "bad"
    if "\xa9" in block.text or "copyright" in block.text.lower():
        return "bad"
    if n < rules.short:
        return "bad" if block.linked else "short"
    words = block.text.lower().split()
    density = sum(w.strip(".,;:!?()[]\"'#$%&*|") in STOP_WORDS for w in words) / len(words)
    if density >= rules.many_stop_words:
        return "good" if n >= rules.long else "near"
    return "near" if density >= rules.few_stop_words else "bad"


def second_pass(labels: list[str]) -> list[str]:
    """good or bad for each; with no decided block at all, near is good and short bad."""
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    out = []
    before, k = -1, 0
    for i, label in enumerate(labels):
        while k < len(decided) and decided[k] <= i:
            before = decided[k]
            k += 1
        if label in ("good", "bad"):
            out.append(label)
            continue
        after = decided[k] if k < len(decided) else -1
        to_before = i - before if before >= 0 else len(labels) + 1
        to_after = after - i if after >= 0 else len(labels) + 1
        if to_before == to_after:
            same = before >= 0 and labels[before] == labels[after]
            out.append(labels[before] if same else "good" if label == "near" else "bad")
        else:
            out.append(labels[before if to_before < to_after else after])
    return out


def extract(page: str, rules: Rules = Rules()) -> tuple[str, int, int]:
    """(main text, blocks, good blocks) of a page."""
    found = blocks(page)
    labels = second_pass([first_pass(b, rules) for b in found])
    good = [b.text for b, label in zip(found, labels) if label == "good"]
    return "\n".join(good), len(found), len(good)


def extracted(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_blocks and n_good of every row of pages.

    A null page has a null text and no blocks; an empty one, or one without
    text, an empty text; a very long one is parsed whole. Null ids and URLs are carried along, repeated rows
    are extracted one by one. Other columns aren't looked at; an empty table
    gives an empty result."""
    rows = Rows(pages)
    asked = rows.df.select(rows["page_id"].cast("long").alias("page_id"), rows["url"].alias("url"), rows["html"].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                got = [(None, 0, 0) if x is None else extract(x, rules) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], ["page_id", "url", "text", "n_blocks", "n_good"])

    return asked.mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_good long")
