"""License scans by conditional compression.

A template's words serve as a raw zstandard dictionary. Words that are close
to the template compress to far fewer bytes with the dictionary than without.
Templates are confirmed by wording: the template is aligned with a span of the
block word by word, and the words that are missing, changed or inserted are
counted exactly. Words that decide which licence it is (version numbers,
NonCommercial, Lesser and the like) aren't within the tolerance: they must
agree. Of confirmed templates that overlap, the reduction in their
own spans decides, and only that: it never excludes a template, however long
the text round it.

Wording that names neither a licence nor a copyright, a warranty, a permission
or the like is no notice: every template holds one of ANCHORS, and so must a
span that it is confirmed for. Which documents reach Python can thus be decided
by substring tests in the JVM.
Within a document, a candidate block is a run of words round anchors that
reaches as far before and after each of them as the longest template could, so
it doesn't matter how lines are wrapped. A template is aligned only where it
could be confirmed: where enough of its words, counted with repeats, are there.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows
from .words import pieces

ANCHORS = ("licen", "copyright", "warrant", "permission", "redistribut", "public domain", "copyleft")
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES = {
    "MIT": _MIT,
    "MIT-notice": "Released under the MIT License.",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}\n{_BSD_THIRD}\n{_BSD_END}",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
    "GPL-3.0-or-later": _GPL,
    "GPL-2.0-or-later": _GPL.replace("version 3", "version 2"),
    "LGPL-3.0-or-later": _GPL.replace("GNU General", "GNU Lesser General"),
    "LGPL-2.1-or-later": _GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "AGPL-3.0-or-later": _GPL.replace("GNU General", "GNU Affero General"),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "proprietary-notice": "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
}
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: words that make another licence of one: a span has none that the template lacks
QUALIFIERS = frozenset("noncommercial nc noderivatives noderivs nd sharealike sa lesser library affero".split())
#: words that name a licence: a span has all that the template has
NAMES = QUALIFIERS | frozenset("mit apache gnu general creative commons cc later".split())
#: a number after one of these is a version; others may be list marks or part of an address
_BEFORE_VERSION = QUALIFIERS | frozenset("version v attribution by".split())
#: the words of an anchor may stand on two lines, with the marks of a comment between them
_BETWEEN = "[^0-9a-z]+"
_ANCHOR = re.compile("|".join(a.replace(" ", _BETWEEN) for a in ANCHORS))


def words(text: str) -> list[str]:
    """Lower-cased words; a version number is one."""
    return [_version(w) for w in _WORD.findall(text.lower())]


def _version(word: str) -> str:
    """3.0 and 3 are the same version, and so the same word."""
    return word.removesuffix(".0")


def deciding(text: list[str]) -> set[str]:
    """The names, qualifiers and version numbers among the words of a licence."""
    versions = {w for before, w in zip(text, text[1:]) if w[0].isdigit() and before in _BEFORE_VERSION}
    return versions.union(NAMES.intersection(text))


def candidate_blocks(text: str, reach: int) -> list[tuple[list[str], list[int]]]:
    """(words, numbers of their lines) of each candidate block: a run of words
    that have an anchor at most ``reach`` words off, however lines are wrapped."""
    low = text.lower()
    found = list(_WORD.finditer(low))
    at = [m.start() for m in found]
    runs: list[list[int]] = []
    for m in _ANCHOR.finditer(low):
        i = max(0, bisect_right(at, m.start()) - 1)
        if runs and i - reach <= runs[-1][1]:
            runs[-1][1] = i + reach + 1
        else:
            runs.append([max(0, i - reach), i + reach + 1])
    out = []
    for a, b in runs:
        part, lines, line, seen = [], [], low.count("\n", 0, at[a]) if at else 0, at[a] if at else 0
        for m in found[a:b]:
            line += low.count("\n", seen, m.start())
            seen = m.start()
            part.append(_version(m[0]))
            lines.append(line)
        out.append((part, lines))
    return out


class _Found(NamedTuple):
    start: int
    end: int
    name: str
    saved: int
    lacking: int
    inserted: int
    rank: tuple[float, int, str]

    def meets(self, other: _Found) -> bool:
        return self.start < other.end and other.start < self.end


class Scanner:
    """Templates with their dictionaries and compressors."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 9):
        for name, text in templates.items():
            if not any(a in text.lower() for a in ANCHORS):
                raise ValueError(f"template {name} holds none of ANCHORS")
        self.words = {name: words(text) for name, text in templates.items()}
        self.counted = {name: Counter(own) for name, own in self.words.items()}
        self.deciding = {name: deciding(own) for name, own in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = {}
        for name, own in self.words.items():
            raw = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(level=level, dict_data=raw)

    def saved(self, name: str, part: list[str]) -> int:
        """Bytes saved by the template's dictionary."""
        data = " ".join(part).encode()
        return len(self.plain.compress(data)) - len(self.given[name].compress(data))

    def aligned(self, name: str, part: list[str], tolerance: float) -> tuple[int, int, int, int] | None:
        """(start, end, template's words that the span lacks or has otherwise,
        words inserted) of the span with the fewest of both, if confirmed."""
        own = self.words[name]
        match = [m for m in difflib.SequenceMatcher(None, own, part, autojunk=False).get_matching_blocks() if m.size]
        best, run = None, None
        for m in match:  # a stray word far from the others costs more than it gives
            gap = m.b - run[1] if run else 0
            if run and run[3] >= gap:
                run = (run[0], m.b + m.size, run[2] + m.size, run[3] - gap + m.size)
            else:
                run = (m.b, m.b + m.size, m.size, m.size)
            if best is None or run[3] >= best[3]:
                best = run
        if best is None:
            return None
        start, end, same, _ = best
        lacking, inserted = len(own) - same, end - start - same
        if lacking + inserted > tolerance * len(own):
            return None
        if not _ANCHOR.search(" ".join(part[start:end])):
            return None
        there, want = deciding(part[start:end]), self.deciding[name]
        if not want <= there or (there - want) & QUALIFIERS or any(w[0].isdigit() for w in there - want):
            return None
        return start, end, lacking, inserted

    def spans(self, name: str, block: list[str], tolerance: float) -> list[tuple[int, int, int, int]]:
        """Disjoint spans of the block that the template is confirmed for, as
        aligned() has them. A confirmed span lies in a window of ``width``
        words with ``need`` of the template's, so only such windows are aligned."""
        counted, n = self.counted[name], len(self.words[name])
        need, width, step = (1 - tolerance) * n - 1e-9, int((1 + tolerance) * n + 1e-9), max(1, n // 4)
        starts: list[int] = []
        have: Counter = Counter()
        same = 0
        for i, word in enumerate(block):
            if word in counted:
                have[word] += 1
                same += have[word] <= counted[word]
            if i >= width and (gone := block[i - width]) in counted:
                same -= have[gone] <= counted[gone]
                have[gone] -= 1
            if same >= need:
                starts.append(max(0, i - width + 1))
        out: list[tuple[int, int, int, int]] = []
        k = done = 0
        while k < len(starts):
            best = None
            while k < len(starts) and (best is None or starts[k] <= best[0]):
                s = max(starts[k], done)
                got = self.aligned(name, block[s : starts[k] + width + step], tolerance)
                if got:
                    got = (got[0] + s, got[1] + s, *got[2:])
                    if best is None or got[0] < best[1] and sum(got[2:]) < sum(best[2:]):
                        best = got
                k = bisect_right(starts, starts[k] + step)
            if best:
                out.append(best)
                done = best[1]
                k = bisect_left(starts, done + need - width)
        return out

    def scan(self, block: list[str], tolerance: float, keep: int) -> list[tuple[int, str, int, int, int]]:
        """(start, template, bytes saved, words lacking, words inserted) of
        every confirmed template, first to last. Where some overlap, the one
        whose dictionary saves most in its span is looked at; of those within
        ``keep`` bytes of it that overlap it, the one of fewest differences for
        a word of the template is taken and the others that overlap this go.
        Then the rest is looked at, until none is left."""
        there = Counter(block)
        found = []
        for name, own in self.words.items():
            if (self.counted[name] & there).total() < (1 - tolerance) * len(own) - 1e-9:
                continue
            for start, end, lacking, inserted in self.spans(name, block, tolerance):
                found.append(_Found(start, end, name, self.saved(name, block[start:end]), lacking, inserted, ((lacking + inserted) / len(own), -len(own), name)))
        found.sort()
        out = []
        while found:
            reach, n = found[0].end, 1
            while n < len(found) and found[n].start < reach:
                reach, n = max(reach, found[n].end), n + 1
            some, found = found[:n], found[n:]
            while some:
                first = min(some, key=lambda x: (-x.saved, x.rank))
                best = min((x for x in some if x.saved >= first.saved - keep and x.meets(first)), key=lambda x: x.rank)
                out.append((best.start, best.name, best.saved, best.lacking, best.inserted))
                some = [x for x in some if not x.meets(best)]
        return sorted(out)


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, tolerance: float = 0.2, keep: int = 16) -> DataFrame:
    """doc_id, line, license, bytes_saved, words_lacking and words_inserted of
    every place that a template is confirmed for, several in a document or block
    if there are, by wording that
    differs in at most ``tolerance`` of the template's words, and in none
    of its deciding ones. ``line`` is the
    number, from 0, of the line on which that wording begins.

    Null and empty texts have no blocks; a very long text is looked at whole,
    and only its blocks are aligned. A null doc_id is carried along,
    repeated rows are scanned one by one, ties between templates go to the
    longer one and then to its name. Other columns aren't looked at; an empty
    table gives an empty result."""
    scanner_of = lambda: Scanner(templates)
    scanner_of()
    rows = Rows(docs)
    asked = rows.df.select(rows["doc_id"].cast("long").alias("doc_id"), rows["text"].alias("text"))
    low = F.lower("text")
    asked = asked.where(reduce(lambda a, b: a | b, (low.rlike(a.replace(" ", _BETWEEN)) if " " in a else F.contains(low, F.lit(a)) for a in ANCHORS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of()
        reach = int((1 + tolerance) * max(map(len, scanner.words.values()))) + 1
        for batch in batches:
            for part in pieces(batch, "text"):
                got = []
                for id_, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for block, lines in candidate_blocks(text, reach):
                        got += ((id_, lines[start], *found) for start, *found in scanner.scan(block, tolerance, keep))
                columns = list(zip(*got)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "line", "license", "bytes_saved", "words_lacking", "words_inserted"])

    return asked.mapInArrow(run, "doc_id long, line long, license string, bytes_saved long, words_lacking long, words_inserted long")
