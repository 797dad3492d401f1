"""License notices found by conditional compression and exact wording.

Lines do not matter: a text is its words.  Around every word that speaks of
licensing lies a block for each template, as wide as the template with all
differences it may have, so a notice can be wrapped over lines or stand inside a
long one.  Templates that miss too many words in the text cannot be confirmed and
are left out.  Every block is compressed alone and with its template as a zstandard
raw dictionary, and the bytes saved rank the candidates.  Down that order the exact
wording confirms: a template is aligned with its block, and stands where the words
to insert, delete and replace are few against its length.  Among confirmed ones at
one place that save nearly as much as the first, the fewest differences win.
Candidates are tried as long as a licensing word in their block is unexplained, so
all confirmed notices that do not overlap are reported.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.llm.frames import col, free_name, map_columns, others

# The most differing words, as a share of the template's.
MOST_DIFFERENT = 0.2
# Confirmed candidates that save at least this share of what the first one at their place
# saves are told apart by their differences.
NEAR_SAVING = 0.9
# Templates of up to this many words without a name or number end their sentence.
BARE = 3
# Templates of more words are whole texts, in which only names and versions tell licenses apart.
LONG = 100

# Notices in common use, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-file-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."),
    "MIT-OR-Apache-2.0": "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    "BSD-style-header": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE "
        "file."),
    "MIT-style-header": (
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE "
        "file."),
    "GPL-2.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 2 of the "
        "License, or (at your option) any later version."),
    "GPL-2.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "GPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."),
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "LGPL-2.1-or-later-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version "
        "2.1 of the License, or (at your option) any later version."),
    "LGPL-2.1-or-later-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version "
        "2.1 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License "
        "for more details."),
    "LGPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version."),
    "LGPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License "
        "for more details."),
    "AGPL-3.0-or-later-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version."),
    "AGPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details."),
    "GPL-2.0-only-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License version 2 as published by the Free Software Foundation."),
    "MIT-SPDX": "SPDX-License-Identifier: MIT",
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause-SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause-SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "GPL-2.0-only-SPDX": "SPDX-License-Identifier: GPL-2.0-only",
    "GPL-2.0-or-later-SPDX": "SPDX-License-Identifier: GPL-2.0-or-later",
    "GPL-3.0-only-SPDX": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-3.0-or-later-SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "LGPL-2.1-or-later-SPDX": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "MPL-2.0-SPDX": "SPDX-License-Identifier: MPL-2.0",
    "AGPL-3.0-only-SPDX": "SPDX-License-Identifier: AGPL-3.0-only",
    "AGPL-3.0-or-later-SPDX": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "CC-BY-4.0-SPDX": "SPDX-License-Identifier: CC-BY-4.0",
    "CC-BY-SA-4.0-SPDX": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "GPL-2.0-SPDX": "SPDX-License-Identifier: GPL-2.0",
    "GPL-2.0-plus-SPDX": "SPDX-License-Identifier: GPL-2.0+",
    "GPL-3.0-SPDX": "SPDX-License-Identifier: GPL-3.0",
    "GPL-3.0-plus-SPDX": "SPDX-License-Identifier: GPL-3.0+",
    "LGPL-3.0-or-later-SPDX": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "Unlicense-SPDX": "SPDX-License-Identifier: Unlicense",
    "Zlib-SPDX": "SPDX-License-Identifier: Zlib",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "MPL-2.0-name": "Mozilla Public License 2.0",
    "MPL-2.0-version-name": "Mozilla Public License, version 2.0",
    "GPL-2.0-license-name": "licensed under the GNU GPL v2",
    "GPL-3.0-license-name": "licensed under the GNU GPL v3",
    "ISC-SPDX": "SPDX-License-Identifier: ISC",
    "CC0-1.0-SPDX": "SPDX-License-Identifier: CC0-1.0",
}
# Whole license texts, each of its license's name with "-text".
TEMPLATES |= {f"{path.stem}-text": path.read_text() for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
# A text without any of these has no candidate; every template holds one.
TRIGGER = (r"(?i)licen[sc]|copyright|permission|rights\W+reserved|public\W+domain|creative\W+commons|\bCC\b")
FOUND = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("saving", T.DoubleType()), T.StructField("differences", T.IntegerType()),
    T.StructField("wording", T.StringType())]))

_WORDS = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
_SPEAKS = re.compile(r"licen[sc]|copyright|permission|^cc(?:-|$)")
# Fixed value: what stands before license identifiers.
_TAG = "spdx-license-identifier"
_PAIRS = {("rights", "reserved"), ("public", "domain"), ("creative", "commons")}


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _speaking(text: list[str]) -> list[int]:
    """The places of words that speak of licensing."""
    known = {w for w in set(text) if _SPEAKS.search(w)}
    return [i for i, w in enumerate(text) if w in known or (text[i - 1] if i else "", w) in _PAIRS]


# Words that tell licenses apart: any with a digit, and these names.
_NAMES = frozenset((
    "apache bsd cc by by-nc by-sa by-nc-sa gnu lesser affero mit mozilla public domain "
    "attribution-sharealike attribution-noncommercial").split())
_LONG_NAMES = _NAMES - {"by", "public", "domain"}


def _is_mark(text: list[str], i: int, long: bool) -> bool:
    w = text[i]
    if w in (_LONG_NAMES if long else _NAMES):
        return True
    # In a whole text, numbers are clauses, years and addresses too.
    return any(c.isdigit() for c in w) and (not long or (i > 0 and text[i - 1] in ("version", "v")))


def _marks(text: list[str], long: bool) -> frozenset[str]:
    return frozenset(text[i] for i in range(len(text)) if _is_mark(text, i, long))


@dataclass
class _Template:
    name: str
    words: list[str]
    counts: Counter
    # How many words may differ.
    most: int
    # Words that carry the version or family of a license may not differ.
    marks: frozenset[str]
    compressor: zstandard.ZstdCompressor

    def possible(self, text: Counter, n: int) -> bool:
        """Whether a text of n words may hold the template: each word it lacks is a difference."""
        if len(self.words) - n > self.most:
            return False
        return sum(c - text[w] for w, c in self.counts.items() if text[w] < c) <= self.most

    @property
    def long(self) -> bool:
        return len(self.words) > LONG

    @property
    def identifier(self) -> bool:
        """A tag with one license identifier."""
        return len(self.words) == 2 and self.words[0] == _TAG


@dataclass(frozen=True, eq=False)
class _Notice:
    template: _Template
    lo: int
    hi: int
    # Bytes saved by compression, and as a share of those without the template.
    saved: int
    share: float
    differences: int

    def overlaps(self, other: _Notice) -> bool:
        return self.lo < other.hi and other.lo < self.hi


class _Text:
    """A text as words, with the places of those that speak of licensing."""

    def __init__(self, text: str, own: list[str], spans: list[tuple[int, int]], places: list[int]) -> None:
        self.text, self.words, self.spans, self.places = text, own, spans, places
        self.ids: dict[str, int] = {}
        self.codes = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in own), np.int64, len(own))

    def raw(self, lo: int, hi: int) -> bytes:
        return self.text[self.spans[lo][0]:self.spans[hi - 1][1]].encode("utf-8", "surrogatepass")

    def coded(self, template: list[str]) -> np.ndarray:
        return np.array([self.ids.get(w, -1) for w in template])

    def within(self, lo: int, hi: int) -> list[int]:
        return self.places[bisect_left(self.places, lo):bisect_left(self.places, hi)]

    def goes_on(self, hi: int) -> bool:
        """Whether the next word belongs to the same sentence, as far as signs tell."""
        return hi < len(self.words) and not self.text[self.spans[hi - 1][1]:self.spans[hi][0]].strip(" ")


_COST = 1 << 32


def alignments(template: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in the text, the fewest words that differ between the template
    and some words up to there, and where those start (the last such place)."""
    n = len(text)
    at = np.arange(n + 1, dtype=np.int64)
    # One number holds the differences and, below, how far the start is from the end.
    best, steps = n - at, at * _COST
    for w in template:
        row = best + _COST
        np.minimum(row[1:], best[:-1] + (text != w) * _COST, out=row[1:])
        best = np.minimum.accumulate(row - steps) + steps
    return best // _COST, n - best % _COST


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.templates = []
        for name, text in templates.items():
            raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = words(text)
            self.templates.append(_Template(
                name, own, Counter(own), int(MOST_DIFFERENT * len(own)), _marks(own, len(own) > LONG),
                zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False)))
        self.identifiers = {t.words[1] + "+" * templates[t.name].endswith("+"): t for t in self.templates if t.identifier}

    def match(self, block: str) -> tuple | None:
        """The confirmed template that explains most of a block, with saving,
        differences and wording."""
        found = self.find(block)
        if not found:
            return None
        name, _, saving, differences, wording, _ = max(found, key=lambda x: x[5])
        return name, saving, differences, wording

    def find(self, text: str) -> list[tuple]:
        """All confirmed notices that do not overlap, in order of place: name, line,
        saving, differences, wording and how many words they explain."""
        text = text.lower()
        spans = [m.span() for m in _WORDS.finditer(text)]
        own = [text[a:b] for a, b in spans]
        places = _speaking(own)
        if not places:
            return []
        return [(x.template.name, text.count("\n", 0, spans[x.lo][0]), x.share, x.differences,
                 self._wording(x, own), len(x.template.words) - x.differences)
                for x in sorted(self._chosen(_Text(text, own, spans, places)), key=lambda x: x.lo)]

    @staticmethod
    def _wording(x: _Notice, own: list[str]) -> str:
        theirs, ours = x.template.words, own[x.lo:x.hi]
        steps = difflib.SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes()
        return "; ".join(f"{' '.join(theirs[j1:j2])} -> {' '.join(ours[i1:i2])}"
                         for tag, i1, i2, j1, j2 in steps if tag != "equal")

    def _saved(self, t: _Template, raw: bytes) -> tuple[int, int]:
        """Bytes saved by the template as a dictionary, and bytes without it."""
        alone = len(self.alone.compress(raw))
        return alone - len(t.compressor.compress(raw)), alone

    def _chosen(self, x: _Text) -> list[_Notice]:
        chosen = self._expressions(x)
        here = Counter(x.words)
        # Blocks of a template do not meet and are in order of place.
        blocks = {n: _ranges(x.places, len(t.words) + t.most, len(x.words)) for n, t in enumerate(self.templates)
                  if not t.identifier and t.possible(here, len(x.words))}
        ranked = sorted((-self._saved(self.templates[n], x.raw(lo, hi))[0], len(self.templates[n].words), n, i)
                        for n, ranges in blocks.items() for i, (lo, hi) in enumerate(ranges))
        taken = np.zeros(len(x.words), bool)
        for y in chosen:
            taken[y.lo:y.hi] = True
        tried: dict[tuple[int, int], list[_Notice]] = {}

        def confirmed(n: int, i: int) -> list[_Notice]:
            if (n, i) not in tried:
                tried[n, i] = self._confirmed(self.templates[n], x, *blocks[n][i])
            tried[n, i] = [y for y in tried[n, i] if not taken[y.lo:y.hi].any()]
            return tried[n, i]

        def rivals(first: _Notice) -> list[_Notice]:
            found = []
            for n, ranges in blocks.items():
                i = bisect_left(ranges, first.lo, key=lambda r: r[1] - 1)
                while i < len(ranges) and ranges[i][0] < first.hi:
                    found += filter(first.overlaps, confirmed(n, i))
                    i += 1
            return found

        for _, _, n, i in ranked:
            # Every notice explains a licensing word; where all have one, none is left.
            while not taken[x.within(*blocks[n][i])].all():
                free = confirmed(n, i)
                if not free:
                    break
                first = max(free, key=lambda y: (y.saved, -y.differences))
                if first.differences:
                    close = rivals(first)
                    most = max(y.saved for y in close)
                    first = min((y for y in close if y.saved >= NEAR_SAVING * most),
                                key=lambda y: (y.differences, -y.saved, y.template.name))
                chosen.append(first)
                taken[first.lo:first.hi] = True
        return chosen

    def _notice(self, t: _Template, x: _Text, lo: int, hi: int, differences: int) -> _Notice:
        saved, alone = self._saved(t, x.raw(lo, hi))
        return _Notice(t, lo, hi, saved, saved / alone, differences)

    def _expressions(self, x: _Text) -> list[_Notice]:
        """Every license named by an expression behind the tag for license identifiers."""
        out = []
        for tag in (i for i, w in enumerate(x.words) if w == _TAG):
            i, lo = tag + 1, tag
            while i < len(x.words):
                name = x.words[i]
                # A plus sign belongs to the identifier it follows.
                end = x.spans[i][1]
                t = self.identifiers.get(name + "+" * (x.text[end:end + 1] == "+"))
                if t is not None:
                    out.append(self._notice(t, x, lo, i + 1, 0))
                i, lo = i + 1, i + 1
                if i < len(x.words) and x.words[i] in ("or", "and") and "\n" not in x.text[end:x.spans[i][0]]:
                    i, lo = i + 1, i + 1
                else:
                    break
        return out

    def _confirmed(self, t: _Template, x: _Text, lo: int, hi: int) -> list[_Notice]:
        """The places in a block where few words differ from the template."""
        costs, starts = alignments(x.coded(t.words), x.codes[lo:hi])
        ends = np.flatnonzero(costs <= t.most)
        if not len(ends):
            return []
        at = [i for i in range(lo, hi) if _is_mark(x.words, i, t.long)]
        out: list[_Notice] = []
        for end in ends[np.argsort(costs[ends], kind="stable")].tolist():
            a, b = lo + int(starts[end]), lo + end
            if a >= b or any(a < y.hi and y.lo < b for y in out) or not x.within(a, b):
                continue
            first, last = np.searchsorted(at, (a, b))
            if {x.words[i] for i in at[first:last]} != t.marks:
                continue
            if len(t.words) <= BARE and not t.marks and x.goes_on(b):
                continue
            out.append(self._notice(t, x, a, b, int(costs[end])))
        return out


def _ranges(places: list[int], reach: int, n: int) -> list[tuple[int, int]]:
    """What lies within reach of any of the places, in order, joined where it meets."""
    out: list[tuple[int, int]] = []
    for i in places:
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def scan(df: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """The frame with `licenses`: the notices found, in order of place.

    Each has the template's name, the line of its first word (from 0), the saving,
    the number of differing words and the differences as "template words -> text
    words".  Null and empty texts give an empty list.  A column named licenses is
    replaced.
    """
    chosen = TEMPLATES if templates is None else templates
    spoken = free_name(df, "license_text")
    kept = others(df, ["licenses"])
    # Only texts that speak of licensing are scanned.
    staged = df.select(*map(col, kept), F.when(col(text).rlike(TRIGGER), col(text)).alias(spoken))

    def start():
        scanner = Scanner(chosen)

        def run(rows):
            return [pa.array([[
                {"license": name, "line": line, "saving": saving, "differences": differences, "wording": wording}
                for name, line, saving, differences, wording, _ in (scanner.find(x) if x else ())]
                for x in rows.to_pylist()], pa.list_(pa.struct([
                    ("license", pa.string()), ("line", pa.int32()), ("saving", pa.float64()),
                    ("differences", pa.int32()), ("wording", pa.string())])))]
        return run

    return map_columns(staged, [spoken], T.StructType([T.StructField("licenses", FOUND)]), start).drop(spoken)
