"""License scans by conditional compression.

Lines that end within a sentence go on in the next one, without the marks of a comment. What results, with a licence cue in it, is
a candidate block. The stretches of it around a cue that align with a template, word by word, are found in one pass over its
words; a stretch is compressed alone and with each template as a zstandard raw dictionary, templates are ranked by how much they
reduce its size, and a winner counts only if the exact difference in wording between stretch and template leaves enough in common
and no version or licence code differs. Wording that several templates share word for word names them all, joined by |. Short names,
such as MIT License or GPLv3, and SPDX expressions are too short for sizes to tell and count by their exact wording alone.
One pass, no shuffle; equal stretches are compared and compressed once.

Cases: a null or empty text has no blocks, an empty table gives no rows; every line of a text of any length is looked at; a block may
hold many notices, anywhere in other text; repeated rows get one result each; equal reductions rank by the templates' order; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_GNU = "{what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{stop} either version {v} of the License, or (at your option) any later version."
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Wordings by which works say how they are licensed, each with its title.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _NO_WARRANTY,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. " + _GNU.format(what="This program", mark=":", kind="", stop=",", v="3"),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. " + _GNU.format(what="This program", mark=";", kind="", stop=";", v="2"),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1. " + _GNU.format(what="This library", mark=";", kind="Lesser ", stop=";", v="2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3. " + _GNU.format(what="This library", mark=":", kind="Lesser ", stop=",", v="3"),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3. " + _GNU.format(what="This program", mark=":", kind="Affero ", stop=",", v="3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "BSD-3-Clause": f"BSD 3-Clause License. {_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "BSD-2-Clause": f"BSD 2-Clause License. {_BSD} {_BSD_END}",
    "ISC": "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    **{
        f"CC-{code}-{v}": f"Licensed under CC {code} {v}. This work is licensed under a Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported'} License."
        for v in ("4.0", "3.0") for code, name in _CC.items()
    },
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",
    "All-Rights-Reserved": "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
}


def _gnu_names(code: str, major: str, title: str) -> str:
    """Short names of a GNU licence of a version, as GPLv3, GNU GPL v2 or later, GPL-2.0-only."""
    minor = "" if "." in major else r"(?:\.0)?"
    return rf"(?:gnu )?{code}(?:[ -]?v(?:ersion)?\.? ?|[ -])?{re.escape(major)}{minor}(?:\+|-only|-or-later| or later)?|gnu {title}general public license,? v(?:ersion)?\.? ?{re.escape(major)}{minor}(?: or later)?"


#: Short names that say a licence by themselves, as patterns over lower-case text.
SHORT = {
    "MIT": r"mit[ -]licen[sc]ed?|licen[sc]ed under (?:the )?mit",
    "Apache-2.0": r"apache(?: software)? licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?|apache[- ]2\.0",
    "GPL-2.0": _gnu_names("gpl", "2", ""), "GPL-3.0": _gnu_names("gpl", "3", ""), "LGPL-2.1": _gnu_names("lgpl", "2.1", "lesser "), "LGPL-3.0": _gnu_names("lgpl", "3", "lesser "), "AGPL-3.0": _gnu_names("agpl", "3", "affero "),
    "MPL-2.0": r"mpl[ -]?v?2\.0|mozilla public licen[sc]e,? (?:version |v\.? ?)?2\.0", "EPL-2.0": r"epl[ -]?v?2\.0|eclipse public licen[sc]e,? (?:-? ?v(?:ersion)?\.? ?)?2\.0",
    "BSD-2-Clause": r"(?:bsd[ -]2-clause|(?:2-clause|two-clause|simplified|freebsd) bsd)(?: licen[sc]ed?)?", "BSD-3-Clause": r"(?:bsd[ -]3-clause|(?:3-clause|three-clause|new|modified|revised) bsd)(?: licen[sc]ed?)?",
    "BSD-2-Clause|BSD-3-Clause": r"bsd[ -]licen[sc]ed?", "ISC": r"isc licen[sc]ed?", "Unlicense": r"(?:the )?unlicense", "CC0-1.0": r"cc0(?:[ -]1\.0)?(?: universal)?",
    **{f"CC-{code}-{v}": rf"cc[ -]{code.lower()}[ -]{re.escape(v)}|creative commons {name.lower()} {re.escape(v)}" for v in ("4.0", "3.0") for code, name in _CC.items()},
}
_SHORT = {k: re.compile(rf"(?<![\w.-])(?:{p})(?![\w+-]|\.\w)") for k, p in SHORT.items()}
_ANY_SHORT = re.compile("|".join(f"(?:{p.pattern})" for p in _SHORT.values()))
_EXPRESSION = re.compile(r"spdx(?:-license-identifier)?: *\(?([a-z0-9.+-]+(?:(?: +(?:or|and|with) +|[ ()]+)[a-z0-9.+-]+)*)")
CUE = re.compile(r"licen[sc]ed?\b|spdx|copyright|all rights reserved|redistribution and use|permission (?:is hereby granted|to use)|creative commons|public domain|as is\b|free software|public license|\b[al]?gpl|\bcc0|\bcc[ -]by", re.I)
#: What begins a line of a comment, and what ends a sentence at the end of a line.
_EDGE = re.compile(r"\n[ \t\r/*#;>%!|-]*")
_CLOSED = re.compile(r"[.!?]['\")\]*/ \t\r]*\Z")
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: Words that tell one licence from another: version numbers and the codes of Creative Commons. They are compared by kind.
_KINDS = [re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*"), re.compile(r"(by(?:-\w\w)*)"), re.compile(r"(attribution(?:-\w+)*)")]
#: Words that make another licence of a name when they are put into it.
_OTHER = frozenset(["lesser", "affero"])
#: Comparisons and rankings that a scanner remembers before it starts anew.
REMEMBERED = 20_000
_OWNED = re.compile(r"copyright|©|\(c\)|\b(?:19|20)\d\d\b", re.I)
_YEAR = re.compile(r"(19|20)\d\d")
_SENTENCE = re.compile(r"[.!?;]['\")\]]*\s")


@dataclass(frozen=True)
class Limits:
    #: Share of its size that the best template must save, and share of the stretch's words that it must have in order.
    min_reduction: float = 0.3
    min_common: float = 0.8
    #: Most words between two runs of template words in one stretch.
    gap: int = 15
    #: Least words in common of a stretch that is only part of its sentence: with a name or a whole cue of three words in it, and without.
    min_named: int = 4
    min_words: int = 8


@dataclass
class Stretch:
    """Words a to b of a line that align with words c to d of a template."""

    name: str
    a: int
    b: int
    c: int
    d: int
    score: float


@functools.lru_cache(REMEMBERED)
def _marks(words: tuple[str, ...]) -> frozenset[tuple[int, str]]:
    return frozenset((k, m[1]) for w in words for k, p in enumerate(_KINDS) if (m := p.fullmatch(w)))


@functools.lru_cache(REMEMBERED)
def _clash(own: tuple[str, ...], other: tuple[str, ...]) -> bool:
    """Whether own has a version or code of a kind that other has too, but another one."""
    mine, theirs = _marks(own), _marks(other)
    return any(k == j and v not in {y for x, y in theirs if x == k} for k, v in mine for j, _ in theirs)


def _outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that lie within no other, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, limits: Limits = Limits()):  # noqa: B008
        import zstandard as z

        self.limits = limits
        self._ranked: dict[str, list[tuple[float, str]]] = {}
        self._compared: dict[tuple[str, ...], tuple[float, list[str], bool]] = {}
        self.plain = z.ZstdCompressor(level=9, write_content_size=False)
        self.by = {k: z.ZstdCompressor(level=9, write_content_size=False, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
        self.words = {k: tuple(_WORD.findall(t.lower())) for k, t in templates.items()}
        #: Where templates have a pair of words in sequence, and the proper names that fewer than half of the templates have.
        self.pairs: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for k, words in self.words.items():
            for i, pair in enumerate(zip(words, words[1:], strict=False)):
                self.pairs.setdefault(pair, []).append((k, i))
        spoken = [re.sub(r"(?:\b[A-Z]+\b[\W]*){5,}", "", t) for t in templates.values()]  # without what is all in capitals
        named = [{w.lower() for w in re.findall(r"(?<=[\w,] )[A-Z][\w.-]*\w", t)} for t in spoken]
        self.names = {w for x in named for w in x if 2 * sum(w in y for y in named) < max(2, len(named))}

    def blocks(self, text: str) -> Iterator[tuple[int, str]]:
        """Candidate blocks and their places. Where lines are joined, spaces stand for the break and a comment's marks."""
        if not CUE.search(text):
            return
        at, lines = 0, text.split("\n")
        start, held = 0, []
        for k, line in enumerate(lines):
            held.append(line)
            at += len(line) + 1
            goes_on = k + 1 < len(lines) and line.strip(" \t\r/*#;>%!|-") and lines[k + 1].strip(" \t\r/*#;>%!|-") and not _CLOSED.search(line[-40:])
            if not goes_on:
                block = _EDGE.sub(lambda m: " " * len(m[0]), "\n".join(held))
                if CUE.search(block if len(held) == 1 else " ".join(block.split())):
                    yield start, block
                start, held = at, []

    def stretches(self, words: tuple[str, ...]) -> list[Stretch]:
        """The best alignments with each template: runs of two words or more that both have, joined over gaps that cost less than they join."""
        runs: list[Stretch] = []
        live: dict[tuple[str, int], Stretch] = {}
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            going = {}
            for name, j in self.pairs.get(pair, ()):
                run = live.get((name, j))
                if run is None:
                    runs.append(run := Stretch(name, i, i + 1, j, j + 1, 1.0))
                run.b, run.d, run.score = i + 2, j + 2, run.score + 1
                going[name, j + 1] = run
            live = going
        out = list(runs)
        best: dict[str, list[Stretch]] = {}
        longest = {k: len(w) / self.limits.min_common + 2 for k, w in self.words.items()}
        for run in runs:  # in the order of their first words
            chain = run
            # A longer stretch than that has too many words that the template lacks.
            before = [x for x in best.get(run.name, []) if x.b > run.a - self.limits.gap - 1 and run.b - x.a <= longest[run.name]]
            for x in before:
                # Words that an earlier run ends with may begin this one too.
                shared = max(0, x.b - run.a, x.d - run.c)
                if run.b - run.a > shared:
                    score = x.score + (run.b - run.a - shared) - 2 * (run.a + shared - x.b) - 0.01 * (run.c + shared - x.d)
                    if score >= max(chain.score, x.score):
                        chain = Stretch(run.name, x.a, run.b, x.c, run.d, score)
            # Of chains that end at the same words in both the best one is enough.
            best[run.name] = [*(x for x in before if (x.b, x.d) != (chain.b, chain.d)), chain]
            if chain is not run:
                out.append(chain)
        return out

    def confirmed(self, line: str, places: list[tuple[int, int]], words: tuple[str, ...], x: Stretch) -> tuple[int, int, str, float, str] | bool:
        """The find that a stretch makes (start, end, licence, reduction, differing words); else whether it names another version or code."""
        other = self.words[x.name]
        a, b = x.a, x.b
        # A single word in common before the stretch, such as Copyright before a year, belongs to it where enough stays in common.
        for k in range(a - 1, max(-1, a - 4), -1):
            if words[k] in other[: x.c] and (x.b - x.a + 1) >= self.limits.min_common * (b - k):
                a = k
                break
        # One or two words over the end of a sentence, such as The, belong to the next one.
        for k in (b - 1, b - 2):
            if k > a and _SENTENCE.search(line, places[k - 1][1], places[k][0]):
                b, cut = k, b - k
                x = Stretch(x.name, x.a, k, x.c, x.d - cut, x.score)
                break
        start, end = places[a][0], places[b - 1][1]
        common, diff, clash = self.compared(words[a:b], x.name)
        if common < self.limits.min_common or clash:
            return clash
        # The version may stand just outside what aligns.
        after = tuple(w for (s, _), w in zip(places[b : b + 2], words[b : b + 2], strict=True) if not _SENTENCE.search(line, end, s))
        before = tuple(w for (_, e), w in zip(places[max(0, a - 2) : a], words[max(0, a - 2) : a], strict=True) if not _SENTENCE.search(line, e, start))
        dated = tuple(w for w in after if not _YEAR.fullmatch(w))
        if _clash(dated, other) or _clash(before, other[max(0, x.c - 2) : x.c]) or not _OTHER.isdisjoint(after):
            return True
        same = round(common * (b - a))
        stretch = line[start:end]
        if same < self.limits.min_words and not (same >= self.limits.min_named and self.names.intersection(words[a:b])):
            # Too little to count as a part: a whole sentence, or a cue that is a phrase of its own.
            left = max([m.end() for m in _SENTENCE.finditer(line, max(0, start - 2000), start)], default=max(0, start - 2000))
            right = m.start() if (m := _SENTENCE.search(line, end, end + 2000)) else min(len(line), end + 2000)
            around = bisect.bisect_left(places, (right, 0)) - bisect.bisect_left(places, (left, 0))
            # A phrase such as All rights reserved needs a sign of whose rights they are, unless it is the whole sentence.
            phrase = any(len(m[0].split()) >= 3 for m in CUE.finditer(stretch)) and (x.name != "All-Rights-Reserved" or _OWNED.search(line, max(0, left - 60), right))
            if not phrase and same < self.limits.min_common * around:
                return False
        saved = dict((k, v) for v, k in self.ranked(stretch))[x.name]
        if saved < self.limits.min_reduction:
            return False
        while end < len(line) and line[end] in ".,;:!?)]\"'":
            end += 1
        while start and line[start - 1] in "([\"'":
            start -= 1
        # Other templates that have these words just as this one does.
        alike = [k for k in self.words if k != x.name and self.compared(words[a:b], k) == (common, diff, False) and not _clash(before, self.words[k]) and not _clash(dated, self.words[k])]
        return start, end, "|".join(sorted([x.name, *alike])), round(saved, 4), " ".join(diff)

    def named(self, line: str) -> list[tuple[int, int, str, float, str]]:
        """Short names and SPDX expressions of a line: start, end, licence, what its templates save of it, no difference."""
        low, out = line.lower(), []
        if len(low) != len(line):  # a letter whose lower case is two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
        for m in _EXPRESSION.finditer(low):
            for w in re.finditer(r"[a-z0-9.+-]+", m[1]):
                ids = [k for k, p in _SHORT.items() if p.fullmatch(w[0])] or [k for k in self.words if re.sub(r"(\+|-only|-or-later)\Z", "", w[0]) == k.lower()]
                out += [(m.start(1) + w.start(), m.start(1) + w.end(), k) for k in ids[:1]]
        for m in _ANY_SHORT.finditer(low):
            if not any(a <= m.start() < b for a, b, _ in out):
                out += [(*m.span(), next(k for k, p in _SHORT.items() if p.fullmatch(low, *m.span())))]
        return [(a, b, k, round(max(v for v, t in self.ranked(line[a:b]) if t in k.split("|")), 4), "") for a, b, k in sorted(out) if set(k.split("|")) <= set(self.words)]

    def notices(self, line: str) -> list[tuple[int, int, str, float, str]]:
        """The confirmed finds of a line, in order; none overlaps another. A short name within a find, or within its sentence where it is of the same licence, is part of it."""
        long, short = self.worded(line), self.named(line)
        spans = [(a, b) for a, b, *_ in long]
        for x in short:
            k = bisect.bisect_right(spans, (x[0], len(line)))
            if not any(a < x[1] and x[0] < b for a, b in spans[max(0, k - 1) : k + 1]):
                long.append(x)
        return sorted(long)

    def worded(self, line: str) -> list[tuple[int, int, str, float, str]]:
        """The finds of a line that align with a template."""
        matched = list(_WORD.finditer(line))
        places, words = [m.span() for m in matched], tuple(m[0].lower() for m in matched)
        cues = [m.span() for m in CUE.finditer(line)]
        cued = []
        for x in self.stretches(words):
            k = bisect.bisect_left(cues, (places[x.b - 1][1], 0))
            # Words may begin before the cue in them, so the cue before the end counts if it ends within.
            if k and cues[k - 1][1] > places[x.a][0]:
                cued.append(x)
        cued.sort(key=lambda x: (x.a, x.b))
        out: list[tuple[int, int, str, float, str]] = []
        i, taken = 0, bytearray(len(words))
        while i < len(cued):  # stretches that overlap are ranked together, over all that they cover
            j, end = i, cued[i].b
            while j < len(cued) and cued[j].a < end:
                end, j = max(end, cued[j].b), j + 1
            group, got, refused = cued[i:j], [], []
            rank = {k: (-v, n) for n, (v, k) in enumerate(self.ranked(line[places[group[0].a][0] : places[end - 1][1]]))}
            for x in sorted(group, key=lambda x: (rank[x.name], -x.score, x.a)):
                if any(taken[x.a : x.b]):
                    continue
                hit = self.confirmed(line, places, words, x)
                if hit is True:
                    refused.append((x.a, x.b))
                elif hit and not any(taken[(k := bisect.bisect_left(places, (hit[0], 0))) : x.b]):
                    taken[k : x.b] = b"\1" * (x.b - k)
                    got.append((hit, x.a, x.b))
            # What is only a part of a name with another version or code names nothing.
            refused = _outermost(refused)
            got = [hit for hit, a, b in got if not ((k := bisect.bisect_right(refused, (a, len(words)))) and b <= refused[k - 1][1] and b - a < refused[k - 1][1] - refused[k - 1][0])]
            out += sorted(got)
            i = j
        return out

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """Templates by the share of the block's compressed size that they save, best first."""
        block = " ".join(block.split())
        if (known := self._ranked.get(block)) is None:
            data = block.encode()
            alone = len(self.plain.compress(data))
            known = sorted(((1 - len(c.compress(data)) / alone, k) for k, c in self.by.items()), key=lambda x: -x[0])
            if len(self._ranked) >= REMEMBERED:
                self._ranked.clear()
            if len(block) < 2_000:
                self._ranked[block] = known
        return known

    def compared(self, own: tuple[str, ...], name: str) -> tuple[float, list[str], bool]:
        """Share of own's words that the template has in order, the words that differ (- only in own, + only between matches of the template),
        and whether they make another licence: a version or code in the place of another, or a word put into the name or left out of it."""
        key = (name, *own)
        if (known := self._compared.get(key)) is None:
            if len(self._compared) >= REMEMBERED:
                self._compared.clear()
            known = self._compared[key] = self._differences(own, self.words[name])
        return known

    def _differences(self, own: tuple[str, ...], other: tuple[str, ...]) -> tuple[float, list[str], bool]:
        match = difflib.SequenceMatcher(None, own, other, autojunk=False)
        ops = match.get_opcodes()
        same = sum(a2 - a1 for op, a1, a2, _, _ in ops if op == "equal")
        hits = [(b1, b2) for op, _, _, b1, b2 in ops if op == "equal"]
        low, high = (hits[0][0], hits[-1][1]) if hits else (0, 0)
        diff, clash = [], False
        for op, a1, a2, b1, b2 in ops:
            if op != "equal":
                diff += [f"-{w}" for w in own[a1:a2]] + [f"+{w}" for k, w in enumerate(other[b1:b2], b1) if low <= k < high]
                clash = clash or _clash(own[a1:a2], other[b1:b2]) or not _OTHER.isdisjoint(own[a1:a2]) or (low < b2 <= high and not _OTHER.isdisjoint(other[b1:b2]))
        return same / max(1, len(own)), diff, clash

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, float, str]]]:
        """Number of candidate blocks, and for each notice: start, end, licence, reduction, differing words."""
        n, out = 0, []
        for at, block in self.blocks(text or ""):
            n += 1
            out += [(at + a, at + b, *rest) for a, b, *rest in self.notices(block)]
        return n, out


OUT = "n_blocks long, licenses string, spans string, best_reduction double, differences string"


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, templates: dict[str, str] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """One row for each document: keep, candidate blocks, licences found (sorted, comma-joined; | between those that share the wording), their spans as
    licence:start:end in code points, the best reduction (null without a find) and the differing words."""
    keep = keep or ["doc_id"]
    given = docs.select(*keep, *([] if text_col in keep else [text_col]))
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            cols = [
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([",".join(sorted({x[2] for x in hits})) for _, hits in found], pa.string()),
                pa.array([",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in hits) for _, hits in found], pa.string()),
                pa.array([max((x[3] for x in hits), default=None) for _, hits in found], pa.float64()),
                pa.array(["; ".join(x[4] for x in hits if x[4]) for _, hits in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cols, names=keep + [x.split()[0] for x in OUT.split(", ")])

    return given.mapInArrow(run, f"{made}, {OUT}")
