"""License scan: patience alignment of documents with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import pieces, text_bytes, tidy, with_columns, words_of
from .storage import plain_columns, small_batches

RESULT = ("licenses", "best_license", "coverage", "matched_words", "span_start", "span_stop")
PIECE = 1 << 20

_BSD_1 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BSD_2 = (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ADS = (
    " All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the organization."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_TERMS = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_X11_END = (
    " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings "
    "in this Software without prior written authorization from the X Consortium."
)
_GNU = {"gpl-2.0": ("General", "2"), "gpl-3.0": ("General", "3"), "lgpl-2.1": ("Lesser General", "2.1"), "lgpl-3.0": ("Lesser General", "3"), "agpl-3.0": ("Affero General", "3")}
_CC = ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA")

# Notices, grants and terms as the licenses publish or recommend them. Of BSD and MIT texts that aren't whole, only the family is known.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    **{f"apache-{v}-line": f"Licensed under the Apache License, Version {v}." for v in ("1.0", "1.1", "2.0")},
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-family-terms": _BSD_1,
    "bsd-2-clause-terms": _BSD_1 + _BSD_2 + _BSD_END,
    "bsd-3-clause-terms": _BSD_1 + _BSD_2 + _BSD_NAMES + _BSD_END,
    "bsd-4-clause-terms": _BSD_1 + _BSD_2 + _BSD_ADS + _BSD_NAMES + _BSD_END,
    **{f"cc-{kind.lower()}-4.0-line": f"Licensed under CC {kind} 4.0." for kind in _CC},
    **{f"{name}-line": f"This work is licensed under the GNU {kind} Public License, version {v}." for name, (kind, v) in _GNU.items()},
    **{f"{name}-short-line": f"Licensed under the GNU {kind} Public License, version {v}." for name, (kind, v) in _GNU.items()},
    **{f"{name}-terms-line": f"Under the terms of the GNU {kind} Public License, version {v}." for name, (kind, v) in _GNU.items()},
    **{
        f"{name}-notice": (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by "
            f"the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
        )
        for name, (kind, v) in _GNU.items()
    },
    "mit-line": "Released under the MIT License.",
    "mit-family-grant": _MIT_GRANT + ".",
    "mit-grant": _MIT_GRANT + _MIT_TERMS + _MIT_END,
    "mit-0-grant": _MIT_GRANT + "." + _MIT_END,
    "x11-grant": _MIT_GRANT + _MIT_TERMS + _MIT_END + _X11_END,
}

# What tells a template from its siblings: these words must align, side by side in the text too.
REQUIRED = {
    **{f"apache-{v}-line": (f"Apache License, Version {v}",) for v in ("1.0", "1.1", "2.0")},
    "apache-2.0-notice": ("Apache License, Version 2.0",),
    "bsd-2-clause-terms": ("Redistributions in binary form must reproduce the above copyright notice",),
    "bsd-3-clause-terms": ("Redistributions in binary form must reproduce the above copyright notice", "endorse or promote products derived from this software"),
    "bsd-4-clause-terms": ("All advertising materials mentioning features or use of this software", "endorse or promote products derived from this software"),
    **{f"cc-{kind.lower()}-4.0-line": (f"CC {kind} 4.0",) for kind in _CC},
    **{f"{name}-{form}line": (f"GNU {kind} Public License, version {v}",) for name, (kind, v) in _GNU.items() for form in ("", "short-", "terms-")},
    **{f"{name}-notice": (f"GNU {kind} Public License", f"version {v} of the License") for name, (kind, v) in _GNU.items()},
    "mit-line": ("MIT License",),
    "mit-grant": ("subject to the following conditions", "shall be included in all copies or substantial portions"),
    "x11-grant": ("subject to the following conditions", "shall not be used in advertising"),
}


@dataclass(frozen=True)
class ScanSettings:
    """coverage: least share of a template's words that must align; density: least share of the words between the first and last aligned one that must be aligned;
    short: a template of at most so many words aligns without other words, or missing ones, in between."""

    coverage: float = 0.85
    density: float = 0.75
    short: int = 15


def patience(a: list[int], b: list[int], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Aligned places of a and b: equal ends first, then words that each side has once, in the longest run that rises on both sides, then the gaps between them alike. A gap without such words aligns nothing more."""
    out: list[tuple[int, int]] = []
    todo = [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b.get(w) == 1}
        anchors = _rising([(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in the first number, of pairs that rise in the second."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(ends, i)
        before[k] = at[p - 1] if p else -1
        if p == len(ends):
            ends.append(i)
            at.append(k)
        else:
            ends[p], at[p] = i, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def regions(text: list[int], template: list[int], settings: ScanSettings, required: tuple[tuple[int, int], ...] = ()) -> list[tuple[float, int, int, int]]:
    """(coverage, aligned words, first, last place in the text) of each alignment that reaches both shares and has the required stretches (from, to) of the template word for word; they may overlap.

    An alignment that covers enough misses few template words, so it holds one of the template's rarest few. Each occurrence of one of those in the text is taken for each of its places in the template,
    unless an alignment found before has just that pair: the words next to it that are equal are aligned first, then the rest of a stretch wide enough for any alignment through the pair. So the same
    template further on, right behind, or far apart words like its own, hide none."""
    n = len(template)
    wanted = Counter(template)
    places: dict[int, list[int]] = {w: [] for w in wanted}
    for i, w in enumerate(text):
        if w in places:
            places[w].append(i)
    marks = [[i for i in places[template[a]] if text[i : i + b - a] == template[a:b]] for a, b in required]
    if not all(marks):
        return []
    need = -int(-settings.coverage * n // 1)
    missing, tested = n - need, []
    for w in sorted(wanted, key=lambda w: (len(places[w]), template.index(w))):  # whatever aligns enough can't miss all of these
        tested.append(w)
        missing -= wanted[w]
        if missing < 0:
            break
    slots = {w: [j for j, v in enumerate(template) if v == w] for w in tested}
    slack = int(n / settings.density) + 1 - n
    known = sorted(i for at in places.values() for i in at)
    out: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    done: set[tuple[int, int]] = set()
    for p in sorted(p for w in tested for p in places[w]):
        for t in slots[text[p]]:
            low, high = max(0, p - t - slack), min(len(text), p - t + n + slack)
            if (p, t) in done or bisect_left(known, high) - bisect_left(known, low) < need or any(bisect_left(at, high) == bisect_left(at, low) for at in marks):
                continue
            here = Counter(text[low:high])
            if sum(min(k, here[w]) for w, k in wanted.items()) < need:
                continue
            pairs = _dense(_through(text, template, p, t, low, high, n <= settings.short), settings.density)
            if len(pairs) >= need and _has(pairs, required):
                done.update(pairs)
                first, last = pairs[0][0], pairs[-1][0]
                if (first, last) not in out or len(pairs) > out[first, last][1]:
                    out[first, last] = len(pairs) / n, len(pairs), first, last
    return list(out.values())


def _has(pairs: list[tuple[int, int]], required: tuple[tuple[int, int], ...]) -> bool:
    """Whether each of the stretches of the template is aligned whole with words that stand side by side."""
    at = {j: i for i, j in pairs}
    return all(a in at and all(at.get(j) == at[a] + j - a for j in range(a, b)) for a, b in required)


def _through(text: list[int], template: list[int], p: int, t: int, low: int, high: int, whole: bool) -> list[tuple[int, int]]:
    """The alignment within text[low:high] that has place p of the text at place t of the template; `whole`: only the equal words next to it."""
    i, j, k, m = p, t, p + 1, t + 1
    while i > low and j > 0 and text[i - 1] == template[j - 1]:
        i, j = i - 1, j - 1
    while k < high and m < len(template) and text[k] == template[m]:
        k, m = k + 1, m + 1
    if whole:
        return list(zip(range(i, k), range(j, m), strict=True))
    before, after = patience(text, template, low, i, 0, j), patience(text, template, k, high, m, len(template))
    return [*before, *zip(range(i, k), range(j, m), strict=True), *after]


def _dense(pairs: list[tuple[int, int]], density: float) -> list[tuple[int, int]]:
    """The pairs without outlying ends: while too few of the words between the ends are aligned, the end with the wider gap goes."""
    a, b = 0, len(pairs)
    while b - a > 1 and b - a < density * (pairs[b - 1][0] - pairs[a][0] + 1):
        if pairs[a + 1][0] - pairs[a][0] > pairs[b - 1][0] - pairs[b - 2][0]:
            a += 1
        else:
            b -= 1
    return pairs[a:b]


def _apart(found: list[tuple[str, tuple]]) -> list[tuple[str, tuple]]:
    """Best first, without those that overlap a better one: a template like another is not found beside it in the same words, but wherever else it stands."""
    kept: list[tuple[str, tuple]] = []
    starts: list[int] = []
    stops: list[int] = []
    for name, best in sorted(found, key=lambda f: (-f[1][1], -f[1][0], f[0], f[1][2])):
        at = bisect_left(stops, best[2])
        if at == len(starts) or starts[at] > best[3]:
            starts.insert(at, best[2])
            stops.insert(at, best[3])
            kept.append((name, best))
    return kept


def _stretches(line: list[int], phrases: list[list[int]]) -> tuple[tuple[int, int], ...]:
    """Where each phrase first stands in the line; one that doesn't stand there is an error."""
    return tuple(next((a, a + len(p)) for a in range(len(line) + 1) if line[a : a + len(p)] == p) for p in phrases)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, settings: ScanSettings = ScanSettings(), required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """docs (text, ...) -> the columns of docs, and licenses (names of all templates found, sorted and comma-joined), best_license, coverage, matched_words, span_start, span_stop (bytes).

    The best license aligns the most words, then has the best coverage, then the first name, then stands first. Every place where a template stands counts; of those that overlap, only the best. A template's required phrases
    (REQUIRED for the own templates) must stand word for word, and a short template stands without other words in between, so a sibling license is not taken for it. Words are lower-case runs of letters and digits; the whole text is looked at, and only templates of which
    it holds enough words at all are aligned. Nothing is shuffled. Null and empty texts, and those without a license, have an empty list, nulls and coverage 0. Repeated rows fare alike. An empty table gives no rows. Columns named like a result are replaced.
    """
    given = TEMPLATES if templates is None else templates
    names = sorted(given)
    words = words_of(*text_bytes(pa.array([given[n] for n in names], pa.string())))
    vocabulary, numbers = np.unique(words.hash, return_inverse=True)
    lines = [numbers[a:b].tolist() for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
    phrases = [(t, p) for t, n in enumerate(names) for p in ((REQUIRED if templates is None else {}) if required is None else required).get(n, ())]
    told = words_of(*text_bytes(pa.array([p for _, p in phrases], pa.string())))
    spelt = [np.searchsorted(vocabulary, told.hash[a:b]).tolist() for a, b in zip(told.bounds, told.bounds[1:], strict=False)]
    marks = [_stretches(line, [p for (of, _), p in zip(phrases, spelt, strict=True) if of == t]) for t, line in enumerate(lines)]
    shares = np.stack([np.bincount(line, minlength=len(vocabulary)) for line in lines]) if lines else np.zeros((0, 0))
    sizes = np.array([len(line) for line in lines])
    keep = plain_columns(docs, *RESULT)
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((names, vocabulary, lines, shares, sizes, marks))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, lines, shares, sizes, marks = shared.value
        for batch in batches:
            for part in pieces(batch, PIECE):
                w = words_of(*text_bytes(part.column("text")))
                place = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
                known = vocabulary[place] == w.hash if len(vocabulary) else np.zeros(len(w.hash), dtype=bool)
                has = np.zeros((part.num_rows, len(vocabulary)), dtype=bool)
                has[w.text[known], place[known]] = True
                enough = (has @ shares.T >= settings.coverage * sizes) & (sizes > 0)
                out = {c: [None] * part.num_rows for c in RESULT}
                out["licenses"], out["coverage"] = [""] * part.num_rows, [0.0] * part.num_rows
                numbers = np.where(known, place, -1)
                for i in np.flatnonzero(enough.any(axis=1)):
                    text = numbers[w.bounds[i] : w.bounds[i + 1]].tolist()
                    found = [(names[t], region) for t in np.flatnonzero(enough[i]) for region in regions(text, lines[t], settings, marks[t])]
                    if found := _apart(found):
                        name, best = found[0]
                        base = w.bounds[i]
                        start = w.start[w.bounds[i]:w.bounds[i + 1]]
                        origin = text_start(part, i)
                        out["licenses"][i] = ",".join(sorted({n for n, _ in found}))
                        out["best_license"][i], out["coverage"][i], out["matched_words"][i] = name, best[0], best[1]
                        out["span_start"][i], out["span_stop"][i] = int(start[best[2]] - origin), int(w.stop[base + best[3]] - origin)
                kinds = {"licenses": pa.string(), "best_license": pa.string(), "coverage": pa.float64()}
                yield with_columns(part, keep, **{c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    def text_start(part: pa.RecordBatch, i: int) -> int:
        return int(text_bytes(part.column("text").slice(0, i))[1][-1])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.mapInArrow(run, ", ".join([*kinds, "licenses string, best_license string, coverage double, matched_words long, span_start long, span_stop long"]))
