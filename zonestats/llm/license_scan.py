"""License scans by conditional compression."""

from __future__ import annotations

import difflib
import pkgutil
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gnu(short: str, name: str, thing: str, *versions: str) -> dict[str, str]:
    """The notices that the GNU licences ask for, and their usual forms
    without later versions. (Several wordings of a licence are a, b, c.)"""
    out = {}
    for v in versions:
        free = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of"
        said, at = f"the {name} as published by the Free Software Foundation", f"version {v.removesuffix('.0')}"
        out |= {f"{short}-{v}-or-later-notice": f"{free} {said}; either {at} of the License, or (at your option) any later version.",
                f"{short}-{v}-only-notice-a": f"{free} {said}; {at} of the License.",
                f"{short}-{v}-only-notice-b": f"{free} {said.replace(name, f'{name} {at}')}.",
                f"{short}-{v}-only-notice-c": f"{free} {at} of {said}."}
    return out


#: Wording of public licence notices, by SPDX-like name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MIT-licensed-notice": "Licensed under the MIT License.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    **{f"CC-{kind.upper().replace(' ', '-')}-4.0-long-notice":
       f"This work is licensed under a Creative Commons {name} 4.0 International License."
       for kind, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"),
                          ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
                          ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))},
    **_gnu("GPL", "GNU General Public License", "program", "1.0", "2.0", "3.0"),
    **_gnu("LGPL", "GNU Library General Public License", "library", "2.0"),
    **_gnu("LGPL", "GNU Lesser General Public License", "library", "2.1", "3.0"),
    **_gnu("AGPL", "GNU Affero General Public License", "program", "3.0"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
           "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
           "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
           "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                  "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                  "See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met: Redistributions of source code must retain the above copyright "
                    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
                    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
           "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
           "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
           "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
           "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
           "SOFTWARE.",
}
TEMPLATES["0BSD"] = TEMPLATES["ISC"].replace(
    ", provided that the above copyright notice and this permission notice appear in all copies", "")
#: The conditions of BSD-2 with their further clauses; what follows is the same in all.
_ENDORSE = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission.")
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + _ENDORSE
TEMPLATES["BSD-4-Clause"] = (
    TEMPLATES["BSD-2-Clause"] + " All advertising materials mentioning features or use of this software must display the following "
    "acknowledgement: This product includes software developed by the organization." + _ENDORSE)
#: Full texts, in the folder ``licenses``.
FULL = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0")
TEMPLATES |= {f"{n}-text": pkgutil.get_data(__package__, f"licenses/{n}.txt").decode() for n in FULL}
CUE = (r"(?i)licen[cs]e|copyright|spdx|hereby[\W_]+granted|redistribution|without[\W_]+warrant|public[\W_]+domain"
       r"|all[\W_]+rights|waived|\bCC[\W_]+BY")
LEAST = 0.15  # least relative size reduction of a window
COVERED = 0.85  # least share of a template's words found in order
#: Words that tell licences apart: a match has as many of them as its template, each in its place.
EXACT = set("apache mit bsd mozilla isc lesser affero cc0 sa nc nd noncommercial sharealike noderivatives noderivs later "
            "endorse advertising appear".split())
SHORT = 60  # words of a notice: every number in it is exact, in longer texts those after "version"
_TAG = re.compile(r"(?i)SPDX-License-Identifier:[ \t(]*")
_TAGGED = re.compile(r"([A-Za-z0-9][A-Za-z0-9.:+-]*[A-Za-z0-9+]|[A-Za-z0-9])[ \t)]*(?:(AND|OR|WITH|and|or|with)[ \t(]+)?")
_WORD = re.compile(r"[0-9a-z]+(?:\.[0-9a-z]+)*")
_NUMBER = re.compile(r"v?\.?(\d+(?:\.\d+)*)")


def _tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, lowered, and where they lie. A version's "v" and
    last ".0" are left out."""
    low = text.lower()
    if len(low) != len(text):  # some characters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = [(m.group(), m.span()) for m in _WORD.finditer(low)]
    numbers = ((_NUMBER.fullmatch(w) if w[0] in "v0123456789" else None, w) for w, _ in found)
    return [re.sub(r"\.0$", "", m.group(1)) if m else w for m, w in numbers], [s for _, s in found]


def _exact(words: list[str], short: bool) -> list[int]:
    """Where the words lie that must agree."""
    return [i for i, w in enumerate(words) if w in EXACT or w == "library" and i and words[i - 1] == "gnu"
            or _NUMBER.fullmatch(w) and (short or i and words[i - 1] in ("version", "v"))]


class _Template:
    """A template's words, their counts over the common vocabulary, and the
    compressor that has them as raw dictionary."""

    def __init__(self, name: str, words: list[str], vocabulary: dict[str, int], level: int):
        import zstandard as zstd

        self.name, self.words, self.n, self.short = name, words, len(words), len(words) <= SHORT
        self.exact = set(_exact(words, self.short))
        self.ids, self.counts = np.unique([vocabulary[w] for w in words], return_counts=True)
        text = " ".join(words).encode()
        self.dict = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(text, dict_type=zstd.DICT_TYPE_RAWCONTENT))

    def may_be_in(self, counts: np.ndarray, covered: float) -> bool:
        """Whether words counted so can cover the template, in any order."""
        return np.minimum(counts[self.ids], self.counts).sum() >= covered * self.n


@lru_cache(maxsize=2)
def _templates(level: int):
    import zstandard as zstd

    words = {n: _tokens(t)[0] for n, t in TEMPLATES.items()}
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in words.values() for w in t}))}
    return zstd.ZstdCompressor(level=level), vocabulary, [_Template(n, w, vocabulary, level) for n, w in words.items()]


def _windows(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """Windows of ``size`` over ``n`` words, ``step`` apart; the last ends at the end."""
    return [(i, i + size) for i in range(0, n - size, step)] + [(max(0, n - size), n)]


def _span(t: _Template, words: list[str], lo: int, hi: int, covered: float):
    """(first, end, words of the template missing, words extra) of the place
    in words[lo:hi] where the template fits best, if it is covered there and
    the words that tell licences apart agree."""
    match = [m for m in difflib.SequenceMatcher(None, words[lo:hi], t.words, autojunk=False).get_matching_blocks() if m.size]
    # the run of matches with the most words in order, less those in between
    best, start, run, at = (0, 0, 0), 0, 0, 0
    for k, m in enumerate(match):
        gap = m.a - at if k else 0
        run, start = (run + m.size - gap, start) if run > gap else (m.size, k)
        at = m.a + m.size
        best = max(best, (run, -start, k))
    match = match[-best[1]:best[2] + 1]
    same = sum(m.size for m in match)
    if not match or same < covered * t.n:
        return None
    first, end = match[0].a, match[-1].a + match[-1].size
    missing, extra = t.n - same, end - first - same
    found = words[lo + first:lo + end]
    ours = {i for m in match for i in range(m.b, m.b + m.size)}
    theirs = {i - first for m in match for i in range(m.a, m.a + m.size)}
    if not t.exact <= ours or not set(_exact(found, t.short)) <= theirs:
        return None
    if "later" not in t.words and "version" in t.words and "later" in words[lo + end:lo + end + 8]:
        return None  # goes on as "or any later version"
    if missing + extra > (1 - covered) * 2 * t.n:
        return None
    return lo + first, lo + end, missing, extra


def tags(text: str) -> list[dict]:
    """The licences that SPDX tags name, one by one: any identifier, exactly
    as written, with its exception."""
    out = []
    for tag in _TAG.finditer(text):
        at, link = tag.end(), "AND"
        while link and (m := _TAGGED.match(text, at)):
            if link.upper() == "WITH":
                out[-1] |= {"license": f"{out[-1]['license'].removesuffix('-tag')} WITH {m[1]}-tag", "end": m.end(1)}
            else:
                out.append({"license": f"{m[1]}-tag", "reduction": None, "missing": 0, "extra": 0, "start": m.start(1), "end": m.end(1)})
            at, link = m.end(), m[2]
    return out


def scan_text(text: str, level: int = 19, least: float = LEAST, covered: float = COVERED) -> list[dict]:
    """Licences of one text, whatever its line breaks and length.

    The words are gone through in windows about as long as each template that
    overlap, so that each place of the template lies in one. A window's
    reduction is how much smaller it gets with the template as raw dictionary.
    Places whose reduction reaches ``least`` are taken by bytes saved, the
    most first, and compared word by word; the first that is confirmed takes
    its words. What is left is gone through again until nothing is found.
    A window whose words could not cover the template in any order is not
    compressed, as no comparison could confirm it. SPDX tags are read as such.
    """
    own, vocabulary, templates = _templates(level)
    words, places = _tokens(text)
    other, found = len(vocabulary), []
    ids = np.array([vocabulary.get(w, other) for w in words], np.int64)
    while len(words):
        counts, ranked = np.bincount(ids, minlength=other + 1), []
        for k, t in enumerate(templates):
            if not t.may_be_in(counts, covered):
                continue
            size = int(t.n * (1 + 2 * (1 - covered))) + 1  # the longest place that is confirmed
            for lo, hi in _windows(len(words), 2 * size, size):
                if t.may_be_in(np.bincount(ids[lo:hi], minlength=other + 1), covered):
                    best = (0.0, 0)
                    for a, b in _windows(hi - lo, size, max(1, size - t.n)):
                        raw = " ".join(words[lo + a:lo + b]).encode()
                        alone = len(own.compress(raw))
                        saved = alone - len(t.dict.compress(raw))
                        best = max(best, (saved / alone, saved))
                    if best[0] >= least:
                        ranked.append((best[1], best[0], -lo, k, lo, hi))
        before = len(found)
        for _, reduction, _, k, lo, hi in sorted(ranked, reverse=True):
            t = templates[k]
            if not t.may_be_in(np.bincount(ids[lo:hi], minlength=other + 1), covered):
                continue  # its words are taken
            hit = _span(t, words, lo, hi, covered)
            if hit:
                a, b, missing, extra = hit
                found.append({"license": t.name, "reduction": round(reduction, 4), "missing": missing, "extra": extra,
                              "start": places[a][0], "end": places[b - 1][1]})
                ids[a:b] = other
                words[a:b] = [""] * (b - a)
        if len(found) == before:
            break
    return sorted(found + tags(text), key=lambda f: (f["start"], f["end"]))


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.int32()),
                             ("extra", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan_rows(batches, level: int, least: float, covered: float):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            out = [scan_text(text or "", level, least, covered) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, _FOUND)], names=["doc_id", "found"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 19, least: float = LEAST,
                  covered: float = COVERED) -> DataFrame:
    """One row per licence found in a document: doc_id, license, reduction
    (relative size saved by the template as dictionary; null for a tag), missing and extra
    (words by which the wording differs), start and end (characters of the
    words found). Only texts with a cue leave the JVM; every word of them is read.

    A null or empty text has none; repeated rows are reported alike; an empty
    table gives no rows; other columns are ignored. No shuffle.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(CUE))
    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(partial(_scan_rows, level=level, least=least, covered=covered),
                         f"doc_id {kind}, found array<struct<license:string,reduction:double,missing:int,extra:int,start:int,end:int>>")
    return out.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
