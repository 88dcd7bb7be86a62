"""License scan by conditional compression.

Words that licenses use mark candidate blocks of a text, across lines and comment marks: a stretch of words of some lengths of a template,
for each class of template lengths. A block is compressed alone and with each template of the class as a raw zstandard dictionary. A
template goes on if it saves ``SHARE`` of what it saves of its own text at least; those are ranked by the bytes that they save, and in
that order confirmed by wording: laid on the same words of the block, a template must stand there with all but ``missing`` of its words,
in order, in a span that isn't much longer; one of fewer than EXACT words must stand there as it is. A place that a template has taken isn't
tried again. Differences in wording are exact: a run of words of the template and the words in the text instead.

Words that tell licenses apart (their names, versions, clauses, and negations) must not differ at all: not be missing, changed or added in
the span, nor may a negation stand before it in the same sentence. So another version or variant, for which there is no template, gives no
name rather than a wrong one. SPDX lines name whatever they say.

Confirmed notices that don't overlap are all reported; of those that do, the one that saves most bytes of its span. Nulls and empties: a
null or empty text has no notice; a null doc_id stays null; repeated rows give their findings each; ties go to the template that
comes first; no rows give no rows. Extra columns are ignored. Notices are looked for in whole texts; equal blocks are ranked, and equal
windows compared, once a worker.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import slices, table, texts

MISSING, CACHE = 0.15, 50_000
EXACT = 6  # templates of fewer words are found in their wording only
#: Of what a template saves of its own text, what it must save of a block; and the longest template of each class of lengths.
SHARE, CLASSES = 0.3, (6, 14, 30, 60, 120, 1_000)
TRIGGERS = ("licens", "licenc", "copyright", "warrant", "redistribut", "spdx-")
PAIRS = {("permission", "is"), ("permission", "to"), ("rights", "reserved"), ("public", "domain"), ("creative", "commons")}
_MAYBE = re.compile("|".join((*TRIGGERS, *(b if b not in ("is", "to") else a for a, b in sorted(PAIRS)))))
#: Public notices, fixed values.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
MIT_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_CONDITIONS = "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": MIT_GRANT,
    "MIT-whole-text": MIT_GRANT + " " + MIT_DISCLAIMER,
    "BSD-2-Clause-text": BSD_CONDITIONS + " " + BSD_DISCLAIMER,
    "BSD-3-Clause-text": BSD_CONDITIONS + " " + BSD_THIRD + " " + BSD_DISCLAIMER,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-whole-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-whole-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "SPDX": "SPDX-License-Identifier:",
}
#: Parts of words that tell licenses apart, and words that turn a notice round.
TELLING = frozenset("apache mit bsd isc gnu general lesser affero private mozilla eclipse creative commons cc nc sa nd attribution sharealike noncommercial noderivatives noderivs proprietary commercial".split())
NEGATIONS = frozenset("not no never neither nor without isn aren wasn weren".split())
_SPDX = re.compile(r"\W*([\w.+-]+(?: +(?:AND|OR|WITH) +[\w.+-]+)*)")
_WORD = re.compile(r"\w[\w.+/-]*\w|\w")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def triggers_of(words: list[str]) -> list[int]:
    return [i for i, w in enumerate(words) if any(t in w for t in TRIGGERS) or (i + 1 < len(words) and (w, words[i + 1]) in PAIRS)]


def tells(word: str) -> bool:
    return not TELLING.isdisjoint(re.split(r"\W+", word)) or word in NEGATIONS


def telling_words(words: list[str]) -> list[bool]:
    """Words of a template that must stand in a text: telling ones, and versions."""
    version = [any(c.isdigit() for c in w) and ("." in w or (i and words[i - 1] in ("version", "v"))) for i, w in enumerate(words)]
    return [v or tells(w) for v, w in zip(version, words, strict=True)]


def _compressor(known=None):
    """Literals are kept as they are, so that what a dictionary saves are the bytes of its matches, whatever else a block holds."""
    import zstandard as zstd

    plain = zstd.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=1, strategy=zstd.STRATEGY_FAST, target_length=1, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False)
    return zstd.ZstdCompressor(compression_params=plain, dict_data=known)


class Template:
    def __init__(self, name: str, text: str, plain):
        import zstandard as zstd

        self.name, self.words = name, words_of(text)
        self.bag, self.telling = Counter(self.words), telling_words(self.words)
        self.at = triggers_of(self.words) or list(range(len(self.words)))
        own = " ".join(self.words).encode()
        known = zstd.ZstdCompressionDict(own, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        self.compressor = _compressor(known)
        self.own = len(plain.compress(own)) - len(self.compressor.compress(own))


class Scanner:
    def __init__(self, templates: dict[str, str], missing: float = MISSING, share: float = SHARE):
        self.missing, self.share = missing, share
        self.plain = _compressor()
        self.templates = [Template(name, text, self.plain) for name, text in templates.items()]
        self.classes = [(most, [k for k, t in enumerate(self.templates) if less < len(t.words) <= most]) for less, most in zip((0, *CLASSES), CLASSES, strict=False)]
        self.seen: dict[tuple, tuple | None] = {}
        self.ranks: dict[tuple, list[int]] = {}

    def saved(self, k: int, raw: bytes) -> int:
        """Bytes that a template saves of a text."""
        return len(self.plain.compress(raw)) - len(self.templates[k].compressor.compress(raw))

    def rank(self, block: tuple[str, ...], among: list[int]) -> list[int]:
        """Templates that save enough of a block, by the bytes they save."""
        key = (among[0], block)
        if key not in self.ranks:
            if len(self.ranks) >= CACHE:
                self.ranks.clear()
            raw, found = " ".join(block).encode("utf-8", "replace"), []
            for k in among:
                saved = self.saved(k, raw)
                if saved > 0 and saved >= self.share * self.templates[k].own:
                    found.append((-saved, k))
            self.ranks[key] = [k for _, k in sorted(found)]
        return self.ranks[key]

    def align(self, k: int, found: tuple[str, ...]) -> tuple[int, int, int, str] | None:
        """Where the template's words begin and end in a window, their number, and the differences; None if it isn't confirmed."""
        if (k, found) not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[k, found] = self._align(k, found)
        return self.seen[k, found]

    def _align(self, k: int, found: tuple[str, ...]) -> tuple[int, int, int, str] | None:
        template = self.templates[k]
        wanted, least = template.words, (1 - self.missing) * len(template.words)
        if sum((template.bag & Counter(found)).values()) < least:
            return None
        ops = SequenceMatcher(None, wanted, found, autojunk=False).get_opcodes()
        inside = [o for o in ops if o[0] == "equal"]
        held = sum(o[2] - o[1] for o in inside)
        if not inside or held < least or inside[-1][4] - inside[0][3] > (1.5 * len(wanted) + 2 if len(wanted) >= EXACT else len(wanted)):
            return None
        changes = [o for o in ops if o[0] != "equal" and not (o[0] == "insert" and (o[4] <= inside[0][3] or o[3] >= inside[-1][4]))]
        for _, i, j, x, y in changes:
            if any(template.telling[i:j]) or any(tells(w) for w in found[max(x, inside[0][3]) : min(y, inside[-1][4])]):
                return None
        return inside[0][3], inside[-1][4], held, "; ".join(f"{' '.join(wanted[o[1] : o[2]]) or '-'} -> {' '.join(found[o[3] : o[4]]) or '-'}" for o in changes)

    def scan(self, text: str) -> list[tuple]:
        """(first line, last line, license, share saved, share held, differences), lines from 0."""
        if not _MAYBE.search(text.lower()):
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[i:j].lower() for i, j in spans]
        triggers = triggers_of(words)
        found: dict[tuple[int, int, int], tuple[int, str]] = {}
        for most, among in self.classes:
            nth = 0
            while among and nth < len(triggers):
                # a block around the triggers of the next ``most`` words
                first, end = triggers[nth], nth
                while end < len(triggers) and triggers[end] <= first + most:
                    end += 1
                here, nth = triggers[nth:end], end
                low, high = max(0, first - 3 * most // 2 - 2), here[-1] + 3 * most // 2 + 2
                taken: list[tuple[int, int]] = []
                for k in self.rank(tuple(words[low:high]), among):
                    for t in here:
                        if not any(i <= t < j for i, j in taken):
                            self._confirm(k, t, words, found, taken)
        ranked = []
        for (i, j, k), (held, changes) in found.items():
            before = words[max(0, i - 2) : i]
            if not NEGATIONS.isdisjoint(before) and not re.search(r"[.!?;:]|\n\s*\n", text[spans[i - len(before)][0] : spans[i][0]]):
                continue
            raw = " ".join(words[i:j]).encode("utf-8", "replace")
            ranked.append((-self.saved(k, raw), -held / len(self.templates[k].words), j - i, k, i, j, held, changes))
        out, taken = [], []
        breaks = [m.start() for m in re.finditer("\n", text)]
        for saved, _, _, k, i, j, held, changes in sorted(ranked):
            if all(j <= a or i >= b for a, b in taken):
                taken.append((i, j))
                name = self.templates[k].name
                if name == "SPDX":
                    said = _SPDX.match(text, spans[j - 1][1])
                    if not said or "\n" in text[spans[j - 1][1] : said.start(1)]:
                        continue
                    name = f"SPDX-{said[1]}"
                whole = len(self.plain.compress(" ".join(words[i:j]).encode("utf-8", "replace")))
                out.append((i, (bisect(breaks, spans[i][0]), bisect(breaks, spans[j - 1][0]), name, -saved / whole, held / len(self.templates[k].words), changes)))
        return [row for _, row in sorted(out)]

    def _confirm(self, k: int, t: int, words: list[str], found: dict, taken: list) -> None:
        template = self.templates[k]
        n = len(template.words)
        # a notice of many trigger words has some that are unchanged
        for p in template.at if len(template.at) <= 2 else [p for p in template.at if template.words[p] == words[t]]:
            # close to the template's length first, so that a stray word before it doesn't stretch it
            for slack in (0, n // 4 + 1, n // 2 + 1):
                begin = max(0, t - p - slack)
                one = self.align(k, tuple(words[begin : max(0, t - p + n + slack)]))
                if one:
                    i, j, held, changes = one
                    found[begin + i, begin + j, k] = held, changes
                    if held == n:
                        taken.append((begin + i, begin + j))
                        return


_FOUND = "doc_id long, first_line long, last_line long, license string, saved double, held double, differences string"


def _scan(templates: dict[str, str], missing: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, missing)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.float64(), pa.float64(), pa.string()]
        for batch in slices(batches):
            rows = [(doc_id, *found) for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for found in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, missing: float = MISSING) -> DataFrame:
    """A row for each confirmed license in each text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(templates or TEMPLATES, missing), _FOUND)


def op4_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_compression": op4_license_compression}
SQL: dict[str, str] = {}
