"""License scans: stretches of words against licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: lower case, only letters and digits of words, lines don't matter. The Dice
coefficient of bags of bigrams of sizes n and m is at most 2 min(n, m) / (n + m), so a template is only compared with
stretches whose size lies between its bounds, and only where enough of its bigrams lie so near together that a
stretch within the bounds could hold them. A best stretch begins and ends with a bigram of its template, so only
those are looked at, anywhere in a text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import lean

THRESHOLD = 0.85

#: Licence notices, fixed texts by their SPDX-like names.
TEMPLATES = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}

#: How notices of one line name licences; fixed values.
NAMES = {
    "AGPL-3.0": ["GNU AGPL v3", "GNU Affero General Public License v3.0"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU GPL v2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU GPL v3", "GNU General Public License v3.0"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU LGPL v3", "GNU Lesser General Public License v3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["MPL 2.0"],
    "Zlib": ["zlib License"],
}
#: How such lines begin; fixed values.
VERBS = ("Distributed", "Licensed", "Released")


def _identifiers(name: str) -> list[str]:
    """The names under which a licence stands in an SPDX line."""
    return [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]


def _all_templates() -> dict[str, list[str]]:
    """TEMPLATES with lines of one verb and a name, SPDX lines, and the two-clause text, which is the three-clause one without its third clause."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, spoken in NAMES.items():
        out[name] += [f"{verb} under the {n}" for verb in VERBS for n in spoken]
    for name in out:
        if name != "all-rights-reserved":
            out[name] += [f"SPDX-License-Identifier: {i}" for i in _identifiers(name)]
    three = max(TEMPLATES["BSD-3-Clause"], key=len)
    out["BSD-2-Clause"].append(three[: three.index("3. Neither")] + three[three.index("THIS SOFTWARE") :])
    return out


ALL_TEMPLATES = _all_templates()

_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c == 0x0A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def bigrams(w: list[bytes]) -> Counter:
    return Counter(zip(w, w[1:]))


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * sum((a & b).values()) / n if n else 0.0


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = ALL_TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [(name, bigrams(words(t.encode()))) for name, texts in sorted(templates.items()) for t in texts]
        size = [bag.total() for _, bag in self.templates]
        self.bounds = [(m * threshold / (2 - threshold), m * (2 - threshold) / threshold) for m in size]
        self.holders: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for k, (_, bag) in enumerate(self.templates):
            for g in bag:
                self.holders[g].append(k)

    def stretches(self, w: list[bytes], k: int, hits: list[int]) -> list[tuple[float, int, int]]:
        """(Dice, first word, last word) of the best stretch from each hit, where one is near enough to template k.

        hits: where bigrams of the template stand in w.
        """
        name, bag = self.templates[k]
        m, (lo, hi) = bag.total(), self.bounds[k]
        need = self.threshold * (m + lo) / 2 - 1e-9  # bigrams in common of the shortest stretch that is near enough
        found = []
        for i, start in enumerate(hits):
            ahead = bisect_right(hits, start + hi - 1, i)
            if ahead - i < need:
                continue
            left = dict(bag)
            common, best = 0, None
            for j in range(i, ahead):
                g = w[hits[j]], w[hits[j] + 1]
                if left[g]:
                    left[g] -= 1
                    common += 1
                    n = hits[j] - start + 1
                    if n >= lo and (d := 2 * common / (n + m)) >= self.threshold and (best is None or d > best[0]):
                        best = (d, start, hits[j] + 1)
            if best:
                found.append(best)
        return found

    def scan(self, text: bytes | None) -> list[tuple[int, int, str, float]]:
        """(first line, last line, licence, Dice) of stretches without a word in common, in order of place.

        The nearest comes first, of equals the earliest, then the longest, then the first by name.
        """
        text = text or b""
        w = words(text)
        hits: dict[int, list[int]] = defaultdict(list)
        for i, g in enumerate(zip(w, w[1:])):
            for k in self.holders.get(g, ()):
                hits[k].append(i)
        near = [(-d, a, -b, self.templates[k][0]) for k, at in hits.items() for d, a, b in self.stretches(w, k, at)]
        if not near:
            return []
        starts: list[int] = []
        ends: list[int] = []
        out: list[tuple[int, int, str, float]] = []
        for d, a, b, name in sorted(near):
            b = -b
            at = bisect_left(starts, a)
            if (at and ends[at - 1] >= a) or (at < len(starts) and starts[at] <= b):
                continue
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((a, b, name, -d))
        last: list[int] = []  # words up to and with each line
        for line in text.translate(_KEEP).split(b"\n"):
            last.append((last[-1] if last else 0) + len(line.split()))
        return [(bisect_right(last, a), bisect_right(last, b), name, d) for a, b, name, d in sorted(out)]


def scan(docs: DataFrame, templates: dict[str, list[str]] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, first_line, last_line, license, dice): one row for each licence notice found in a text.

    Lines count from 0. Null and empty texts have none; repeated rows are each scanned; ids are only passed on and may
    be null or of any type.
    """
    scanner = Scanner(templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for m in scanner.scan(t.as_py())]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column("doc_id").type, pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["doc_id", "first_line", "last_line", "license", "dice"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, first_line int, last_line int, license string, dice double")


def by_document(docs: DataFrame, templates: dict[str, list[str]] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_notices, licenses, best_license, best_dice) of every row of docs; none: 0, '', null, 0.

    licenses are the distinct names, sorted; best_license is the nearest notice's, of equals the first by name. Null,
    empty and very long texts, repeated rows and ids of any type are each scanned as they are.
    """
    scanner = Scanner(templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column("text")]
            best = [min(((-d, name) for _, _, name, d in m), default=(0.0, None)) for m in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(m) for m in found], pa.int64()), pa.array([",".join(sorted({name for _, _, name, _ in m})) for m in found], pa.string()), pa.array([name for _, name in best], pa.string()), pa.array([abs(d) for d, _ in best], pa.float64())],
                ["doc_id", "n_notices", "licenses", "best_license", "best_dice"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_notices long, licenses string, best_license string, best_dice double")
