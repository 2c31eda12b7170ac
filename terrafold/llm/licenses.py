"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Three kinds of units are compared: the whole text, its blocks (between blank lines) and its lines.
With d the least coefficient wanted, a unit of n bigrams can only match templates of n * d / (2 - d)
to n * (2 - d) / d bigrams: units outside all those bounds are dropped by their word count alone,
and inside them only templates that share a bigram (found through an index) are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 0.8
UNITS = ("whole", "block", "line")
#: Notices that the licences ask for or that are commonly used, then whole bodies of short licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)

_WORDS = re.compile(r"[^\W_]+")
_BLOCKS = re.compile(r"\n[ \t]*\n")


def words(text: str) -> list[str]:
    """Runs of letters and digits of the lower-cased text; all else separates."""
    return _WORDS.findall(text.lower())


def template_files(folder: str) -> tuple[tuple[str, str], ...]:
    """Templates from whole licence texts: one for each file of ``folder``, named by the file without its suffix."""
    return tuple((p.stem, p.read_text("utf-8", "replace")) for p in sorted(Path(folder).iterdir()) if p.is_file())


class Matcher:
    """Templates indexed by bigram, with the bounds that their sizes allow."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> None:
        self.least = least
        self.names = [name for name, _ in templates]
        split = [words(t) for _, t in templates]
        grams = [set(zip(w, w[1:])) for w in split]
        self.sizes = [len(g) for g in grams]
        self.index: dict[tuple[str, str], list[int]] = {}
        for i, g in enumerate(grams):
            for x in g:
                self.index.setdefault(x, []).append(i)
        self.fewest = min(n * least / (2 - least) for n in self.sizes) - 1e-6
        self.most = max(n * (2 - least) / least for n in self.sizes) + 1e-6

    def best(self, w: list[str]) -> tuple[float, str, int] | None:
        """(coefficient, licence, template) of the best template with the least coefficient or more."""
        if len(w) - 1 < self.fewest:  # distinct bigrams are fewer still
            return None
        hit = [x for x in zip(w, w[1:]) if x in self.index]
        if not hit:
            return None
        n = len(set(zip(w, w[1:])))
        if not self.fewest <= n <= self.most:
            return None
        shared = Counter(i for x in set(hit) for i in self.index[x] if 2 * min(n, self.sizes[i]) / (n + self.sizes[i]) >= self.least)
        scored = [(2 * c / (n + self.sizes[i]), self.names[i], i) for i, c in shared.items()]
        top = [s for s in scored if s[0] >= self.least]
        return min(top, key=lambda s: (-s[0], s[1], s[2])) if top else None

    def scan(self, text: str | None) -> list[tuple[str, int, int, str, float]]:
        """(unit, start, end, licence, coefficient) of all matching units, offsets in code points."""
        if not text:
            return []
        out = []
        at = 0
        per_line: list[tuple[int, int, list[str]]] = []
        for line in text.split("\n"):
            per_line.append((at, at + len(line), words(line)))
            at += len(line) + 1
        for start, end, w in per_line:
            if w and (m := self.best(w)):
                out.append(("line", start, end, m[1], m[0]))
        if "\n" in text:
            at = line = 0
            for b in [*_BLOCKS.finditer(text), None] if _BLOCKS.search(text) else []:
                end = b.start() if b else len(text)
                part: list[str] = []
                while line < len(per_line) and per_line[line][0] < at:
                    line += 1
                while line < len(per_line) and per_line[line][1] <= end:
                    part += per_line[line][2]
                    line += 1
                if text.find("\n", at, end) >= 0 and (m := self.best(part)):
                    out.append(("block", at, end, m[1], m[0]))
                at = b.end() if b else end
            if m := self.best([w for _, _, ws in per_line for w in ws]):
                out.append(("whole", 0, len(text), m[1], m[0]))
        elif out:
            out.append(("whole", 0, len(text), out[0][3], out[0][4]))
        return out


_SPAN_DDL = "array<struct<unit:string,start:bigint,end:bigint,license:string,dice:double>>"
_SPAN = pa.struct([("unit", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, n_lines, licenses and matches, one row for each row of ``docs``.

    ``license`` and ``dice`` are of the best unit (ties: the name first in order), null if none reaches
    ``least``; ``n_lines`` counts matching lines; ``licenses`` joins the distinct names found in order;
    ``matches`` are all units with offsets. Null and empty texts match nothing; repeated rows and
    null ids come back as they are; other columns are never read; an empty table gives an empty result.
    ``templates`` may be extended, by :func:`template_files` for instance; they are sent to the workers, so they must stay few.
    """
    matcher = Matcher(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matcher.scan(t.as_py()) for t in b.column(1)]
            best = [min(f, key=lambda m: (-m[4], m[3])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x and x[3] for x in best], pa.string()),
                    pa.array([x and x[4] for x in best], pa.float64()),
                    pa.array([sum(m[0] == "line" for m in f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({m[3] for m in f})) for f in found], pa.string()),
                    pa.array([[dict(zip(("unit", "start", "end", "license", "dice"), m, strict=True)) for m in f] for f in found], pa.list_(_SPAN)),
                ],
                names=["doc_id", "license", "dice", "n_lines", "licenses", "matches"],
            )

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("t"))
    return src.mapInArrow(run, f"doc_id long, license string, dice double, n_lines long, licenses string, matches {_SPAN_DDL}")
