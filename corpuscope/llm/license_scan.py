"""License scans by patience alignment.

Words of a text are looked up in the templates' vocabulary. A template whose distinct words are mostly there gets
windows of the text that hold enough of its words, and each window is aligned: words that occur once in both are
anchors, the longest increasing subsequence of their places is kept, and the gaps between anchors are aligned the same
way after equal words at their ends are taken. Coverage is the share of the template's words that the alignment matches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import only, released, tune
from corpuscope.llm.decontam import words_of

#: Share of a template's words that must be matched, and that a window must hold to be aligned.
COVERAGE = 0.9
#: A match may hold this share of foreign words besides, and SLACK_WORDS more.
LOOSE = 0.5
SLACK_WORDS = 4

# Public license texts and notices, by SPDX identifier.
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both, by patience: gaps in turn, on a stack."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, p, q = stack.pop()
        while a < b and p < q and text[a] == template[p]:
            out.append((a, p))
            a, p = a + 1, p + 1
        while a < b and p < q and text[b - 1] == template[q - 1]:
            b, q = b - 1, q - 1
            out.append((b, q))
        if a == b or p == q:
            continue
        once: dict[int, int] = {}
        for i in range(a, b):
            once[text[i]] = -1 if text[i] in once else i
        seen: dict[int, int] = {}
        for j in range(p, q):
            seen[template[j]] = -1 if template[j] in seen else j
        pairs = [(once.get(w, -1), j) for w, j in seen.items() if j >= 0]  # in order of the template
        pairs = [x for x in pairs if x[0] >= 0]
        kept = [pairs[i] for i in longest_increasing([x[0] for x in pairs])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, p - 1), *kept, (b, q)]
        stack += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Templates:
    """Templates over their common vocabulary."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in templates]
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)] for _, t in templates]
        self.member = np.zeros((len(templates), len(self.vocabulary) + 1), dtype=bool)  # the last column: other words
        for k, w in enumerate(self.words):
            self.member[k, w] = True
        self.distinct = self.member.sum(axis=1)

    def scan(self, text: str | None, least: float = COVERAGE) -> tuple[int, list[dict]]:
        """(words, matches by place), a match being license, template, coverage, start and end (in words)."""
        words = words_of(text)
        other = len(self.vocabulary)
        get = self.vocabulary.get
        ids = np.array([get(w, other) for w in words], dtype=np.int64)
        out: list[dict] = []
        if not len(ids):
            return 0, out
        present = np.zeros(other + 1, dtype=np.int64)
        present[ids] = 1
        for k in np.flatnonzero(self.member @ present >= least * self.distinct):
            out += self._windows(ids, int(k), least)
        # of matches that overlap, the one of most matched words counts
        out.sort(key=lambda x: (-round(x["coverage"] * len(self.words[x["template"]])), -x["coverage"], x["start"], x["template"]))
        taken: list[dict] = []  # by place, apart from each other: a match need only be held against its neighbours
        starts: list[int] = []
        for x in out:
            k = bisect_left(starts, x["end"])
            if not k or taken[k - 1]["end"] <= x["start"]:
                starts.insert(k, x["start"])
                taken.insert(k, x)
        return len(words), taken

    def _windows(self, ids: np.ndarray, k: int, least: float) -> list[dict]:
        template = self.words[k]
        m = len(template)
        reach = m + int(LOOSE * m) + SLACK_WORDS
        held = np.concatenate(([0], np.cumsum(self.member[k][ids])))
        count = held[np.minimum(np.arange(len(ids)) + reach, len(ids))] - held[:-1]
        starts = np.flatnonzero((count >= least * m) & self.member[k][ids])
        found, at = [], 0
        while (i := int(np.searchsorted(starts, at))) < len(starts):
            s = int(starts[i])
            pairs = align(ids[s : s + reach].tolist(), template)
            if len(pairs) >= least * m and pairs[-1][0] + 1 - pairs[0][0] <= reach:
                found.append({"license": self.names[k], "template": k, "coverage": len(pairs) / m, "start": s + pairs[0][0], "end": s + pairs[-1][0] + 1})
                at = found[-1]["end"]
            else:
                at = s + 1
        return found


_MATCHES = "n_words bigint, licenses array<struct<license:string,template:int,coverage:double,start:bigint,end:bigint>>"


def scan_licenses(docs: DataFrame, text: str = "text", least: float = COVERAGE) -> DataFrame:
    """docs with n_words and licenses (matches by place; none for null, empty and wordless texts).

    Whole texts are read. Of overlapping matches the one of most matched words stays, ties by coverage, place and order of templates.
    Repeated rows get equal results, an empty table gives an empty one; columns named as the new ones are replaced, all
    others come through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    tune(docs.sparkSession)
    docs = docs.drop("n_words", "licenses")
    schema = StructType(docs.schema.fields + StructType.fromDDL(_MATCHES).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for b in batches:
            got = [templates.scan(t.as_py(), least) for t in b.column(text)]
            extra = [pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], arrow.field("licenses").type)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], schema=arrow)

    return docs.mapInArrow(released(run), schema)


def license_query(spark, sf_dir: str) -> DataFrame:
    """op6: per document its words, matches and the licenses that they name."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = scan_licenses(docs)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("licenses").cast("bigint").alias("n_matches"), names.alias("licenses"), best.alias("coverage"), F.col("licenses").alias("matches"))
