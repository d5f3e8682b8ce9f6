"""License scans: runs of words compared with license templates by the Dice coefficient.

Texts and templates are normalised to lower-case words (A-Z lowered; letters, digits and all
non-ASCII characters count). A window is a run of two or more consecutive words, wherever in a line it
begins or ends; its bigrams are its neighbouring words, across line ends too, repeats included.

    dice(window, template) = 2 * |common bigrams| / (|window| + |template|)

A dice of ``THRESHOLD`` t or more needs |window| between t / (2 - t) and (2 - t) / t times |template|, so
each template meets only windows of its size, and t / (2 - t) of the template's size is the least number of
its bigrams that such a window holds, which is counted first. A window of greatest dice begins and ends
with bigrams of the template (without another one at an end its dice is greater), so only those are
compared, by counts that grow with the window. Texts are read where they lie; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import WORD_BYTES, chunks, share, taken

THRESHOLD = 0.8

#: Licence notices in their usual wording, under their SPDX names.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Whole licence texts, without their copyright lines, under their SPDX names.
FULL_TEXTS = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
     "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
     "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
     "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
     "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
     "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
     "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)

TEMPLATES = NOTICES + FULL_TEXTS


def _most_common(kind: np.ndarray, counts: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each start i the bigrams that kind[i : end[i]] has in common with a template of these counts."""
    n = len(kind)
    order = np.argsort(kind, kind="stable")
    group = kind[order]
    number = np.arange(n) - np.searchsorted(group, group)
    # A bigram counts for the starts behind the one that is as many occurrences ago as the template holds.
    most = counts[group]
    behind = np.empty(n, np.int64)
    behind[order] = np.where(number >= most, order[np.maximum(np.arange(n) - most, 0)], -1) + 1
    first = np.maximum(behind, np.searchsorted(end, np.arange(n), "right"))
    change = np.bincount(first, minlength=n + 1)
    change[1:] -= 1
    return np.cumsum(change[:-1])


class Templates:
    """Templates as counts of numbered bigrams."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.t, self.all = threshold, []
        self.share = threshold / (2 - threshold) - 1e-9
        words: dict[bytes, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        bags = []
        for name, text in templates:
            ids = [words.setdefault(x, len(words) + 1) for x in text.encode().translate(WORD_BYTES).split()]
            if len(ids) > 1:
                bags.append((name, Counter(pairs.setdefault(x, len(pairs) + 1) for x in zip(ids, ids[1:], strict=False)), len(ids) - 1))
        self.words = words
        self.pair = np.zeros((len(words) + 1, len(words) + 1), np.int32)
        for (x, y), k in pairs.items():
            self.pair[x, y] = k
        for name, bag, size in bags:
            counts = np.zeros(len(pairs) + 1, np.int64)
            counts[list(bag)] = list(bag.values())
            self.all.append((name, counts, size))

    def best(self, text: bytes) -> dict[str, tuple[float, int, int]]:
        """Each licence's best (dice, line of its first word, line of its last word) of at least the threshold;
        of equal ones the first window, and of those that begin together the shortest."""
        get, line, ids = self.words.get, [], []
        for k, x in enumerate(text.split(b"\n")):
            w = [get(y, 0) for y in x.translate(WORD_BYTES).split()]
            ids += w
            line += [k] * len(w)
        x = np.array(ids, np.int64)
        pair = self.pair[x[:-1], x[1:]]
        places = np.flatnonzero(pair)
        pair = pair[places]
        found: dict[str, tuple[float, int, int]] = {}
        for name, counts, size in self.all if len(places) else ():
            own = counts[pair] > 0
            at, least = places[own], math.ceil(self.share * size - 1e-6)
            if len(at) < least:
                continue
            kind = pair[own]
            end = np.searchsorted(at, at + int(size / self.share), "left")  # windows hold fewer bigrams than this is ahead
            starts = np.flatnonzero(_most_common(kind, counts, end) >= least)
            if not len(starts):
                continue
            at, kind, most = at.tolist(), kind.tolist(), counts.tolist()
            for i in starts.tolist():
                seen: dict[int, int] = {}
                common = 0
                for j in range(i, int(end[i])):
                    g = kind[j]
                    seen[g] = seen.get(g, 0) + 1
                    common += seen[g] <= most[g]
                    dice = 2 * common / (at[j] - at[i] + 1 + size)
                    if dice >= self.t and (-dice, at[i], at[j]) < found.get(name, (0.0, 0, 0)):
                        found[name] = (-dice, at[i], at[j])
        return {n: (-d, line[i], line[j + 1]) for n, (d, i, j) in found.items()}


def scan(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``lic_found``: an array of (license, dice, first, last), one for each licence found,
    by name; first and last number the lines that its best window begins and ends in, from 0.

    Null, empty and wordless texts have none. All rows and columns stay, but for one named ``lic_found``.
    A template of fewer than two words matches nothing.
    """
    shared = share(docs.sparkSession, Templates(templates, threshold))
    docs = docs.drop("lic_found")
    one = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = taken(shared)
        for batch in batches:
            for rows, raw, at in chunks(batch, text):
                data = raw.tobytes()
                found = [[{"license": n, "dice": d, "first": a, "last": z} for n, (d, a, z) in sorted(known.best(data[at[k] : at[k + 1]]).items())] for k in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, kind)], [*names, "lic_found"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lic_found", T.ArrayType(one))]))


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    top = F.element_at(F.array_sort("lic_found", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).otherwise(1)), 1)
    best = F.when(F.size("lic_found") > 0, top)
    return found.select(
        F.col(doc).alias("doc_id"), F.size("lic_found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("lic_found", lambda x: x["license"]), ",").alias("licenses"),
        best["license"].alias("best_license"), best["dice"].alias("best_dice"), best["first"].alias("best_first"), best["last"].alias("best_last"),
    )
