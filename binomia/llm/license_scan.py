"""Licence scans: Dice coefficient over word bigrams of normalised text and templates.

A run is a stretch of words; it starts and ends with a bigram of the template, because
other ends only lower the coefficient, and holds no more bigrams, repeats counted, than
the size bound allows. With a and b distinct bigrams Dice is at most 2 min(a, b) / (a + b);
so a template is compared only with texts that hold enough of its distinct bigrams, and
only from starts that enough of them follow. A run whose first bigram comes again inside
it is never better than the one that starts later and isn't tried, which keeps texts of
many equal lines cheap. All starts of a text are tried at once in numpy, in slices of
bounded size.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, sliced

#: Wordings by which licences are usually granted or named, and the whole short licences.
#: Longer ones are a parameter: see :func:`read_templates`.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}
THRESHOLD = 0.8

#: Places (starts x words) that are compared at a time.
CELLS = 1 << 20


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class Matcher:
    """Templates as sets of bigrams, and the runs of a text that come close to them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float) -> None:
        self.threshold = threshold
        words = [(name, alnum_words(t)) for name, texts in templates.items() for t in texts]
        self.templates = [(name, bigrams(w)) for name, w in words if len(w) > 1]
        #: Bigrams that a run must share, and those that it may have, by template
        self.least = np.array([threshold / (2 - threshold) * len(own) - 1e-9 for _, own in self.templates])
        self.most = [int((2 - threshold) / threshold * (len(w) - 1) + 1e-9) for _, w in words if len(w) > 1]
        self.vocab: dict[bytes, int] = {}
        for _, own in self.templates:
            for pair in sorted(own):
                for w in pair:
                    self.vocab.setdefault(w, len(self.vocab))
        codes = [np.array([self._code(*p) for p in sorted(own)], np.int64) for _, own in self.templates]
        self.codes = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]))
        self.member = np.zeros((len(self.templates), len(self.codes) + 1), bool)
        for k, c in enumerate(codes):
            self.member[k, np.searchsorted(self.codes, c)] = True

    def _code(self, a: bytes, b: bytes) -> int:
        return self.vocab[a] * len(self.vocab) + self.vocab[b]

    def find(self, text: str | None) -> list[tuple[float, str, int, int]]:
        """(Dice, licence, first word, last word + 1), best first, without overlaps.

        Every start has its best run, the shortest of equals; ties among runs go to the
        longer template, then the first name and place.
        """
        words = alnum_words(text or "")
        if len(words) < 2 or not len(self.codes):
            return []
        known = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        both = (known[:-1] >= 0) & (known[1:] >= 0)
        code = known[:-1] * len(self.vocab) + known[1:]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        gram = np.where(both & (self.codes[at] == code), at, len(self.codes))
        seen = np.unique(gram)
        close = np.flatnonzero(self.member[:, seen].sum(1) >= self.least)
        if not len(close):
            return []
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        ids = ids[:-1] * len(number) + ids[1:]
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        past, after = np.full(len(ids), -1), np.full(len(ids), len(ids))
        past[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
        hits = []
        for k in close.tolist():
            name, own = self.templates[k]
            for dice, start, stop in self._runs(k, self.member[k][gram], past, after):
                hits.append((-dice, -len(own), name, start, stop))
        out: list[tuple[float, str, int, int]] = []
        taken: list[tuple[int, int]] = []
        for dice, _, name, start, stop in sorted(hits):
            x = bisect(taken, (start, stop))
            if (x == 0 or taken[x - 1][1] <= start) and (x == len(taken) or taken[x][0] >= stop):
                taken.insert(x, (start, stop))
                out.append((-dice, name, start, stop))
        return out

    def _runs(self, k: int, inside: np.ndarray, past: np.ndarray, after: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """The best run (Dice, first word, last word + 1) of each start, where it reaches the threshold."""
        size = len(self.templates[k][1])
        starts = np.flatnonzero(inside)
        limit = np.minimum(after[starts], starts + self.most[k])  # the first bigram doesn't come again
        total = np.concatenate([[0], np.cumsum(inside)])
        enough = total[np.minimum(limit, len(inside))] - total[starts] >= self.least[k]
        starts, limit = starts[enough], np.minimum(limit[enough], len(inside))
        if not len(starts):
            return
        wide = int((limit - starts).max())
        rows = max(1, CELLS // wide)
        for lo in range(0, len(starts), rows):
            s, e = starts[lo : lo + rows, None], limit[lo : lo + rows, None]
            col = np.minimum(s + np.arange(wide), len(inside) - 1)
            fresh = (past[col] < s) & (s + np.arange(wide) < e)
            hit = fresh & inside[col]
            shared = np.cumsum(hit, 1, dtype=np.int32)
            dice = np.where(hit, 2 * shared / (np.cumsum(fresh, 1, dtype=np.int32) + size), 0)
            best = dice.argmax(1)
            top = dice[np.arange(len(best)), best]
            for x in np.flatnonzero(top >= self.threshold).tolist():
                first = int(starts[lo + x])
                yield float(top[x]), first, first + int(best[x]) + 2


def read_templates(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Whole licence texts from a folder, one file each, named as the licence: ``GPL-3.0.txt``.

    For a set of licences, which is small: its texts are held by every task that scans.
    """
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return {r["name"].rsplit(".", 1)[0]: (r["value"],) for r in rows.orderBy("name").collect()}


def _scan(templates: dict[str, tuple[str, ...]], threshold: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for b in sliced(batches):
            rows = [[{"license": n, "dice": d, "start": s, "stop": e} for d, n, s, e in matcher.find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "licenses"])

    return run


def license_matches(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, license, dice, licenses``.

    ``licenses`` holds all matches with Dice of at least ``threshold`` by falling Dice, each
    with its words [start, stop); overlapping weaker ones are left out. ``license`` and
    ``dice`` are those of the first, null without any. Ties go to the longer template, then
    the first name. Null and empty texts match nothing; repeated rows are kept; other
    columns are ignored. Nothing is shuffled.
    """
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(templates, threshold), "doc_id long, licenses array<struct<license:string,dice:double,start:long,stop:long>>")
    return out.select("doc_id", F.get("licenses", 0)["license"].alias("license"), F.get("licenses", 0)["dice"].alias("dice"), "licenses")
