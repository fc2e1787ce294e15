"""License scans: MinHash bands over overlapping windows, verified by containment.

A template of n words is looked for in windows of twice ``block`` words, where block
is the power of two from n up: every place of a template lies inside a window, and
a window with all of the template's shingles is at least a quarter template. With
one row a band and BANDS bands, such a window misses every band with a chance of
0.75 ** BANDS (1e-6). A band is one hash function; the window's minimum is the lesser
of two block minima, so a word costs one hash and one comparison a band. The templates'
minima of a band are a sorted table in which the windows' minima are looked up, so the
cost of a window grows with the logarithm of the number of templates. Windows that meet
a template in some band are compared with it shingle by shingle.

Templates are a parameter: a list of (name, notice) of at most MAX_TEMPLATES, so
what the tasks hold is bounded. All words of all documents are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontamination import tokenized
from .wordbytes import BASE, Words, mix

SHINGLE = 2
BANDS = 48
CONTAINMENT = 0.8
MIN_BLOCK = 4
MAX_TEMPLATES = 10_000

#: Public license notices, file headers and whole short licenses, without
#: the names of holders. Each has a name of its own.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("as-is", "The software is provided as is, without warranty of any kind, express or implied."),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details. You should have received a copy of the GNU General Public License along with this program. If not,
        see <https://www.gnu.org/licenses/>."""),
    ("GPL-2.0-header", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details. You should have received a copy of the GNU General Public License along with this program; if not,
        write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("LGPL-2.1-header", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
        Public License for more details."""),
    ("AGPL-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
        Public License for more details."""),
    ("MPL-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT-full", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause-full", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
        OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC-full", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE."""),
    ("Unlicense-full", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    ("Zlib-full", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions."""),
    ("BSL-1.0-full", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so."""),
]


def shingle_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each shingle; a text of one word has that word as shingle."""
    at = np.flatnonzero(w.whole(SHINGLE))
    single = w.first[:-1][np.diff(w.first) == 1]
    place = np.concatenate((at, single))
    h = np.concatenate((w.shingles(SHINGLE)[at], w.hash[single]))
    order = np.argsort(place, kind="stable")
    return place[order], h[order]


class Templates:
    """The templates' shingles and, for each block size, their band minima."""

    def __init__(self, templates: list[tuple[str, str]]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates")
        self.names, self.shingles, self.blocks = [], [], {}
        for name, text in templates:
            for _, w in tokenized([text]):
                _, h = shingle_hashes(w)
                if len(h):
                    block = max(MIN_BLOCK, 1 << int(len(w.hash) - 1).bit_length())
                    self.blocks.setdefault(block, []).append(len(self.names))
                    self.names.append(name)
                    self.shingles.append(np.unique(h))
        self.table = {b: [self._sorted([self.band(self.shingles[t], k).min() for t in of], of) for k in range(BANDS)] for b, of in self.blocks.items()}

    @staticmethod
    def _sorted(minima: list[np.uint64], templates: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A band's look-up table: the minima in order, and whose they are."""
        order = np.argsort(minima, kind="stable")
        return np.array(minima, dtype=np.uint64)[order], np.array(templates, dtype=np.int64)[order]

    @staticmethod
    def band(h: np.ndarray, k: int) -> np.ndarray:
        x = (h ^ np.uint64((k + 1) * BASE % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def scan(self, w: Words) -> list[tuple[int, int, int, int, float]]:
        """(text number, template, first word, last word + 1, containment) of windows."""
        place, h = shingle_hashes(w)
        out: list[tuple[int, int, int, int, float]] = []
        if not len(h):
            return out
        text = w.text[place]
        local = place - w.first[text]
        cells, met = {}, {}
        for block in self.blocks:
            cell = np.concatenate(([True], (text[1:] != text[:-1]) | (local[1:] // block != local[:-1] // block)))
            begins = np.flatnonzero(cell)
            joined = np.append(text[begins[1:]] == text[begins[:-1]], False)  # the next block is the same text's
            cells[block], met[block] = (begins, joined), []
        for k in range(BANDS):
            value = self.band(h, k)
            for block, (begins, joined) in cells.items():
                low = np.minimum.reduceat(value, begins)
                window = np.where(joined, np.minimum(low, np.append(low[1:], low[-1:])), low)
                least, whose = self.table[block][k]
                first, stop = np.searchsorted(least, window, side="left"), np.searchsorted(least, window, side="right")
                found = np.flatnonzero(stop > first)
                n = (stop - first)[found]
                at = np.repeat(first[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                met[block].append(np.stack([np.repeat(found, n), whose[at]]))
        for block, (begins, joined) in cells.items():
            ends = np.append(begins[1:], len(h))
            for n, template in np.unique(np.concatenate(met[block], axis=1), axis=1).T.tolist():
                stop = ends[n + 1] if joined[n] else ends[n]
                own = h[begins[n] : stop]
                part = float(np.isin(self.shingles[template], own).mean())
                if part >= CONTAINMENT:
                    hit = np.flatnonzero(np.isin(own, self.shingles[template])) + begins[n]
                    out.append((int(text[begins[n]]), template, int(local[hit[0]]), int(local[hit[-1]] + SHINGLE), part))
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment): a row for each window of
    ``docs`` (doc_id, text) that holds CONTAINMENT or more of a template's shingles,
    with the words from the first to the last shared shingle. A place in two
    overlapping windows is found twice. Null, empty and wordless texts find nothing;
    rows that repeat are scanned each."""
    common.batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            found = [(first + t, *rest) for first, w in tokenized(r["text"].to_pylist()) for t, *rest in shared.value.scan(w)]
            at, template, lo, hi, part = zip(*found, strict=True) if found else ((),) * 5
            names = [shared.value.names[t] for t in template]
            columns = [r["doc_id"].take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(part, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "first_word", "end_word", "containment"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, license string, first_word long, end_word long, containment double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document and license of TEMPLATES that it holds, the highest containment
    and the number of windows. Null, empty and wordless texts have no row; rows that
    share a doc_id count together; an empty table gives no rows."""
    found = scan_licenses(common.table(spark, sf_dir, "documents"), TEMPLATES)
    return found.groupBy("doc_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.count("*").alias("n_windows"))


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    return rf"""
WITH template(license, text) AS (VALUES {quoted}),
word AS (
  SELECT license, regexp_extract_all(translate(text, '{common.ASCII_UPPER}', '{common.ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM template),
shingle AS (SELECT DISTINCT license, len(w) AS n, w[i] || ' ' || w[i + 1] AS s FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM word)),
size AS (
  SELECT license, count(*) AS n_shingles, greatest({MIN_BLOCK}, CAST(pow(2, ceil(log2(min(n)))) AS BIGINT)) AS block FROM shingle GROUP BY license),
low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.ASCII_UPPER}', '{common.ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT doc_id, len(w) - 1 AS n, i - 1 AS at, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM low)),
met AS (
  SELECT p.doc_id, z.license, z.n_shingles, p.s, unnest([p.at // z.block, p.at // z.block - 1]) AS cell, (p.n - 1) // z.block AS last_cell
  FROM place p JOIN shingle t ON t.s = p.s JOIN size z ON z.license = t.license),
held AS (
  SELECT doc_id, license, cell, count(DISTINCT s) / any_value(n_shingles)::DOUBLE AS containment FROM met WHERE cell >= 0 AND cell <= last_cell GROUP BY doc_id, license, cell)
SELECT doc_id, license, round(max(containment), 6) AS containment, count(*) AS n_windows
FROM held WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license
"""


OP6_SQL = _sql()
