"""License notices in texts: MinHash bands over windows, then exact containment.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased; shingles
are five words.  Templates are put in length classes.  For each class, windows
of the text overlap so that any run of as many words as a template of the class
lies whole within one of them.  Each window has a MinHash value for each band;
a window that agrees with a template in one band (looked up in the band's table, so that
templates cost nothing a window) is a candidate, and is kept if it holds at least 80 % of the template's shingles, exactly.

With one value a band, a window of similarity s is found with probability
1 - (1 - s) ** bands.  :func:`bands_for` picks the bands of each class from the
least similarity that a window with 80 % of a template can have, so that the
probability is at least 1 - 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ragged import mix64, row_slices
from tessera.llm.wordhash import ALNUM, HASH_BYTES, Sequences, hash_words

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6

BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")

#: Public texts and notices as their licences or their stewards give them (fixed values).  Notices of one family differ in a
#: few words, so a text may hold 80 % of several; its own has the largest containment.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT line": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-2.0-only notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "version 2 as published by the Free Software Foundation."),
    "LGPL-2.1 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0 waiver": "has waived all copyright and related or neighboring rights to",
    "CC0-1.0 line": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    "CC-BY-4.0 short line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 short line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 full line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. " + BSD_DISCLAIMER),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. " + BSD_DISCLAIMER),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
}


@dataclass
class LengthClass:
    """Templates of ``least`` to ``most`` words; windows of ``width`` words begin every ``step`` words."""

    least: int
    most: int
    names: list[str]
    shingles: list[np.ndarray]
    step: int
    width: int
    bands: int
    #: For each band the templates' values, ascending, with the template of each.
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: For each band which low bits some template's value has.
    filters: list[np.ndarray] = field(default_factory=list)


def _template_shingles(text: str) -> tuple[int, np.ndarray]:
    hashes = hash_words(pa.array([text], pa.string()), ALNUM).hashes
    n = len(hashes)
    if n < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    at = np.arange(n - SHINGLE + 1)
    return n, np.unique(Sequences(hashes).of(at, at + SHINGLE))


def bands_for(shingles: int, window: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands that find a window of ``window`` shingles holding the given part of ``shingles``, but for ``miss``."""
    common = math.ceil(containment * shingles - 1e-9)
    least = common / (shingles + window - common)
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def length_classes(templates: dict[str, str], containment: float = CONTAINMENT, miss: float = MISS) -> list[LengthClass]:
    sized = sorted(((*_template_shingles(text), name) for name, text in templates.items()), key=lambda x: (x[0], x[2]))
    out: list[LengthClass] = []
    for n, shingles, name in sized:
        if out and n <= out[-1].least * 5 // 4:
            out[-1].most = n
            out[-1].names.append(name)
            out[-1].shingles.append(shingles)
        else:
            out.append(LengthClass(n, n, [name], [shingles], 0, 0, 0))
    for c in out:
        c.step = max(1, c.least // 4)
        c.width = c.most + c.step - 1
        window = c.width - SHINGLE + 1
        c.bands = max(bands_for(len(s), window, containment, miss) for s in c.shingles)
        for band in range(c.bands):
            values = np.array([_band_hash(s, band).min() for s in c.shingles], np.uint64)
            order = np.argsort(values, kind="stable")
            c.tables.append((values[order], order))
            low = np.zeros(1 << 16, bool)
            low[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
            c.filters.append(low)
    return out


def _band_hash(shingles: np.ndarray, band: int) -> np.ndarray:
    return mix64(shingles ^ np.uint64((0x9E3779B97F4A7C15 * (band + 1)) % (1 << 64)))


def _window_minima(values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least value of values[start : start + size] for each window."""
    ends = np.minimum(starts + size, len(values))
    pairs = np.empty(2 * len(starts), np.int64)
    pairs[0::2], pairs[1::2] = starts, ends
    return np.minimum.reduceat(np.append(values, np.uint64(2**64 - 1)), pairs)[0::2]


def _scan(classes: list[LengthClass], containment: float):
    def run(batches):
        for batch in row_slices(batches, "text", HASH_BYTES):
            words = hash_words(batch.column("text"), ALNUM)
            if len(words.hashes) < SHINGLE:
                continue
            at = np.arange(len(words.hashes) - SHINGLE + 1)
            grams = Sequences(words.hashes).of(at, at + SHINGLE)
            count = np.maximum(words.offsets[1:] - words.offsets[:-1] - SHINGLE + 1, 0)  # shingles of each text
            found = []
            hashed: dict[int, np.ndarray] = {}
            for c in classes:
                span = c.width - SHINGLE + 1
                # windows of each text: every step, and one that ends with the text
                number = np.where(count > 0, -(-np.maximum(count - span, 0) // c.step) + 1, 0)
                text = np.repeat(np.arange(len(count)), number)
                index = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
                start = words.offsets[:-1][text] + index * c.step
                size = np.minimum(span, words.offsets[:-1][text] + count[text] - start)
                hits = [np.zeros(0, np.int64)]
                for band in range(c.bands):
                    if band not in hashed:
                        hashed[band] = _band_hash(grams, band)
                    low = _window_minima(hashed[band], start, size)
                    # few windows have the low bits of a template's value; those are looked up
                    some = np.flatnonzero(c.filters[band][(low & np.uint64(0xFFFF)).astype(np.int64)])
                    values, which = c.tables[band]
                    first, last = np.searchsorted(values, low[some]), np.searchsorted(values, low[some], "right")
                    n = last - first
                    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hits.append(which[at] * len(text) + np.repeat(some, n))
                for t, w in zip(*(x.tolist() for x in divmod(np.unique(np.concatenate(hits)), max(len(text), 1)))):
                    here, shingles = grams[start[w]:start[w] + size[w]], c.shingles[t]
                    held = np.intersect1d(here, shingles, return_indices=True)
                    if len(held[0]) >= containment * len(shingles) - 1e-9:
                        place = int(start[w] - words.offsets[text[w]] + held[1].min())
                        found.append((int(text[w]), c.names[t], place, len(held[0]) / len(shingles)))
            if found:
                text, name, place, part = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text)), pa.array(name, pa.string()), pa.array(place, pa.int64()), pa.array(part, pa.float64())],
                    ["doc_id", "license", "first_word", "containment"])

    return run


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                 containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """``doc_id, license, n_places, first_word, containment`` for each document and template found in it.

    ``n_places`` are the different words (numbered as letter-digit runs) at which
    a match begins, ``first_word`` the first of them, ``containment`` the largest
    part of the template's shingles in one window.  Null and empty texts and those
    without a match are not in the result; rows that repeat an id are taken as
    one document; null ids form one group.
    """
    classes = length_classes(TEMPLATES if templates is None else templates, containment, miss)
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = named.mapInArrow(_scan(classes, containment), "doc_id long, license string, first_word long, containment double")
    places = found.groupBy("doc_id", "license", "first_word").agg(F.max("containment").alias("containment"))
    return places.groupBy("doc_id", "license").agg(
        F.count("*").alias("n_places"), F.min("first_word").alias("first_word"), F.max("containment").alias("containment"))
