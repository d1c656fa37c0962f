"""License notices by conditional compression: a block of text shrinks most under the dictionary of the template it was made from.

Texts are candidates by their words; templates of which a text has enough words are aligned with it, and the exact differences in wording
decide. The stretch found is compressed with the templates as raw zstandard dictionaries, and what they save ranks them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording of common license notices, by SPDX identifier; the longer ones are the grants themselves.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]
#: Words of which a candidate text has at least one; every template does.
CUE = r"(?i)licen[sc]|permission is|permission to|redistribut|public domain|\bspdx\b|free software"
_CUE = re.compile(CUE)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-+/][a-z0-9]+)*", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.\-+() \t]+)")
_DECLARED = {name.lower(): name for name, _ in TEMPLATES}
#: Identity of a license lies in these: a wording that has other ones is another license.
_TELLING = re.compile(r"\d|^(?:mit|apache|gnu|lesser|affero|bsd|isc|mozilla|mpl|cc|cc0|by|by-\S+|nc|nd|sa|attribution\S*|unencumbered)$")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@lru_cache(maxsize=1)
def _templates() -> list[tuple[str, str, list[str], zstandard.ZstdCompressor]]:
    # levels past 3 find matches of three bytes, which short notices need
    return [(name, text, words(text), zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(" ".join(words(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)) for name, text in TEMPLATES]


@lru_cache(maxsize=1)
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False)


def savings(block: str) -> list[tuple[float, int]]:
    """``(share of the compressed size that the template saves, number of the template)``, the best first, ties in the templates' order; letters' case and marks don't count."""
    data = " ".join(words(block)).encode()
    if not data:
        return []
    alone = len(_plain().compress(data))
    out = [((alone - len(t[3].compress(data))) / alone, k) for k, t in enumerate(_templates())]
    return sorted(out, key=lambda x: (-x[0], x[1]))


def alignments(template: list[str], text: list[str], most: int) -> list[tuple[int, int, int]]:
    """``(differing words, begin, end)`` of the stretches of ``text`` that ``template`` turns into with at most ``most`` words inserted, dropped
    or changed: the best stretch for each end, the least differing first."""
    number = {w: k for k, w in enumerate(dict.fromkeys(template))}
    own = np.fromiter((number.get(w, -1) for w in text), dtype=np.int64, count=len(text))
    # cost and begin in one number, so that the least cost with the first begin is the least number
    one, at = np.int64(1 << 32), np.arange(len(text) + 1, dtype=np.int64)
    costs, row = at * one, at
    for w in template:
        now = row + one
        np.minimum(now[1:], row[:-1] + (own != number[w]) * one, out=now[1:])
        row = np.minimum.accumulate(now - costs) + costs
    return sorted((int(v >> 32), int(v & 0xFFFFFFFF), int(j)) for j, v in enumerate(row.tolist()) if v >> 32 <= most) if (row >> 32).min() <= most else []


def differences(template: list[str], text: list[str]) -> tuple[int, int, int]:
    """Least number of words to insert, drop or change between ``template`` and a stretch of ``text``, and where that stretch begins and ends."""
    best = alignments(template, text, len(template))
    return min(best, key=lambda x: (x[0], x[2]))


def scan(text: str, most_different: float = 0.15) -> list[tuple[str, float | None, int, int, str]]:
    """``(license, saving, differing words, first line, text found)`` of each license found in ``text``, once a license, the best match of each.

    A template is aligned with the whole text wherever the text has enough of its words, so that neither the sentence or line around a notice nor
    where its lines break matters. The wording decides; what the template saves of the stretch found ranks equal wordings. A license
    that the text only declares, by an SPDX line, has no saving.
    """
    found: dict[str, tuple[str, float, int, int, str]] = {}
    if not _CUE.search(text):
        return []
    line_of = lambda at: text.count("\n", 0, at)
    places = [(m[0].lower(), m.start()) for m in _WORD.finditer(text)]
    own = [w for w, _ in places]
    there = Counter(own)
    for k, (name, _, wanted, _) in enumerate(_templates()):
        most = int(max(1, most_different * len(wanted)))
        needed = Counter(wanted)
        telling = {w: n for w, n in needed.items() if _TELLING.search(w)}
        # bounds, not guesses: a stretch that passes has all telling words, and all but ``most`` of the others
        if any(there[w] < n for w, n in telling.items()) or sum(min(n, there[w]) for w, n in needed.items()) < len(wanted) - most:
            continue
        for wrong, a, b in alignments(wanted, own, most):
            have = Counter(own[a:b])
            if all(have[w] >= n for w, n in telling.items()) and not any(_TELLING.search(w) and w not in needed for w in have):
                stretch = " ".join(own[a:b])
                saving = next(x for x, j in savings(stretch) if j == k)
                old = found.get(name)
                if old is None or (wrong, -saving) < (old[2], -old[1]):
                    found[name] = (name, round(saving, 6), wrong, line_of(places[a][1]), stretch)
                break
    for m in _SPDX.finditer(text):
        for name in declared(m[1]):
            found.setdefault(name, (name, None, 0, line_of(m.start()), m[0].strip()))
    return sorted(found.values(), key=lambda x: (x[3], x[0]))


def declared(expression: str) -> list[str]:
    """The licenses of the templates that an SPDX expression names, operators and ``-only`` or ``-or-later`` aside; other words are none."""
    parts = re.sub(r"[()]", " ", expression).split()
    names = [_DECLARED.get(re.sub(r"(?:-only|-or-later|\+)$", "", x.lower())) for x in parts]
    return [x for x in dict.fromkeys(names) if x]


def scan_licenses(docs: DataFrame, **how: float) -> DataFrame:
    """``(doc_id, license, saving, n_different, first_line, found)`` of every license of every row of ``docs(doc_id, text, ...)``.

    Whole texts are read. Rows without a license (null and empty texts too) give no row; repeated rows give their rows again. Other columns
    are ignored. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scan(t, **how)]
            if rows:
                kinds = (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "license", "saving", "n_different", "first_line", "found"])

    slim = docs.select("doc_id", "text").where(F.col("text").rlike(CUE))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, license string, saving double, n_different int, first_line int, found string")
