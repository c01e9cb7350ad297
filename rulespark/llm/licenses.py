"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Templates and texts are token sequences (lower-cased runs of letters and digits). Of the hashes of
``GRAM``-token runs each window of ``WINDOW`` keeps the least; the templates' kept hashes form an
inverted index. Hits of a text in the index give (template, diagonal) candidates. Edits that leave a
template's coverage at ``COVERAGE`` leave a number of its kept hashes in place, and candidates with
fewer hits within the band are passed over. The others are aligned within the band: matched tokens
count, tokens of the text in between cost as much, and numbers and modifiers (ShareAlike, Lesser ...)
may neither be missing nor be added. An alignment that covers enough of its template is reported with
the bytes it spans, unless a better one overlaps it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

GRAM = 3
WINDOW = 2
BAND = 8
COVERAGE = 0.8

#: Words that make another license of one.
MODIFIERS = ("sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "noderivs", "lesser", "library", "affero")

#: Public license statements.
STATEMENTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT/line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0/line": "Released under CC0 1.0 Universal.",
    "all-rights": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}
#: GNU licenses and their versions; Creative Commons elements, their names, and versions.
GNU = {"GPL": ("General Public License", ("1", "2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def templates() -> dict[str, str]:
    """The statements, and the forms in which GNU and Creative Commons licenses are named in every version."""
    out = dict(STATEMENTS)
    for short, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            out[f"{spdx}/line"] = f"This work is licensed under the GNU {name}, version {v}."
            out[spdx] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    out["LGPL-2.0/line"] = "This work is licensed under the GNU Library General Public License, version 2."
    for element, name in COMMONS.items():
        for v in COMMONS_VERSIONS:
            out[f"CC-{element}-{v}"] = f"Licensed under CC {element} {v}."
            out[f"CC-{element}-{v}/long"] = f"This work is licensed under a Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License."
    return out


TEMPLATES = templates()


def tokenized(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start bytes, end bytes, first token of each text). Bytes are those of the given text."""
    buf, offs = T.packed(column)
    low = T.lowered(buf)
    starts, ends, first = T.word_bounds(low, offs)
    return T.word_hashes(low, starts, ends), starts, ends, first


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the kept hashes: the rightmost least of each window; all of a shorter sequence's least."""
    n = len(grams)
    if n <= window:
        return np.array([int(np.flatnonzero(grams == grams.min())[-1])]) if n else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


#: Below any score: an alignment that lacks a token it must have, or holds one it must not.
DEAD = -1_000_000


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int, must: np.ndarray | None = None, foreign: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """(matched tokens, tokens of the text in between, first and last matched place) of the best alignment near a diagonal.

    Tokens match, or are skipped on either side; a skipped token of the text inside the alignment costs
    what a match gains. ``must`` marks template tokens that may not be skipped, ``foreign`` text tokens
    that may not. Places differ from the diagonal by ``band`` at most. Nothing matches if there is no
    such alignment.
    """
    m, n = len(template), len(text)
    if diagonal >= 0 and diagonal + m <= n and (text[diagonal : diagonal + m] == template).all():
        return m, 0, diagonal, diagonal + m - 1
    must = np.zeros(m, bool) if must is None else must
    low, high = max(0, diagonal - band), min(n, diagonal + m + band)
    part = text[low:high].tolist()
    bad = [False] * len(part) if foreign is None else np.isin(text[low:high], foreign).tolist()
    # (score, minus skipped text tokens, matched, first, last); an alignment that has not begun costs nothing
    free = int(must.argmax()) if must.any() else m  # an alignment begins no later than the first token it must have
    zero, dead = (0, 0, 0, -1, -1), (DEAD, 0, 0, -1, -1)
    before: dict[int, tuple] = {}
    for i, (token, needed) in enumerate(zip(template.tolist(), must.tolist(), strict=True)):
        row: dict[int, tuple] = {}
        for j in range(max(low, i + diagonal - band), min(high, i + diagonal + band + 1)):
            best = dead if needed else before.get(j, zero)
            if j - 1 in row:
                x = row[j - 1]
                if x[2]:
                    x = dead if bad[j - low] else (x[0] - 1, x[1] - 1, *x[2:])
                best = max(best, x)
            if token == part[j - low]:
                x = before.get(j - 1, zero)
                if x is not dead and (x[2] or i <= free):
                    best = max(best, (x[0] + 1, x[1], x[2] + 1, x[3] if x[2] else j, j))
            row[j] = best
        before = row
    best = max(before.values(), default=zero)
    return (best[2], -best[1], best[3], best[4]) if best[2] else (0, 0, -1, -1)


def best_apart(matches: list[tuple]) -> list[tuple]:
    """Of (minus coverage, minus matched, first, last, template) those that no better match overlaps, by place."""
    kept: list[tuple] = []
    for m in sorted(matches):
        i = bisect_left([k[2] for k in kept], m[2])
        if not (i and kept[i - 1][3] >= m[2]) and not (i < len(kept) and kept[i][2] <= m[3]):
            kept.insert(i, m)
    return kept


def _index(given: dict[str, str], gram: int, window: int):
    names = list(given)
    column = pa.array([given[n] for n in names], pa.string())
    hashes, starts, ends, first = tokenized(column)
    buf = T.lowered(T.packed(column)[0])
    words = [buf[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    must = np.array([w.isdigit() or w in MODIFIERS for w in words], bool)
    parts = [(hashes[a:b], must[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    posts = defaultdict(list)
    for t, (p, _) in enumerate(parts):
        g = T.grams(p, gram)
        for q in winnow(g, window).tolist():
            posts[int(g[q])].append((t, q))
    return names, parts, posts


def least_hits(tokens: int, gram: int, window: int, coverage: float) -> int:
    """Kept hashes that are left in place where no more than the share of tokens that coverage allows is edited.

    Of the runs of gram + window - 1 tokens each edit spoils that many at most, every other one keeps a
    hash, and a hash is kept by ``window`` of them at most.
    """
    run = gram + window - 1
    return max(1, math.ceil((tokens - run + 1 - run * math.floor((1 - coverage) * tokens + 1e-9)) / window))


#: Templates under so many tokens name a license: a number that is added in between makes it another one.
NAME_TOKENS = 24


def _scanner(given: dict[str, str], gram: int, window: int, band: int, coverage: float):
    names, parts, posts = _index(given, gram, window)
    lookup = T.Lookup(np.array(sorted(posts), dtype=T.U64))
    listed = [posts[h] for h in sorted(posts)]
    least = [least_hits(len(p), gram, window, coverage) for p, _ in parts]
    modifiers = tokenized(pa.array([" ".join(MODIFIERS)]))[0]

    def run(batches):
        for part in T.slices(batches):
            buf, offs = T.packed(part.column(1))
            hashes, starts, ends, first = tokenized(part.column(1))
            at, key = lookup.find(T.grams(hashes, gram))
            doc = np.searchsorted(first, at, side="right") - 1
            ok = at + gram <= first[1:][doc]
            seen = defaultdict(lambda: defaultdict(list))
            for d, p, j in zip(doc[ok].tolist(), at[ok].tolist(), key[ok].tolist(), strict=True):
                for t, q in listed[j]:
                    seen[d][t].append(p - int(first[d]) - q)
            rows = []
            for d in sorted(seen):
                a, b = int(first[d]), int(first[d + 1])
                words, matches = hashes[a:b], []
                numbers = None
                for t in sorted(seen[d]):
                    places, last, found = sorted(seen[d][t]), None, set()
                    template, must = parts[t]
                    for diagonal in places:
                        if last is not None and diagonal - last <= band // 2:
                            continue
                        if bisect_right(places, diagonal + band) - bisect_left(places, diagonal - band) < least[t]:
                            continue
                        last = diagonal
                        if numbers is None:
                            digit = (buf[starts[a:b]] >= 48) & (buf[starts[a:b]] < 58)
                            numbers = np.unique(words[digit])
                        foreign = np.concatenate([modifiers, numbers]) if len(template) < NAME_TOKENS else modifiers
                        matched, more, x, y = align(template, words, diagonal, band, must, foreign)
                        if matched < coverage * len(template) - 1e-9 or more > (1 - coverage) * len(template) + 1e-9 or (x, y) in found:
                            continue
                        # a version that goes on behind the match is another one, but for .0
                        after = a + y + 1
                        if must[-1] and after < b and buf[ends[after - 1] : starts[after]].tobytes() == b"." and 48 <= buf[starts[after]] < 58 and buf[starts[after] : ends[after]].tobytes() != b"0":
                            continue
                        found.add((x, y))
                        matches.append((-matched / len(template), -matched, x, y, t))
                for _, matched, x, y, t in best_apart(matches):
                    rows.append((d, names[t], -matched, len(parts[t][0]), int(starts[a + x] - offs[d]), int(ends[a + y] - offs[d])))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array([x / y for x, y in zip(c[2], c[3], strict=True)], pa.float64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64())],
                    names=["doc_id", "license", "matched_tokens", "template_tokens", "coverage", "start_byte", "end_byte"],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, matched_tokens, template_tokens, coverage, start_byte, end_byte), one row a match.

    ``end_byte`` is exclusive; bytes are UTF-8. Null and tokenless texts match nothing; null ids stay
    null. Texts are scanned whole, and every place that matches is reported. Repeated rows are scanned
    each. Extra columns are ignored; an empty table gives no rows. A place is found if it has a run of
    ``gram + window - 1`` tokens of the template unedited; templates with fewer than ``gram`` tokens are
    not found.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(_scanner(TEMPLATES if templates is None else templates, gram, window, band, coverage), "doc_id long, license string, matched_tokens int, template_tokens int, coverage double, start_byte long, end_byte long")
