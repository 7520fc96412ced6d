"""License scans by patience alignment.

A template and a stretch of text are aligned on words that are unique in both: the
longest increasing subsequence of their positions anchors the alignment, and the gaps
between anchors are aligned the same way.  Coverage is the share of the template's
words that are matched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, row_slices, texts_of

#: Share of a template's words that must be matched.
MIN_COVERAGE = 0.8
#: A stretch of text that may hold a template is this much longer than it, plus SLACK words.
STRETCH = 1.25
SLACK = 4
#: Cells of an alignment table that is held at once; a larger gap is split in two first.
TABLE_CELLS = 1 << 20

#: Notices scanned for (public license texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version."),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version."),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "All rights reserved",
}


def bare(word: str) -> str:
    """Lower case, without punctuation around it (inner dots and hyphens stay)."""
    return re.sub(r"^[^0-9a-z]+|[^0-9a-z]+$", "", word.lower())


def words_of(text: str) -> list[str]:
    return [w for w in map(bare, re.findall(r"[^\x20\x09-\x0D]+", text)) if w]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = increasing(pairs)
        if anchors:
            out.extend(anchors)
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False))
        else:
            out.extend(common(a, b, a0, a1, b0, b1))
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first position) that increases in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(j)
            at.append(i)
        else:
            tops[k], at[k] = j, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _lcs_row(same: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences from the next word of one side on, by the start
    in the other; ``last``: the same from the word after it on."""
    cells = np.maximum(last[:-1], np.where(same, last[1:] + 1, 0))
    return np.append(np.maximum.accumulate(cells[::-1])[::-1], 0)


def common(a, b, a0, a1, b0, b1) -> list[tuple[int, int]]:
    """Longest common subsequence of two gaps of any size: a gap of more than ``TABLE_CELLS``
    cells is split where the halves' lengths add up to the most."""
    number: dict = {}
    x, y = [np.array([number.setdefault(w, len(number)) for w in part], dtype=np.int64) for part in (a[a0:a1], b[b0:b1])]
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n * m > TABLE_CELLS and n > 1:
            mid = (i0 + i1) // 2
            below = np.zeros(m + 1, dtype=np.int64)
            for i in range(i1 - 1, mid - 1, -1):
                below = _lcs_row(y[j0:j1] == x[i], below)
            above = np.zeros(m + 1, dtype=np.int64)
            for i in range(i0, mid):
                above = _lcs_row(y[j0:j1][::-1] == x[i], above)
            j = j0 + int(np.argmax(above[::-1] + below))
            todo += [(i0, mid, j0, j), (mid, i1, j, j1)]
            continue
        best = np.zeros((n + 1, m + 1), dtype=np.int64)
        for i in range(n - 1, -1, -1):
            best[i] = _lcs_row(y[j0:j1] == x[i0 + i], best[i + 1])
        i = j = 0
        while i < n and j < m:
            if x[i0 + i] == y[j0 + j]:
                out.append((a0 + i0 + i, b0 + j0 + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return sorted(out)


def find(text: list, template: list, min_coverage: float) -> list[tuple[int, int, int]]:
    """Places of a template: (first word, last word + 1, matched words), left to right,
    not overlapping.  A stretch starts at every template word whose following words
    hold enough of the template's words; only such stretches can reach the coverage."""
    need = max(1, int(np.ceil(min_coverage * len(template) - 1e-9)))
    span = int(len(template) * STRETCH) + SLACK
    wanted = Counter(template)
    hits = [i for i, w in enumerate(text) if w in wanted]
    out: list[tuple[int, int, int]] = []
    held: Counter = Counter()
    enough = stop = begin = 0
    for k, i in enumerate(hits):
        while stop < len(hits) and hits[stop] < i + span:
            w = text[hits[stop]]
            held[w] += 1
            enough += held[w] <= wanted[w]
            stop += 1
        if enough >= need and i >= begin:
            matched, base = patience(text[i:i + span], template), i
            if matched and matched[0][0]:
                # The same from the first matched word on, so the stretch holds the whole notice.
                again = patience(text[i + matched[0][0]:i + matched[0][0] + span], template)
                if len(again) >= len(matched):
                    base, matched = i + matched[0][0], again
            if len(matched) >= need:
                out.append((base + matched[0][0], base + matched[-1][0] + 1, len(matched)))
                begin = out[-1][1]
        w = text[i]
        enough -= held[w] <= wanted[w]
        held[w] -= 1
    return out


def licenses(text: list, templates: dict[str, list], min_coverage: float) -> list[dict]:
    """Licenses of one text.  Where places overlap, the one with more matched words stays
    (then higher coverage, then template order)."""
    found = []
    for order, (name, words) in enumerate(templates.items()):
        for a, b, n in find(text, words, min_coverage):
            found.append((-n, -n / len(words), order, a, b, name))
    kept: list[tuple] = []
    for hit in sorted(found):
        if all(hit[4] <= k[3] or hit[3] >= k[4] for k in kept):
            kept.append(hit)
    return [{"license": k[5], "coverage": -k[1], "matched": -k[0], "start": k[3], "stop": k[4]}
            for k in sorted(kept, key=lambda k: k[3])]


HIT = "array<struct<license: string, coverage: double, matched: long, start: long, stop: long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per document: doc_id, n_words and ``licenses``, the notices found in order
    with coverage, matched words and the span of words they cover.

    Words are ``[^\\x20\\x09-\\x0D]+`` in lower case without punctuation around them; words
    of punctuation only do not count.  Whole texts are read.  Null and empty texts have no
    words and no licenses; repeated rows are scanned one by one.  Templates without words
    are ignored.  An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < min_coverage <= 1:
        raise ValueError("min_coverage must be above 0 and at most 1")
    lists = {k: words_of(t) for k, t in (TEMPLATES if templates is None else templates).items()}
    lists = {k: w for k, w in lists.items() if w}
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in lists.values() for w in ws}))}
    coded = {k: [vocabulary[w] for w in ws] for k, ws in lists.items()}
    # Rows: templates, columns: vocabulary; how often a template holds a word.
    weight = np.array([np.bincount(c, minlength=len(vocabulary)) for c in coded.values()], dtype=np.int64)
    weight = weight.reshape(len(coded), len(vocabulary))
    need = np.array([np.ceil(min_coverage * len(c) - 1e-9) for c in coded.values()])
    names = list(coded)
    hit_type = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()),
                                   ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in row_slices(batches, "text"):
            words = Words(texts_of(batch, "text"), join=False)
            found: list[list] = [[] for _ in range(words.n)]
            n_words = np.zeros(words.n, dtype=np.int64)
            if len(words.flat):
                ids, distinct = words.encoded()
                lower = pc.replace_substring_regex(pc.ascii_lower(distinct), r"^[^0-9a-z]+|[^0-9a-z]+$", "")
                table = np.array([vocabulary.get(w, -1) if w else -2 for w in lower.to_pylist()], dtype=np.int64)
                code = table[ids]
                real = code != -2
                owner, code = words.text_of_word[real], code[real]
                n_words = np.bincount(owner, minlength=words.n).astype(np.int64)
                first = np.concatenate(([0], np.cumsum(n_words)))
                # A template can only reach its coverage in a text that holds enough of its words.
                known = np.flatnonzero(code >= 0)
                seen = np.zeros((words.n, len(vocabulary)), dtype=bool)
                seen[owner[known], code[known]] = True
                possible = seen.astype(np.int64) @ weight.T >= need
                for i in np.flatnonzero(possible.any(axis=1)):
                    own = {names[t]: coded[names[t]] for t in np.flatnonzero(possible[i])}
                    found[i] = licenses(code[first[i]:first[i + 1]].tolist(), own, min_coverage)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(found, hit_type)],
                                             names=["doc_id", "n_words", "licenses"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, licenses {HIT}")
