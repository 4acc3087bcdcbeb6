"""Licence scans: text windows compared with licence templates by the Dice coefficient of word bigrams.

Text and templates are normalised alike: ASCII letters to lower case, all other ASCII but digits to spaces. A window of L
bigrams and a template of m share c (each counted as often as both hold it) and are alike by 2c / (L + m). For a limit t
that needs c >= t m / (2 - t) and L <= (2 - t) m / t, so texts with fewer of a template's bigrams than the first bound
are never compared with it, and windows longer than the second never made.

Licences share sentences, so windows of several templates may overlap. They are one statement, named by the template that
shares most bigrams with its window: the whole BSD-2-Clause text and not the sentence that all BSD licences begin with.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colonnade.llm import textops as T
from colonnade.llm.runtime import beside

LIMIT = 0.8

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AD = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement"
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
_GNU = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{} either version {} of the License"
_CC = "This work is licensed under a Creative Commons {} International License"

# Licence statements as they are commonly written in files and pages
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("0BSD", _ISC + "." + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_NAME + _BSD_END),
    ("BSD-4-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_AD),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("LGPL-2.0", _GNU.format("This library", ";", "Library General", ";", "2")),
    ("LGPL-2.1", _GNU.format("This library", ";", "Lesser General", ";", "2.1")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", _GNU.format("This library", ":", "Lesser General", ",", "3")),
    ("AGPL-3.0", _GNU.format("This program", ":", "Affero General", ",", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivatives 4.0")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike 4.0")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivatives 4.0")),
)

_PLAIN = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _c = chr(_b)
    _PLAIN[_b] = ord(_c.lower()) if _c.isalnum() else 32


def normal_words(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word of the normalised texts."""
    plain = T.Block(block.first, _PLAIN[block.data], block.borders)
    starts, ends, texts = T.spans(plain)
    return T.hashes(plain.data, starts, ends), texts


def bigrams(text: str) -> np.ndarray:
    block = next(T.blocks(pa.array([text], pa.large_string())))
    return T.windows(*normal_words(block), 2)[0]


def windows(places: np.ndarray, found: list, template: Counter, m: int, limit: float) -> list[tuple[int, float, int, int]]:
    """(shared, dice, first, last) of the best window from each place of a bigram that the template holds, where it reaches `limit`."""
    out = []
    longest = (2 - limit) * m / limit
    for i in range(len(places)):
        left, shared, best = dict(template), 0, (0, 0.0, 0, 0)
        for k in range(i, len(places)):
            size = int(places[k] - places[i]) + 1
            if size > longest:
                break
            if left.get(found[k], 0):
                left[found[k]] -= 1
                shared += 1
                dice = 2 * shared / (size + m)
                if dice > best[1]:
                    best = (shared, dice, int(places[i]), int(places[k]))
        if best[1] >= limit:
            out.append(best)
    return out


def statements(candidates: list[tuple]) -> list[tuple]:
    """Of windows (shared, dice, first, last, template) that overlap the one with most shared bigrams, then dice, then template given first."""
    starts, taken = [], []
    for c in sorted(candidates, key=lambda c: (-c[0], -c[1], c[4], c[2])):
        at = bisect_left(starts, c[2])
        if (at == 0 or taken[at - 1][3] < c[2]) and (at == len(starts) or starts[at] > c[3]):
            starts.insert(at, c[2])
            taken.insert(at, c)
    return taken


def scan(docs: DataFrame, templates=TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """Per row: doc_id, license (of the statement of highest dice, null if none reaches `limit`), dice, first_word, n_words
    (of that window, in normalised words from 0), licenses (names of all statements, sorted, joined by commas).

    Null and empty texts have none. Of equal statements the template given first wins, then the first. Rows are neither dropped nor
    combined; other columns are not read.
    """
    known = [(name, bigrams(text)) for name, text in templates]

    def start():
        sets = [(name, Counter(grams.tolist()), len(grams)) for name, grams in known if len(grams)]
        vocabulary = np.unique(np.concatenate([g for _, g in known])) if known else np.zeros(0, np.uint64)

        def work(column):
            rows = []
            for block in T.blocks(column):
                h, t = T.windows(*normal_words(block), 2)
                begin = np.searchsorted(t, np.arange(block.n + 1))
                at = np.searchsorted(vocabulary, h)
                hits = np.flatnonzero((at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == h)) if len(vocabulary) else np.zeros(0, np.int64)
                cut = np.searchsorted(hits, begin)
                for i in range(block.n):
                    rows.append(one(hits[cut[i]:cut[i + 1]] - begin[i], h[hits[cut[i]:cut[i + 1]]]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return [pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()), strict=True)]

        def one(places, found):
            candidates = []
            if len(places):
                values = found.tolist()
                seen = Counter(values)
                for number, (_, template, m) in enumerate(sets):
                    need = limit * m / (2 - limit) - 1e-9
                    if len(values) < need or sum(min(n, seen.get(g, 0)) for g, n in template.items()) < need:
                        continue
                    mine = [k for k, g in enumerate(values) if g in template]
                    candidates += [(*w, number) for w in windows(places[mine], [values[k] for k in mine], template, m, limit)]
            kept = statements(candidates)
            if not kept:
                return None, None, None, None, None
            _, dice, first, last, number = min(kept, key=lambda c: (-c[1], c[4], c[2]))
            return sets[number][0], dice, first, last - first + 2, ",".join(sorted({sets[c[4]][0] for c in kept}))

        return work

    return beside(docs.select("doc_id", "text"), [("license", "string"), ("dice", "double"), ("first_word", "long"), ("n_words", "long"), ("licenses", "string")], start).drop("text")
