"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Every line of a text, and every run of neighbouring lines that speak of licensing, is compared with license templates:
cosine of TF-IDF vectors over words and word pairs, computed over the shared terms only. Lines without any telling word
are skipped; telling words are chosen so that what remains of every template cannot reach the threshold. A statement
within a longer line or over several lines is found by its telling words: the words around each, as many as the template
has, are compared as well.

Overlapping windows of ``SPAN`` words go over the whole text and are compared with windows of whole license texts (the
files of ``license_texts``). Windows with fewer than ``SHARED`` of those texts' runs of four words are skipped. Neighbouring
windows that match are one block, named by the whole license that it resembles most, or as its best window if it is a
part only. A row takes the license of its best block: whole licenses come before statements and parts, and "All rights reserved."
decides only where nothing else is found.

Files that are license files by name or by content declare the license of their directory. Rows without a license of
their own get that of the nearest ancestor directory that has one: distinct directories are exploded to their ancestors,
joined with the declared ones, and the deepest wins; rows are then joined by directory.

Defined results: a NULL or empty text has no license and score 0; ties between licenses go to the smaller name, between
blocks to the earlier one; if files of one directory declare different licenses, the higher score wins, then the smaller
name; a NULL path has no directory and inherits nothing; equal rows are scanned as rows of their own; an empty table gives
no rows; columns of the caller are kept but the text and those that have the name of an output, and the working columns
avoid their names.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import pathlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, temp_name

THRESHOLD = 0.6

SPDX = tuple("0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Python-2.0 Unicode-DFS-2016 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.1".split())

#: Fixed texts: usual statements and opening paragraphs of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in SPDX for end in (("", "-only", "-or-later", "+") if "GPL-" in name else ("",))),
    ("Proprietary", "All rights reserved."),
)
#: Of the cosine at which words around a telling word count as the statement.
WITHIN = 0.8
#: Words in a window, words from one window of a text to the next, the same of a whole license, and shared runs of four words that make a window worth a look.
SPAN, STEP, STEP_WHOLE, SHARED = 120, 60, 30, 10


def whole_texts() -> tuple[tuple[str, str], ...]:
    """The whole licenses, by name. Those of AGPL, CC-BY and CC-BY-NC are derived from their nearest relatives."""
    return tuple((p.name.removesuffix(".txt"), p.read_text()) for p in sorted((pathlib.Path(__file__).parent / "license_texts").glob("*.txt")))


_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words too common to speak of licensing by themselves.
WEAK = frozenset("a an and any are as at be by can copy deal either except file files following for form forms free from have if in into is it its later may met name names neither nor not of on one option or or/and other person product products promote source that the this to use used was which will with without work you your program version v published terms under all public general".split())


def terms(words: list[str]) -> Counter:
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


class Index:
    """TF-IDF vectors of texts that are given as words."""

    def __init__(self, texts: list[tuple[str, list[str]]]):
        self.names = [n for n, _ in texts]
        bags = [terms(w) for _, w in texts]
        df = Counter(t for b in bags for t in b)
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
        self.rare = math.log(1 + len(bags)) + 1
        self.posting: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.vectors: list[dict[str, float]] = []
        for i, b in enumerate(bags):
            w = {t: n * self.idf[t] for t, n in b.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.vectors.append({t: x / norm for t, x in w.items()})
            for t, x in self.vectors[-1].items():
                self.posting[t].append((i, x))

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """The highest cosine, and its license."""
        score: dict[int, float] = defaultdict(float)
        norm = 0.0
        for t, n in terms(words).items():
            x = n * self.idf.get(t, self.rare)
            norm += x * x
            for i, y in self.posting.get(t, ()):
                score[i] += x * y
        if not score:
            return 0.0, None
        top, name = min((-s, self.names[i]) for i, s in score.items())
        return min(1.0, -top / math.sqrt(norm)), name


class Templates(Index):
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, whole: tuple[tuple[str, str], ...] | None = None):
        self.threshold = threshold
        self.made_of = (templates, threshold, whole_texts() if whole is None else whole)
        listed = [(n, _WORD.findall(t.lower())) for n, t in templates]
        super().__init__(listed)
        self.telling: set[str] = set()
        for (_, words), w in zip(listed, self.vectors):
            self.telling.update(t for t in words if t not in WEAK)
            while True:  # what only the other words can reach
                rest = math.sqrt(sum(x * x for t, x in w.items() if not self.telling.intersection(t.split())))
                if rest < threshold:
                    break
                self.telling.add(min((t for t in words if t not in self.telling), key=lambda t: (-len(t), t)))  # long words are rare in prose
        self.around: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
        for _, words in listed:
            for i, t in enumerate(words):
                if t in self.telling:
                    self.around[t].append((i, words))
        self.longest = max((len(w) for _, w in listed), default=0)
        texts = [(n, _WORD.findall(t.lower())) for n, t in self.made_of[2]]
        self.wholes = Index(texts)
        self.spans = Index([(n, w[a : a + SPAN]) for n, w in texts for a in starts(len(w), STEP_WHOLE)])
        self.fours = {x for _, w in texts for x in fours(w)}

    def __reduce__(self) -> tuple:
        return _known, self.made_of  # small on its way to the workers, and built once in each

    def whole(self, words: list[str]) -> list[tuple[int, float, int, int, str]]:
        """Blocks that look like whole licenses (rank 0) or parts of them (1): (rank, -cosine, first word, word after the last, license)."""
        if len(self.fours.intersection(fours(words))) < SHARED:
            return []
        near: list[tuple[int, int, float, str]] = []
        for a in starts(len(words), STEP):
            shared = [i for i, x in enumerate(fours(words[a : a + SPAN]), a) if x in self.fours]
            if len(shared) >= SHARED:
                s, name = self.spans.best(words[shared[0] : shared[-1] + 4])  # without other text at its ends
                if name is not None and s >= self.threshold:
                    near.append((a, a + SPAN, s, name))
        out = []
        while near:
            n = next((i for i in range(1, len(near)) if near[i][0] > near[i - 1][1]), len(near))
            block, near = near[:n], near[n:]
            a, b = max(0, block[0][0] - STEP), block[-1][1] + STEP  # the ends may lie in windows that hold more of other text
            shared = [i for i, x in enumerate(fours(words[a:b]), a) if x in self.fours]
            a, b = shared[0], shared[-1] + 4
            s, name = self.wholes.best(words[a:b])
            rank = int(name is None or s < self.threshold or b - a <= self.longest)
            if rank:
                s, name = max(((x[2], x[3]) for x in block), key=lambda x: x[0])
            out.append((rank, -s, a, b, name))
        return out

    def scan(self, text: str | None) -> tuple[str | None, float, int, float]:
        """License, cosine and first line of the best block, and the share of the text's words in licensing blocks."""
        lines = [_WORD.findall(x) for x in (text or "").lower().split("\n")]
        flat = [w for x in lines for w in x]
        run: list[str] = []
        found: list[tuple[int, float, int, str]] = []  # by rank: whole licenses; statements and parts; reservations of rights
        start = at = 0
        covered = bytearray(len(flat))
        tried: set[tuple[int, int]] = set()

        def look(words: list[str], line: int, least: float = self.threshold) -> bool:
            s, name = self.best(words)
            if name is not None and s >= least:
                found.append((2 if name == "Proprietary" else 1, -s, line, name))
                return True
            return False

        def look_around(first: int, words: list[str], line: int) -> None:
            for i, w in enumerate(words, first):
                for off, template in self.around.get(w, ()):
                    a, b = i - off, i - off + len(template)
                    if a >= 0 and b <= len(flat) and (a, b) not in tried and 10 * sum(x == y for x, y in zip(flat[a:b], template)) >= 6 * len(template):
                        tried.add((a, b))
                        if look(flat[a:b], line, WITHIN):
                            covered[a:b] = b"\1" * (b - a)

        for i, words in enumerate([*lines, []]):
            if words and not self.telling.isdisjoint(words):
                start = start if run else i
                run.extend(words)
                if look(words, i):
                    covered[at : at + len(words)] = b"\1" * len(words)
                else:
                    look_around(at, words, i)
            elif run:
                if i - start > 1:
                    look(run, start)
                run = []
            at += len(words)
        if blocks := self.whole(flat):
            ends = list(itertools.accumulate(map(len, lines)))
            for rank, s, a, b, name in blocks:
                found.append((rank, s, bisect.bisect_right(ends, a), name))
                covered[a:b] = b"\1" * (b - a)
        if not found:
            return None, 0.0, -1, 0.0
        _, s, line, name = min(found)
        return name, -s, line, sum(covered) / len(flat)


def fours(words: list[str]) -> Iterator[tuple[str, str, str, str]]:
    return zip(words, words[1:], words[2:], words[3:])


def starts(n: int, step: int) -> range:
    """Of windows of SPAN words that cover n words."""
    return range(0, max(1, n - SPAN + step), step)


@functools.cache
def _known(*made_of) -> Templates:
    return Templates(*made_of)


KIND = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("line", T.IntegerType()), T.StructField("share", T.DoubleType())])


def scan_column(text: Column, templates: Templates | None = None) -> Column:
    known = templates or Templates()

    @F.pandas_udf(KIND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([known.scan(t) for t in batch], columns=KIND.names)

    return scanned(text)


def parent(path: Column) -> Column:
    """The directory of a path; the root is ''."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def license_file_name(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike(r"(^|/)(licen[sc]e|copying|unlicense|notice)([-._][^/]*)?$"), F.lit(False))


def scan_licenses(files: DataFrame, text: str, path: str, file_share: float = 0.5) -> DataFrame:
    """The caller's columns but the text, with ``license``, ``score`` and ``line`` (the row's own), ``license_file``, ``effective``
    (own or inherited) and ``inherited_from`` (the directory).

    A row is a license file by its name, or if at least ``file_share`` of its words stand in licensing blocks.
    """
    hit, folder, up, near = temp_name(files, "hit", "folder", "up", "near")
    scanned = files.withColumns({hit: scan_column(F.col(text)), folder: parent(F.col(path))})
    own = scanned.withColumns({"license": F.col(f"{hit}.license"), "score": F.col(f"{hit}.score"), "line": F.col(f"{hit}.line")})
    own = own.withColumn("license_file", F.col("license").isNotNull() & (license_file_name(F.col(path)) | (F.col(f"{hit}.share") >= file_share)))
    own = cut(own.drop(hit, text))  # read three times below, scanned once
    declared = own.where("license_file").where(F.col(folder).isNotNull()).groupBy(F.col(folder).alias(up)).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).getField("license").alias("declared"))
    folders = own.select(folder).where(F.col(folder).isNotNull()).distinct()
    steps = F.split(F.col(folder), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("at")))
    # an absolute path has an empty first step, so its root is found twice
    chains = folders.select(folder, F.inline(above)).select(folder, "depth", F.col("at").alias(up))
    nearest = chains.join(declared, up).groupBy(folder).agg(F.max(F.struct("depth", F.col(up).alias("at"), "declared")).alias(near))
    joined = own.join(nearest, folder, "left")
    own_names = ("license", "score", "line", "license_file", "effective", "inherited_from")
    return joined.select(*[c for c in files.columns if c != text and c not in own_names], "license", "score", "line", "license_file", F.coalesce("license", f"{near}.declared").alias("effective"), F.when(F.col("license").isNull(), F.col(f"{near}.at")).alias("inherited_from"))
