"""License scans by wording and conditional compression.

A text is cut into blocks: paragraphs, and each of their lines where there are several. Blocks with a word that licence
wordings use are candidates. Each candidate is compressed with each template as zstandard raw dictionary, and templates
are ranked by how far they reduce its size. In that order, and without leaving any out, templates are confirmed: aligned
with the candidate word by word, where few of the template's words may be missing or put in between, none of them with a
digit or a name of a licence. The best alignment is a span, and what is left of the block on either side is searched
again, until nothing more is found. Each span comes with its template's size reduction and rank in the block.

An alignment with at most k odd words holds at least one of k + 1 parts of the wording unbroken, so only the surroundings
of such parts are aligned, and nothing is lost.

Defined results: null and empty texts hold no licence. Of templates that are equally good the one whose name sorts
first is taken. A span is reported once for each licence, and a span inside another of the same licence is left out.
Repeated rows are scanned each. Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pieces, table

#: Licence notices by SPDX name; a name may have several wordings.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Parts of words that make a block a candidate.
CUES = ("licens", "licence", "redistribut", "permission", "copyright", "unencumbered")
#: Words that must be there and may not be added, as they tell licences apart.
NAMES = frozenset("apache mit gnu lesser general public affero mozilla isc bsd eclipse cc by nc sa nd".split())
#: Largest share of a template's words that may differ.
DIFFERENCE = 0.1
#: Characters of a block that are looked at together; any wording is shorter than half of it.
WINDOW = 4000
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in WORD.finditer(text)]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.templates = sorted(templates)
        kind = dict(dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), **kind), **plain) for _, t in self.templates]
        self.words = [[w for w, _, _ in words(t)] for _, t in self.templates]
        self.odd = [int(DIFFERENCE * len(w)) for w in self.words]
        self.parts = [[(at, w[at:end]) for at, end in pairwise(len(w) * i // (k + 1) for i in range(k + 2))] for w, k in zip(self.words, self.odd, strict=True)]

    def blocks(self, text: str) -> Iterator[tuple[int, str]]:
        """Start and text of the candidates; long blocks come as windows that overlap by half."""
        cue = lambda t: any(c in t.lower() for c in CUES)
        for m in re.finditer(r"[^\n]+(?:\n[^\n]+)*", text) if cue(text) else ():
            if not cue(m[0]):
                continue
            lines = list(re.finditer(r"[^\n]+", m[0]))
            for at, block in [(m.start() + x.start(), x[0]) for x in lines] + [(m.start(), m[0])] * (len(lines) > 1):
                for i in range(0, max(1, len(block) - WINDOW // 2), WINDOW // 2):
                    if cue(part := block[i : i + WINDOW]):
                        yield at + i, part

    def reduction(self, block: str, i: int) -> float:
        """Share by which the template as dictionary reduces the block's compressed size."""
        raw = block.lower().encode()
        return 1 - len(self.given[i].compress(raw)) / len(self.alone.compress(raw))

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """Size reduction and number of each template, largest first."""
        return sorted(((self.reduction(block, i), i) for i in range(len(self.templates))), key=lambda r: (-r[0], r[1]))

    def near(self, found: list[str], i: int) -> list[tuple[int, int]]:
        """Ranges of words around the unbroken parts of the template's wording, merged."""
        joined = f" {' '.join(found)} "
        begin = [0, *accumulate(len(w) + 1 for w in found)]
        n, k, out = len(self.words[i]), self.odd[i], []
        for offset, part in self.parts[i]:
            piece = f" {' '.join(part)} "
            at = joined.find(piece)
            while at >= 0:
                first = bisect.bisect_left(begin, at) - offset
                out.append((max(0, first - k), min(len(found), first + n + k)))
                at = joined.find(piece, at + 1)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(out):
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return merged

    def aligned(self, found: list[str], i: int) -> tuple[int, int, int] | None:
        """Number of odd words, first word and end of the best alignment: fewest odd words, then longest, then first."""
        wanted, limit = self.words[i], self.odd[i]
        cost = lambda w: limit + 1 if w in NAMES or any(c.isdigit() for c in w) else 1
        skip = [cost(w) for w in wanted]
        before = [0, *accumulate(skip)]
        none = limit + 1, 0
        best = None
        last = [none] * (len(wanted) + 1)  # odd words and first word, by number of the template's words that are done
        for j, w in enumerate(found):
            now, extra = [none], cost(w)
            for p, t in enumerate(wanted):
                here = min((last[p + 1][0] + extra, last[p + 1][1]), (now[p][0] + skip[p], now[p][1]))
                if w == t:
                    match = min(last[p], (before[p], j))
                    here = min(here, match)
                    if (odd := match[0] + before[-1] - before[p + 1]) <= limit:
                        end = odd, match[1] - j, match[1], j + 1
                        best = end if best is None else min(best, end)
                now.append(here if here[0] <= limit else none)
            last = now
        return best and (best[0], best[2], best[3])

    def confirmed(self, block: str, i: int) -> list[tuple[int, int, int]]:
        """Start, end and number of differing words of each place where the block has the template's wording."""
        found = words(block)
        plain = [w for w, _, _ in found]
        out, left = [], [(0, len(found))]
        while left:
            a, b = left.pop()
            tried = [(odd, x - y, c + x, c + y) for c, d in ((a + c, a + d) for c, d in self.near(plain[a:b], i)) if (best := self.aligned(plain[c:d], i)) for odd, x, y in [best]]
            if tried:
                odd, _, first, last = min(tried)
                out.append((found[first][1], found[last - 1][2], odd))
                left += [(a, first), (last, b)]
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int, float, int]]:
        """Licence, start, end, differing words, size reduction and rank of each span, by start."""
        out: dict[tuple[str, int, int], tuple[int, int, float]] = {}
        for at, block in self.blocks(text):
            for rank, (reduction, i) in enumerate(self.ranked(block), 1):
                for first, last, odd in self.confirmed(block, i):
                    key, seen = (self.templates[i][0], at + first, at + last), (odd, rank, -reduction)
                    out[key] = min(out.get(key, seen), seen)
        spans = [(n, a, b, d, -r, k) for (n, a, b), (d, k, r) in out.items()]
        return sorted((s for s in spans if not any(o[0] == s[0] and o[1] <= s[1] and s[2] <= o[2] and o[1:3] != s[1:3] for o in spans)), key=lambda s: (s[1], s[2], s[0]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id and an array of spans (licence, start and end in code points, differing words, size reduction, rank)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("differences", pa.int64()), ("reduction", pa.float64()), ("rank", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for part in pieces(batch, "text"):
                spans = [[dict(zip((n for n, _ in fields), s, strict=True)) for s in scanner.scan(t or "")] for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(spans, pa.list_(pa.struct(fields)))], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<license:string,start:long,end:long,differences:long,reduction:double,rank:long>>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its spans, licences, and spans without a differing word."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_spans"),
        F.size(F.filter("found", lambda s: s["differences"] == 0)).cast("long").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"])), ",").alias("spans"),
    )
