"""License scans by conditional compression.

Words that licenses are told by (license, copyright, permission and so on) make candidate
blocks: windows of words, across line breaks, around them, at several widths for wordings of
different lengths. Each block is compressed alone and with each template of its width as
a raw zstandard dictionary. The templates that shorten a block are ranked by the bytes
they save, and in that order confirmed by the exact differences of wording at each place
of the block: a template's words must be there in order but for few, and none of its telling words (numbers
and names) missing or replaced. A place goes to the template that saves most there.
"""

from __future__ import annotations

import difflib
import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task

# The usual short wordings of public licenses, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Names that files give in a line of their own.
TAGS = tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES if name != "BSD"))
#: Every confirmed match holds one of these, so texts without any need no scan.
CUE = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|endorse|creative commons|unencumbered|mozilla"
#: The same for a word.
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "endorse", "creative", "unencumbered", "mozilla", "spdx")
#: Words that most wordings share; all others of a template must be met exactly.
COMMON = frozenset("a an and any by for from in is it its of or that the this to under with work licensed released license you may not be".split())
#: The share of a template's words that must be met.
MET = 0.85
#: Words of the longest templates whose blocks have one width.
WIDTHS = (16, 48)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Compressors of all templates."""

    def __init__(self, templates=TEMPLATES + TAGS):
        self.templates = templates
        self.words = [word_list(t) for _, t in templates]
        self.telling = [sorted(set(w) - COMMON) for w in self.words]
        #: Words that may stand between those of a template.
        self.slack = [int((1 - MET) * len(w) + 1) for w in self.words]
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        least, self.scales = 0, []
        for width in (*WIDTHS, max(map(len, self.words))):
            ks = [k for k, w in enumerate(self.words) if least < len(w) <= width]
            if ks:
                self.scales.append((max(len(self.words[k]) + self.slack[k] for k in ks), ks))
            least = width

    def gain(self, k: int, block: list[str]) -> int:
        """Bytes that a template saves."""
        raw = " ".join(block).encode("utf8", "replace")
        return len(self.alone.compress(raw)) - len(self.given[k].compress(raw))

    def ranked(self, ks: list[int], block: list[str]) -> list[tuple[int, int]]:
        """``bytes saved, template`` of those that shorten the block, the greatest saving first."""
        raw = " ".join(block).encode("utf8", "replace")
        alone = len(self.alone.compress(raw))
        saved = [(alone - len(self.given[k].compress(raw)), k) for k in ks]
        return sorted((x for x in saved if x[0] > 0), key=lambda x: (-x[0], x[1]))

    def blocks(self, words: list[str], reach: int) -> list[tuple[int, int]]:
        """``from, to``: windows in which every wording of at most ``reach`` words with one of the cues lies whole."""
        out, until = [], -1
        for j, w in enumerate(words):
            if j > until and w.startswith(CUES):
                until = j + reach
                out.append((max(0, j - reach), min(len(words), until + reach + 1)))
        return out

    def places(self, k: int, block: list[str]) -> list[tuple[int, int]]:
        """``from, to``: where in a block a template may be met: around its rarest telling word."""
        at = defaultdict(list)
        for j, w in enumerate(block):
            at[w].append(j)
        t = self.words[k]
        if not all(w in at for w in self.telling[k]):
            return []
        anchor = min(self.telling[k], key=lambda w: len(at[w]))
        first, last = t.index(anchor), len(t) - t[::-1].index(anchor)
        return sorted({(max(0, j - last + 1 - self.slack[k]), min(len(block), j - first + len(t) + self.slack[k])) for j in at[anchor]})

    def differences(self, k: int, block: list[str]) -> tuple[int, int, bool, int, int]:
        """Template words met in order, words put in between, whether all telling words are met, and the part of the block from the first to the last."""
        t = self.words[k]
        m = [x for x in difflib.SequenceMatcher(None, t, block, autojunk=False).get_matching_blocks() if x.size]
        met = sum(x.size for x in m)
        have = {i for x in m for i in range(x.a, x.a + x.size)}
        first, end = (m[0].b, m[-1].b + m[-1].size) if m else (0, 0)
        return met, end - first - met, all(i in have for i, w in enumerate(t) if w not in COMMON), first, end

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """``license, bytes saved, words that differ`` of the confirmed wordings, in order."""
        words = word_list(text)
        found: dict[tuple[int, int, int], tuple[int, int]] = {}
        for reach, ks in self.scales:
            for a, b in self.blocks(words, reach):
                for _, k in self.ranked(ks, words[a:b]):
                    for c, d in self.places(k, words[a:b]):
                        part, size = words[a + c : a + d], len(self.words[k])
                        met, between, telling, first, end = self.differences(k, part)
                        if telling and met >= MET * size and between <= (1 - MET) * size + 1:
                            saved = self.gain(k, part[first:end])
                            if saved > 0:
                                found[a + c + first, a + c + end, k] = saved, size - met + between
        # of confirmed templates that share words of the text, the one that saves most there counts
        taken: list[tuple[int, int, int, int, int]] = []
        for (first, end, k), (saved, wrong) in sorted(found.items(), key=lambda x: (-x[1][0], x[1][1], x[0])):
            if all(end <= a or b <= first for a, b, *_ in taken):
                taken.append((first, end, k, saved, wrong))
        return [(self.templates[k][0], saved, wrong) for _, _, k, saved, wrong in sorted(taken)]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_matches, licenses, evidence`` for each row: the confirmed licenses by
    name, and ``name:bytes saved:words that differ`` of each confirmed place in order.

    Null and empty texts have none. Rows keep a null or repeated doc_id, and repeated rows
    come out alike; a text of any length is scanned whole, one at a time; of templates that
    save as much at a place the one that differs least counts, then the first named. An
    empty table gives an empty result, and other columns don't matter.
    """
    by_task(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(CUE), F.col("text").cast("string")).alias("text"))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            got = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([",".join(sorted({x for x, _, _ in g})) for g in got], pa.string()), pa.array([",".join(f"{x}:{n}:{d}" for x, n, d in g) for g in got], pa.string())],
                ["doc_id", "n_matches", "licenses", "evidence"],
            )

    return docs.mapInArrow(run, "doc_id long, n_matches long, licenses string, evidence string")
