"""License scans by conditional compression.

Candidate blocks are the words around each cue word, as far as a template can reach; lines do not matter, overlapping blocks
are joined and long ones taken in overlapping windows, for templates of similar length at a time, the longest first. A block is
compressed by zstandard with each template as a raw dictionary; templates are ranked by the bytes they save. The words of template
and block are aligned around each run of equal words that is long enough for so few differences, within the template's length and
the allowed differences. Of the templates whose wording differs little enough, and in none of its telling words (names, versions,
conditions), and that save enough of their span, the one with the fewest differences wins. Its span is taken out and the rest of
the block is looked at again. ``alone_bytes`` and ``with_template_bytes`` are of the span.

Null and empty texts have no matches. Each input row gives one row, also null and repeated keys. Whole texts are read.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.text import per_process

#: Notices and texts of common licenses, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
                   "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
                   "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under "
                   "the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                         "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                     "without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                         "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                          "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                          "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
                     "BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
                     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
                  "by any means."),
]
#: Words of which one must be in a block, and words that tell licenses apart.
CUES = ["licen", "copyright", "warrant", "permission", "redistribut", "public domain", "cc by", "cc0"]
CUE_WORD = re.compile(r"licen|copyright|warrant|permission|redistribut|public$|cc$|cc0$")
TELLING = {"mit", "apache", "gnu", "lesser", "affero", "general", "mozilla", "mpl", "cc", "cc0", "by", "nc", "nd", "sa", "bsd", "neither"}
WORD = re.compile(r"\w+")
REPORT = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
                       T.StructField("alone_bytes", T.LongType()), T.StructField("with_template_bytes", T.LongType()),
                       T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("added", T.ArrayType(T.StringType()))])


class Scanner:
    def __init__(self, templates, level: int, share: float, differing: float):
        import zstandard as z

        compressor = lambda **kw: z.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **kw)
        self.templates = [(name, [w.lower() for w in WORD.findall(text)]) for name, text in templates]
        self.alone = compressor()
        self.given = [compressor(dict_data=z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for _, w in self.templates]
        self.own = [len(self.alone.compress(" ".join(w).encode())) for _, w in self.templates]
        self.share, self.differing = share, differing
        groups: dict[int, list[int]] = {}
        for i, (_, w) in enumerate(self.templates):
            groups.setdefault(len(w).bit_length(), []).append(i)
        #: Templates of similar length, the longest first, and how many words a match can have.
        self.groups = [(max(int(len(self.templates[i][1]) * (1 + differing)) for i in g), g) for _, g in sorted(groups.items(), reverse=True)]

    def sizes(self, words: list[str], group: list[int]) -> list[tuple[int, int, int]]:
        """Templates by the bytes they save: place, size alone, size with the template."""
        block = " ".join(words).encode()
        alone = len(self.alone.compress(block))
        sizes = [(i, alone, len(self.given[i].compress(block))) for i in group]
        return sorted(sizes, key=lambda x: (x[2], len(self.templates[x[0]][1]), x[0]))

    def best(self, words: list[str], group: list[int]) -> tuple | None:
        """The template with the fewest differences that saves enough of its own span; of equal ones, that which saves most of the window."""
        out, least = None, 2.0
        for i, *_ in self.sizes(words, group):
            if found := self.differences(self.templates[i][1], words):
                x, y, missing, added = found
                (_, alone, given), = self.sizes(words[x:y], [i])
                part = (len(missing) + len(added)) / len(self.templates[i][1])
                if alone - given >= self.share * min(self.own[i], alone) and part < least:
                    out, least = (self.templates[i][0], x, y, alone, given, missing, added), part
        return out

    def differences(self, template: list[str], words: list[str]):
        """Span of the block that the template is aligned to, and the words missing and added there; None if they are too many."""
        allowed = int(self.differing * len(template))
        # with so few differences, one of at most allowed + 1 runs of equal words has this length
        least = max(1, -(-(len(template) - allowed) // (allowed + 1)))
        places: dict[str, list[int]] = {}
        for j, w in enumerate(words):
            places.setdefault(w, []).append(j)
        runs, before = [], {}
        for i, w in enumerate([*template, None]):
            here = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
            runs += [(n, j + 1 - i) for j, n in before.items() if n >= least and j + 1 not in here]
            before = here
        tried = set()
        for _, start in sorted(runs, key=lambda r: (-r[0], r[1])):  # where the template would begin
            if start not in tried:
                tried.add(start)
                lo = max(0, start - allowed)
                if found := self.aligned(template, words[lo:start + len(template) + allowed]):
                    a, b, missing, added = found
                    return lo + a, lo + b, missing, added
        return None

    def aligned(self, template: list[str], words: list[str]):
        match = difflib.SequenceMatcher(None, template, words, autojunk=False)
        parts = [m for m in match.get_matching_blocks() if m.size]
        # a run at either end that is further off than it is long is not the template's
        main = max(range(len(parts)), key=lambda i: (parts[i].size, -i), default=0)
        lo, hi = main, main
        cost = lambda i: parts[i + 1].b - parts[i].b - parts[i].size  # noqa: E731  (words added after run i)
        gain = 0
        for i in range(main - 1, -1, -1):
            gain += parts[i].size - cost(i)
            if gain >= 0:
                lo, gain = i, 0
        gain = 0
        for i in range(main + 1, len(parts)):
            gain += parts[i].size - cost(i - 1)
            if gain >= 0:
                hi, gain = i, 0
        parts = parts[lo:hi + 1]
        if not parts:
            return None
        a, b = parts[0].b, parts[-1].b + parts[-1].size
        hit = {i for m in parts for i in range(m.a, m.a + m.size)}
        met = {j for m in parts for j in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(template) if i not in hit]
        added = [w for j, w in enumerate(words[a:b], a) if j not in met]
        telling = [w for w in missing + added if w in TELLING or any(c.isdigit() for c in w)]
        if telling or len(missing) + len(added) > self.differing * len(template):
            return None
        return a, b, missing, added

    def window(self, words: list[str], group: list[int]) -> Iterator[tuple]:
        """Matches ``(license, first word, last word, sizes, differences)`` in a window of words."""
        todo = [(0, len(words))]
        while todo:
            a, b = todo.pop()
            if not any(CUE_WORD.match(w) for w in words[a:b]):
                continue
            if found := self.best(words[a:b], group):
                name, x, y, *rest = found
                yield name, a + x, a + y, *rest
                todo += [(a, a + x), (a + y, b)]

    def scan(self, text: str) -> list[dict]:
        places = [w.span() for w in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        cues = [i for i, w in enumerate(words) if CUE_WORD.match(w)]
        free, out = [True] * len(words), {}
        for reach, group in self.groups:
            blocks: list[list[int]] = []
            for i in cues:
                if free[i]:
                    a, b = max(0, i - reach), min(len(words), i + reach + 1)
                    if blocks and a <= blocks[-1][1]:
                        blocks[-1][1] = b
                    else:
                        blocks.append([a, b])
            for lo, hi in blocks:
                for a in range(lo, max(lo + 1, hi - reach), reach):  # a match is whole in one window
                    b = min(hi, a + 2 * reach)
                    at = a
                    while at < b:
                        end = next((j for j in range(at, b) if free[j] != free[at]), b)
                        if free[at]:
                            for name, x, y, alone, given, missing, added in self.window(words[at:end], group):
                                x, y = at + x, at + y
                                if y == b < hi:
                                    continue  # it may be cut off here, and is whole in the next window
                                free[x:y] = [False] * (y - x)
                                out[places[x][0]] = {
                                    "license": name, "start": places[x][0], "stop": places[y - 1][1], "alone_bytes": alone,
                                    "with_template_bytes": given, "missing": missing, "added": added}
                        at = end
        return [out[k] for k in sorted(out)]


def licensed(docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = 9, share: float = 0.4, differing: float = 0.2,
             templates: Sequence[tuple[str, str]] = tuple(TEMPLATES)) -> DataFrame:
    """One row per document: ``key`` and ``matches``, each with license, span in characters, sizes alone and given the
    template, and the differing words. ``share`` is the part of the smaller of span and template that must be saved,
    ``differing`` the part of the template's words that may differ; ``templates`` are pairs of name and text, each with a cue word."""
    table = tuple((name, wording) for name, wording in templates)

    @F.arrow_udf(T.ArrayType(REPORT))
    def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        scanner = per_process(f"licenses {level} {share} {differing} {table}", lambda: Scanner(table, level, share, differing))
        kind = to_arrow_type(T.ArrayType(REPORT))
        for column in texts:
            yield pa.array([scanner.scan(x.as_py()) if x.is_valid else [] for x in column], kind)

    t = F.col(f"`{text}`")
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(F.lower(t), F.lit(c))
    return docs.select(F.col(f"`{key}`").alias(key), scanned(F.when(cue, t)).alias("matches"))
