"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Sentences that speak of licensing, anywhere in a text, are candidates, and so are runs of
them. Each is a sparse vector over words, weighted by term frequency and by how few of
all documents have the word, and goes to the template with the highest cosine, if that is
at least `LEAST`. Only template words need a document count, so the counts are bounded by the
templates; a word outside them weighs as one that no document has.

A text that as a whole is close to a whole licence text has that licence. Of passages, the highest cosine counts,
then the longer; a bare "All rights reserved.", which stands beside many a licence, counts only if nothing else does.

A file whose text is mostly such a passage, or is named like a licence file, licenses its
directory. Every directory is expanded to its ancestors (a row for each level of the path), joined with
the licensed directories, and takes the deepest; files then join their directory.
Files are never paired with each other. What was found, without texts, is written once; directories with a licence are broadcast while
there are few, else the files of a directory are dealt over `SALT` keys, so that one with very many files is no single task.

Defined cases: null texts have no licence; null paths are in no directory and inherit
nothing; of several licences in one directory the highest score counts, then the smallest
path; equal scores go to the first template by name; repeated rows each get a row; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import checkpoint_dir, chunks, small_batches
from relayloom.llm.license_texts import COUNTS, TEXTS

LEAST = 0.55
#: Least cosine of a whole text to a whole licence.
LEAST_WHOLE = 0.85
BARE = "All rights reserved."
#: Licensed directories that are broadcast at most, and keys for the files of a directory beyond that.
BROADCAST, SALT = 1_000_000, 64
#: A file is a licence file if this share of its words is in the passage.
MOSTLY = 0.5

# Notices by which texts state a licence, under its SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Parts of words, lower case, one of which every candidate has.
TRIGGERS = ("licen", "copyright", "spdx", "rights reserved", "public domain", "permission", "redistribut", "free software", "cc by", "creative commons")
TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"[^\n]+?(?:[.;!?](?=\s)|(?=\n)|\Z)")
_FILE = r"(?i)^(licen[sc]e|copying|copyright|notice|unlicense)([._-].*)?$"


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


VOCABULARY = frozenset(w for texts in TEMPLATES.values() for t in texts for w in words(t))
#: Words of a passage at most, unless one sentence has more: a quarter more than the longest template.
LONGEST = 5 * max(len(words(t)) for texts in TEMPLATES.values() for t in texts) // 4
#: Words in which a statement of a licence may go on.
RUN_WORDS = VOCABULARY.union(*(words(t) for t in TEXTS.values()))


def document_counts(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that have each template word; counted map-side, a row a word and task."""
    out = files.sparkSession.createDataFrame([], "word string, n long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for part in chunks(batches):
            for text in part.column("text").to_pylist():
                count[""] += 1
                count.update(VOCABULARY.intersection(words(text or "")))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=out.names)

    got = {r.word: r.n for r in files.select("text").mapInArrow(run, out).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


class Scanner:
    def __init__(self, documents: int, count: dict[str, int]):
        self.weight = {w: math.log((1 + documents) / (1 + count.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = math.log(1 + documents) + 1
        self.names, self.index, self.bare = [], defaultdict(list), set()
        for name in sorted(TEMPLATES):
            for text in TEMPLATES[name]:
                vector, norm = self.vector(words(text))
                for w, x in vector.items():
                    self.index[w].append((len(self.names), x / norm))
                if text == BARE:
                    self.bare.add(len(self.names))
                self.names.append(name)
        bags = {n: Counter(words(t)) for n, t in TEXTS.items()} | {n: Counter({w: int(k) for w, k in (p.split(":") for p in t.split())}) for n, t in COUNTS.items()}
        self.wholes = {name: self.vector(bags[name]) for name in sorted(bags)}

    def vector(self, tokens: list[str] | Counter[str]) -> tuple[dict[str, float], float]:
        made = {w: (1 + math.log(n)) * self.weight.get(w, self.other) for w, n in Counter(tokens).items()}
        return made, math.sqrt(sum(x * x for x in made.values()))

    def whole(self, tokens: list[str]) -> tuple[float, str]:
        """Highest cosine of a whole text to a whole licence, and that. AGPL-3.0 is GPL-3.0 but for its heading and a section,
        so the heading tells."""
        vector, norm = self.vector(tokens)
        score, name = max(((round(sum(x * v[w] for w, x in vector.items() if w in v) / (norm * n), 9), k) for k, (v, n) in self.wholes.items()), key=lambda p: p[0], default=(0.0, ""))
        return score, "AGPL-3.0" if name == "GPL-3.0" and "affero" in tokens[:40] else name

    def closest(self, tokens: list[str]) -> tuple[float, str]:
        """Highest cosine, and the licence of that template."""
        score, k = self._closest(tokens)
        return score, "" if k < 0 else self.names[k]

    def _closest(self, tokens: list[str]) -> tuple[float, int]:
        vector, norm = self.vector(tokens)
        dot: dict[int, float] = defaultdict(float)
        for w, x in vector.items():
            for k, y in self.index.get(w, ()):
                dot[k] += x * y
        best = max(dot.items(), key=lambda p: (round(p[1] / norm, 9), -p[0]), default=None)
        return (0.0, -1) if best is None else (round(best[1] / norm, 9), best[0])

    def scan(self, text: str) -> tuple[str | None, float, int, int, float]:
        """Licence, cosine, start, end (code points) and share of the text's words of the best passage."""
        low = text.lower()
        none = (None, 0.0, 0, 0, 0.0)
        if not any(t in low for t in TRIGGERS):
            return none
        all_words = words(low)
        score, name = self.whole(all_words)
        if score >= LEAST_WHOLE:
            return name, score, 0, len(text), 1.0
        best, least, known = None, (), {}
        for run in self._runs(text):
            # A run as a whole may be a licence: one in a comment above a program, say.
            if sum(len(x[2]) for x in run) > LONGEST:
                score, name = self.whole([w for x in run for w in x[2]])
                if score >= LEAST_WHOLE and (True, 1.0, 1 << 30) > least:  # before any passage of it
                    best, least = (name, score, run[0][0], run[-1][1], sum(len(x[2]) for x in run)), (True, 1.0, 1 << 30)
            for last in range(len(run)):
                tokens: list[str] = []
                for first in range(last, -1, -1):
                    tokens = run[first][2] + tokens
                    if len(tokens) > LONGEST and first < last:
                        break
                    key = tuple(tokens)
                    if key not in known:  # lines repeat
                        known[key] = self._closest(tokens)
                    score, k = known[key]
                    rank = (k not in self.bare, score, len(tokens))
                    if score >= LEAST and (best is None or rank > least):
                        best, least = (self.names[k], score, run[first][0], run[last][1], len(tokens)), rank
        return none if best is None else (*best[:4], best[4] / max(len(all_words), 1))

    @staticmethod
    def _runs(text: str) -> Iterator[list[tuple[int, int, list[str]]]]:
        """Runs of sentences that speak of licensing, or go on in words of the templates: start, end and words of each."""
        run: list[tuple[int, int, list[str]]] = []
        for m in _SENTENCE.finditer(text):
            own, lower = words(m[0]), m[0].lower()
            if any(t in lower for t in TRIGGERS) or (run and own and sum(w in RUN_WORDS for w in own) >= 0.8 * len(own)):
                run.append((m.start(), m.end(), own))
            elif run and own:
                yield run
                run = []
        if run:
            yield run


def scan_files(files: DataFrame) -> DataFrame:
    """doc_id, path, license, score, start, end and share (of the words) of rows (doc_id, path, text)."""
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    scanner = Scanner(*document_counts(rows))
    out = files.sparkSession.createDataFrame([], "doc_id long, path string, license string, score double, start int, end int, share double").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
        for part in chunks(batches):
            found = [scanner.scan(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], names=out.names)

    return rows.mapInArrow(run, out)


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned with inherited_license and inherited_from: of the nearest directory, at or above the file's, with a licence file."""
    checkpoint_dir(scanned.sparkSession)
    kept = [c for c in scanned.columns if c not in ("inherited_license", "inherited_from")]
    files = scanned.select(*kept).withColumn("__dir", F.regexp_replace("path", "/?[^/]*$", "")).checkpoint()
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(_FILE)
    proof = files.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (named | (F.col("share") >= MOSTLY)))
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("best")
    licensed = proof.groupBy("__dir").agg(best).select(F.col("__dir").alias("__from"), F.col("best.license").alias("inherited_license"))
    parts = F.split("__dir", "/")
    above = F.when(F.col("__dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("from")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from")))
    )
    levels = files.where(F.col("__dir").isNotNull()).select("__dir").distinct().select("__dir", F.explode(above).alias("a")).select("__dir", F.col("a.depth").alias("__depth"), F.col("a.from").alias("__from"))
    deepest = F.max(F.struct(F.col("__depth").alias("depth"), F.col("__from").alias("from"), F.col("inherited_license").alias("license"))).alias("n")
    nearest = levels.join(licensed, "__from").groupBy("__dir").agg(deepest).checkpoint()
    found = [F.col("n.license").alias("inherited_license"), F.col("n.from").alias("inherited_from")]
    if nearest.count() <= BROADCAST:
        return files.join(F.broadcast(nearest), "__dir", "left").select(*kept, *found)
    dealt = files.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALT)))
    copies = nearest.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return dealt.join(copies, ["__dir", "__salt"], "left").select(*kept, *found)


def license_scan(files: DataFrame) -> DataFrame:
    """Each file's own licence, and that of its nearest licensed directory."""
    small_batches(files.sparkSession)
    return inherit(scan_files(files))
