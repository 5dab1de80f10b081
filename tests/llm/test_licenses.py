import math
import re
import textwrap
from collections import Counter

import pytest

from relayloom.llm.common import table
from relayloom.llm.licenses import TEMPLATES, Scanner, document_counts, inherit, license_scan, scan_files, words
from relayloom.llm.queries import op8_licenses

STATED = {
    r"Licensed under the Apache License, Version 2\.0\.": "Apache-2.0",
    r"Released under the MIT License\.": "MIT",
    r"This work is licensed under the GNU General Public License, version 3\.": "GPL-3.0",
    r"Licensed under CC BY-NC 4\.0\.": "CC-BY-NC-4.0",
    r"All rights reserved\.": "Proprietary",
}


def test_query_finds_what_is_stated_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in op8_licenses(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        stated = {name for pattern, name in STATED.items() if re.search(pattern, text)}
        assert (got[i].license in stated) if stated else got[i].license is None, (i, stated, got[i])
        if stated and len(stated) == 1:
            assert re.search(next(p for p, n in STATED.items() if n in stated), text[got[i].start : got[i].end])


def test_query_inherits_as_climbing_from_file_to_root_does(spark):
    rows = op8_licenses(spark, "/root/testdata/sf0.01").collect()
    above = lambda path: path.rpartition("/")[0]
    licensed = {}
    for r in rows:
        name = r.path.rpartition("/")[2].lower()
        if r.license and (r.share >= 0.5 or name.split(".")[0] in ("license", "licence", "copying", "copyright", "notice", "unlicense")):
            best = licensed.setdefault(above(r.path), (-r.score, r.path, r.license))
            licensed[above(r.path)] = min(best, (-r.score, r.path, r.license))
    assert licensed
    for r in rows:
        at = above(r.path)
        while at and at not in licensed:
            at = above(at)
        want = (licensed[at][2], at) if at in licensed else (None, None)
        assert (r.inherited_license, r.inherited_from) == want


def test_directories_with_very_many_files(spark, monkeypatch):
    """Dealt over keys or broadcast: the same."""
    from relayloom.llm import licenses

    rows = [(k, f"a/b/{k}", None, 0.0, 0.0) for k in range(500)] + [(500, "a/LICENSE", "MIT", 1.0, 1.0), (501, None, None, 0.0, 0.0), (501, None, None, 0.0, 0.0)]
    files = spark.createDataFrame(rows, "doc_id long, path string, license string, score double, share double").selectExpr("*", "1 as dir", "2 as depth", "'x' as inherited_from")
    both = []
    for most in (licenses.BROADCAST, -1):
        monkeypatch.setattr(licenses, "BROADCAST", most)
        both.append(sorted(map(str, inherit(files).collect())))
    assert both[0] == both[1] and len(both[0]) == 503 and sum("inherited_license='MIT', inherited_from='a'" in x for x in both[0]) == 501


def test_licences_above_programs():
    from relayloom.llm.license_texts import TEXTS

    scanner = Scanner(1000, {})
    for name, text in TEXTS.items():
        wrapped = textwrap.fill(text, 70)
        commented = "\n".join("# " + line for line in wrapped.splitlines())
        program = "import os\n\n\ndef run(path):\n    for entry in os.scandir(path):\n        print(entry.name, entry.stat().st_size)\n" * 20
        got = scanner.scan(commented + "\n\n" + program)
        assert got[0] == name, (name, got)
    for n in range(30):  # no window of so many sentences
        found = scanner.scan("Released under the MIT License.\n" + "This permission notice is granted.\n" * n + "All rights reserved.\n")
        assert found[0] == "MIT"


def test_cosine_equals_dense_vectors(spark, sf):
    docs = table(spark, sf, "documents")
    n, count = document_counts(docs)
    assert n == docs.count()
    has = Counter(w for r in docs.collect() for w in set(words(r.text)))
    assert count == {w: has[w] for w in count} and count["the"] == has["the"]
    scanner = Scanner(n, count)

    def cosine(a, b):
        a, b = Counter(words(a)), Counter(words(b))
        weight = lambda w: math.log((1 + n) / (1 + count.get(w, 0))) + 1 if w in scanner.weight else math.log(1 + n) + 1
        x, y = ({w: (1 + math.log(k)) * weight(w) for w, k in c.items()} for c in (a, b))
        return sum(x[w] * y.get(w, 0) for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    for text in ("This file is licensed under the Apache License, version 2.0 or later", "GNU license 3", "reserved words of all kinds"):
        score, name = scanner.closest(words(text))
        best = max((cosine(text, t), m) for m, ts in TEMPLATES.items() for t in ts)
        assert score == pytest.approx(best[0]) and name == best[1]


def test_long_passages_and_spdx():
    scanner = Scanner(1000, {})
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert scanner.scan("Some words here.\n" + t + "\nOther words")[0] == name
    assert scanner.scan("// SPDX-License-Identifier: MIT\nint x;")[0] == "MIT"
    assert scanner.scan("my driving license was renewed by the office in town")[0] is None


def test_nearest_directory(spark):
    rows = [
        (1, "LICENSE", "MIT", 0.9, 1.0),
        (2, "a/x.py", None, 0.0, 0.0),
        (3, "a/b/COPYING.txt", "GPL-3.0", 0.9, 0.2),
        (4, "a/b/c/d/y.py", None, 0.0, 0.0),
        (5, "a/b/c/z.py", "Apache-2.0", 0.9, 0.1),
        (6, "a/bb/z.py", None, 0.0, 0.0),
        (7, None, "MIT", 1.0, 1.0),
        (8, "a/b/license", "ISC", 0.8, 1.0),
        (9, "top.py", None, 0.0, 0.0),
    ]
    got = {r.doc_id: (r.inherited_license, r.inherited_from) for r in inherit(spark.createDataFrame(rows, "doc_id long, path string, license string, score double, share double")).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: ("GPL-3.0", "a/b"), 4: ("GPL-3.0", "a/b"), 5: ("GPL-3.0", "a/b"), 6: ("MIT", ""), 7: (None, None), 8: ("GPL-3.0", "a/b"), 9: ("MIT", "")}


def test_odd_rows(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    files = odd_docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).withColumn("license", F.lit("x"))
    assert license_scan(files).count() == odd_docs.count()
    assert scan_files(no_docs.withColumn("path", F.lit("a"))).count() == 0
    assert Scanner(1, {}).scan("my license " * 30_000)[0] is None
    assert Scanner(1, {}).scan("word. " * 30_000 + "\nReleased under the MIT License.\n" + "word. " * 30_000)[0] == "MIT"


def test_whole_licence_files_are_told_apart():
    from relayloom.llm.license_texts import COUNTS, TEXTS

    scanner = Scanner(1000, {})
    line = "Copyright (c) 2020, X. All rights reserved.\n\n"
    for name, text in TEXTS.items():
        for head in ("", line):
            assert scanner.scan(head + text.split("License. ", 1)[-1])[0] == name
    assert scanner.scan(line + "Released under the MIT License, see the file beside this.")[0] == "MIT"
    assert scanner.scan(line)[0] == "Proprietary"
    for name, counts in COUNTS.items():
        text = " ".join(" ".join([w] * int(n)) for w, n in (p.split(":") for p in counts.split()))
        assert scanner.scan(line + text)[0] == name
        assert scanner.whole(words("GNU AFFERO GENERAL PUBLIC LICENSE Version 3 " + text))[1] == ("AGPL-3.0" if name == "GPL-3.0" else name)
